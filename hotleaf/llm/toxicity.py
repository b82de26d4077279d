"""Toxicity by compression distance (operator 9).

Two zstandard dictionaries: one is trained on windows of ordinary text; one on the stretches of toxic text that tell it from
ordinary text, row by row (beginnings of words which many toxic rows and hardly any ordinary ones have; whole windows of toxic
text are mostly prose, and a dictionary of them finds fewer toxic rows; the README has the figures).  A text is cut into
windows of eight words.  Each window is compressed
twice: with the ordinary dictionary, and with the same preceded by the toxic one, so that the number of bytes saved is what
toxic text explains and ordinary text doesn't.  A stretch that both dictionaries know goes before each
window, as a text that hardly shrinks would be stored as it is, and one after it, long enough to be a match in any case, so that
literals and offsets around the window cost the same both times.  Windows that save anything are looked at again word
by word.  How often savings reach one, two and three bytes, and how many words
confirm them, are turned into a probability by logistic regression.

Training reads a bounded sample of labelled rows: the ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` rows of either label with the
least hash of their id, of those whose crc32(id as text) mod 5 is not 0.  Two thirds of them train the dictionaries (near-copies
count once), one third calibrates.  Scoring covers every window of every text.

Null, empty and wordless texts have no windows and get the calibrated score of no evidence.  Without any labelled
rows of one kind all scores are the share of toxic rows (0 if there are no rows).  Labels that repeat for an id are averaged; of texts
that repeat for an id training takes the least.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_TOXIC, SAMPLE_ORDINARY = 2_500, 5_000
#: The ordinary dictionary is trained on every k-th window of the sampled ordinary rows, so that about so many are read.
DICTIONARY_WINDOWS = 60_000
WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 8 << 10, 4 << 10
#: Bytes known to both dictionaries before and after what is compressed.
BEFORE, AFTER = 48, 20
STEM = 4
#: A stem is in this share of toxic rows at least, in this many rows, and so many times likelier there than elsewhere.
SHARE, ROWS, LIKELIER = 0.03, 8, 20
FEATURES = 10
_STEPS = np.array([1, 2, 3])
_PUNCTUATION = b".,;:!?\"'()[]"


def windows(raw: bytes, n: int = WORDS) -> list[bytes]:
    words = raw.lower().split()
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=5, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0

    def scorer(self):
        """features(raw): savings of a text's windows and words."""
        if not self.toxic:
            return lambda raw: np.zeros(FEATURES)
        with_, without = (_compressor(x).compress for x in (self.toxic + self.ordinary, self.ordinary))
        before, after = self.ordinary[-BEFORE:], self.ordinary[-AFTER:]
        cache: dict[bytes, int] = {}

        def saving(part: bytes) -> int:
            text = before + part + after
            return len(without(text)) - len(with_(text))

        def word_saving(word: bytes) -> int:
            if word not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[word] = saving(b" " + word + b" ")
            return cache[word]

        def features(raw: bytes) -> np.ndarray:
            n = np.zeros(6)
            parts = windows(raw)
            for w in parts:
                saved = saving(w)
                if saved >= 1:
                    n[:3] += saved >= _STEPS
                    for word in w.split():
                        n[3:] += word_saving(word) >= _STEPS
            x = np.log1p(n)
            return np.concatenate([x, n[[0, 3]] > 1, x[[0, 3]] / np.log(len(parts) + 2)])

        return features

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


# ---------------------------------------------------------------- training
def _row_counts(texts: list[bytes]) -> tuple[Counter, int]:
    """In how many texts each word is; texts with the same least word hash are near-copies and count once."""
    seen, counts = set(), Counter()
    for raw in texts:
        words = {w.strip(_PUNCTUATION) for w in raw.lower().split()}
        least = min(map(zlib.crc32, words), default=0)
        if least not in seen:
            seen.add(least)
            counts.update(words)
    return counts, len(seen)


def _beginnings(counts: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in counts.items():
        for size in range(STEM, len(word) + 1):
            out[word[:size]] += n
    return out


def toxic_stems(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Beginnings of words that tell toxic rows from others, each as long as nearly all its words share it; rarest first."""
    counts, n_toxic = _row_counts(toxic)
    others, n_others = _row_counts(ordinary)
    counts, others = _beginnings(counts), _beginnings(others)
    least = max(ROWS, SHARE * n_toxic)
    found = [s for s, n in counts.items() if n >= least and n / n_toxic >= LIKELIER * (others[s] + 0.3) / max(1, n_others)]
    stems: list[bytes] = []
    longer: dict[bytes, bytes] = {}
    for s in sorted(found, key=lambda s: (-counts[s], s)):
        if len(s) > STEM and counts[s] > counts.get(longer.get(s[:-1], b""), 0):
            longer[s[:-1]] = s
    for s in sorted(found, key=lambda s: (len(s), s)):
        if not any(s.startswith(x) or x.startswith(s) for x in stems):
            while s in longer and counts[longer[s]] >= 0.9 * counts[s]:
                s = longer[s]
            stems.append(s)
    return sorted(set(stems), key=lambda s: (counts[s], s))


def toxic_stretches(raw: bytes, stems: list[bytes]) -> bytes:
    """The beginnings of a text's words that are stems, in order."""
    either = tuple(stems)
    words = [w.lstrip(_PUNCTUATION) for w in raw.lower().split()]
    found = [max((s for s in stems if w.startswith(s)), key=len) for w in words if w.startswith(either)]
    return b" " + b" ".join(found) + b" " if found else b""


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """The model of labelled texts, in the order of their sampling."""
    part = [(raw, y) for k, (raw, y) in enumerate(rows) if k % 3]
    rest = [(raw, y) for k, (raw, y) in enumerate(rows) if k % 3 == 0]
    toxic, ordinary = [[raw for raw, y in part if y == label] for label in (1, 0)]
    share = float(np.mean([y for _, y in rows])) if rows else 0.0
    model = Model(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not toxic or not ordinary:
        return model
    samples = [w for raw in ordinary for w in windows(raw, 12)]
    step = max(1, len(samples) // DICTIONARY_WINDOWS)
    model.ordinary = _dictionary(samples[::step], ORDINARY_BYTES)
    stems = toxic_stems(toxic, ordinary)
    stretches = [s for s in (toxic_stretches(raw, stems) for raw in toxic) if s]
    model.toxic = _dictionary(stretches, TOXIC_BYTES) if stretches else b""
    if model.toxic and rest:
        features = model.scorer()
        model.weights, model.bias = _logistic(np.array([features(raw) for raw, _ in rest]), np.array([y for _, y in rest], float))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(fold != 0)
    marked = marked.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    order = F.xxhash64("id")
    chosen = [marked.where(F.col("y") == y).select("id", "y", order.alias("h")).orderBy("h", "id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    sample = spark.createDataFrame(chosen[0].union(chosen[1]).collect(), "id long, y int, h long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # one text an id, so that what comes to the driver is bounded by the sample
    rows = texts.join(F.broadcast(sample), "id").groupBy("h", "id", "y").agg(F.min("text").alias("text")).orderBy("h", "id").select("text", "y").toArrow()
    return fit([((t or "").encode(), y) for t, y in zip(rows.column("text").to_pylist(), rows.column("y").to_pylist(), strict=True)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_windows, n_hits): probability of toxicity, windows, and windows with savings of three bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        features = model.scorer()
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            x = np.array([features(raw) for raw in raws]).reshape(-1, FEATURES)
            sizes = [-(-len(raw.split()) // WORDS) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x)), pa.array(sizes, pa.int64()), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], ["doc_id", "score", "n_windows", "n_hits"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_windows long, n_hits long")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "n_hits")
