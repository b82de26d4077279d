"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 10).

Training counts the hashed 1- to 3-grams of all training texts per language; a task returns one row per language it
met, and these sums are all that travels.  The matrix of log probabilities has a fixed number of rows (hash values) and a
column per language, goes to every task, and texts are scored in numpy: gather the rows of a text's n-grams
and add them up.

The prediction is ``und`` with score 0 if a text is null, has no letter, or nothing was learned.  Otherwise the score is
the posterior of the predicted language, tempered by the square root of the number of n-grams.  Ties go to the
language first in order of code points.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 16
GRAMS = (1, 2, 3)
_STEP = 1 << 19


@cache
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x33480)])


def _batches(text: pa.Array):
    """Stretches of lower-cased texts as code points: (first row, code points, edges)."""
    lowered = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    sizes = np.asarray(pc.utf8_length(lowered)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _STEP, "right")) - 1)
        joined = "".join(lowered[at:to].to_pylist())
        yield at, np.frombuffer(joined.encode("utf-32-le"), np.uint32), edges[at : to + 1] - edges[at]
        at = to


def _grams(points: np.ndarray, edges: np.ndarray):
    """Hashes of the n-grams for each n, SIZE where an n-gram leaves its text."""
    end = np.repeat(edges[1:], np.diff(edges))
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            slot = (h & np.uint32(SIZE - 1)).astype(np.int64)
            slot[np.arange(n, len(points) + 1) > end[: len(slot)]] = SIZE
            yield slot


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs, codes = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        for at, points, edges in _batches(batch.column(0)):
            own = codes[at : at + len(edges) - 1]
            of = np.repeat(own, np.diff(edges)) * (SIZE + 1)
            sums = np.zeros(len(langs) * (SIZE + 1), np.int64)
            for slot in _grams(points, edges):
                sums += np.bincount(of[: len(slot)] + slot, minlength=len(sums))
            for k in np.unique(own):
                lang = str(langs[k])
                totals[lang] = totals.get(lang, 0) + sums.reshape(len(langs), -1)[k, :SIZE]
                docs[lang] = docs.get(lang, 0) + int((own == k).sum())
    if totals:
        yield pa.RecordBatch.from_pydict({"lang": list(totals), "docs": pa.array([docs[x] for x in totals], pa.int64()), "counts": [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in totals.values()]})


def _sum(key, table):
    counts = sum(np.frombuffer(zstandard.decompress(x), "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"lang": [key[0].as_py()], "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "counts": [zstandard.compress(counts.tobytes(), 1)]})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their (SIZE + 1) x languages matrix of log probabilities; the last row is the log prior."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string"))
    kind = "lang string, docs long, counts binary"
    found = sorted(rows.mapInArrow(_count, kind).groupBy("lang").applyInArrow(_sum, kind).collect(), key=lambda r: r["lang"])
    if not found:
        return [], np.zeros((SIZE + 1, 0), np.float32)
    counts = np.stack([np.frombuffer(zstandard.decompress(r["counts"]), "<i8") for r in found], 1).astype(float) + 0.5
    prior = np.array([r["docs"] for r in found], float)
    return [r["lang"] for r in found], np.vstack([np.log(counts / counts.sum(0)), np.log(prior / prior.sum())]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score)."""
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches):
        langs, matrix = shared.value
        table = matrix.copy()
        table[SIZE] = 0
        for batch in batches:
            pred, score = [], []
            for _, points, edges in _batches(batch.column(1)):
                n = len(edges) - 1
                sums, grams, letter = np.zeros((n, len(langs))), np.zeros(n), np.zeros(n, bool)
                some = np.flatnonzero(np.diff(edges))
                if len(some) and langs:
                    for slot in _grams(points, edges):
                        begin = edges[some]
                        live = begin < len(slot)
                        sums[some[live]] += np.add.reduceat(table[slot], begin[live])
                        grams[some[live]] += np.add.reduceat(slot < SIZE, begin[live])
                    known = letters()
                    letter[some] = np.logical_or.reduceat(known[np.minimum(points, len(known) - 1)], edges[some])
                if langs:
                    sums += matrix[SIZE]
                    best = sums.argmax(1)
                    chance = 1 / np.exp((sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(grams, 1))[:, None]).sum(1)
                pred += [langs[best[k]] if letter[k] else "und" for k in range(n)]
                score += [float(chance[k]) if letter[k] else 0.0 for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(id_col: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % n


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
