"""SimHash near-duplicates over a byte-position inverted index with count filtering (operator 4).

A fingerprint has eight bytes.  Two fingerprints that differ in at most three bits differ in at most three bytes, so
they share at least five positional bytes, and three of those lie in the same half.  The index therefore posts each
distinct fingerprint under the eight triples of positional bytes within its halves (24 bits each): every pair that
can link meets in a list, and a list has about N / 2**24 chance members.  Within a list the shared positional
bytes of a pair are tallied; pairs with five or more are kept and verified by the number of differing bits.

Equal fingerprints are one entry, however many documents have them.  A list isn't turned into pairs: from one
member the search spreads over those not yet reached, and the list gives one link per member it joins.  So a list
of n near-copies costs about n comparisons a link found and n - 1 rows, and no link between different texts is lost.
Components of the links are found by alternating stars.

Null, empty and wordless texts have fingerprint zero, linked like any other; ids may repeat (rows with one id are
nodes by their fingerprint); null ids take part, and count last in the choice of a component's id.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.graph import components
from hotleaf.llm.shared import settled

_SEED = 42
_ROWS = 1 << 15


def fingerprint(raw: bytes, shingle: int = 3) -> bytes:
    """64 bits, most significant first: bit set if set in over half of the shingles' XXH64."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return bytes(8)
    text = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_digest(text, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    count, total, pairs = np.zeros(64, np.int64), n - shingle + 1, zip(starts, stops, strict=True)
    digest = xxhash.xxh64_digest
    for _ in range(0, total, _ROWS):
        bits = np.unpackbits(np.frombuffer(b"".join([digest(text[a:b], _SEED) for a, b in islice(pairs, _ROWS)]), np.uint8))
        count += bits.reshape(-1, 64).sum(0, dtype=np.uint16 if _ROWS < 1 << 16 else np.int64)
    return np.packbits(count * 2 > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            out = b"".join(fingerprint((x or "").encode(), shingle) for x in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


#: For each posting the bytes it covers: the four positions of a half but one.
POSTINGS = [sum(0xFF << 8 * p for p in range(4 * half, 4 * half + 4) if p != left_out) for half in (0, 1) for left_out in range(4 * half, 4 * half + 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(list_: np.ndarray, most: int) -> tuple[list, list]:
    """One link per joined member of a posting list of distinct fingerprints, to the least of those it reaches there."""
    left, members, roots = list_.copy(), [], []
    while len(left) > 1:
        queue, reached, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            differ = left ^ queue.pop()
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = shared >= 8 - most
            near[near] = np.bitwise_count(differ[near]) <= most
            if near.any():
                found = left[near]
                queue.extend(found)
                reached.extend(found)
                left = left[~near]
        if len(reached) > 1:
            all_ = np.array(reached, np.uint64).view(np.int64)
            least = all_.min()
            members.append(all_[all_ != least])
            roots.append(np.full(len(all_) - 1, least))
    return members, roots


def _search(most: int):
    def run(batches):
        open_key, open_parts = None, []

        def close() -> list:
            list_ = np.concatenate(open_parts) if open_parts else np.empty(0, np.uint64)
            members, roots = _links(list_, most) if len(list_) > 1 else ([], [])
            return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(roots))], ["u", "v"])] if members else []

        for batch in batches:
            posting, value, fp = (np.asarray(batch.column(k)) for k in range(3))
            if not len(fp):
                continue
            edge = np.flatnonzero((posting[1:] != posting[:-1]) | (value[1:] != value[:-1])) + 1
            edge = np.concatenate([[0], edge, [len(fp)]])
            fp = fp.astype(np.int64).view(np.uint64)
            single = np.diff(edge) == 1
            last = len(edge) - 2
            members, roots = [], []
            for k in np.flatnonzero(~single | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                a, b = edge[k], edge[k + 1]
                key = int(posting[a]), int(value[a])
                if k == 0 or k == last:
                    if key != open_key:
                        yield from close()
                        open_key, open_parts = key, []
                    open_parts.append(fp[a:b])
                else:
                    m, r = _links(fp[a:b], most)
                    members += m
                    roots += r
            if members:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(roots))], ["u", "v"])
        yield from close()

    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_linked): documents grouped by links of at most ``most`` differing bits.

    ``most`` is at most three, as the postings are made for that.  n_linked is the number of distinct fingerprints of
    the component.
    """
    if not 0 <= most <= 3:
        raise ValueError("most must be 0 to 3")
    marked = settled(fingerprints(docs, id_col, text_col, shingle))
    kinds = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    postings = kinds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("posting"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"), "fp") for k, m in enumerate(POSTINGS)])).alias("p")).select("p.*")
    lists = postings.repartition("posting", "value").sortWithinPartitions("posting", "value")
    links = lists.mapInArrow(_search(most), "u long, v long").distinct()
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    roots = components(links)
    named = kinds.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("v", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n_linked"))
    known = settled(named.join(ids, "root").select("fp", "component_id", "n_linked"))
    out = marked.join(known, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", "fingerprint", "component_id")
