"""Operator 4 for a similarity of 0.8, as the pipeline's near_dedup takes it: SimHash, positional bytes, count filter, exact sets.

At a Jaccard similarity of 0.8 two SimHash fingerprints differ in 15 % of their bits and a byte is the same in
27 % of positions, so 64 bits don't tell such a pair from others.  Here a fingerprint has WIDE bytes, and is posted under
disjoint triples of its positional bytes, in ROUNDS random deals.  A posting carries two more bytes of its deal: members of a
list that differ from every other one there in over BESIDE bits met by chance, and leave the list in its bucket.  Such a pair at 0.8
passes in 92 % of its lists, each with other bytes, other pairs in 4 %.  Candidates share a list, and at least SHARED positional bytes.

Nodes are distinct texts (by a 64-bit hash); exact copies are one node.  No list is cut or sampled.  First each member of a
list is compared with the least one; what these links join is one component.  Lists of three or more whose members are still in several
components are then searched whole: members without enough bytes in common with one of another component leave, every pair of
the others that are in different components is compared, and one link per joined component leaves the task.  All links are
decided by the sets of shingles (64-bit hashes of five words), not by the fingerprints.

Words are cut and lower-cased as in operator 4.  A text of fewer than five words has one shingle, all its words; null,
empty and wordless texts are equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.exchange import mix, pack, unpack
from hotleaf.llm.graph import components
from hotleaf.llm.shared import settled, small

SHINGLE = 5
WIDE, ROUNDS, SHARED = 256, 13, 24
#: Bits in which two members of a list may differ in the bytes beside their posting.
BESIDE = 4
_SEED = 42
_RANDOM = np.random.default_rng(_SEED)
_FACTORS = _RANDOM.integers(1, 1 << 63, WIDE // 8, np.uint64) * np.uint64(2) + np.uint64(1)
#: The positions of each posting.
POSITIONS = np.concatenate([_RANDOM.permutation(WIDE)[: WIDE // 3 * 3].reshape(-1, 3) for _ in range(ROUNDS)])
#: The positions of the bytes beside it, which another posting of the deal has.
_BESIDE_AT = np.roll(POSITIONS.reshape(ROUNDS, -1, 3), -1, 1).reshape(-1, 3)
_STEP = 1 << 9
#: Postings have 35 bits, and a bucket about so many of them; so many fingerprints are posted at once.
_BITS, _BUCKET, _SLICE = 35, 2 << 20, 1 << 11
#: Members of lists up to this length are compared one by one, of others by their distinct bytes, if these are no more than _MANY.
_SHORT, _MANY = 64, 1 << 11
_SPREAD = 0x2545F4915


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = raw.lower().split()
    grams = [b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, _SEED) for g in grams]), ">u8").astype(np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE bytes: a bit is 1 if set in over half of the shingles."""
    count = np.zeros(WIDE * 8, np.int64)
    for at in range(0, len(hashes), _STEP):
        count += np.unpackbits(mix(hashes[at : at + _STEP, None] * _FACTORS).view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(2 * count > len(hashes))


def postings(marks: np.ndarray) -> np.ndarray:
    """The postings of each fingerprint (row), spread over _BITS bits."""
    a, b, c = (marks[:, POSITIONS[:, k]].astype(np.uint64) for k in range(3))
    value = np.arange(len(POSITIONS), dtype=np.uint64) << np.uint64(24) | a << np.uint64(16) | b << np.uint64(8) | c
    return value * np.uint64(_SPREAD) & np.uint64((1 << _BITS) - 1)


def alike(common, n, m):
    """Whether sets of n and m shingles with so many in common have Jaccard similarity 0.8 or more."""
    return 9 * common >= 4 * (n + m)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents and the node of each, ``__key``."""
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _signatures(batches):
    for batch in batches:
        found = [shingles((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array([fingerprint(x).tobytes() for x in found], pa.binary())], ["key", "n", "mark"])


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE)


def beside(marks: np.ndarray) -> np.ndarray:
    """Two bytes for each posting of each fingerprint (row)."""
    return marks[:, _BESIDE_AT[:, 0]].astype(np.uint16) << np.uint16(8) | marks[:, _BESIDE_AT[:, 1]]


def _posted(n_buckets: int):
    """Postings of each bucket, in slices of fingerprints with consecutive numbers."""
    limits = np.array([-(-(b << _BITS) // n_buckets) for b in range(n_buckets + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            breaks = np.flatnonzero(np.diff(ids) != 1) + 1
            cuts = np.unique(np.concatenate([np.arange(0, len(ids), _SLICE), breaks, [len(ids)]]))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                marks = _rows(batch.column(1).slice(a, z - a))
                values, others = postings(marks).ravel(), beside(marks).ravel()
                order = np.argsort(values)
                values, others, member = values[order], others[order], (order // len(POSITIONS)).astype(np.uint16)
                edges = np.searchsorted(values, limits)
                made = [(b, pack(values[x:y], member[x:y], ids[a : a + 1]), others[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "body", "others"])

    return run


def meeting(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each posting (sorted by value) has one of the same value that differs in BESIDE bits or fewer beside it."""
    keep = np.zeros(len(values), bool)
    at = np.flatnonzero(values[1:] == values[:-1])
    for step in range(1, _SHORT):
        close = at[np.bitwise_count(others[at] ^ others[at + step]) <= BESIDE]
        keep[close] = keep[close + step] = True
        at = at[at + step + 1 < len(values)]
        at = at[values[at + step + 1] == values[at]]
    for value in np.unique(values[at]):
        x, y = np.searchsorted(values, value), np.searchsorted(values, value, "right")
        found, which, n = np.unique(others[x:y], return_inverse=True, return_counts=True)
        # so many distinct bytes all have some that are close
        near = n > 1 if len(found) <= _MANY else np.ones(len(found), bool)
        for k in np.flatnonzero(~near).tolist():
            near[k] = np.count_nonzero(np.bitwise_count(found ^ found[k]) <= BESIDE) > 1
        keep[x:y] = near[which]
    return keep


def _lists(_, table):
    """The posting lists of a bucket, of members that meet others not only by chance."""
    parts = []
    for blob, other in zip(table.column("body").to_pylist(), table.column("others").to_pylist(), strict=True):
        value, member, first = unpack(blob)
        parts.append((value, first + member, np.frombuffer(other, np.uint16)))
    values, ids, others = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values = values[order]
    same = values[1:] == values[:-1]
    several = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    values, order = values[several], order[several]
    keep = meeting(values, others[order])
    return pa.table({"value": pa.array(values[keep].astype(np.int64)), "id": pa.array(ids[order[keep]], pa.int64())})


def _counted(batches):
    for batch in batches:
        keep = (_rows(batch.column(2)) == _rows(batch.column(3))).sum(1) >= SHARED
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles((x or "").encode()).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["key", "grams"])


def _verified(batches):
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
        keep = [bool(alike(len(np.intersect1d(x, y, True)), len(x), len(y))) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def joined(keys: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different components of one list: each such pair is compared, until they are joined."""
    own, root = np.unique(roots, return_inverse=True)
    sizes = np.array([len(x) for x in sets], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets)
    out = []
    largest = np.bincount(root).argmax()
    for i in np.flatnonzero(root != largest).tolist():
        others = root != root[i]
        if not others.any():
            continue
        at = np.searchsorted(sets[i], flat)
        at[at == len(sets[i])] = 0
        common = np.add.reduceat(sets[i][at] == flat, edges, dtype=np.int64)
        for j in np.flatnonzero(others & alike(common, sizes, sizes[i])).tolist():
            if root[j] != root[i]:
                out.append((keys[i], keys[j]))
                root[root == root[j]] = root[i]
    return out


def partnered(roots: list[int], marks: list[bytes]) -> np.ndarray:
    """Members of a list that share SHARED positional bytes with one of another component."""
    root, rows = np.array(roots), np.frombuffer(b"".join(marks), np.uint8).reshape(-1, WIDE)
    keep = np.zeros(len(root), bool)
    names, which = np.unique(root, return_inverse=True)
    for i in np.flatnonzero(which != np.bincount(which).argmax()).tolist():
        found = ((rows == rows[i]).sum(1) >= SHARED) & (root != root[i])
        keep |= found
        keep[i] |= found.any()
    return keep


def _by_list(batches, close, width: int):
    """close(value, columns) of each list; rows come sorted by their first column."""
    open_value, held = None, tuple([] for _ in range(width))
    for batch in batches:
        for value, *row in zip(*(batch.column(k).to_pylist() for k in range(width + 1)), strict=True):
            if value != open_value:
                yield from close(open_value, held)
                open_value, held = value, tuple([] for _ in range(width))
            for column, x in zip(held, row, strict=True):
                column.append(x)
    yield from close(open_value, held)


def _narrowed(batches):
    def close(value, held):
        keys, roots, marks = held
        at = np.flatnonzero(partnered(roots, marks)) if len(keys) > 1 else []
        return [pa.RecordBatch.from_arrays([pa.array([f[k] for k in at], pa.int64()) for f in ([value] * len(keys), keys, roots)], ["value", "key", "root"])] if len(at) else []

    yield from _by_list(batches, close, 3)


def _searched(batches):
    def close(_, held):
        keys, roots, grams = held
        found = joined(keys, roots, [np.frombuffer(x, np.uint64) for x in grams]) if len(keys) > 1 else []
        return [pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (max, min)], ["u", "v"])] if found else []

    yield from _by_list(batches, close, 3)


def near_copies(rows: DataFrame) -> DataFrame:
    """(u, v) for each node u of ``keyed`` rows that isn't the least of its component, v being the least."""
    texts = rows.select(F.col("__key").alias("key"), F.col("text").cast("string").alias("text"))
    numbered = settled(texts.mapInArrow(_signatures, "key long, n long, mark binary").dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()))
    marks = numbered.drop("id")
    n_buckets = max(1, math.ceil(marks.count() * len(POSITIONS) / _BUCKET))
    lists = numbered.select("id", "mark").mapInArrow(_posted(n_buckets), "bucket int, body binary, others binary").groupBy("bucket").applyInArrow(_lists, "value long, id long")
    shared = settled(lists.join(numbered.select("id", "key"), "id").select("value", "key"))
    heads = shared.groupBy("value").agg(F.min("key").alias("v"))
    pairs = shared.join(heads, "value").where("key <> v").select(F.col("key").alias("u"), "v").distinct()
    named = lambda frame, name: frame.select(*[F.col(c).alias(name if c == "key" else f"{name}_{c}") for c in frame.columns])
    near = pairs.join(named(marks, "u"), "u").join(named(marks, "v"), "v").where("9 * least(u_n, v_n) >= 4 * (u_n + v_n)")
    near = settled(near.select("u", "v", "u_mark", "v_mark").mapInArrow(_counted, "u long, v long"))

    def sets(members: DataFrame) -> DataFrame:
        return texts.join(small(members.distinct()), "key", "left_semi").dropDuplicates(["key"]).mapInArrow(_sets, "key long, grams binary")

    grams = settled(sets(near.select(F.col("u").alias("key")).union(near.select("v"))))
    wide = near.join(named(grams, "u"), "u").join(named(grams, "v"), "v").select("u", "v", "u_grams", "v_grams")
    links = settled(wide.mapInArrow(_verified, "u long, v long"))
    roots = components(links)

    marked = shared.join(roots.select(F.col("u").alias("key"), "v"), "key", "left").select("value", "key", F.coalesce("v", "key").alias("root"))
    split = marked.groupBy("value").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("members")).where("a <> b AND members > 2").select("value")
    open_ = marked.join(split, "value").join(marks, "key").select("value", "key", "root", "mark")
    left = settled(open_.repartition("value").sortWithinPartitions("value").mapInArrow(_narrowed, "value long, key long, root long"))
    whole = left.join(sets(left.select("key")), "key").select("value", "key", "root", "grams")
    more = settled(whole.repartition("value").sortWithinPartitions("value").mapInArrow(_searched, "u long, v long").distinct())
    return components(links.union(more))
