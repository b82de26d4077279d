"""Chunked key exchange: how the corpus-wide operators ask "where else does this occur?".

Documents are dealt into chunks by a hash of id and text, so that rows without an id, or with the same one, don't gather
in one task.  A chunk computes all its keys (hashes of lines, words, byte strings ...) in numpy, keeps each *once*, and
sends them, sorted and delta-coded, to the buckets of the key range.  A bucket merges what all chunks sent and answers
each chunk about its own keys.  A key that a third of all documents share is thus one entry per chunk, not one row per
document.  Chunks grow with the corpus from ``CHUNK_BYTES`` to ``CHUNK_MOST`` of text, so at 100 TB such a key has
about six million entries (some 70 MB) in its bucket.  A chunk's work and rows are bounded by its own keys, whatever the
number of buckets: only buckets that it has keys for are visited.

All stages are ordinary lazy DataFrames (repartition, grouped and co-grouped Arrow functions), so lost
executors cost a recomputation only.  The exchange that deals out the texts is the same plan node each time and
is reused by Spark within a query.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, CHUNK_MOST = 2 << 20, 16 << 20
CHUNKS = 2048
BUCKET_BYTES = 32 << 20
#: Blobs of few keys aren't worth compressing.
_SMALL = 128
_REQUEST = "bucket int, chunk int, body binary"


# ---------------------------------------------------------------- arrays in blobs
def pack(*arrays: np.ndarray, delta: bool = True) -> bytes:
    """Arrays in one blob.  The first, if ``delta``, is sorted unsigned and stored as differences."""
    parts = [struct.pack("<BB", len(arrays), delta)]
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        kind = a.dtype.str[1:].encode()
        if k == 0 and delta and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        parts.append(struct.pack("<2sQ", kind, len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    raw = b"".join(parts)
    return b"\0" + raw if len(raw) < _SMALL else b"\1" + zstandard.compress(raw, 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob[1:]) if blob[0] else blob[1:]
    count, delta = struct.unpack_from("<BB", raw)
    at, out = 2, []
    for k in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        size = dtype.itemsize * n
        a = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel() if n else np.empty(0, dtype)
        at += size
        out.append(np.cumsum(a, dtype=dtype) if k == 0 and delta and n else a)
    return out


def again(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Whether each key is sent twice or more, or marked as being found several times by its sender."""
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return ((n > 1) | (np.bincount(which, several) > 0))[which]


def split(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted uint64 keys that go to each bucket: bucket b holds [b, b + 1) of n equal key ranges."""
    if not len(keys):
        return
    at = (keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(at[a]), slice(a, b)


def inside(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether the sorted table has it, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


class Merged:
    """What all chunks sent to one bucket, as one set of arrays, with the chunk of each entry."""

    def __init__(self, sent: list[tuple[int, bytes]]):
        sent = sorted(sent, key=lambda x: x[0])
        columns = [unpack(body) for _, body in sent]
        self.chunks = [c for c, _ in sent]
        self.edges = np.concatenate([[0], np.cumsum([len(c[0]) for c in columns])]).astype(np.int64)
        self.columns = [np.concatenate(x) for x in zip(*columns, strict=True)]
        self.chunk = np.repeat(np.array(self.chunks, np.int64), np.diff(self.edges))

    def slices(self) -> Iterator[tuple[int, slice]]:
        for k, chunk in enumerate(self.chunks):
            yield chunk, slice(int(self.edges[k]), int(self.edges[k + 1]))


# ---------------------------------------------------------------- documents of a chunk
class Docs:
    """The documents of a chunk: ids (None where null), their bytes in one array, and where each begins.

    With ``ordered`` they come in the order of id and text, so that a place in the chunk is the same in all stages.
    """

    def __init__(self, table: pa.Table, ordered: bool = False):
        if ordered:
            ids = table.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max)
            marks = [xxhash.xxh3_64_intdigest(x or "") for x in table.column("text").to_pylist()]
            table = table.take(pa.array(np.lexsort((np.array(marks, np.uint64), np.asarray(ids)))))
        text = table.column("text")
        text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_string()).fill_null("")
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
        n = len(text)
        _, offsets, data = text.buffers()
        edges = np.frombuffer(offsets, np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        self.buf = body[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        self.table = table
        self.n = n

    def ids(self) -> np.ndarray:
        """Ids as int64; a null id counts as larger than any."""
        ids = self.table.column("doc_id").combine_chunks()
        return np.asarray(ids.fill_null(np.iinfo(np.int64).max)).astype(np.int64)

    def raw(self, k: int) -> bytes:
        return self.buf[self.edges[k] : self.edges[k + 1]].tobytes()


class Deal:
    """Documents dealt into chunks, and the stages that run over them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, ordered: bool = False):
        self.ordered = ordered
        own_id, own_text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
        size, rows = docs.agg(F.sum(F.octet_length(own_text)), F.count(F.lit(1))).first()
        total = (size or 0) + 64 * (rows or 0)
        self.total = total
        chunk_bytes = max(chunk_bytes, min(CHUNK_MOST, total // CHUNKS))
        self.n_chunks = max(1, math.ceil(total / chunk_bytes))
        self.n_buckets = max(1, math.ceil(total / bucket_bytes))
        wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        parts = max(1, min(self.n_chunks, max(wanted, math.ceil(total / (32 << 20)))))
        columns: list[Column] = [
            F.pmod(F.xxhash64(own_id, own_text), F.lit(self.n_chunks)).cast("int").alias("chunk"),
            own_id.alias("doc_id"),
            own_text.alias("text"),
        ]
        if carry:
            columns.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"))
        self.parts = parts
        self.docs = docs.select(*columns).repartition(parts, "chunk")

    def ask(self, make: Callable[[Docs, list], Iterator[tuple[int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
        """make(docs, answers so far) gives (bucket, blob).  Bucket -1 is an echo: it comes back to its chunk."""
        ordered = self.ordered

        def rows(chunk: int, docs: pa.Table, got: list) -> pa.Table:
            made = list(make(Docs(docs, ordered), got))
            return pa.table(
                {
                    "bucket": pa.array([b if b >= 0 else -1 - chunk for b, _ in made], pa.int32()),
                    "chunk": pa.array([chunk] * len(made), pa.int32()),
                    "body": pa.array([x for _, x in made], pa.binary()),
                }
            )

        if answers is None:

            def alone(key, docs):
                return rows(key[0].as_py(), docs, [])

            return self.docs.groupBy("chunk").applyInArrow(alone, _REQUEST)

        def both(key, docs, got):
            return rows(key[0].as_py(), docs, received(got))

        return self.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, _REQUEST)

    def settle(self, requests: DataFrame, merge: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """merge(what the chunks sent to a bucket) gives (chunk, blob)."""

        def run(key, sent):
            bucket = key[0].as_py()
            if bucket < 0:
                return sent.select(["bucket", "chunk", "body"])
            made = list(merge(list(zip(sent.column("chunk").to_pylist(), sent.column("body").to_pylist(), strict=True))))
            return pa.table(
                {
                    "bucket": pa.array([bucket] * len(made), pa.int32()),
                    "chunk": pa.array([c for c, _ in made], pa.int32()),
                    "body": pa.array([x for _, x in made], pa.binary()),
                }
            )

        return requests.groupBy("bucket").applyInArrow(run, _REQUEST)

    def finish(self, answers: DataFrame, make: Callable[[Docs, list], pa.Table], schema) -> DataFrame:
        ordered = self.ordered

        def run(key, docs, got):
            return make(Docs(docs, ordered), received(got))

        return self.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def received(got: pa.Table) -> list[tuple[int, bytes]]:
    """(bucket, blob) of what came back to a chunk; a negative bucket marks an echo."""
    return list(zip(got.column("bucket").to_pylist(), got.column("body").to_pylist(), strict=True)) if got.num_rows else []


def bodies(got: list[tuple[int, bytes]], echo: bool = False) -> list[list[np.ndarray]]:
    return [unpack(body) for bucket, body in got if (bucket < 0) == echo]


def table_of(got: list[tuple[int, bytes]], dtypes: tuple, echo: bool = False) -> list[np.ndarray]:
    """All answers' arrays joined, sorted by the first."""
    found = bodies(got, echo)
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, d) for d in dtypes]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


# ---------------------------------------------------------------- hashes
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the pair (a, b)."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xA0761D6478BD642F) + _U(0x8EBC6AF09C88C6E3))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums modulo 2**64."""

    powers = np.ones(1, np.uint64)
    backs = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling.powers) < n + 1:
            Rolling.powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE)]))
            Rolling.backs = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BACK)]))
        self.n = n
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * Rolling.powers[:n], out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        """Hash of each q consecutive values."""
        return mix((self.sums[q:] - self.sums[: self.n + 1 - q]) * Rolling.backs[: self.n + 1 - q])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * Rolling.backs[lo] + (hi - lo).astype(np.uint64))


def minimum_of(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    size = 1
    while size * 2 <= w:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (w - size)], keys[w - size :]) if w > size else keys


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[edges] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return lo, hi, np.searchsorted(edges, lo, "right") - 1


def word_ids(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each word: its bytes, eight at a time, are scrambled into the length one after another.

    Unlike a polynomial modulo 2**64 no step is linear, so no pair of long words collides by construction; words of
    up to eight bytes and one length have different identifiers.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    size = hi - lo
    out = mix(size.astype(np.uint64) * _BASE)
    left = np.arange(len(lo))
    at = 0
    while len(left):
        rest = size[left] - at
        lane = lanes[lo[left] + at]
        short = rest < 8
        lane[short] &= (_U(1) << (rest[short].astype(np.uint64) * _U(8))) - _U(1)
        out[left] = mix(out[left] * _U(0xD6E8FEB86659FD93) ^ lane)
        at += 8
        left = left[rest > 8]
    return out
