"""Removal of word passages that an earlier document already has, by De Bruijn compaction (operator 7).

Each window of 13 words is an edge of the De Bruijn graph of the corpus (from its first to its last 12 words), and
a document is a walk.  Edges are dealt out by their minimizer, the least of the identifiers of their nine 5-word
parts: consecutive edges with one minimizer at one place are a path.

1. Minimizers that occur once are dropped: their edges repeat nowhere else.
2. A path travels as one record (minimizer, identifier of all its words, document and place of its first word).  Where
   all walks through a minimizer take the same path, it doesn't branch: it is compacted, and its source is its
   place in the least document that has it.
3. Where paths through a minimizer differ (passages begin or end, or texts vary), one path of each kind is opened
   into edges, joined with those of the other kinds, and each edge gets its own source.
4. Paths and edges of a document whose sources follow one another are compacted into long spans, and every span is
   verified: it asks for the words at the coordinates of its source (each question once, however many documents ask),
   and the chunk that holds the source answers by a 128-bit digest of the words there.  Spans that don't hold are not cut.

A word goes if an edge over it has a source with a smaller id than its own document.  Identifiers choose sources and
the words at the source decide.

Null texts have no words; a null id counts as larger than all others; equal ids are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm import exchange
from hotleaf.llm.exchange import Deal, Docs, Merged, Rolling, again, inside, join_ids, minimum_of, pack, received, split, table_of, words_of

_U = np.uint64
_LOW = _U((1 << 24) - 1)


class Words:
    """The words of a chunk: places of their bytes, and their document."""

    def __init__(self, docs: Docs):
        self.lo, self.hi, self.doc = words_of(docs.buf, docs.edges)
        self.raw = docs.buf.tobytes()

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.lo[at : at + n].tolist(), self.hi[at : at + n].tolist(), strict=True)])

    def digest(self, at: int, n: int) -> bytes:
        return hashlib.blake2b(self.joined(at, n), digest_size=16).digest()


class Paths:
    """The paths (runs of edges with one minimizer) of a chunk's documents."""

    def __init__(self, docs: Docs, size: int, part: int):
        self.size = size
        self.words = words = Words(docs)
        self.doc = words.doc
        n = len(words.lo) - size + 1
        self.first = self.last = self.at = np.empty(0, np.int64)
        self.minimizer = np.empty(0, np.uint64)
        self.owner = np.empty(0, np.int64)
        if n <= 0:
            return
        self.rolling = Rolling(exchange.word_ids(docs.buf, words.lo, words.hi))
        parts = self.rolling.grams(part)
        self.edges = self.rolling.grams(size)
        keys = (parts & ~_LOW) | (np.arange(len(parts), dtype=np.uint64) & _LOW)
        pointer = minimum_of(keys, size - part + 1)[:n] & _LOW
        start = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        if not len(start):
            return
        at = start + ((pointer[start] - start.astype(np.uint64)) & _LOW).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        edge = np.flatnonzero(new)
        self.first, self.last = start[edge], start[np.concatenate([edge[1:] - 1, [len(start) - 1]])]
        self.at = at[edge]
        self.minimizer = parts[self.at]
        self.owner = docs.ids()[self.doc[self.first]]

    def kinds(self, of: np.ndarray) -> np.ndarray:
        lo, hi = self.first[of], self.last[of]
        place = (hi - lo).astype(np.uint64) << _U(32) | (self.at[of] - lo).astype(np.uint64)
        return join_ids(self.rolling.spans(lo, hi + self.size), place)

    def opened(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.last[of] - self.first[of] + 1
        which = np.repeat(np.arange(len(of)), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(of) else np.empty(0, np.int64)
        return self.first[of][which] + np.arange(len(which)) - begin[which], which


def _least(owner: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """Each key once, with its least owner, the first place there, and its greatest owner."""
    order = np.lexsort((at, owner, *keys[::-1]))
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edge = np.flatnonzero(new)
    last = np.concatenate([edge[1:], [len(order)]])[: len(edge)] - 1
    return [*[k[edge] for k in keys], owner[order][edge], at[order][edge].astype(np.uint32), owner[order][last]]


def _merge_minimizers(sent: list) -> Iterator[tuple[int, bytes]]:
    m = Merged(sent)
    keys, several = m.columns
    found = again(keys, several)
    for chunk, s in m.slices():
        if found[s].any():
            yield chunk, pack(keys[s][found[s]])


def _merge_paths(sent: list) -> Iterator[tuple[int, bytes]]:
    """Source of each path; whether its minimizer branches; told to chunks where that decides something."""
    m = Merged(sent)
    minimizer, kind, least, at, most = m.columns
    order = np.lexsort((m.chunk, least, kind, minimizer))
    b, k = minimizer[order], kind[order]
    new_b = np.concatenate([[True], b[1:] != b[:-1]])
    new_k = new_b | np.concatenate([[True], k[1:] != k[:-1]])
    of_b, of_k = np.cumsum(new_b) - 1, np.cumsum(new_k) - 1
    branches = (np.bincount(of_b, new_k) > 1)[of_b]
    first = np.empty(len(kind), np.int64)
    first[order] = order[new_k][of_k]
    branch, tell = np.empty(len(kind), np.uint8), np.empty(len(kind), bool)
    branch[order] = branches
    tell[order] = branches & new_k
    source = least[first]
    tell |= most > source
    for chunk, s in m.slices():
        some = np.flatnonzero(tell[s])
        if len(some):
            of = first[s][some]
            yield chunk, pack(kind[s][some], source[s][some], m.chunk[of].astype(np.uint32), at[of], branch[s][some], delta=False)


def _merge_edges(sent: list) -> Iterator[tuple[int, bytes]]:
    m = Merged(sent)
    keys, least, at, most = m.columns
    order = np.lexsort((m.chunk, least, keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.empty(len(keys), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    for chunk, s in m.slices():
        some = np.flatnonzero(most[s] > least[first[s]])
        if len(some):
            of = first[s][some]
            yield chunk, pack(keys[s][some], least[of], m.chunk[of].astype(np.uint32), at[of])


def _unchanged(key, table):
    return table


_SPAN = "chunk int, start long, n long, target int, at long, digest binary"
_SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string, kept_sha256 string"
_STATE = ("u8", "i8", "u4", "u4", "u1")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, part: int = 5, with_kept: bool = True, with_spans: bool = True, chunk_bytes: int = exchange.CHUNK_BYTES, bucket_bytes: int = 2 << 20) -> DataFrame:
    """Removes each word covered by a window of ``size`` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, spans (first word and number of words of each removed run), kept (the words
    that stay, joined by a space) and kept_sha256.
    """
    deal = Deal(docs, id_col, text_col, chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes, ordered=True)
    n_buckets = deal.n_buckets

    def minimizers(d: Docs, _):
        p = Paths(d, size, part)
        keys, least, _, most = _least(p.owner, p.first, p.minimizer)
        several = (most > least).astype(np.uint8)
        for b, s in split(keys, n_buckets):
            yield b, pack(keys[s], several[s])

    def paths(d: Docs, got):
        (shared,) = table_of(got, ("u8",))
        p = Paths(d, size, part)
        of = np.flatnonzero(inside(p.minimizer, shared)[0])
        columns = _least(p.owner[of], p.first[of], p.minimizer[of], p.kinds(of)) if len(of) else [np.empty(0, np.uint64)]
        for b, s in split(columns[0], n_buckets):
            yield b, pack(*[c[s] for c in columns])

    def undecided(p: Paths, kind, source, branch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths that go as a whole, paths of a branching minimizer that are their kind's source; each path's kind."""
        known, at = inside(p.kinds(np.arange(len(p.first))), kind)
        later = p.owner > source[at]
        return np.flatnonzero(known & later), np.flatnonzero(known & ~later & (branch[at] > 0)), at

    def edges(d: Docs, got):
        kind, source, chunk, place, branch = table_of(got, _STATE)
        if not len(kind):
            return
        p = Paths(d, size, part)
        _, of, _ = undecided(p, kind, source, branch)
        where, which = p.opened(of)
        columns = _least(p.owner[of][which], where, p.edges[where])
        for b, s in split(columns[0], n_buckets):
            yield b, pack(*[c[s] for c in columns])
        yield -1, pack(kind, source, chunk, place, branch)

    def spans(d: Docs, got) -> list[np.ndarray]:
        """Start, words, and coordinates (chunk, word) of the source of every span to cut, and its digest."""
        kind, source, chunk, place, branch = table_of(got, _STATE, echo=True)
        key, key_source, key_chunk, key_place = table_of(got, _STATE[:4])
        if not len(kind):
            return [np.empty(0, np.int64)] * 4 + [[]]
        p = Paths(d, size, part)
        whole, of, at = undecided(p, kind, source, branch)
        where, which = p.opened(of)
        found, of_key = inside(p.edges[where], key) if len(where) else (np.empty(0, bool), np.empty(0, np.int64))
        some = np.flatnonzero(found)
        some = some[p.owner[of][which[some]] > key_source[of_key[some]]]
        start = np.concatenate([p.first[whole], where[some]])
        end = np.concatenate([p.last[whole] + size, where[some] + size])
        target = np.concatenate([chunk[at[whole]], key_chunk[of_key[some]]]).astype(np.int64)
        shift = np.concatenate([place[at[whole]], key_place[of_key[some]]]).astype(np.int64) - start
        order = np.argsort(start, kind="stable")
        start, end, target, shift = (x[order] for x in (start, end, target, shift))
        new = np.ones(len(start), bool)
        doc = p.doc[start]
        new[1:] = (target[1:] != target[:-1]) | (shift[1:] != shift[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
        edge = np.flatnonzero(new)
        n = end[np.concatenate([edge[1:], [len(start)]])[: len(edge)] - 1] - start[edge]
        start, target, shift = start[edge], target[edge], shift[edge]
        return [start, n, target, start + shift, [p.words.digest(a, b) for a, b in zip(start.tolist(), n.tolist(), strict=True)]]

    def find(key, table, got):
        start, n, target, at, digest = spans(Docs(table, True), received(got))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(start), pa.int32()), "start": pa.array(start), "n": pa.array(n), "target": pa.array(target, pa.int32()), "at": pa.array(at), "digest": pa.array(digest, pa.binary())})

    def verify(key, table, asked):
        """The questions whose words at the source are others."""
        if not asked.num_rows:
            return asked
        words = Words(Docs(table, True))
        columns = [asked.column(c).to_pylist() for c in ("at", "n", "digest")]
        return asked.filter(pa.array([words.digest(at, n) != digest for at, n, digest in zip(*columns, strict=True)], pa.bool_()))

    def cut(key, table, found):
        d = Docs(table, True)
        of_word = words_of(d.buf, d.edges)[2]
        sizes = np.bincount(of_word, minlength=d.n).astype(np.int64)
        change = np.zeros(len(of_word) + 1, np.int32)
        start, n = (np.asarray(found.column(c).combine_chunks()).astype(np.int64) for c in ("start", "n"))
        np.add.at(change, start, 1)
        np.add.at(change, start + n, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.concatenate([[0], np.cumsum(sizes)])
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[edge[1:]] - before[edge[:-1]]
        runs, keeps, digests = [], [], []
        for k in range(d.n):
            own, cuts = d.raw(k).split(), []
            if removed[k]:
                mask = gone[edge[k] : edge[k + 1]]
                own = compress(own, ~mask)
                if with_spans:
                    step = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    cuts = [{"start": int(a), "length": int(b - a)} for a, b in zip(step[::2], step[1::2], strict=True)]
            kept = b" ".join(own)
            runs.append(cuts if with_spans else None)
            keeps.append(kept.decode() if with_kept else None)
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.table(
            {
                "doc_id": d.table.column("doc_id"),
                "n_words": pa.array(sizes),
                "n_removed": pa.array(removed.astype(np.int64)),
                "spans": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                "kept": pa.array(keeps, pa.string()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    shared = deal.settle(deal.ask(minimizers), _merge_minimizers)
    compacted = deal.settle(deal.ask(paths, shared), _merge_paths)
    joined = deal.settle(deal.ask(edges, compacted), _merge_edges)
    found = deal.docs.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(find, _SPAN)
    # both uses of the spans read this one exchange
    found = found.groupBy("chunk").applyInArrow(_unchanged, _SPAN)
    question = ["target", "at", "n", "digest"]
    asked = found.groupBy(*question).agg(F.min("chunk").alias("chunk"), F.min("start").alias("start")).select(*found.columns)
    refuted = asked.groupBy("target").cogroup(deal.docs.groupBy("chunk"))
    refuted = refuted.applyInArrow(lambda key, asked, table: verify(key, table, asked), _SPAN).select(*question)
    held = found.join(refuted, question, "left_anti")
    return deal.docs.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(cut, _SCHEMA)


def op7_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_passages(docs, with_kept=False, with_spans=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
