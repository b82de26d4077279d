"""Language-model scoring by online logistic context mixing (operator 2).

A text is the sequence of its words (A-Z lower-cased) and one end mark.  Every token is coded in bits, and every bit is
predicted by several hashed contexts whose predictions are mixed in the logistic domain by gated weights:

* A word that training texts have is coded by the bits of its 64-bit hash, from the first on, as far as other known words
  share them.  The first LEAF bits are predicted in the running text: their contexts are the hash's
  beginning within the kind of text, after the word before, after the one before that, and after both, with counts
  of every occurrence in training texts.  A text starts from the same weights and corrects them block of words after
  block of words; the gate is the bit's depth and how often it was seen after the word before.  The other bits are
  predicted from the beginning, overall and within a kind of text, by exact counts; the gate is how often the kind has seen it.
* A new word is spelled: a word is its bytes and a space, the end mark one byte.  The contexts of a bit are the last one to four
  bytes of the word and its whole beginning, with counts over all distinct training words.  The gate is which bit of the byte
  it is and how often the longest context was seen.

Weights outside the running text are refined online too: a bucket of the vocabulary starts from equal weights and corrects them step by step, with
the count of the token at hand left out; the buckets' weights are averaged by the tokens behind them, as integers, so that
neither partitions nor their order change a score.  A known and a new word have the shares that Good and Turing
give them.

The kind of text is a context of all words: kinds are the signs of the main axes of byte frequencies over all
training texts, a text is scored under each of them, and they are weighted by their share of the training tokens and,
word after word, by how well they predicted the words before.  Costs are rounded up to 1 / UNIT, so the probabilities of all
token sequences sum to at most one.

Words are counted over all training documents: stretches of documents send their distinct words once, buckets of the
vocabulary add up, and answer each chunk of documents with its words' counts and costs.  The counts of known words grow
with the corpus and stay in their buckets; per bucket only its totals come to the driver.  The tables for spelling and for the running text have a fixed size.

Null and empty texts are the end mark alone.  With no training documents all counts are zero and the bit predictor is
uniform.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.exchange import BUCKET_BYTES, BYTE_VALUES, Deal, Docs, Merged, Rolling, inside, mix, pack, split, table_of, unpack, word_ids, words_of
from hotleaf.llm.shared import settled

_U = np.uint64
AXES = 3
KINDS = 1 << AXES
BITS = 19
MODELS = 5
GATES = 8 * 4
END_ID = int(mix(np.array([0x656E64], np.uint64))[0])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BINS = 64
_STEP = 1 << 16
CHUNK_BYTES = 4 << 20
STRETCH_BYTES = 8 << 20
#: Costs (natural logarithms) travel as multiples of 1 / UNIT.
UNIT = 512
#: Gates of the known words' bits: how often the kind has seen the context, as a power of two.
LEVELS = 12
_START = np.tile(np.array([0.7, 0.3]), (LEVELS, 1))
#: Bits of a word's hash that are mixed in the running text.
LEAF = 12
#: Contexts there, as bits of the context's hash and of the word's: kind of text, word before, the one before that, both.
AROUND = ((AXES, LEAF), (10, 11), (10, 11), (12, 9))
_GRAIN = 16
_AROUND_START = (0.4, 0.35, 0.15, 0.25)
_AROUND_RATE = 0.003
#: Texts whose weights are held at once.  They change a score by rounding only; with few of them late blocks, of few long texts, are many.
_TEXTS = 2048


def held_out_fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


# ---------------------------------------------------------------- kinds of text
def _spectrum(raw: np.ndarray) -> np.ndarray:
    """Byte frequencies in 1 / 4096, as integers, so that sums don't depend on their order."""
    counts = np.bincount(_LOWER[raw] & (_BINS - 1), minlength=_BINS)
    return (counts << 12) // max(1, len(raw))


def text_axes(docs: DataFrame) -> np.ndarray:
    """Mean and main axes (1 + AXES rows) of the byte frequencies of all training texts."""

    def moments(batches):
        total = np.zeros(1 + _BINS + _BINS * _BINS, np.int64)
        for batch in batches:
            x = np.array([_spectrum(np.frombuffer(t.encode(), np.uint8)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and held_out_fold(i) != 2], np.int64).reshape(-1, _BINS)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    sums = _summed(docs.mapInArrow(moments, "k int, v long"), 1 + _BINS + _BINS * _BINS)
    n = max(1.0, sums[0])
    mean = sums[1 : _BINS + 1] / n
    _, axes = np.linalg.eigh(sums[_BINS + 1 :].reshape(_BINS, _BINS) / n - np.outer(mean, mean))
    axes = axes[:, -AXES:].T
    return np.vstack([mean, axes * np.sign(axes[np.arange(AXES), np.abs(axes).argmax(1)] + 1e-300)[:, None]])


def kind_of(raw: np.ndarray, axes: np.ndarray) -> int:
    return int((axes[1:] @ (_spectrum(raw) - axes[0]) > 0) @ (1 << np.arange(AXES)))


# ---------------------------------------------------------------- tokens of a chunk
def _tokens(d: Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; id, start, end and document of every token, end marks last."""
    buf = _LOWER[d.buf]
    lo, hi, doc = words_of(buf, d.edges)
    ids = np.concatenate([word_ids(buf, lo, hi), np.full(d.n, END_ID, np.uint64)])
    none = np.zeros(d.n, np.int64)
    return buf, ids, np.concatenate([lo, none]), np.concatenate([hi, none]), np.concatenate([doc, np.arange(d.n)])


def _gather(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches, joined, and their lengths."""
    sizes = hi - lo
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(lo - begin, sizes)
    return buf[at], sizes.astype(np.uint32)


def _words_sent(d: Docs, axes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    buf, ids, lo, hi, doc = _tokens(d)
    learn = np.array([held_out_fold(x) != 2 for x in d.table.column("doc_id").to_pylist()], bool)
    kind = np.array([kind_of(d.buf[d.edges[k] : d.edges[k + 1]], axes) for k in range(d.n)], np.int64)
    keys, first, which = np.unique(ids, return_index=True, return_inverse=True)
    counts = np.bincount(which * KINDS + kind[doc], learn[doc], len(keys) * KINDS).astype(np.uint32).reshape(-1, KINDS)
    for b, s in split(keys, n_buckets):
        body, sizes = _gather(buf, lo[first[s]], hi[first[s]])
        yield b, pack(keys[s], sizes, body, *[counts[s, k] for k in range(KINDS)])


def _stretches(batches) -> Iterator[Docs]:
    """Consecutive documents of up to STRETCH_BYTES."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH_BYTES, "right")))
            yield Docs(table.slice(at, to - at))
            at = to


def _merge_words(key, table):
    """The vocabulary of a bucket: each word once, with its counts."""
    m = Merged(list(enumerate(table.column("body").to_pylist())))
    keys, sizes, body, *counts = m.columns
    vocabulary, first, which = np.unique(keys, return_index=True, return_inverse=True)
    end = np.cumsum(sizes.astype(np.int64))
    words, lengths = _gather(body, end[first] - sizes[first], end[first])
    blob = pack(vocabulary, lengths, words, *[np.bincount(which, c, len(vocabulary)).astype(np.int64) for c in counts])
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([blob], pa.binary())})


def word_counts(rows: DataFrame, axes: np.ndarray, n_buckets: int) -> DataFrame:
    """(bucket, body): the words of all texts with their counts in training texts of each kind."""

    def send(batches):
        for d in _stretches(batches):
            made = list(_words_sent(d, axes, n_buckets))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in made], pa.int32()), "body": pa.array([x for _, x in made], pa.binary())})

    return rows.mapInArrow(send, "bucket int, body binary").groupBy("bucket").applyInArrow(_merge_words, "bucket int, body binary")


# ---------------------------------------------------------------- bits of known words
def _nodes(keys: np.ndarray, counts: np.ndarray, depths: range):
    """The contexts at each depth that known words part in: (node of each key, its bit, tokens with ones, tokens)."""
    sums = np.vstack([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)])
    for depth in depths:
        top = keys >> _U(64 - depth) if depth else np.zeros(len(keys), np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(keys) else np.empty(0, np.int64)
        if not len(edge) or depth > depths[0] and len(edge) == len(keys):
            return
        bit = (keys >> _U(63 - depth) & _U(1)).astype(np.int64)
        end = np.concatenate([edge[1:], [len(keys)]])
        ones = np.add.reduceat(bit, edge)
        parted = (ones > 0) & (ones < end - edge)
        node = np.cumsum(np.isin(np.arange(len(keys)), edge)) - 1
        number = np.cumsum(parted) - 1
        node = np.where(parted[node], number[node], -1)
        yield node, bit, (sums[end] - sums[end - ones])[parted], (sums[end] - sums[edge])[parted]


def _stretched(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (np.maximum(all_ - ones, 0) + 0.4))


def _known_gate(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(seen, 0) + 1).astype(np.int64), LEVELS - 1)


def _refine_known(keys: np.ndarray, counts: np.ndarray, first: int, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (gate x predictor) refined over a bucket's contexts, each token's own count left out; tokens per gate."""
    weights, mass = _START.copy(), np.zeros(LEVELS, np.int64)
    for round_ in range(passes):
        for _, _, ones, all_ in _nodes(keys, counts, range(first, 64)):
            every = all_.sum(1, keepdims=True), ones.sum(1, keepdims=True)
            for bit in (0, 1):
                n = ones if bit else all_ - ones
                gate = _known_gate(all_ - 1)
                x = np.stack([_stretched(np.maximum(ones - bit, 0), all_ - 1), np.broadcast_to(_stretched(np.maximum(every[1] - bit, 0), every[0] - 1), n.shape)])
                error = bit - 1 / (1 + np.exp(-(weights[gate, 0] * x[0] + weights[gate, 1] * x[1])))
                hits = np.bincount(gate.ravel(), n.ravel(), LEVELS)
                for k in range(2):
                    weights[:, k] += 0.3 * np.bincount(gate.ravel(), (n * error * x[k]).ravel(), LEVELS) / np.maximum(hits, 64)
                if not round_:
                    mass += hits.astype(np.int64)
    return weights, mass


def known_costs(keys: np.ndarray, counts: np.ndarray, depths: range, weights: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each key, given what all keys share, for each kind."""
    out = np.zeros(counts.shape)
    for node, bit, ones, all_ in _nodes(keys, counts, depths):
        gate = _known_gate(all_)
        mixed = weights[gate, 0] * _stretched(ones, all_) + weights[gate, 1] * _stretched(ones.sum(1), all_.sum(1))[:, None]
        wrong = np.stack([mixed, -mixed])
        cost = np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))
        some = np.flatnonzero(node >= 0)
        out[some] -= cost[bit[some], node[some]]
    return out


# ---------------------------------------------------------------- bits of words in the running text
def _in_order(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Id and document of every token in the order of the texts; ids of the two words before (0: none)."""
    order = np.argsort(doc, kind="stable")
    ids, doc = ids[order], doc[order]
    before = np.zeros((2, len(ids)), np.uint64)
    for k in (1, 2):
        before[k - 1, k:] = np.where(doc[k:] == doc[:-k], ids[:-k], _U(0))
    return ids, doc, before[0], before[1]


def _around(kind: np.ndarray, last: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """The context of each token in each model."""
    hashes = mix(last), mix(second + _U(0x32)), mix(mix(last) + second)
    return [kind, *((h >> _U(64 - wide)).astype(np.int64) for h, (wide, _) in zip(hashes, AROUND[1:], strict=True))]


def _count_around(axes: np.ndarray):
    """Counts of words, by the beginning of their hash, in every context of the running training texts."""

    def run(batches):
        totals = [np.zeros(1 << wide + deep, np.int64) for wide, deep in AROUND]
        for d in _stretches(batches):
            _, ids, _, _, doc = _tokens(d)
            ids, doc, last, second = _in_order(ids, doc)
            learn = np.array([held_out_fold(x) != 2 for x in d.table.column("doc_id").to_pylist()], bool)
            kind = np.array([kind_of(d.buf[d.edges[k] : d.edges[k + 1]], axes) for k in range(d.n)], np.int64)
            some = learn[doc]
            for total, context, (_, deep) in zip(totals, _around(kind[doc], last, second), AROUND, strict=True):
                at = context[some] << deep | (ids[some] >> _U(64 - deep)).astype(np.int64)
                total += np.bincount(at, minlength=len(total))
        found = [np.flatnonzero(x) for x in totals]
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(len(AROUND)), pa.int32()), "body": [pack(at.astype(np.uint32), x[at]) for at, x in zip(found, totals, strict=True)]})

    return run


def _add_around(key, table):
    wide, deep = AROUND[key[0].as_py()]
    total = np.zeros(1 << wide + deep, np.int64)
    for blob in table.column("body").to_pylist():
        at, counts = unpack(blob)
        total[at] += counts
    at = np.flatnonzero(total)
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "body": [pack(at.astype(np.uint32), total[at])]})


def _tree(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context and node (1: the whole hash, 2n and 2n + 1: beginnings one bit longer) counts of zeros and ones."""
    zeros, ones = np.zeros(leaves.shape, np.int64), np.zeros(leaves.shape, np.int64)
    while leaves.shape[1] > 1:
        half = leaves.shape[1] // 2
        zeros[:, half : 2 * half], ones[:, half : 2 * half] = leaves[:, 0::2], leaves[:, 1::2]
        leaves = leaves[:, 0::2] + leaves[:, 1::2]
    return zeros, ones


def _blocks(place: np.ndarray) -> np.ndarray:
    """Number of the block that a place in a text is in: of 16 words, later of an eighth of the words before."""
    edges = [0]
    while len(place) and edges[-1] <= place.max():
        edges.append(edges[-1] + max(16, edges[-1] // 8))
    return np.searchsorted(edges, place, "right") - 1


@dataclass
class Around:
    """Predictors of the running text, as multiples of 1 / _GRAIN by context and node, and what words cost without them."""

    stretch: list[np.ndarray]
    level: np.ndarray
    parted: np.ndarray
    #: For each kind and beginning the probability of a known word that has it.
    share: np.ndarray
    prior: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, counts: list[np.ndarray], weights: np.ndarray, unseen: np.ndarray, tokens: np.ndarray) -> Around:
        trees = [_tree(x.reshape(1 << wide, 1 << deep)) for x, (wide, deep) in zip(counts, AROUND, strict=True)]
        stretch = [np.rint(np.clip(_GRAIN * np.log((ones + 0.4) / (zeros + 0.4)), -127, 127)).astype(np.int8).ravel() for zeros, ones in trees]
        by_kind = counts[0].reshape(KINDS, -1).T
        some = np.flatnonzero(by_kind.sum(1))
        share = np.zeros((KINDS, 1 << LEAF))
        share[:, some] = (np.exp(known_costs(some.astype(np.uint64) << _U(64 - LEAF), by_kind[some], range(0, LEAF), weights)) * (1 - unseen)).T
        prior = np.maximum(tokens, 1) / np.maximum(tokens, 1).sum()
        return cls(stretch, _level(trees[1][0] + trees[1][1]).ravel(), (trees[0][0].sum(0) > 0) & (trees[0][1].sum(0) > 0), share, prior, 1 - unseen)

    def gains(self, ids: np.ndarray, doc: np.ndarray, last: np.ndarray, second: np.ndarray, costs: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
        """For each text the natural log of what its known words gain over the kinds' own predictions.

        ``costs`` (kind x token) are multiples of 1 / UNIT, of which the texts' beginnings give the kinds' weights.
        """
        if n > _TEXTS:
            cuts = np.searchsorted(doc, np.arange(0, n + _TEXTS, _TEXTS))
            parts = [self.gains(ids[a:b], doc[a:b] - k * _TEXTS, last[a:b], second[a:b], costs[:, a:b], known[a:b], min(_TEXTS, n - k * _TEXTS)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if k * _TEXTS < n]
            return np.concatenate(parts)
        out, spent = np.zeros(n), np.zeros((KINDS, n), np.int64)
        weights = np.empty((LEAF, len(AROUND), 4 * n), np.float32)
        weights[:] = np.array(_AROUND_START)[:, None] / _GRAIN
        block = _blocks(np.arange(len(doc)) - np.searchsorted(doc, doc))
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) > 0, [True]])) if len(order) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            own, cost = doc[at], costs[:, at]
            after = np.cumsum(cost, 1, np.int64)
            after += (spent - np.take(after - cost, np.searchsorted(own, np.arange(n)), 1, mode="clip"))[:, own]
            ends = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]]))
            spent[:, own[ends]] = after[:, ends]
            some = np.flatnonzero(known[at])
            so_far = (after - cost)[:, some]
            at, own = at[some], own[some]
            odds = np.exp((so_far - so_far.min(0)) / -UNIT) * self.prior[:, None]
            leaf = (ids[at] >> _U(64 - LEAF)).astype(np.int64)
            gain = np.log(self.known @ odds) - np.log(sum(share.take(leaf) * x for share, x in zip(self.share, odds, strict=True)))
            gain += self._mixed(weights, own, leaf, _around(odds.argmax(0), last[at], second[at]))
            out += np.bincount(own, gain, n)
        return out

    def _mixed(self, weights: np.ndarray, doc: np.ndarray, leaf: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each word's beginning; ``weights`` of the texts are corrected afterwards."""
        out, size = np.zeros(len(leaf)), weights.shape[2]
        contexts = [c << deep for c, (_, deep) in zip(contexts, AROUND, strict=True)]
        for depth in range(LEAF):
            node = 1 << depth | leaf >> LEAF - depth
            sign = ((leaf >> LEAF - 1 - depth & 1) * 2 - 1).astype(np.float32)
            one_way = not self.parted[1 << depth : 2 << depth].all()
            if one_way:
                sign *= self.parted.take(node)
            slots = [c + node for c, (_, deep) in zip(contexts, AROUND, strict=True) if depth < deep]
            x = [table.take(at).astype(np.float32) for table, at in zip([t for t, (_, deep) in zip(self.stretch, AROUND, strict=True) if depth < deep], slots, strict=True)]
            used = [k for k, (_, deep) in enumerate(AROUND) if depth < deep]
            which = doc * 4 + self.level.take(slots[used.index(1)]) if 1 in used else doc * 4
            odds = 1 + np.exp(np.minimum(-sign * sum(weights[depth, k].take(which) * v for k, v in zip(used, x, strict=True)), 60))
            # a beginning that all known words go on from in one way costs nothing
            out -= np.where(sign == 0, 0, np.log(odds)) if one_way else np.log(odds)
            error = sign * (1 - 1 / odds)
            rate = _AROUND_RATE / _GRAIN**2 / np.maximum(1, np.bincount(which, minlength=size) / 64)
            for k, v in zip(used, x, strict=True):
                weights[depth, k] += rate * np.bincount(which, error * v, size)
        return out


# ---------------------------------------------------------------- bit predictors
@dataclass
class Vocabulary:
    keys: np.ndarray
    sizes: np.ndarray
    body: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, blob: bytes) -> Vocabulary:
        keys, sizes, body, *counts = unpack(blob)
        return cls(keys, sizes, body, np.stack(counts, 1))

    def coded(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches of whole words: (word of each byte, byte, place in word, context hash of each model)."""
        end = np.cumsum(self.sizes.astype(np.int64))
        size = self.sizes.astype(np.int64)[of] + 1
        begin = np.cumsum(size) - size
        at = 0
        while at < len(of):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + _STEP)))
            part, own = of[at:to], size[at:to]
            start = np.cumsum(own) - own
            word = np.repeat(np.arange(at, to), own)
            place = np.arange(len(word)) - np.repeat(start, own)
            source = np.repeat(end[part] - own + 1, own) + place
            last = place == np.repeat(own, own) - 1
            byte = np.where(last, 32, self.body[np.minimum(source, max(0, len(self.body) - 1))] if len(self.body) else 32).astype(np.uint8)
            byte[last & np.repeat(self.keys[part] == _U(END_ID), own)] = 10
            yield word, byte, place, self.contexts(byte, place, np.repeat(start, own))
            at = to

    @staticmethod
    def contexts(byte: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.empty((MODELS, len(byte)), np.uint32)
        seen = np.zeros(len(byte), np.uint32)
        for order in range(1, MODELS):
            back = np.zeros(len(byte), np.uint32)
            back[order:] = byte[:-order] if order < len(byte) else 0
            seen = (seen << np.uint32(8)) | np.where(place >= order, back, 0).astype(np.uint32)
            h = (seen + np.uint32(order)) * np.uint32(0x9E3779B1)
            out[order - 1] = h ^ (h >> np.uint32(15))
        at = np.arange(len(byte))
        out[MODELS - 1] = (Rolling(BYTE_VALUES[byte]).spans(start, at) >> _U(32)).astype(np.uint32)
        return out


def _slots(contexts: np.ndarray, byte: np.ndarray, bit: int) -> np.ndarray:
    """Slot of each model for a bit (7 is the first), given the bits before it."""
    node = (np.uint32(1 << (7 - bit))) | (byte.astype(np.uint32) >> np.uint32(bit + 1))
    h = (contexts + node * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))) & np.uint32((1 << BITS) - 1)


def _count_bits(batches):
    """Counts of zeros and ones (at 2 * slot + bit) over every distinct training word."""
    counts = np.zeros((MODELS, 2 << BITS), np.int64)
    some = False
    for batch in batches:
        for blob in batch.column("body").to_pylist():
            v = Vocabulary.of(blob)
            for _, byte, _, contexts in v.coded(np.flatnonzero(v.counts.sum(1) > 0)):
                some = True
                for bit in range(8):
                    at = _slots(contexts, byte, bit) * np.uint32(2) + (byte >> bit & 1)
                    for k in range(MODELS):
                        np.add.at(counts[k], at[k], 1)
    if some:
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(MODELS), pa.int32()), "body": [pack(counts[k], delta=False) for k in range(MODELS)]})


def _add_tables(key, table):
    total = [sum(x) for x in zip(*map(unpack, table.column("body").to_pylist()), strict=True)]
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "body": [pack(*total, delta=False)]})


def _left_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot and bit seen there: the stretched probability of a one without that sighting; and the sightings."""
    zeros, ones = counts[:, 0::2].astype(np.float32), counts[:, 1::2].astype(np.float32)
    out = np.empty(counts.shape, np.float32)
    out[:, 0::2] = np.log((ones + 0.4) / (np.maximum(zeros - 1, 0) + 0.4))
    out[:, 1::2] = np.log((np.maximum(ones - 1, 0) + 0.4) / (zeros + 0.4))
    return out, _level(zeros[MODELS - 2] + ones[MODELS - 2] - 1)


def _level(seen: np.ndarray) -> np.ndarray:
    """Confidence in the longest context: 0, 1 to 2, 3 to 14, or more sightings."""
    return (np.minimum(np.log2(np.maximum(seen, 0) + 1).astype(np.int64), 6) // 2).astype(np.uint8)


def _refine(table: np.ndarray, level: np.ndarray, first: int):
    """Online refinement of both sets of weights over the words of each bucket, each with its own count left out."""

    def run(batches):
        total = np.zeros(GATES * (MODELS + 1) + 3 * LEVELS, np.int64)
        for batch in batches:
            for blob in batch.column("body").to_pylist():
                v = Vocabulary.of(blob)
                known = np.flatnonzero(v.counts.sum(1) > 0)
                weights, mass = np.full((GATES, MODELS), 0.3, np.float32), np.zeros(GATES, np.int64)
                for _, byte, _, contexts in v.coded(known):
                    for bit in range(8):
                        on = byte >> bit & 1
                        slot = _slots(contexts, byte, bit)
                        at = slot * np.uint32(2) + on
                        gate = level[slot[MODELS - 2]]
                        x = [table[k][at[k]] for k in range(MODELS)]
                        own = weights[bit * 4 : bit * 4 + 4]
                        error = on - 1 / (1 + np.exp(-sum(own[gate, k] * x[k] for k in range(MODELS))))
                        hits = np.bincount(gate, minlength=4)
                        for k in range(MODELS):
                            own[:, k] += 0.5 * np.bincount(gate, error * x[k], 4) / np.maximum(hits, 256)
                        mass[bit * 4 : bit * 4 + 4] += hits
                bits, tokens = _refine_known(v.keys[known], v.counts[known], first)
                # by bytes and by tokens in units that keep the sums of all buckets within 64 bits
                for w, m, at in ((weights, mass, 0), (bits, tokens, GATES * (MODELS + 1))):
                    m = -(-m // 64)
                    total[at : at + w.size] += np.rint(w * 4096).astype(np.int64).ravel() * np.repeat(m, w.shape[1])
                    total[at + w.size : at + w.size + len(m)] += m
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    return run


@dataclass
class Model:
    stretch: np.ndarray
    level: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    #: For each kind: training tokens, and the share of new words; for each bucket and kind the log of its share.
    tokens: np.ndarray
    unseen: np.ndarray
    shares: np.ndarray
    words: int
    first: int
    around: Around | None = None

    def word_bits(self, v: Vocabulary) -> np.ndarray:
        """Natural log of the bit predictor's probability of each word."""
        out = np.zeros(len(v.keys))
        for word, byte, _, contexts in v.coded(np.arange(len(v.keys))):
            cost = np.zeros(len(byte), np.float32)
            for bit in range(8):
                slot = _slots(contexts, byte, bit)
                own, gate = self.weights[bit * 4 : bit * 4 + 4], self.level[slot[MODELS - 2]]
                mixed = sum(own[gate, k] * self.stretch[k][slot[k]] for k in range(MODELS))
                wrong = np.where(byte >> bit & 1, -mixed, mixed)
                cost += np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))
            out -= np.bincount(word, cost, len(out))
        return out

    def log_probabilities(self, v: Vocabulary, bucket: int) -> np.ndarray:
        """For each word and kind the natural log of its probability."""
        out = np.log(self.unseen) + self.word_bits(v)[:, None]
        known = np.flatnonzero(v.counts.sum(1) > 0)
        bits = known_costs(v.keys[known], v.counts[known], range(self.first, 64), self.known)
        out[known] = np.log(1 - self.unseen) + self.shares[bucket] + bits
        return out


def _totals(batches):
    """Per bucket: training tokens of each kind, known words, and words seen once in each kind."""
    for batch in batches:
        rows = []
        for blob in batch.column("body").to_pylist():
            counts = Vocabulary.of(blob).counts
            whole = counts.sum(1)
            rows.append([*counts.sum(0).tolist(), int((whole > 0).sum()), *counts[whole == 1].sum(0).tolist()])
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(rows, pa.list_(pa.int64()))], ["bucket", "totals"])


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for k, v in rows.groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)"))).collect():
        out[k] = v
    return out


def around_counts(rows: DataFrame, axes: np.ndarray) -> list[np.ndarray]:
    parts = rows.mapInArrow(_count_around(axes), "model int, body binary").withColumn("part", F.spark_partition_id() % 16)
    once = parts.groupBy("model", "part").applyInArrow(_add_around, "model int, body binary")
    counts = [np.zeros(1 << wide + deep, np.int64) for wide, deep in AROUND]
    for row in once.groupBy("model").applyInArrow(_add_around, "model int, body binary").collect():
        at, found = unpack(row["body"])
        counts[row["model"]][at] = found
    return counts


def fit(vocabulary: DataFrame, n_buckets: int, around: list[np.ndarray]) -> Model:
    """The model of a vocabulary (rows of bucket and blob) and the running text's counts.  What comes to the driver has a fixed size, but for a row per bucket."""
    spark = vocabulary.sparkSession
    first = n_buckets.bit_length() - 1
    totals = np.zeros((n_buckets, 2 * KINDS + 1), np.int64)
    for row in vocabulary.mapInArrow(_totals, "bucket int, totals array<long>").collect():
        totals[row["bucket"]] = row["totals"]
    blobs = vocabulary.select("body").mapInArrow(_count_bits, "model int, body binary").withColumn("part", F.spark_partition_id() % 16)
    once = blobs.groupBy("model", "part").applyInArrow(_add_tables, "model int, body binary")
    found = once.groupBy("model").applyInArrow(_add_tables, "model int, body binary").collect()
    counts = np.zeros((MODELS, 2 << BITS), np.int64)
    for row in found:
        (counts[row["model"]],) = unpack(row["body"])
    tables = spark.sparkContext.broadcast(_left_out(counts))

    def refine(batches):
        yield from _refine(*tables.value, first)(batches)

    size = GATES * (MODELS + 1)
    sums = _summed(vocabulary.select("body").mapInArrow(refine, "k int, v long"), size + 3 * LEVELS)

    def averaged(sums, gates, n, start):
        mass = sums[gates * n :]
        return np.where(mass[:, None] > 0, sums[: gates * n].reshape(gates, n) / np.maximum(mass, 1)[:, None] / 4096, start)

    known = averaged(sums[size:], LEVELS, 2, _START)
    tokens, singles = totals[:, :KINDS].sum(0), totals[:, KINDS + 1 :].sum(0)
    unseen = np.clip(singles / np.maximum(tokens, 1), 1e-4, 0.5) if tokens.sum() else np.ones(KINDS)
    # buckets without known words take no share
    some = np.flatnonzero(totals[:, KINDS])
    shares = np.full((n_buckets, KINDS), -np.inf)
    shares[some] = known_costs(some.astype(np.uint64) << _U(64 - first) if first else np.zeros(len(some), np.uint64), totals[some, :KINDS], range(0, first), known)
    zeros, ones = counts[:, 0::2], counts[:, 1::2]
    stretch = np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)
    return Model(stretch, _level(zeros[MODELS - 2] + ones[MODELS - 2]), averaged(sums[:size], GATES, MODELS, 0.3).astype(np.float32), known, tokens, unseen, shares, int(totals[:, KINDS].sum()), first, Around.of(around, known, unseen, tokens))


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores all texts, learning from those whose crc32(id as text) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word counts), score (log10
    probability of the text) and bits_per_byte of the coded text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    axes = text_axes(rows)
    deal = Deal(docs, id_col, text_col, chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes)
    n_buckets = 1 << (deal.n_buckets - 1).bit_length()
    vocabulary = settled(word_counts(rows, axes, n_buckets))
    model = fit(vocabulary, n_buckets, around_counts(rows, axes))
    shared = spark.sparkContext.broadcast(model)
    n, v = int(model.tokens.sum()), model.words

    def ask(d: Docs, _):
        keys = np.unique(_tokens(d)[1])
        for b, s in split(keys, n_buckets):
            yield b, pack(keys[s])

    def answer(key, asked, known):
        """Counts and costs in the order of the keys that a chunk asks for."""
        words = Vocabulary.of(known.column("body")[0].as_py())
        costs = np.ceil(shared.value.log_probabilities(words, key[0].as_py()) * -UNIT).astype(np.uint32)
        counts = words.counts.sum(1)
        chunks, bodies = asked.column("chunk").to_pylist(), []
        for blob in asked.column("body").to_pylist():
            at = np.searchsorted(words.keys, unpack(blob)[0])
            own = costs[at]
            own = own.astype(np.uint16) if own.size and own.max() < 1 << 16 else own
            bodies.append(pack(counts[at], *[own[:, k] for k in range(KINDS)], delta=False))
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(chunks), pa.int32()), "chunk": pa.array(chunks, pa.int32()), "body": pa.array(bodies, pa.binary())})

    requests = deal.ask(ask)
    answers = requests.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(answer, "bucket int, chunk int, body binary")
    prior = np.log(np.maximum(model.tokens, 1) / np.maximum(model.tokens, 1).sum())

    def finish(d: Docs, got) -> pa.Table:
        # buckets are ranges of keys, so their answers in order are those of all keys in order
        counts, *costs = (np.concatenate(x) for x in zip(*[unpack(body) for _, body in sorted(got, key=lambda x: x[0])], strict=True))
        _, ids, lo, hi, word = _tokens(d)
        ids, doc, last, second = _in_order(ids, word)
        _, at = np.unique(ids, return_inverse=True)
        count, costs = counts[at], np.stack([x[at] for x in costs])
        sums = np.stack([np.bincount(doc, x, d.n) for x in costs], 1) / -UNIT + prior
        top = sums.max(1)
        gains = shared.value.around.gains(ids, doc, last, second, costs, count > 0, d.n)
        score = (top + np.log(np.exp(sums - top[:, None]).sum(1)) + gains) / np.log(10)
        tokens = np.bincount(doc, minlength=d.n)
        sizes = np.bincount(word, hi - lo, d.n) + tokens
        return pa.table(
            {
                "doc_id": d.table.column("doc_id"),
                "held_out": pa.array([held_out_fold(x) == 2 for x in d.table.column("doc_id").to_pylist()]),
                "n_tokens": pa.array(tokens.astype(np.int64)),
                "n_known": pa.array(np.bincount(doc, count > 0, d.n).astype(np.int64)),
                "train_tokens": pa.array([n] * d.n, pa.int64()),
                "base_score": pa.array(np.bincount(doc, np.log10((count + 1) / (n + v + 1)), d.n)),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score * np.log2(10) / sizes),
            }
        )

    return deal.finish(answers, finish, _SCHEMA)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
