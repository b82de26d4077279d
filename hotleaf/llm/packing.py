"""Best-fit packing of documents into fixed-length sequences by hierarchical residual packing (operator 5).

Tokenizing yields one small row per piece.  Each partition of pieces is packed best-fit, longest first; bins that
are nearly full, or that not even the shortest piece could still enter, are final.  The other bins become items of
their own (a bin travels whole, with its pieces), are dealt into a quarter as many groups, and are packed again,
until one group is left or hardly anything moves.  A group has a bounded number of items, and what climbs the tree are
underfull bins only, so no task sees more than its share.

A null or empty text has no ids but the end mark and makes one piece of length one.  Rows that repeat are packed
as documents of their own.
"""

from __future__ import annotations

import codecs
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.shared import settled

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Bins with at most so many free places are final.
SLACK = 8
GROUP_ITEMS = 50_000
_CACHED_WORDS = 600_000
_STEP_BYTES = 4 << 20
#: How the vocabulary cuts a lower-cased word into pieces (a fixed value of the vocabulary file).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words in which normalization changes nothing but case, character by character, and no special token begins.
_PLAIN = regex.compile(r"[!-;=-~\u00A1-\u012F\u0132-\u0148\u014A-\u017E]+")
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))


class WordIds:
    """Ids of whitespace-separated words, which the tokenizer never joins, kept as little-endian bytes per word."""

    open: dict[str, WordIds] = {}

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.words: dict[bytes, bytes] = {}
        self.marks = {m: self.piece(m) for m in (b".", b",")}

    @classmethod
    def of(cls, file: str) -> WordIds:
        if file not in cls.open:
            cls.open[file] = cls(file)
        return cls.open[file]

    def piece(self, lowered: bytes) -> bytes:
        ids = [x.id for x in self.tokenizer.model.tokenize(codecs.charmap_decode(lowered, "strict", _SHOWN)[0])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def letters(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin-1 letters alone, which is one piece; None for other words."""
        if word.isalpha():
            return self.piece(word.lower())
        text = word.decode()
        if not text.isalpha():
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.piece(text.lower().encode())

    def encode(self, word: bytes) -> bytes:
        last = self.marks.get(word[-1:])
        known = self.letters(word if last is None else word[:-1])
        if known is not None:
            return known if last is None else known + last
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self.words.get(p) or self.piece(p) for p in map(str.encode, _PIECES.findall(text.lower()))])

    def table(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of all the words; those that come first are remembered, up to a number, and the others made anew."""
        known, encode = self.words, self.encode
        new = {w: encode(w) for w in words if w not in known}
        if len(known) + len(new) <= _CACHED_WORDS:
            known.update(new)
            return known
        return {w: known.get(w) or new[w] for w in words}


def tokenized(texts: list[str | None], file: str):
    """The ids of each text and the end mark, as little-endian unsigned 32-bit bytes."""
    words_of = WordIds.of(file)
    end = struct.pack("<I", END)
    at = 0
    while at < len(texts):
        rows, size = [], 0
        while at < len(texts) and size < _STEP_BYTES:
            raw = (texts[at] or "").encode()
            rows.append(raw.split())
            size += len(raw)
            at += 1
        table = words_of.table(set().union(*rows))
        for words in rows:
            yield b"".join([table[w] for w in words]) + end


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): texts longer than ``capacity`` ids are cut, no others."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    file = file or vocabulary()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenized(batch.column(1).to_pylist(), file), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(columns, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(columns[5]), "<u4").astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[3])]).astype(np.int32)), flat))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the bin with the least room that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = open_rooms >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_rooms ^= 1 << free
        else:
            free, b, n = capacity, n, n + 1
        bins[item], offsets[item] = b, capacity - free
        if free > size:
            room[free - size].append(b)
            open_rooms |= 1 << (free - size)
    return bins, offsets


_BIN = "used long, final boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _packed(table: pa.Table, capacity: int, least: int) -> pa.Table:
    """Packs items (used, members) into bins."""
    used = np.asarray(table.column("used").combine_chunks()).astype(np.int64)
    bins, offsets = best_fit(used, capacity)
    n = int(bins.max()) + 1 if len(bins) else 0
    filled = np.bincount(bins, used, n).astype(np.int64)
    order = np.lexsort((offsets, bins))
    lists = table.column("members").combine_chunks().take(pa.array(order))
    flat = lists.flatten()
    sizes = np.diff(np.asarray(lists.offsets))
    moved = np.asarray(flat.field("offset")) + np.repeat(offsets[order], sizes)
    fields = [flat.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    members = pa.StructArray.from_arrays([*fields, pa.array(moved, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "offset"])
    per_bin = np.bincount(bins[order], sizes, n).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    free = capacity - filled
    return pa.table(
        {
            "used": pa.array(filled),
            "final": pa.array(free <= max(SLACK, least - 1)),
            "members": pa.ListArray.from_arrays(pa.array(edges), members),
        }
    )


def _again(capacity: int, least: int):
    def run(key, table):
        return _packed(table, capacity, least)

    return run


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, fan_in: int = 4, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Rounds go on until one group is left, or a round joins fewer than one bin in a thousand: best-fit leaves at most
    one bin in a group of ``group_items`` that is half full or emptier.  Sequences are numbered at the end, by partition
    and place in it, over the checkpointed bins of all rounds.
    """
    rows = settled(rows)
    least = rows.agg(F.min("length")).first()[0] or 1
    items = rows.select(F.col("length").alias("used"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))).alias("members"))

    def first(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 4 * group_items:
                yield from _packed(pa.Table.from_batches(held), capacity, least).to_batches()
                held, count = [], 0
        if count:
            yield from _packed(pa.Table.from_batches(held), capacity, least).to_batches()

    level, packed = 0, settled(items.mapInArrow(first, _BIN))
    done = packed.where("final")
    left, before = packed.where("not final"), None
    groups = packed.rdd.getNumPartitions()
    while True:
        n = left.count()
        if not n or (groups == 1 and level) or before is not None and n > 0.999 * before and groups > 1 and n > group_items:
            numbered = done.union(left).select(F.monotonically_increasing_id().alias("sequence_id"), "members")
            return numbered.select(F.explode("members").alias("m"), "sequence_id").select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
        before, level = n, level + 1
        groups = max(1, -(-n // group_items), groups // fan_in if n > 64 * groups else 1)

        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)).cast("int")).select("group", "used", "members")
        packed = settled(dealt.groupBy("group").applyInArrow(_again(capacity, least), _BIN))
        done, left = done.union(packed.where("final")), packed.where("not final")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_pieces(pieces(docs))
