"""Removal of lines that an earlier document already has (operator 6).

Each chunk of documents sends every distinct line key once, with the first document and position that hold it.
The 128-bit keys are range-partitioned (they are uniform, so the bounds need no sampling) and sorted by key,
document and position within each partition; a stream over each partition lets the first occurrence pass and tells
the chunks of all others that an earlier document has the line.  A line that most documents share is one row per
chunk.  What comes back per document is a zlib-compressed bitmap of the lines to keep; the text itself never travels
but with its document.

Null and empty texts are one empty line, which stays; a null id counts as larger than all others; rows with equal
ids are one document.  Extra columns can be carried along under any names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.exchange import Deal, Docs

_LAST = np.iinfo(np.int64).max


def _keys(raw: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and the 16-byte key of each (None if it's too short to be looked for)."""
    lines = raw.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        line = line.strip().lower()
        n = len(line)
        short = n < least or n < 4 * least and len(line.decode("utf-8", "replace")) < least
        keys.append(None if short else xxhash.xxh3_128_digest(line))
    return lines, keys


def _first_places(d: Docs, least: int) -> dict[bytes, tuple[int, int]]:
    """For each key of a chunk the least (document id, position)."""
    ids = d.ids()
    first: dict[bytes, tuple[int, int]] = {}
    for k in range(d.n):
        own = int(ids[k])
        for at, key in enumerate(_keys(d.raw(k), least)[1]):
            if key is not None and (key not in first or (own, at) < first[key]):
                first[key] = own, at
    return first


def _stream(batches):
    """Over rows sorted by key, document and position: those of other documents than the first of each key."""
    last = None
    for batch in batches:
        high, low, owner = (np.asarray(batch.column(c)) for c in ("high", "low", "doc_id"))
        if not len(high):
            continue
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
        source = owner[first]
        if last is not None and last[:2] == (high[0], low[0]):
            source[first == 0] = last[2]
        last = high[-1], low[-1], source[-1]
        yield batch.select(["chunk", "high", "low"]).take(pa.array(np.flatnonzero(owner != source)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, with_text: bool = False, with_digest: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Which lines of each document to keep.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased.  Keys of at least ``least`` code
    points lose their lines in every document but the one with the least id.  Returns doc_id, n_lines, n_dropped,
    keep_bitmap (zlib of the bits, first line first), text (if asked for), kept_sha256, and ``rest``, a struct of the
    columns in ``carry``.
    """
    deal = Deal(docs, id_col, text_col, carry)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), deal.n_buckets)

    def places(key, table):
        first = _first_places(Docs(table), least)
        halves = np.frombuffer(b"".join(first), np.int64).reshape(-1, 2) if first else np.empty((0, 2), np.int64)
        return pa.table(
            {
                "high": pa.array(halves[:, 0]),
                "low": pa.array(halves[:, 1]),
                "doc_id": pa.array([x for x, _ in first.values()], pa.int64()),
                "pos": pa.array([x for _, x in first.values()], pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(first), pa.int32()),
            }
        )

    rows = deal.docs.groupBy("chunk").applyInArrow(places, "high long, low long, doc_id long, pos long, chunk int")
    place = (F.shiftrightunsigned("high", 32) * parts / (1 << 32)).cast("int")
    ordered = rows.repartitionById(parts, place).sortWithinPartitions("high", "low", "doc_id", "pos")
    later = ordered.mapInArrow(_stream, "chunk int, high long, low long")

    schema = "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, text string, kept_sha256 string"
    if carry:
        kinds = dict(docs.dtypes)
        schema += ", rest struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in carry) + ">"

    def apply(key, table, found):
        d = Docs(table)
        halves = np.stack([np.asarray(found.column(c).combine_chunks()) for c in ("high", "low")], 1) if found.num_rows else np.empty((0, 2), np.int64)
        packed = halves.astype(np.int64).tobytes()
        elsewhere = {packed[i : i + 16] for i in range(0, len(packed), 16)}
        first = _first_places(d, least)
        ids, absent = d.ids(), table.column("text").is_null().to_pylist()
        n_lines, n_dropped, bitmaps, texts, digests = [], [], [], [], []
        for k in range(d.n):
            raw, own = d.raw(k), int(ids[k])
            lines, keys = _keys(raw, least)
            keep = np.array([x is None or (x not in elsewhere and first[x][0] == own) for x in keys])
            dropped = len(lines) - int(keep.sum())
            if dropped:
                raw = b"\n".join(x for x, stays in zip(lines, keep, strict=True) if stays)
            n_lines.append(len(lines))
            n_dropped.append(dropped)
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            texts.append(raw.decode() if with_text and not absent[k] else None)
            digests.append(hashlib.sha256(raw).hexdigest() if with_digest else None)
        out = {
            "doc_id": table.column("doc_id"),
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
            "keep_bitmap": pa.array(bitmaps, pa.binary()),
            "text": pa.array(texts, pa.string()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if carry:
            out["rest"] = table.column("rest")
        return pa.table(out)

    return deal.docs.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(apply, schema)


def keep_mask(bitmap: bytes, n_lines: int) -> list[bool]:
    """The bits of a bitmap, for use on the document's lines."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool).tolist()


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP6_SQL = r"""
WITH lines AS (
  SELECT d.rowid AS r, d.doc_id, i AS pos, l[i] AS line,
         lower_ascii AS key
  FROM (SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u,
       LATERAL (SELECT translate(trim(l[i], E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) k
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT lines.*, length(lines.key) >= 10 AND lines.doc_id > firsts.first_doc AS gone
  FROM lines LEFT JOIN firsts ON lines.key = firsts.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM marked GROUP BY r
"""
