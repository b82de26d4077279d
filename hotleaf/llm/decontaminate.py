"""Benchmark decontamination by size-partitioned MinHash containment search (operator 8), in DataFrame functions only.

Items are short and documents long, so what matters is containment: the share of an item's distinct 5-word shingles that
the document has.  Items are partitioned by the number n of their shingles (powers of two), and a partition whose items
have at most u shingles keeps of each item the k = u - ceil(t * u) + 1 shingles with the least hashes.  A document
that contains a share t of an item lacks at most n - ceil(t * n) shingles, fewer than k, so it holds one of the kept:
the search finds every pair, whatever the document's length, and no signature of documents is needed.

*Search.*  Shingle hashes of the documents look up the kept hashes, and nothing else of the items.  The kept hashes are
broadcast in blocks of at most ``BLOCK_ROWS`` rows (40 bytes each); a larger benchmark is searched block by block, so no
shingle of a document is ever shuffled.  Hits become (document, item) candidates within the task that read the document, so
a passage that a third of all documents have doesn't pile up anywhere.

*Verification.*  Candidates alone meet the texts again, and the item's shingles that the document has are counted
as words, not as hashes.

Words are runs of letters and digits, lower-cased.  Texts of fewer than five words have one shingle, all their
words, which only an equal text shares.  Null and empty texts have none.  A document is its id and text (a null id is a
value like any other): texts under one id, or under none, are judged each for itself, and rows with equal id and text
are one document.  The same holds for items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.shared import settled, small

SHINGLE = 5
CONTAINED = 0.8
#: Kept hashes of one broadcast (rows of at most 40 bytes).
BLOCK_ROWS = 500_000
#: The key of a text: two 64-bit hashes.
KEY = ["__k1", "__k2"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def text_key(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(1), text).alias(KEY[1])]


def _places() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))


def _gram(at: Column) -> Column:
    return F.concat_ws(" ", *[F.get("words", at + k) for k in range(SHINGLE)])


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", share: float = CONTAINED) -> DataFrame:
    """(item_id, item, grams, n_shingles, kept): an item's distinct shingles, and the hashes that its sketch keeps."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), _words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item_id", F.array_distinct(F.transform(_places(), _gram)).alias("grams"))
    rows = rows.select("item_id", F.xxhash64("item_id", "grams").alias("item"), F.array_sort("grams").alias("grams")).dropDuplicates(["item_id", "item", "grams"])
    hashes = F.array_sort(F.transform("grams", lambda g: F.xxhash64(*[F.get(F.split(g, " "), F.lit(k)) for k in range(SHINGLE)])))
    size = F.size("grams")
    upper = F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int")
    keep = upper - F.ceil(F.lit(share) * upper - F.lit(1e-9)).cast("int") + 1
    return rows.select("item_id", "item", "grams", size.cast("long").alias("n_shingles"), F.slice(hashes, F.lit(1), keep).alias("kept"))


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, key, item): each document of (doc_id, key, words) that holds a kept hash of an item."""
    kept = settled(sketches.select("item", F.explode("kept").alias("hash")))
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    found = None
    grams = docs.select("doc_id", *KEY, "words", F.explode(_places()).alias("place")).select("doc_id", *KEY, F.xxhash64(*[F.get("words", F.col("place") + k) for k in range(SHINGLE)]).alias("hash"))
    for block in range(blocks):
        part = kept.where(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else kept
        pairs = grams.join(F.broadcast(part), "hash").select("doc_id", *KEY, "item").distinct()
        found = pairs if found is None else found.union(pairs)
    return found.distinct() if blocks > 1 else found


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = CONTAINED, with_key: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) for all pairs with containment of at least ``share``.

    n_shingles counts the item's distinct 5-word shingles, n_common those that the document has.  ``with_key`` adds the
    key of the document's text.
    """
    text = F.col(f"`{text_col}`")
    sketches = settled(item_sketches(items, share=share))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *text_key(text), text.cast("string").alias("text"))
    found = settled(candidates(rows.select("doc_id", *KEY, _words(F.col("text")).alias("words")), sketches))
    asked = found.join(small(sketches.select("item", "item_id", "grams", "n_shingles")), "item")
    own = found.select(F.col("doc_id").alias("__id"), *KEY).distinct()
    texts = rows.join(small(own), [rows["doc_id"].eqNullSafe(own["__id"]), *[rows[k] == own[k] for k in KEY]], "left_semi").dropDuplicates(["doc_id", *KEY])
    # words are cut below the join, once a text, and not once a shingle; the few texts may be long, so they aren't broadcast
    texts = texts.select(F.col("doc_id").alias("__id"), *[F.col(k).alias(f"{k}_") for k in KEY], _words(F.col("text")).alias("words"))
    pairs = asked.join(texts.hint("merge"), [F.col("doc_id").eqNullSafe(F.col("__id")), *[F.col(k) == F.col(f"{k}_") for k in KEY]])
    pairs = pairs.withColumn("held", F.transform(_places(), _gram))
    pairs = pairs.select("doc_id", *KEY, "item_id", "n_shingles", F.size(F.array_intersect("grams", "held")).cast("long").alias("n_common"))
    pairs = pairs.withColumn("containment", F.col("n_common") / F.col("n_shingles")).where(F.col("containment") >= share)
    return pairs.select("doc_id", "item_id", "n_shingles", "n_common", "containment", *(KEY if with_key else []))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(docs, items)


def _sql_shingles(table: str, key: str) -> str:
    return rf"""
  SELECT {key}, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM {table}) s,
       LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 2))) AS i) u
  WHERE len(words) > 0"""


OP8_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, g FROM ({_sql_shingles("documents", "doc_id")}) x),
b AS (SELECT DISTINCT item_id, g FROM ({_sql_shingles("benchmark", "item_id")}) x),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, n.n_shingles, count(*) AS n_common, CAST(count(*) AS DOUBLE) / n.n_shingles AS containment
FROM d JOIN b ON d.g = b.g JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id, n.n_shingles HAVING count(*) >= 0.8 * n.n_shingles
"""
