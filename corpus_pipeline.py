"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of ``docs``; the
last returns packed pieces.  The near-dedup stage decides per row: ids may be missing (and count last) or repeat.  Other columns, and more than documents has, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotleaf.llm.decontaminate import KEY, contained_items, text_key
from hotleaf.llm.line_dedup import drop_repeated_lines
from hotleaf.llm.near_copies import keyed, near_copies
from hotleaf.llm.packing import pack_pieces, pieces
from hotleaf.llm.quality_rules import ledger, passes
from hotleaf.llm.shared import settled, small


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules of policy v1."""
    return ledger(docs, carry=docs.columns).where(passes("v1")).select("keep.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    rows = drop_repeated_lines(docs, with_text=True, with_digest=False, carry=others)
    out = {c: F.col(f"rest.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(out["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[out[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word Jaccard similarity of 0.8 or more the row with the least id."""
    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text"))
    rows = rows.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(0))).withColumn("__none", F.isnull("doc_id"))
    at = ["__none", "__id", "__key"]
    roots = near_copies(rows).select(F.col("u").alias("__key"), "v")
    named = rows.select(*at).join(roots, "__key", "left").withColumn("root", F.coalesce("v", "__key"))
    first = named.groupBy("root").agg(F.min(F.struct(*at)).alias("least")).select("least.*")
    once = Window.partitionBy(*at).orderBy(F.to_json(F.col("__row").dropFields("text")))
    return rows.join(first, at, "left_semi").withColumn("__nth", F.row_number().over(once)).where("__nth = 1").select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; texts under one id, or under none, are judged each for itself."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = settled(contained_items(docs, items, with_key=True).select(F.col("doc_id").alias(f"{KEY[0]}id"), *KEY).distinct())
    own = dict(zip(KEY, text_key(F.col("text")), strict=True))
    same = [F.col("doc_id").eqNullSafe(F.col(f"{KEY[0]}id")), *[own[k] == F.col(k) for k in KEY]]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id"), F.col("text"))
    return kept.join(small(leaks), same, "left_anti").select("__row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return pack_pieces(pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL has no tokenizer and no best-fit packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
    return docs
