"""Quality rules in a bitmask ledger (operator 3), in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.  A policy is
a versioned set of rules, that is a mask: a document passes if it fails none of them.  So policies are applied, compared and
ablated over the ledger by bitwise arithmetic, without another look at the texts.

Null texts have no words (and fail ``few_words``); empty ones likewise.  Rows that repeat are judged one by one; other
columns are carried along untouched if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a set of characters and as a regular expression.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` is an SQL condition over the measurements."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 25 * n_words"),
    Rule("no_letters", 6, "2 * n_letters < word_chars"),
)

#: Versioned policies: names of rules.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "no_letters"),
}


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def measured(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The measurements, beside ``keep``, a struct of the columns in ``carry``."""
    kept = F.struct(*[F.col(f"`{c}`") for c in carry or [text_col]]).alias("keep")
    rows = docs.select(kept, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("keep", "text", words(F.col("text")).alias("words"))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"))
    windows = F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    rows = rows.select(
        "keep",
        "text",
        "n_words",
        F.array_join("words", "").alias("joined"),
        F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter(F.split("text", "\n", -1), _solid).alias("lines"),
    )
    # only texts in which some window repeats are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(
        "keep",
        "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("joined", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    again = F.filter("ordered", lambda x, k: F.coalesce((k > 0) & (F.get("ordered", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.select(*[c for c in rows.columns if c != "ordered"], F.when(F.col("ordered").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))).alias("at"))
    gaps = F.transform("at", lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("at", k - 1))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return rows.select(*[c for c in rows.columns if c != "at"], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    rows = measured(docs, text_col, carry)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    # a condition that holds but isn't constant: a filter on the bits must not be moved below, where it would evaluate
    # every rule anew, and the array expressions once per element
    return rows.withColumn("failed_bits", F.when(F.spark_partition_id() >= 0, bits).otherwise(F.lit(0).cast("long")))


def passes(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many would pass without it."""
    whole = mask(policy)
    own = F.col("failed_bits").bitwiseAND(F.lit(whole))
    named = [r for r in RULES if r.name in POLICIES[policy]]
    counts = [F.sum(F.when(own.bitwiseAND(F.lit(1 << r.bit)) != 0, 1).otherwise(0)).alias(f"f{r.bit}") for r in named]
    alone = [F.sum(F.when(own == F.lit(1 << r.bit), 1).otherwise(0)).alias(f"a{r.bit}") for r in named]
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_or(own).alias("seen_bits"), *counts, *alone)
    per_rule = [F.struct(F.lit(r.name).alias("rule"), F.coalesce(f"f{r.bit}", F.lit(0)).alias("n_failed"), F.coalesce(f"a{r.bit}", F.lit(0)).alias("n_only_failed")) for r in named]
    return total.select("n", F.explode(F.array(*per_rule)).alias("r")).select(F.lit(policy).alias("policy"), "n", "r.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ledger(docs, carry=["doc_id"])
    return rows.select("keep.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "n_lines", "n_letters", "failed_bits")


OP3_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i) u
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM repeated, LATERAL (SELECT unnest(range(i, i + 5)) AS p) u GROUP BY r
), m AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(array_to_string(words, ''), '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.r = covered.r
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
         + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, n_lines, n_letters, failed_bits FROM f
"""
