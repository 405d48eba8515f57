"""Filter interaction audit by lattice edges.

A document's failures are a mask of the filters that it fails. The lattice has an
edge for each set of filters that have been applied and each next filter: 16 sets
times five filters, 80 edges. Masks are counted first (at most 32 for each part),
each mask then contributes its count to the edges, and an order of the filters is
a path of five edges: 120 orders, 600 steps. What a step counts is what its edge
counts, so the edges are joined to the steps and no document meets an order.

The copies of a text differ in E alone: rows equal in id, text and part are one
row with a count, the least id of each text is found on digests, and one join by
text and id marks the rows that hold it, so a text that very many rows share is
not one task's work. Texts never move, SHA-256 digests of 32 bytes do.

Defined cases: a null or empty text has no words (A fails, B and C don't); null
and empty texts are identical; every row is a document, repeated rows included,
and rows that share the least doc_id of a text all pass E; a null doc_id is not
smaller than any other, has no smaller one and no labels; a document is good or
toxic if any of its labels says so; a null lang is the part of the empty string;
an empty table has no parts; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import table

#: Filters in the order of their bits.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
WORDS, DISTINCT, UPPER, MARKS = 100, 80, 10, r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _bits(fails: list[Column]) -> Column:
    out = F.lit(0)
    for i, x in enumerate(fails):
        out = out + F.when(x, 1 << i).otherwise(0)
    return out


def text_failures(text: Column) -> Column:
    """Mask of A to D."""
    # The words are bound once by the outer function.
    words = F.array_remove(F.split(text, SPACE), "")
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"))), 0)
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    over = lambda s: _bits([s["n"] < WORDS, 100 * s["different"] < DISTINCT * s["n"]])
    few = F.get(F.transform(F.array(sizes), over), 0)
    return few + F.when(100 * upper > UPPER * F.char_length(text), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the
    filters of the mask, and how many of them are good and toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"),
    ).groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    least = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("least"))
    first = least.select("digest", F.col("least").alias("id"), F.lit(True).alias("first"))
    # Rows without an id are dealt by text, and meet nothing.
    deal = F.when(F.col("id").isNull(), F.xxhash64("digest").bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("bigint")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).withColumn("deal", F.lit(0).cast("bigint"))
    met = rows.join(first, ["digest", "id"], "left").withColumn("deal", deal).join(known, ["id", "deal"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return met.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def on_edges(counted: DataFrame) -> DataFrame:
    """Each row of `counted` once for each of the 80 edges: applied (mask of the
    filters before), next (a filter), paths (orders through the edge)."""
    n = len(FILTERS)
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("next"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("applied"))
    before = F.bit_count("applied")
    return each.where("(applied & shiftleft(1, next)) = 0").withColumn("paths", F.factorial(before) * F.factorial(F.lit(n - 1) - before))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, applied mask, filter) of the 600 steps."""
    return [("".join(FILTERS[f] for f in order), i + 1, sum(1 << g for g in order[:i]), f) for order in permutations(range(len(FILTERS))) for i, f in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, one row for each step of
    each order in each part."""
    spark = docs.sparkSession
    bit = F.expr("shiftleft(1, next)")
    fails, passed = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) == 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    # Each part has masks, so each of its 80 edges has a row, with zeros where no mask contributes.
    held = on_edges(masks(docs, labels)).groupBy("part", "applied", "next", "paths").agg(
        count(passed & ~fails).alias("kept"), count(passed & fails).alias("removed"), count(~passed & fails).alias("redundant"),
        count(F.col("mask") == bit).alias("unique_fails"), count(passed & fails, "good").alias("good_lost"), count(passed & fails, "toxic").alias("toxic_lost"),
    )
    share = held.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    path = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int"))
    return held.join(path, ["applied", "next"]).join(share, ["part", "next"]).select("part", "filter_order", "step", *COUNTS)


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same in SQL: one row for each document and step, without the lattice.
ORACLE = {
    "op11_filters": r"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), words as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs
), least as (
  select text, min(doc_id) as first_id from docs group by text
), marked as (
  select part,
    len(w) < 100 as "A", 100 * len(list_distinct(w)) < 80 * len(w) as "B",
    100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 10 * length(d.text) as "C",
    regexp_matches(d.text, '[#$%&*|]') as "D", coalesce(d.doc_id > l.first_id, false) as "E",
    coalesce(k.good, false) as good, coalesce(k.toxic, false) as toxic
  from words d join least l on d.text = l.text
  left join (
    select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
  ) k on d.doc_id = k.doc_id
), masks as (
  select part, "A"::int + 2 * "B"::int + 4 * "C"::int + 8 * "D"::int + 16 * "E"::int as mask, count(*) as n,
    sum(good::int) as good, sum(toxic::int) as toxic
  from marked group by 1, 2
), letters as (
  select 'A' as f, 1 as bit union all select 'B', 2 union all select 'C', 4 union all select 'D', 8 union all select 'E', 16
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, a.bit as b1, b.bit as b2, c.bit as b3, d.bit as b4, e.bit as b5
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps as (
  select filter_order, 1 as step, 0 as applied, b1 as bit from orders
  union all select filter_order, 2, b1, b2 from orders
  union all select filter_order, 3, b1 + b2, b3 from orders
  union all select filter_order, 4, b1 + b2 + b3, b4 from orders
  union all select filter_order, 5, b1 + b2 + b3 + b4, b5 from orders
), counted as (
  select part, filter_order, step, bit,
    sum(case when (mask & applied) = 0 and (mask & bit) = 0 then n else 0 end) as kept,
    sum(case when (mask & applied) = 0 and (mask & bit) <> 0 then n else 0 end) as removed,
    sum(case when (mask & applied) <> 0 and (mask & bit) <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when (mask & applied) = 0 and (mask & bit) <> 0 then good else 0 end) as good_lost,
    sum(case when (mask & applied) = 0 and (mask & bit) <> 0 then toxic else 0 end) as toxic_lost
  from masks, steps group by part, filter_order, step, bit
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from counted
""",
}
