"""Source divergence audit by upper-bound term search.

A term's likelihood in a source or a language is a whole number of billionths with
add-one smoothing; what a term gives to the divergence of p from q is
f(p, q) = floor((p - q)^2 / q). All of it is exact in longs and decimals.

Terms of a source (part `term`). Terms of a source with the same count have the same
p, and f falls as q grows below p. So the terms of a source are put in buckets by
their count, each with the extremes of its terms' language likelihoods: f at the
least q bounds the bucket from above. Buckets are evaluated best bound first: a round
takes buckets until they hold TOP terms for each source, the next rounds
WIDER times as many; a source is done once every unseen bound is strictly below its
TOP-th value, or nothing is left. Only what the buckets of a round hold is read from
the stored postings, and what has been found is at most TOP rows a source.

Pairs of sources (part `pair`). With a and b the sources of a language, summing over
all kept terms, most of which one of the two lacks, is
    sum over a's counts of f(p, b's p of none) * terms + the same for b
    + (V - terms of a - terms of b) * f(none, none)
    + over the postings that both have: f(p, q) - f(p, none) - f(none, q) + f(none, none)
so a term costs the pairs of the sources that have it, summed before the shuffle.
Terms are counted in each task before they are dealt by language and term.

Defined cases: null text, lang and source are empty strings, and groups of their
own; every row is a document, repeated rows included; a text without terms adds its
group alone; a lang without kept terms has pairs with value 0 and no terms; a lang
with one source has no pairs; ties rank by the item's bytes; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import release, table, written

#: Bytes below 128 that are no letters part terms; A-Z become a-z, all others stay.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 400_000
#: Sources that are broadcast.
FEW_SOURCES = 100_000
LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: A round evaluates so many times as many terms of a source as the one before.
WIDER = 8


def _p(count: str, total: str, kept: str = "v") -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); decimals where a long can't hold it."""
    small = f"{SCALE}L * ({count} + 1) div ({total} + {kept})"
    large = f"cast(cast({SCALE} as decimal(19,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} + {kept} as decimal(20,0)) as bigint)"
    return F.expr(f"1 + case when {count} < 9000000000 then {small} else {large} end")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), summed
    over what a task has read; a term may have several rows."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())]
            if len(n):
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for at, (lang, source, body) in enumerate(zip(*[batch.column(c) for c in ("lang", "source", "body")], strict=True)):
                if at % 256 == 0 and sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from told(held)
                    held = {}
                terms = body.as_py().translate(TERM_BYTES).split(b" ")
                n, docs_ = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                own = Counter(terms)
                own.pop(b"", None)
                n.update(own)
                docs_.update(own.keys())
        yield from told(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, lang_n, held (source, n): a row for each term that a language
    keeps. All sums are made where one shuffle by language and term has put them."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def groups(docs: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each (lang, source): total and terms of the source; lang_total and v
    (kept terms) of the language; none, the likelihood of a term without occurrences."""
    here = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = held.select("lang", F.explode("held").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"), F.count(F.lit(1)).alias("terms"))
    lang = held.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    out = here.join(own, ["lang", "source"], "left").join(F.broadcast(lang), "lang", "left").na.fill(0, ["total", "terms", "lang_total", "v"])
    return out.withColumn("none", F.when(F.col("v") > 0, _p("0L", "total")).otherwise(0))


def likelihoods(held: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, term, n, p (of the source), q (of the language), none."""
    flat = held.select("lang", "term", "lang_n", F.explode("held").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    known = sources.select("lang", "source", "total", "lang_total", "v", "none")
    few = known.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    met = flat.join(F.broadcast(known) if few else known, ["lang", "source"])
    return met.select("lang", "source", "term", "n", _p("n", "total").alias("p"), _p("lang_n", "lang_total").alias("q"), "none")


def pairs(valued: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the sum of f over all kept terms."""
    # The postings of a term: a source each. Two of them are a pair, summed in the row's task.
    lists = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("held"))
    each = lists.select("lang", "held", F.explode("held").alias("x")).select("lang", "x", F.explode("held").alias("y")).where("x.source <> y.source")
    each = each.select("lang", "x.source", F.col("y.source").alias("item"), "x.p", F.col("y.p").alias("q"), "x.none", F.col("y.none").alias("absent"))
    both = each.groupBy("lang", "source", "item").agg(F.sum(_f("p", "q") - _f("p", "absent") - _f("none", "q") + _f("none", "absent")).alias("value"))
    # Counts of a source and how many of its terms have them meet the other sources of the language.
    counts = valued.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("m"))
    a = sources.select("lang", "source", "v", "terms", F.col("none").alias("p0"))
    b = sources.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("none").alias("q0"))
    forth = counts.join(b, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(_f("p", "q0") * F.col("m")).alias("value"))
    turned = counts.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(a, "lang").where("source <> item")
    back = turned.groupBy("lang", "source", "item").agg(F.sum(_f("p0", "q") * F.col("m")).alias("value"))
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("item_terms")) * F.expr("(p0 - q0) * (p0 - q0) div greatest(q0, 1L)")).otherwise(0)
    none = a.join(b, "lang").where("source <> item").select("lang", "source", "item", rest.alias("value"))
    return both.unionByName(forth).unionByName(back).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def top_terms(valued: DataFrame, top: int = TOP, wider: int = WIDER) -> DataFrame:
    """lang, source, item (a term), value, rank up to `top`: best buckets first."""
    valued = valued.withColumnRenamed("term", "item")
    buckets = valued.where("p > q").groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.min("q").alias("low"), F.count(F.lit(1)).alias("m"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("lang", "source", "n", _f("p", "low").alias("bound"), "m")
    buckets = written(buckets.withColumn("before", F.coalesce(F.sum("m").over(best), F.lit(0))))
    found, wanted, seen = None, top, 0
    while True:
        # Of the sources that are not done, the buckets that start within the next `wanted` terms.
        turn = buckets.where((F.col("before") >= seen) & (F.col("before") < wanted))
        after = buckets.where(F.col("before") >= wanted).groupBy("lang", "source").agg(F.max("bound").alias("unseen"))
        if found is not None:
            turn = turn.join(found.where("open").select("lang", "source").distinct(), ["lang", "source"], "left_semi")
        fresh = valued.where("p > q").join(turn.select("lang", "source", "n"), ["lang", "source", "n"], "left_semi").select("lang", "source", "item", _f("p", "q").alias("value"))
        all_ = fresh if found is None else fresh.unionByName(found.select("lang", "source", "item", "value"))
        ranked = _ranked(all_).where(F.col("rank") <= top)
        kth = F.min(F.when(F.col("rank") == top, F.col("value"))).over(Window.partitionBy("lang", "source"))
        more = F.col("unseen").isNotNull() & (F.col("kth").isNull() | (F.col("unseen") >= F.col("kth")))
        state = written(ranked.withColumn("kth", kth).join(after, ["lang", "source"], "left").withColumn("open", more).select("lang", "source", "item", "value", "rank", "open"))
        if found is not None:
            release(found)
        found, seen, wanted = state, wanted, wanted * wider
        if not found.where("open").limit(1).count():
            break
    out = written(found.select("lang", "source", "item", "value", "rank"))
    release(buckets, found)
    return out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    held = written(postings(docs, least_docs))
    sources = written(groups(docs, held))
    valued = written(likelihoods(held, sources))
    near = _ranked(pairs(valued, sources)).withColumn("part", F.lit("pair"))
    terms = top_terms(valued, top)
    out = near.unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")
    out = written(out)
    release(held, sources, valued, terms)
    return out


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same in SQL, densely: every kept term meets every pair of sources.
ORACLE = {
    "op13_divergence": r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), occurrences as (
  select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term, count(*) as n from occurrences group by lang, term having count(distinct d) >= 3
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), sources as (
  select distinct lang, source from docs
), counts as (
  select o.lang, o.source, o.term, count(*) as n from occurrences o join kept k on o.lang = k.lang and o.term = k.term group by 1, 2, 3
), totals as (
  select s.lang, s.source, coalesce(sum(c.n), 0) as total from sources s left join counts c on s.lang = c.lang and s.source = c.source group by 1, 2
), given as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.total + l.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) as lang_p
  from totals t join kept k on t.lang = k.lang join langs l on t.lang = l.lang
  left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
), pair_sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from given a join given b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value
  from sources a join sources b on a.lang = b.lang and a.source <> b.source
  left join pair_sums p on p.lang = a.lang and p.source = a.source and p.item = b.source
), terms as (
  select lang, source, term as item, ((p - lang_p) * (p - lang_p)) // lang_p as value from given where n > 0 and p > lang_p
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (
    select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms
  ) where rank <= 200
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked
""",
}
