"""Entropy balancing of sources to target weights.

Document rates minimise the relative entropy sum (r log r - r + 1) over all
documents under one token constraint for each source, sum r * size = target, and
r <= MOST. The convex dual has one multiplier for each constraint and gives the
exponential tilt r = min(MOST, exp(lambda * x)) with the feature x = size over the
source's mean size, so a source that grows takes its long documents more often
and a source that shrinks gives up long ones first. Newton iterations solve it,
each one distributed aggregate over (source, size); a step that leaves the bracket
of the root is replaced by its middle, and a dual that doesn't converge is an error.

Rates become copies. Documents of one source and size are a class with one rate;
classes take whole copies in descending size and hand what is left to the next
(error diffusion), so a source ends within half of a small document of its target,
as long as small documents can take the rest.
Inside a class the copies are dealt evenly by running numbers. The numbers come
from parts of about PART_ROWS rows (a salt by the documents' hash), and equal rows
are one row with a count, so neither a hot source, nor a hot size, nor a row that
is repeated very often meets in one task.

The table of sources (a row each, pre-aggregated) is brought to the driver; at
most MAX_SOURCES rows, else an error. Diffusion reads the classes of a source and
of a block of BLOCK sizes in one task: at most BLOCK rows. Documents stay
distributed.

Defined cases: a null text has size 0 and takes 0; sources sort by code point,
null last; a source without words has target 0; repeated rows are documents of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import release, table, written

MAX_SOURCES = 1_000_000
PART_ROWS, BLOCK = 8192, 1 << 16
#: A rate never exceeds this many copies.
MOST = 2
#: Share of a target by which the dual may miss it; rounding to copies errs more.
MISS = 1e-7


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), row (tells repeated ids apart),
    m: how many rows are equal in these."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("bigint").alias("size"), F.xxhash64(text).alias("row"))
    return rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("m"))


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight; a share stops at most * size and the excess
    is shared again by weight until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = sorted(i for i in open_ if unit * weights[i] > most * sizes[i])
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
        left = max(left, 0.0)
    return out


def solve(sums: DataFrame, goals: dict[int, float], most: float = MOST, steps: int = 60) -> tuple[dict[int, float], int]:
    """Multipliers of the dual and the number of iterations. `sums`: s (number of
    the constraint), x (feature), size, n. Each iteration is one distributed
    aggregate giving the gradient and the diagonal Hessian of the open constraints.
    A goal at `most` times all sizes has the multiplier infinity."""
    spark = sums.sparkSession
    first = sums.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("mass"), F.sum(F.col("x") * F.col("size") * F.col("n")).alias("slope")).collect()
    lam, low, high = {}, {}, {}
    for r in first:
        ratio = goals[r.s] / r.mass
        if ratio >= most * (1 - 1e-12):
            lam[r.s] = math.inf
        else:
            lam[r.s] = math.log(ratio) * r.mass / r.slope
            low[r.s], high[r.s] = (-math.inf, 0.0) if ratio < 1 else (0.0, math.inf)
    open_ = {s for s in low if lam[s]}
    for step in range(1, steps + 1):
        if not open_:
            return lam, step - 1
        held = spark.createDataFrame([(s, float(lam[s])) for s in sorted(open_)], "s int, lam double")
        tilt = F.exp(F.col("lam") * F.col("x"))
        mass = F.col("size") * F.col("n")
        found = (
            sums.join(F.broadcast(held), "s").groupBy("s")
            .agg(F.sum(mass * F.least(tilt, F.lit(float(most)))).alias("got"), F.sum(F.when(tilt < most, mass * tilt * F.col("x")).otherwise(0.0)).alias("slope")).collect()
        )
        for r in found:
            s, miss = r.s, goals[r.s] - r.got
            if abs(miss) <= MISS * goals[s]:
                open_.discard(s)
                continue
            if miss > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            new = lam[s] + miss / r.slope if r.slope > 0 else math.nan
            if not low[s] < new < high[s]:
                ends = (low[s], high[s])
                new = 2 * lam[s] if any(map(math.isinf, ends)) else sum(ends) / 2
            lam[s] = new
    raise ArithmeticError(f"the dual of {len(open_)} sources did not converge in {steps} iterations")


def _diffuse(classes: DataFrame) -> DataFrame:
    """s, size, n, rate, debt -> with `take`, the copies of each class, and
    `left`, the words that the last class of a group still owes (0 elsewhere)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        take, left, debt = np.zeros(len(group), np.int64), np.zeros(len(group)), float(group.debt.iloc[0])
        for i, (size, n, rate) in enumerate(zip(group["size"].tolist(), group.n.tolist(), group.rate.tolist(), strict=True)):
            if size:
                want = debt + n * rate * size
                take[i] = min(MOST * n, max(0, math.floor(want / size + 0.5)))
                debt = want - take[i] * size
        left[-1] = debt
        return group.assign(take=take, left=left)[["s", "size", "n", "take", "left"]]

    return classes.withColumn("block", F.floor(F.col("size") / BLOCK)).groupBy("s", "block").applyInPandas(run, "s int, size bigint, n bigint, take bigint, left double")


def shares(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, source, size, row, source_size, target, m (equal rows), total
    (copies that they take together): one row for each different row."""
    spark = docs.sparkSession
    rows = written(sized(docs))
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(per))]
    sizes = [r["size"] for r in per]
    goals = targets(sizes, w, share * sum(sizes))
    listed = [(i, r.source, r["size"], goals[i]) for i, r in enumerate(per)]
    sources = F.broadcast(spark.createDataFrame(listed, "s int, source_ string, source_size bigint, target double"))
    parts = max(1, math.ceil(sum(r.rows for r in per) / PART_ROWS))
    placed = rows.join(sources, rows.source.eqNullSafe(F.col("source_"))).drop("source_")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts)).cast("int"))
    means = F.broadcast(spark.createDataFrame([(i, max(r["size"], 1) / r.rows) for i, r in enumerate(per)], "s int, mean double"))
    classes = placed.groupBy("s", "size").agg(F.sum("m").alias("n")).join(means, "s").withColumn("x", F.col("size") / F.col("mean")).drop("mean")
    classes = written(classes)
    lam, _ = solve(classes.where("size > 0"), {i: g for i, g in enumerate(goals) if sizes[i]})
    # Infinity times x > 0 gives the rate MOST; classes of size 0 take nothing.
    tilt = F.broadcast(spark.createDataFrame([(i, float(lam.get(i, 0.0))) for i in range(len(per))], "s int, lam double"))
    rated = classes.join(tilt, "s").withColumn("rate", F.when(F.col("size") > 0, F.least(F.exp(F.col("lam") * F.col("x")), F.lit(float(MOST)))).otherwise(0.0))
    rated = rated.select("s", "size", "n", "rate")
    large = written(_diffuse(rated.where(F.col("size") >= BLOCK).withColumn("debt", F.lit(0.0))))
    owed = F.broadcast(large.groupBy("s").agg(F.sum("left").alias("owed")))  # a row a source
    small = rated.where(F.col("size") < BLOCK).join(owed, "s", "left").withColumn("debt", F.coalesce("owed", F.lit(0.0))).drop("owed")
    taking = _diffuse(small).unionByName(large).select("s", "size", "n", "take")
    # The first number of each part of a class: at most `parts` rows of a class.
    counts = placed.groupBy("s", "size", "part").agg(F.sum("m").alias("held"))
    ahead = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "size", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start")).join(taking, ["s", "size"])
    inside = Window.partitionBy("s", "size", "part").orderBy(F.xxhash64("row", "doc_id"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("own", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(starts, ["s", "size", "part"])
    upto = lambda at: F.expr(f"({at}) * take div n")
    out = numbered.withColumn("total", upto("start + own + m") - upto("start + own"))
    out = written(out.select("doc_id", "source", "size", "row", "source_size", "target", "m", "total"))
    release(rows, classes, large)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, row of every row. Equal
    rows share their copies as evenly as whole copies can."""
    each = shares(docs, weights, share)
    turn = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))
    each = each.select("doc_id", "size", "source_size", "target", "row", "m", "total", turn.alias("turn"))
    copies = F.expr("turn * total div m - (turn - 1) * total div m")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
