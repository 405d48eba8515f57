"""K-d tree partitioning by bytes, in DataFrame functions alone.

Documents with equal texts are one weighted unit of the tree: they share the place
of their representative (least doc_id, source and language) and lie in one shard.
Only a unit of more than WHOLE of the target's bytes is cut, by a hash of its
doc_ids, since the law is `bytes`: sizes near equal.

Dimensions of the metadata, each as a place of 16 bits between the least and the
largest value of the table, so that widths can be compared: the logarithm of the
size, the source and the language by their rank among the values (code point, null
first), and the doc_id. A node with more bytes than the target is split along
its widest dimension at the weighted median (the quantile that leaves each side
its share of leaves). Units with the median's value are split further by the
text's checksum.

A median needs up to three histograms of at most 65,536 bins for each node,
pre-aggregated before they are shuffled; what reaches the driver is one row for
each node, and the sources and languages, MAX_VALUES at most (else an error). The
tree has as many leaves as shards, whatever the data.

Defined cases: null text counts 16 bytes and checksum 0 and equals an empty one;
null metadata have a place of their own; a null doc_id has the least place; slots
follow doc_id, null first; rows equal in doc_id and text get slots of their own; an
empty table gives an empty result; further columns are ignored; with fewer bytes
than shards some shards stay empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import release, table, written

DIMENSIONS = ("by_size", "by_source", "by_lang", "by_id")
CELLS = 1 << 16
#: Equal texts, and cells of equal checksums, are kept whole below this share of the target.
WHOLE = 0.03
#: Rows of a part of a shard that numbers its rows on its own.
PART_ROWS = 8192
MAX_VALUES = 1_000_000
#: Rows of equal texts that meet in one task; more of them by broadcast, MANY texts at most.
HOT, MANY = 10_000, 50_000


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    cut: tuple[str, int] | None = None  # dimension, then the least key of the right side
    left: Node | None = None
    right: Node | None = None

    def open(self) -> list[Node]:
        if self.cut is None:
            return [self] if self.leaves > 1 else []
        return self.left.open() + self.right.open()

    def depth(self) -> int:
        return 0 if self.cut is None else 1 + max(self.left.depth(), self.right.depth())

    def listed(self) -> list[Node]:
        return [self] + ([] if self.cut is None else self.left.listed() + self.right.listed())


def placed_in(rows: DataFrame, root: Node) -> DataFrame:
    """Add `node`: the number of the first leaf of the row's node. Rows walk the
    tree a level at a time through literal tables of its nodes."""
    nodes = root.listed()
    number = {id(n): k for k, n in enumerate(nodes)}
    at = lambda of: F.get(F.array(*[F.lit(of(n)) for n in nodes]), F.col("node"))
    out = rows.withColumn("node", F.lit(0))
    for _ in range(root.depth()):
        value = F.get(F.array(*DIMENSIONS), at(lambda n: DIMENSIONS.index(n.cut[0]) if n.cut else 0))
        key = F.shiftleft(value.cast("bigint"), 32) + F.shiftleft(F.col("by_text").cast("bigint"), 16) + F.col("by_row")
        lower = key < at(lambda n: n.cut[1] if n.cut else 0)
        left = at(lambda n: number[id(n.left)] if n.cut else number[id(n)])
        right = at(lambda n: number[id(n.right)] if n.cut else number[id(n)])
        # A generator is not inlined, so the levels don't multiply in one expression.
        step = F.explode(F.array(F.when(lower, left).otherwise(right)))
        out = out.select(*rows.columns, step.alias("node"))
    return out.withColumn("node", at(lambda n: n.first))


def _ranked(docs: DataFrame, column: str) -> DataFrame:
    """A row for each value of `column` with its place; broadcast by the caller."""
    found = docs.select(F.col(column).cast("string").alias(column)).distinct().limit(MAX_VALUES + 1)
    values = F.sort_array(F.collect_set(column)).alias("values")
    n = found.where(F.col(column).isNotNull()).count()
    if n > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values of {column}")
    listed = found.agg(values).select(F.posexplode("values").alias("at", f"{column}_"))
    place = F.floor((F.col("at") + 1) * (CELLS - 1) / max(1, n)).cast("int")
    return listed.select(f"{column}_", place.alias(f"by_{column}"))


def metadata(docs: DataFrame, shards_of: int) -> DataFrame:
    """doc_id, size, text_crc32, m (equal rows) and the dimensions of each different
    row. `shards_of`: bytes of a shard, from which equal texts may be cut."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 16).cast("bigint")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
    )
    # Equal rows are one with a count, so no group of them is a task's work.
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")))
    units = rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("m")).alias("bytes"),
        F.min(F.struct("doc_id", "source", "lang")).alias("first"),
    )
    units = written(units.where("n > 1").select(F.col("a").alias("a_"), F.col("b").alias("b_"), "n", "bytes", "first"))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(HOT, total // MANY)  # at most MANY texts
    same = lambda u: (F.col("a") == u.a_) & (F.col("b") == u.b_)
    hot, rest = F.broadcast(units.where(often)), units.where(~often)
    plain = rows.join(hot, same(hot), "left_anti")
    joined = rows.join(hot, same(hot)).unionByName(plain.join(rest, same(rest), "left"), allowMissingColumns=True)
    of = lambda c: F.when(F.col("n").isNull(), F.col(c)).otherwise(F.col(f"first.{c}")).alias(c)
    cut = F.coalesce(F.col("bytes") > WHOLE * shards_of, F.lit(False))
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("size").alias("least"), F.max("size").alias("most")).first()
    low, width = ends.low or 0, max(1, (ends.high or 0) - (ends.low or 0))
    small, steps = math.log2(ends.least or 1), max(1e-9, math.log2(ends.most or 1) - math.log2(ends.least or 1))
    placed = joined.select(
        F.col("doc_id").alias("id"), "size", "text_crc32", "m", of("doc_id"), of("source"), of("lang"),
        F.when(cut, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CELLS))).otherwise(0).cast("int").alias("by_row"),
    )
    for column in ("source", "lang"):
        ranks = F.broadcast(_ranked(rows, column))
        placed = placed.join(ranks, F.col(column) == F.col(f"{column}_"), "left").withColumn(f"by_{column}", F.coalesce(f"by_{column}", F.lit(0))).drop(f"{column}_")
    top = F.lit(CELLS - 1)
    part_of = (F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(float(width))
    out = written(placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", "m", (F.col("size") * F.col("m")).alias("bytes"),
        F.least(F.greatest(F.floor((F.log2(F.col("size").cast("double")) - F.lit(small)) / F.lit(steps) * top), F.lit(0)), top).cast("int").alias("by_size"),
        "by_source", "by_lang", F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(F.floor(part_of * top), top)).cast("int").alias("by_id"),
        F.shiftright("text_crc32", 16).cast("int").alias("by_text"), "by_row",
    ))
    release(rows, units)
    return out


def _median(rows: DataFrame, value: Column, goals: dict[int, float]) -> dict[int, tuple[int, float, int]]:
    """For each node the bin in which the running size reaches the goal: bin, size
    before it, size in it."""
    bins = rows.groupBy("node", value.alias("bin")).agg(F.sum("bytes").alias("size"))
    running = F.sum("size").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    goal = F.create_map(*[F.lit(x) for pair in goals.items() for x in (pair[0], float(pair[1]))])[F.col("node")]
    found = bins.withColumn("upto", running).where((F.col("upto") >= goal) & (F.col("upto") - F.col("size") < goal))
    return {r.node: (r.bin, float(r.upto - r["size"]), r["size"]) for r in found.collect()}


def _choice(of: dict[int, object]) -> Column:
    out = None
    for node, value in of.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.col("node") == node, value) if out is None else out.when(F.col("node") == node, value)
    return out


def grow(rows: DataFrame, leaves: int, target: float) -> Node:
    """The tree: a level at a time, all open nodes of a level in the same jobs."""
    root = Node(leaves, 0)
    while open_ := root.open():
        placed = placed_in(rows, root).where(F.col("node").isin([n.first for n in open_]))
        spans = [f(d).alias(f"{d}_{k}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))]
        sums = {r.node: r for r in placed.groupBy("node").agg(F.sum("bytes").alias("size"), *spans).collect()}
        widest, goals = {}, {}
        for n in open_:
            half = n.leaves // 2
            n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)
            if n.first not in sums:
                n.cut = (DIMENSIONS[0], 0)
                continue
            r = sums[n.first]
            widest[n.first] = max(DIMENSIONS, key=lambda d: r[f"{d}_high"] - r[f"{d}_low"])
            goals[n.first] = r["size"] * half / n.leaves
        if not widest:
            continue
        placed = placed.withColumn("value", _choice({k: F.col(d) for k, d in widest.items()}))
        one = _median(placed, F.col("value"), goals)
        at = placed.where(F.col("value") == _choice({k: v[0] for k, v in one.items()}))
        rest = {k: goals[k] - v[1] for k, v in one.items()}
        two = _median(at, F.col("by_text"), rest)
        split = {k: v for k, v in two.items() if v[2] > WHOLE * target}
        three = {}
        if split:
            cell = at.where(F.col("by_text") == _choice({k: v[0] for k, v in split.items()}))
            three = _median(cell, F.col("by_row"), {k: rest[k] - v[1] for k, v in split.items()})
        for n in (n for n in open_ if n.cut is None):
            k = n.first
            text, before, held = two[k]
            if k in three:
                row, inner, mass = three[k]
                n.cut = (widest[k], (one[k][0] << 32) + (text << 16) + row + (rest[k] - before - inner > mass / 2))
            else:
                n.cut = (widest[k], (one[k][0] << 32) + ((text + (rest[k] - before > held / 2)) << 16))
    return root


def shard(docs: DataFrame, target_bytes: int | None = None, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row. The target is given
    or the total over `shards`; the tree has total / target leaves, rounded up."""
    sizes = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    target = target_bytes or max(1, -(-sizes.total // shards))
    rows = metadata(docs, target)
    tree = grow(rows, max(1, -(-sizes.total // target)), target)
    parts = max(1, -(-sizes.n // PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int")
    placed = placed_in(rows, tree).select("doc_id", "size", "text_crc32", "m", F.col("node").cast("int").alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.sum("m").alias("held"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("own", F.coalesce(F.sum("m").over(own), F.lit(0))).join(starts, ["shard", "part"])
    each = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("turn"))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own") + F.col("turn")).cast("bigint").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
