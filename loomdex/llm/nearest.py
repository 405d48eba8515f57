"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to unit length and turned by a random rotation, after which a
block of their columns is a random projection. They lie in lists around centres
fitted on a bounded sample; every vector is indexed. A query visits the lists of
its nearest centres: PROBES, or as many more, up to all, as a sample of JUDGED
queries needs to meet RECALL of its neighbours, which are found by brute force
over all entries. Inside a list candidates are read SPAN at a time and their
columns block by block: after d of D columns the partial squared distance, scaled
by D / d, is tested against the current k-th distance times
(1 + EPSILON / sqrt(d))^2, and the candidates that fail are abandoned. The current
k-th distance falls with every span; each query begins with its nearest list, and
the k-th distance found there goes with it to all the others. Survivors are scored
by the cosine of the original vectors in double precision (scaled by powers of
two, which changes no digit and cannot overflow).

Equal vectors are one entry with its k + 1 smallest ids (a partial top-k before
the shuffle), so a vector that many rows share is one candidate. Lists are cut
into blocks of BLOCK entries and their queries into blocks too; each pair of
blocks is a task's work, so a large list is many small groups. Lists are as many
as the square root of the entries, up to MAX_LISTS; beyond MAX_LISTS^2 entries
they grow longer, and so does the work of a query.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most take no part, as query or as candidate; rows
with a null vec_id neither; rows that repeat an id are one row, with the vector of
least hash where they differ; ties go to the smaller vec_id; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, table, written

EPSILON, COLUMNS = 2.1, 16
PROBES, MAX_LISTS, SAMPLE, SPAN = 64, 16_384, 20_000, 256
#: Above 0.9 by what a sample of queries may err and what the scan abandons.
RECALL, JUDGED = 0.95, 256
BLOCK = 4096


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) and two hashes of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (common[0].d if common else 0)).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    key = F.struct("a", "b")
    odd = rows.groupBy("vec_id").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least <> most")
    odd = odd.select("vec_id", F.col("least.a").alias("a_"), F.col("least.b").alias("b_"))
    one = rows.join(odd, "vec_id", "left").where("a_ is null or (a = a_ and b = b_)")
    return one.select("vec_id", "v", "a", "b")


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """key (two longs), v, ids: one entry for each distinct vector."""
    keyed = rows.dropDuplicates(["a", "b", "vec_id"])
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    few = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(x), 1024)])


def fit(entries: DataFrame, n: int, d: int) -> np.ndarray:
    """Centres (rotated, unit length) from the entries of least hash: SAMPLE, or
    four for each list, 4 * MAX_LISTS at most."""
    lists = int(max(1, min(MAX_LISTS, round(n**0.5))))
    some = entries.select("a", "v").orderBy("a").limit(max(SAMPLE, 4 * lists)).collect()
    x = unit(np.array([r.v for r in some])) @ rotation(d)
    centres = x[np.random.default_rng(5).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(8):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _assigned(rows: DataFrame, centres: np.ndarray, probes: int, ids: str) -> DataFrame:
    """list and its turn (0: the nearest centre; one row for each probed list), the
    key, v and the column `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[ids].dataType.simpleString()

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        c = shared.value
        x = unit(np.array(batch.column("v").to_pylist())) @ rotation(c.shape[1])
        near = x @ c.T
        p = min(probes, len(c))
        lists = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
        lists = np.take_along_axis(lists, np.argsort(-np.take_along_axis(near, lists, 1), axis=1, kind="stable"), 1)
        take, turn = pa.array(np.repeat(np.arange(len(x)), p)), np.tile(np.arange(p, dtype=np.int32), len(x))
        return pa.RecordBatch.from_arrays(
            [pa.array(lists.ravel().astype(np.int32)), pa.array(turn), *[batch.column(n).take(take) for n in ("a", "b", "v", ids)]],
            ["list", "nth", "a", "b", "v", ids],
        )

    return arrow_map(rows.select("a", "b", "v", ids), run, f"list int, nth int, a bigint, b bigint, v array<double>, `{ids}` {kind}")


def probes_for(index: DataFrame, asked: DataFrame, centres: np.ndarray, k: int) -> int:
    """The least number of lists, PROBES at least, that holds RECALL of the k
    nearest other entries of JUDGED queries of least hash, which every entry is
    compared with."""
    some = asked.select("a", "b", "v").orderBy("a", "b").limit(JUDGED).collect() if len(centres) > PROBES else []
    if not some:
        return PROBES
    y = unit(np.array([r.v for r in some]))
    turns = np.argsort(np.argsort(-(y @ rotation(y.shape[1])) @ centres.T, axis=1, kind="stable"), axis=1)
    own = np.array([(r.a, r.b) for r in some])
    shared = index.sparkSession.sparkContext.broadcast((y, turns, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, turns, own = shared.value
        best, turn = np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64)
        for batch in batches:
            if batch.num_rows:
                a, b, lists = (batch.column(n).to_numpy() for n in ("a", "b", "list"))
                score = y @ unit(np.array(batch.column("v").to_pylist())).T
                score[(own[:, :1] == a) & (own[:, 1:] == b)] = -np.inf
                best, turn = np.hstack([best, score]), np.hstack([turn, turns[:, lists]])
                few = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, turn = np.take_along_axis(best, few, 1), np.take_along_axis(turn, few, 1)
        q, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, at]), pa.array(turn[q, at])], ["q", "score", "turn"])

    near = index.select("list", "a", "b", "v").mapInArrow(run, "q bigint, score double, turn bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "turn")
    found = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("turn").collect()
    need = sorted(r.turn for r in found)
    return max(PROBES, need[math.ceil(RECALL * len(need)) - 1] + 1) if need else PROBES


def scan(x: np.ndarray, y: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, float]:
    """Rows of `x` that may be among the k nearest to `y` (both rotated) and not
    beyond the squared distance `limit`, and the k-th squared distance known after."""
    d, found, best = x.shape[1], [], np.full(k, np.inf)
    for start in range(0, len(x), SPAN):
        alive = np.arange(start, min(len(x), start + SPAN))
        part = np.zeros(len(alive))
        for at in range(0, d, COLUMNS):
            upto = min(d, at + COLUMNS)
            part += ((x[alive, at:upto] - y[at:upto]) ** 2).sum(1)
            if limit < np.inf:
                bound = limit * (1 if upto == d else (1 + EPSILON / upto**0.5) ** 2 * upto / d)
                stay = part <= bound * (1 + 1e-9) + 1e-12
                alive, part = alive[stay], part[stay]
        found.append(alive)
        best = np.partition(np.r_[best, part], k - 1)[:k]
        limit = min(limit, best.max())
    return np.concatenate(found), limit


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, their largest component between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _met(index: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """a, b, vec_id, score of the k + 1 best entries of each probed list, and
    `kth`, the squared distance of the k + 1-th. probed: list, a, b, v, kth."""
    # Numbers of blocks of each list: at most MAX_LISTS rows.
    blocks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    turns = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    grid = F.broadcast(blocks.join(turns, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(grid, "list").withColumn("block", F.pmod("a", F.col("blocks")).cast("int")).withColumn("turn", every("turns"))
    right = probed.join(grid, "list").withColumn("turn", F.pmod("a", F.col("turns")).cast("int")).withColumn("block", every("blocks"))
    key = ["list", "block", "turn"]

    def near(held: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(questions):
            held = held.sort_values("a", kind="stable")
            x, y = scaled(np.stack(held.v.to_numpy())), scaled(np.stack(questions.v.to_numpy()))
            turn = rotation(x.shape[1])
            rx, ry = unit(x) @ turn, unit(y) @ turn
            xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            ids = held.ids.tolist()
            for i, (a, b, limit) in enumerate(zip(questions.a, questions.b, questions.kth, strict=True)):
                found, kth = scan(rx, ry[i], k + 1, limit)
                score = (x[found] * y[i]).sum(1) / (xn[found] * yn[i])
                order = np.lexsort(([ids[j][0] for j in found], -score))[: k + 1]
                for j in order:
                    out += [(a, b, int(one), float(score[j]), kth) for one in ids[found[j]]]
        return pd.DataFrame(out, columns=["a", "b", "vec_id", "score", "kth"]).astype({"a": "int64", "b": "int64", "vec_id": "int64", "score": "float64", "kth": "float64"})

    return left.select(*key, "a", "v", "ids").groupBy(key).cogroup(right.select(*key, "a", "b", "v", "kth").groupBy(key)).applyInPandas(
        near, "a bigint, b bigint, vec_id bigint, score double, kth double"
    )


def search(rows: DataFrame, queries: F.Column, k: int = 5, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that `queries` picks; `probes`
    lists a query, or as many as RECALL takes."""
    rows = written(usable(rows))
    entries = written(_entries(rows, k))
    n = entries.count()
    first = entries.select(F.size("v").alias("d")).first()
    d = first.d if first else 1
    centres = fit(entries, n, d) if n else np.ones((1, 1))
    index = written(_assigned(entries, centres, 1, "ids"))
    asked = rows.where(queries).select("a", "b", "v", F.lit(0).alias("q")).dropDuplicates(["a", "b"])
    if probes is None:
        probes = probes_for(index, asked, centres, k)
    probed = written(_assigned(asked, centres, probes, "q"))
    home = written(_met(index, probed.where("nth = 0").withColumn("kth", F.lit(float("inf"))), k))
    known = home.groupBy("a", "b").agg(F.min("kth").alias("kth"))
    away = probed.where("nth > 0").join(known, ["a", "b"], "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    hits = home.unionByName(_met(index, away, k)).drop("kth")
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    few = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    who = rows.where(queries).select("a", "b", F.col("vec_id").alias("query_id")).distinct()
    ranked = few.join(who, ["a", "b"]).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
