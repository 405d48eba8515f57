"""Health of sources and routines: what is declared, what ran, what is stored.

runs: name, success (time of the last good run), start, end, error. declared: name,
enabled, refresh, mode, trust. Both are small tables, a row each; records are counted
before they meet them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.temporal import bound, freshness
from loomdex.sources.config import Program

DECLARED = "name string, enabled boolean, refresh bigint, mode string, trust string"
RUNS = "name string, success timestamp_ntz, start timestamp_ntz, end timestamp_ntz, error string, action string"


def declared(spark: SparkSession, programs: dict[str, Program]) -> DataFrame:
    return spark.createDataFrame([(n, p.enabled, p.refresh, p.mode, p.trust) for n, p in sorted(programs.items())], DECLARED)


def _age(now: datetime):
    return (F.unix_micros(bound(now).cast("timestamp")) - F.unix_micros(F.col("success").cast("timestamp"))) / 1e6


def source_health(declared: DataFrame, runs: DataFrame, counts: DataFrame, now: datetime, trusted: bool = True) -> DataFrame:
    """source, state (active, disabled, historical), freshness, trust, mode, since,
    until, failed, records, latest of every source that is declared or stored.
    counts: source, records, latest."""
    both = declared.withColumnRenamed("name", "source").join(counts, "source", "full_outer").join(runs.withColumnRenamed("name", "source"), "source", "left")
    known = F.col("enabled").isNotNull()
    state = F.when(~known, "historical").when(F.col("enabled"), "active").otherwise("disabled")
    fresh = F.when(known & F.col("enabled"), freshness(_age(now), F.col("refresh"), F.lit(trusted))).otherwise("unknown")
    window = ~known | (F.col("mode") == "window")
    return both.select(
        "source", state.alias("state"), fresh.alias("freshness"), F.coalesce("trust", F.lit("external")).alias("trust"), "mode", F.col("success").alias("last_collected"),
        F.when(window & F.col("end").isNotNull(), F.col("start")).alias("since"), F.when(window & F.col("start").isNotNull(), F.col("end")).alias("until"),
        (F.coalesce("error", F.lit("")) != "").alias("failed"), F.coalesce("records", F.lit(0)).alias("records"), "latest", F.coalesce("refresh", F.lit(0)).alias("refresh"),
    )


def routine_health(declared: DataFrame, runs: DataFrame, now: datetime, trusted: bool = False) -> DataFrame:
    """routine, enabled, freshness, failed, last action of every declared routine."""
    both = declared.join(runs, "name", "left")
    fresh = F.when(F.col("enabled"), freshness(_age(now), F.col("refresh"), F.lit(trusted))).otherwise("unknown")
    return both.select(F.col("name").alias("routine"), "enabled", fresh.alias("freshness"), (F.coalesce("error", F.lit("")) != "").alias("failed"), "action", "refresh")


def _due(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("refresh") > 0) & (F.col("failed") | F.col("freshness").isin("never", "stale")))


def attention(sources: DataFrame, routines: DataFrame | None = None, trusted: bool = True) -> DataFrame:
    """kind, name, freshness, failed of what this machine runs on a schedule and
    failed or is late; nothing where it runs nothing."""
    out = _due(sources.where("state = 'active'")).select(F.lit("sensor").alias("kind"), F.col("source").alias("name"), "freshness", "failed")
    if routines is not None:
        out = out.unionByName(_due(routines.where("enabled")).select(F.lit("routine").alias("kind"), F.col("routine").alias("name"), "freshness", "failed"))
    return out if trusted else out.limit(0)


def coverage(sources: DataFrame) -> DataFrame:
    """state, sources, records; a row for each state, whether it has any."""
    states = sources.sparkSession.createDataFrame([(s,) for s in ("active", "disabled", "historical")], "state string")
    found = sources.groupBy("state").agg(F.count(F.lit(1)).alias("sources"), F.sum("records").alias("records"))
    return F.broadcast(states).join(found, "state", "left").select("state", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("records", F.lit(0)).alias("records"))


def report(items: DataFrame, problems: DataFrame, sources: DataFrame, routines: DataFrame | None = None, trusted: bool = True, index: str = "ready") -> DataFrame:
    """One row: notes, records, skipped files and whether the brain is healthy."""
    late = attention(sources, routines, trusted).agg(F.count(F.lit(1)).alias("late"))
    counts = items.agg(F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("kind") == "record").alias("records"))
    skipped = problems.agg(F.count(F.lit(1)).alias("skipped"))
    healthy = (F.col("late") == 0) & (F.col("skipped") == 0) & F.lit(index == "ready")
    return counts.crossJoin(F.broadcast(skipped)).crossJoin(F.broadcast(late)).select("notes", "records", "skipped", "late", healthy.alias("healthy"))
