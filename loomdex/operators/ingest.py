"""Collection: mapping, guarded upserts and snapshots, coverage, what is due."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex import sinks
from loomdex.functions.identity import at_pointer, bad_traversal, clean, is_identity, strict_json
from loomdex.functions.temporal import bound, canonical
from loomdex.sources.brain import manifest_digest, record_problem
from loomdex.sources.config import Config, Field, Program
from loomdex.sources.segments import Store

FIELDS = ("body", "updated", "observed", "ts")
CATCH_UP = "INTERVAL 30 DAYS"


def guard_ids(rows: DataFrame) -> DataFrame:
    """(source, id) stored more than once: nothing may change while there are any."""
    return rows.groupBy("source", "id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _judged(stored: DataFrame, incoming: DataFrame, snapshot: bool) -> DataFrame:
    """`upsert` with `rewritten`: whether the stored row becomes another. Both sides
    meet in one group an id, so there is one shuffle; the guard is judged there."""
    held = F.struct(*FIELDS)
    side = lambda rows, mark: rows.select("source", "id", held.alias("h"), F.lit(mark).alias("side"))
    of = lambda mark: F.first(F.when(F.col("side") == mark, F.col("h")), ignorenulls=True).alias(mark)
    many = lambda mark: F.count_if(F.col("side") == mark).alias(f"n_{mark}")
    both = side(stored, "s").unionByName(side(incoming, "i")).groupBy("source", "id").agg(of("s"), many("s"), of("i"), many("i"))
    told = F.concat(F.lit("more than one record has the id "), "source", F.lit(":"), F.col("id").cast("string"))
    in_s, in_i = F.col("n_s") == 1, F.col("n_i") == 1
    was, new_ = {c: F.col("s")[c] for c in FIELDS}, {c: F.col("i")[c] for c in FIELDS}
    reliable = ~F.coalesce(was["updated"] > was["observed"], F.lit(False))
    stale = reliable & F.coalesce(new_["updated"] < was["updated"], F.lit(False))
    same = was["body"].eqNullSafe(new_["body"]) & was["ts"].eqNullSafe(new_["ts"]) & was["updated"].eqNullSafe(new_["updated"])
    action = F.when((F.col("n_s") > 1) | (F.col("n_i") > 1), F.raise_error(told).cast("string"))
    action = action.when(~in_i, "removed" if snapshot else "kept").when(~in_s, "added").when(stale | same, "unchanged").otherwise("updated")
    both = both.withColumn("action", action)
    new = F.col("action").isin("added", "updated")
    kept = {c: F.when(new, new_[c]).otherwise(was[c]) for c in FIELDS}
    seen = (F.col("action") == "unchanged") & was["observed"].isNull()
    kept["observed"] = F.when(new | seen, new_["observed"]).otherwise(was["observed"])
    return both.select("source", "id", "action", *[v.alias(c) for c, v in kept.items()], (new | (seen & new_["observed"].isNotNull())).alias("rewritten"))


def upsert(stored: DataFrame, incoming: DataFrame, snapshot: bool = False) -> DataFrame:
    """Both: source, id, body, updated, observed, ts. Returns a row per id with
    `action` (added, updated, unchanged, removed, kept) and the columns that hold
    after it. An older `updated` never replaces a newer one, unless the stored one
    lies after its own observation (an unreliable clock). An unchanged row keeps its
    stored observation if it has one. An id that either side repeats is an error."""
    return _judged(stored, incoming, snapshot).drop("rewritten")


def counters(result: DataFrame) -> DataFrame:
    return result.groupBy("source").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "updated", "unchanged", "removed")])


def moved(stored: DataFrame, result: DataFrame, month: Callable[[Column], Column]) -> DataFrame:
    """source, id, was, now of the rows whose partition their new time changes."""
    old = stored.select("source", "id", month(F.col("ts")).alias("was"))
    now = result.where("action = 'updated'").select("source", "id", month(F.col("ts")).alias("now"))
    return now.join(old, ["source", "id"]).where("was <> now")


# --- fields of the shared schema ---


def scalar_problem(value: Column, field: Field) -> Column:
    """Why one variant is no value of the field; null for a fine one."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    fine = {
        "string": kind == "STRING", "integer": kind == "BIGINT", "boolean": kind == "BOOLEAN", "timestamp": kind == "STRING", "identity": kind == "STRING",
        "number": kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
    }[field.type]
    out = F.when(~F.coalesce(fine, F.lit(False)), f"expected {field.type}")
    if field.type in ("string", "timestamp", "identity"):
        out = out.when(F.length(text) > 8192, "longer than 8192 characters").when(~clean(text), "empty or with control characters")
    if field.type == "timestamp":
        out = out.when(canonical(text).isNull(), "expected ISO 8601 with a zone")
    if field.type == "identity":
        out = out.when(~is_identity(text), "expected an identity")
    return out


def value_problem(value: Column, field: Field) -> Column:
    """The same of one value or, for a field of many, of a list of at most 1000."""
    if field.cardinality != "many":
        return scalar_problem(value, field)
    held = F.try_variant_get(value, "$", "array<variant>")
    first = F.get(F.filter(F.transform(held, lambda v: scalar_problem(v, field)), lambda p: p.isNotNull()), F.lit(0))
    return F.when(held.isNull() | (F.size(held) > 1000), "expected a list of at most 1000 values").otherwise(first)


def mapped(rows: DataFrame, program: Program, config: Config, document: str = "document") -> DataFrame:
    """Adds `fields`, a map of JSON texts of each declared field: a literal, or what
    its pointer finds in the variant `document`. A required field that is missing, a
    pointer into a scalar and a value of another kind end the batch; other missing
    values are left out. Lists keep the first of equal values."""
    doc, pairs = F.col(document), []
    for name, how in sorted(program.fields.items()):
        field = config.schema[name]
        if "value" in how:
            value, wrong = F.parse_json(F.lit(json.dumps(how["value"]))), F.lit(False)
        else:
            value, wrong = at_pointer(doc, how["path"], "variant"), bad_traversal(doc, how["path"])
            value = F.when(~F.is_variant_null(value), value)
        problem = F.when(wrong, "the pointer leads into a scalar").when(value.isNull(), "the required value is missing" if field.cardinality == "one" else None)
        problem = F.coalesce(problem, F.when(value.isNotNull(), value_problem(value, field)))
        text = F.to_json(value)
        if field.cardinality == "many":
            each = F.array_distinct(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.to_json(v)))
            text = F.when(each.isNotNull(), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
        fine = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit(f"schema field {name}: "), problem)).cast("string")).otherwise(text)
        pairs.append(F.struct(F.lit(name).alias("key"), fine.alias("value")))
    held = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else F.array().cast("array<struct<key:string,value:string>>")
    return rows.withColumn("fields", F.map_from_entries(held))


# --- a run ---


def collect(spark: SparkSession, lines: DataFrame, source: str, stored: DataFrame, program: Program, config: Config, observed: datetime) -> tuple[DataFrame, dict]:
    """One run of a sensor whose records came as JSON lines (`value`): (rows that
    hold after it, what happened). Every error comes before anything is returned to
    write: a bad line, a repeated id, an unmapped required field, an empty snapshot
    over a catalog that has rows."""
    bad = lines.select(record_problem(F.col("value")).alias("p")).where("p is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{source}: {bad[0].p}")
    document = strict_json(F.col("value"))
    rows = mapped(lines.withColumn("document", document), program, config)
    text = lambda key: at_pointer(F.col("document"), f"/{key}")
    at = lambda c: F.try_to_timestamp(canonical(c)).cast("timestamp_ntz")
    incoming = rows.select(
        F.lit(source).alias("source"), text("id").alias("id"), F.to_json(F.struct("value", F.map_entries("fields").alias("fields"))).alias("body"),
        at(at_pointer(F.col("document"), "/attributes/updated")).alias("updated"), bound(observed).alias("observed"), at(text("time")).alias("ts"),
    )
    mine = stored.where(F.col("source") == source)
    snapshot = program.mode == "snapshot"
    if snapshot and lines.isEmpty() and not mine.isEmpty():
        raise ValueError(f"{source}: an empty snapshot would erase a catalog that has records")
    result = upsert(mine, incoming, snapshot)
    counted = counters(result).collect()  # a row, and what raises does so here
    told = counted[0].asDict() if counted else {"source": source, "added": 0, "updated": 0, "unchanged": 0, "removed": 0}
    return result.where("action <> 'removed'").drop("action"), told


# --- records in a store ---

RECORDS = "source string, id string, body string, updated timestamp_ntz, observed timestamp_ntz, ts timestamp_ntz"


def record_store(spark: SparkSession, root: str) -> Store:
    """Records by key in segments: a change writes its rows, all others keep their files."""
    return Store(spark, root, {"records": "key"})


def stored(spark: SparkSession, root: str, columns: str = RECORDS) -> DataFrame:
    """The records that hold now; none before the first commit."""
    kept = record_store(spark, root)
    held = kept.head()
    return kept.table("records", held).drop("key") if held else spark.createDataFrame([], columns)


def apply_changes(spark: SparkSession, root: str, judged: DataFrame, note: dict | None = None) -> dict:
    """Commit what `_judged` rows change: rows that are rewritten go to a new segment,
    theirs and removed ones are marked in the older ones."""
    kept = record_store(spark, root)
    key = F.concat_ws(":", "source", F.col("id").cast("string"))
    step = f"{root}/judged-{uuid.uuid4().hex}"
    judged.where("rewritten or action = 'removed'").withColumn("owner", key).write.parquet(step)
    found = spark.read.parquet(step)
    live = found.where("rewritten")
    owners = live.select(F.col("owner").alias("name"), F.lit("").alias("digest"))
    try:
        rows = live.drop("action", "rewritten").withColumn("key", F.col("owner"))
        return kept.apply({"records": rows, "owners": owners}, found.where("action <> 'added'").select("owner"), note)
    finally:
        sinks.remove(spark, step)


def store(spark: SparkSession, root: str, source: str, held: DataFrame, before: DataFrame) -> dict:
    """Commit a source's rows `held` in place of the stored ones among `before`;
    rows that stay as they are and other sources are not written again."""
    name = F.col("source") == source
    old = before.where(name).select(*held.columns)
    same = held.exceptAll(old)
    gone = old.select("source", "id").exceptAll(held.select("source", "id"))
    fresh = same.join(old.select("source", "id", F.lit(True).alias("was")), ["source", "id"], "left")
    judged = fresh.withColumns({"action": F.when(F.col("was"), "updated").otherwise("added"), "rewritten": F.lit(True)}).drop("was")
    return apply_changes(spark, root, judged.unionByName(gone.withColumns({"action": F.lit("removed"), "rewritten": F.lit(False)}), allowMissingColumns=True))


def coverage(runs: list[tuple[float, float, float]]) -> tuple[float, float] | None:
    """Left fold of (start, end, observed): windows that touch the kept interval
    join it, a newer one apart replaces it, an older one apart is forgotten."""
    kept = None
    for run in runs:
        kept, _ = covered(kept, *run)
    return kept


def covered(kept: tuple[float, float] | None, start: float, end: float, observed: float) -> tuple[tuple[float, float] | None, bool]:
    """(interval after one run, whether the run is the latest window). Nothing is
    covered beyond the run's own time, and a kept end beyond it was a wrong clock."""
    end = min(end, observed)
    if kept is not None:
        kept = (kept[0], min(kept[1], observed))
        kept = kept if kept[0] < kept[1] else None
    if end <= start:
        return kept, False
    if kept is None:
        return (start, end), True
    if start <= kept[1] and end >= kept[0]:
        return (min(start, kept[0]), max(end, kept[1])), end >= kept[1]
    return ((start, end), True) if end >= kept[1] else (kept, False)


def coverage_of(runs: Column) -> Column:
    """`coverage` of an array of runs (start, end, observed) in their order: the kept
    interval as a struct (start, end) of doubles, null where there is none."""
    none = F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))

    def step(kept: Column, run: Column) -> Column:
        end, until = F.least(run["end"], run["observed"]), F.least(kept["end"], run["observed"])
        held = F.coalesce(kept["start"] < until, F.lit(False))
        old = F.when(held, pair(kept["start"], until)).otherwise(pair(none, none))
        touches = (run["start"] <= until) & (end >= kept["start"])
        newer = F.when(touches, pair(F.least(run["start"], kept["start"]), F.greatest(end, until))).when(end >= until, pair(run["start"], end)).otherwise(old)
        return F.when(end <= run["start"], old).when(~held, pair(run["start"], end)).otherwise(newer)

    return F.aggregate(runs, pair(none, none), step, lambda k: F.when(k["start"].isNotNull(), k))


def _ready(at: Column) -> Column:
    """Enabled, scheduled, and the schedule has passed since the last good run."""
    elapsed = F.unix_timestamp(at) - F.unix_timestamp("success")
    return F.col("enabled") & (F.col("refresh") > 0) & (F.col("success").isNull() | (elapsed >= F.col("refresh")))


def due(sensors: DataFrame, now: datetime) -> DataFrame:
    """name, since of the sensors to run: from the last end less the overlap, at
    most 30 days back; a first run and a snapshot go back by their lookback.
    sensors: name, enabled, refresh, mode, lookback, overlap, success, last_end."""
    at = bound(now)
    back = at - F.make_dt_interval(secs=F.col("lookback"))
    resumed = F.col("last_end") - F.make_dt_interval(secs=F.col("overlap"))
    window = F.when(resumed < at, F.greatest(resumed, at - F.expr(CATCH_UP))).otherwise(back)
    return sensors.where(_ready(at)).select("name", F.when((F.col("mode") == "snapshot") | F.col("last_end").isNull(), back).otherwise(window).alias("since"))


def due_routines(routines: DataFrame, now: datetime) -> DataFrame:
    """name, since: each due routine covers the time since its last reviewed end."""
    at = bound(now)
    back = at - F.make_dt_interval(secs=F.col("lookback"))
    return routines.where(_ready(at)).select("name", F.when(F.col("last_end") < at, F.col("last_end")).otherwise(back).alias("since"))


def update(steps: dict[str, Callable[[], object]]) -> tuple[dict[str, object], list[dict]]:
    """Run sensors, routines and the refresh in the order given; one that fails is a
    problem and does not keep the others from running."""
    done, problems = {}, []
    for name, step in steps.items():
        try:
            done[name] = step()
        except Exception as error:  # noqa: BLE001 - any program may fail in its own way
            problems.append({"step": name, "error": str(error).splitlines()[0][:500] if str(error) else type(error).__name__})
    return done, problems


# --- projections that follow the files ---


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of two manifests (path, digest)."""
    both = old.withColumnRenamed("digest", "was").join(new.withColumnRenamed("digest", "is"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def refreshed(stored: DataFrame, again: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """A projection after `changes` (path, change): rows of other files stay, rows
    of files that are new or changed come from `again`."""
    gone = F.broadcast(changes.select(F.col("path").alias(key))) if changes.count() <= 200_000 else changes.select(F.col("path").alias(key))
    live = changes.where("change <> 'removed'").select(F.col("path").alias(key))
    return stored.join(gone, key, "left_anti").unionByName(again.join(live, key, "left_semi"))


def gate(spark: SparkSession, root: str, manifest: DataFrame, signature: str) -> str:
    """ready: the committed projection is of these files; stale: of others;
    rebuild: of another schema, or there is none."""
    held = sinks.current(spark, root)
    if held is None or held["note"].get("signature") != signature:
        return "rebuild"
    return "ready" if held["note"].get("manifest") == manifest_digest(manifest) else "stale"
