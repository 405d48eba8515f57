"""Validation of notes, records, links and names; retrieval cases; evidence; usage.

Every check is a plan whose rows are problems; `report` puts them together, so one
bad file never hides another.
"""

from __future__ import annotations

import posixpath
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.identity import address, is_authored, parse_address, split_ref, strict_json
from loomdex.functions.markdown import concept_problems  # noqa: F401
from loomdex.functions.temporal import bound, month
from loomdex.operators.ingest import value_problem
from loomdex.sources.brain import once, resolved_path
from loomdex.sources.config import Config

CAP = 200


def wrong_partition(records: DataFrame) -> DataFrame:
    return records.where((F.col("partition") != month(F.col("time"))) & (F.col("partition") != "snapshot"))


def missing_targets(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_anti")


def field_problems(records: DataFrame, config: Config) -> DataFrame:
    """ref, field, problem of values that the schema does not declare or not so.
    records: ref, fields (map of JSON texts)."""
    each = records.select("ref", F.explode("fields").alias("field", "value"))
    value, out = strict_json(F.col("value")), None
    for name, field in sorted(config.schema.items()):
        here = F.col("field") == name
        problem = F.coalesce(F.when(value.isNull(), "not JSON"), value_problem(value, field))
        out = F.when(here, problem) if out is None else out.when(here, problem)
    problem = out.when(~F.col("field").isin(sorted(config.schema)), "undeclared") if out is not None else F.lit("undeclared")
    return each.select("ref", "field", problem.alias("problem")).where("problem is not null")


def action_problems(files: DataFrame) -> DataFrame:
    """folder, problem of folders of actions that are misnamed or lack their file;
    loose files are fine. files: path."""
    deep = files.where(F.col("path").rlike(r"^actions/[^/]+/.+"))
    folders = deep.groupBy(F.split("path", "/")[1].alias("folder")).agg(F.bool_or(F.col("path").rlike(r"^actions/[^/]+/ACTION\.md$")).alias("has"))
    day = F.substring("folder", 1, 10)
    named = F.col("folder").rlike(r"^\d{4}-\d{2}-\d{2}_[a-z0-9]+(-[a-z0-9]+)*$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    problem = F.when(~F.coalesce(named, F.lit(False)), "name it YYYY-MM-DD_slug").when(~F.col("has"), "no ACTION.md")
    return folders.select("folder", problem.alias("problem")).where("problem is not null")


def broken_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """path, target, problem of relative links that leave the brain, name no file or
    folder, or name no heading. notes: path, targets, slugs; files: path."""
    each = notes.select("path", F.explode("targets").alias("target")).where(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.col("target") != "#"))
    whole, part = resolved_path(F.col("path"), F.col("target"))
    each = once(each, "spot", F.struct(whole.alias("file"), part.alias("part"))).select("path", "target", "spot.file", "spot.part")
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    there = files.select(F.explode(folders).alias("file")).distinct().withColumn("there", F.lit(True))
    heads = notes.select(F.col("path").alias("file"), "slugs")
    both = each.join(there, "file", "left").join(heads, "file", "left")
    problem = (
        F.when(F.col("file").startswith("..") & F.col("file").rlike(r"^\.\.(/|$)"), "leaves the brain").when(F.col("there").isNull(), "broken link")
        .when((F.col("part") != "") & F.col("slugs").isNotNull() & ~F.array_contains("slugs", F.col("part")), "missing heading")
    )
    return both.select("path", "target", problem.alias("problem")).where("problem is not null")


def missing_records(notes: DataFrame, records: DataFrame, sources: list[str]) -> DataFrame:
    """path, target of notes that cite a record (`source:id`) that is not stored."""
    each = notes.select("path", F.explode("targets").alias("target")).where(F.substring_index("target", ":", 1).isin(sources))
    return each.join(records.select(F.col("ref").alias("target")).distinct(), "target", "left_anti").select("path", "target")


def unresolved_addresses(edges: DataFrame, names: DataFrame, notes: DataFrame, records: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(value, problem of addresses of this brain that name nothing, a missing
    section, or a section of a record; values of other brains, which are unresolved
    here). names: name, item; notes: path, slugs; records: ref."""
    said = edges.select(F.explode(F.array("subject", "target")).alias("value")).distinct()
    said = once(said, "a", parse_address(F.col("value"))).where("a.valid")
    foreign = said.where(F.col("a.brain") != config.name).select("value")
    own = said.where(F.col("a.brain") == config.name).select("value", F.col("a.path").alias("path"), F.col("a.fragment").alias("fragment"), address(config.name, F.col("a.path")).alias("name"))
    owned = own.join(names.select("name", "item").distinct(), "name", "left").withColumn("at", F.coalesce("item", "path"))
    held = owned.join(notes.select(F.col("path").alias("at"), "slugs"), "at", "left").join(records.select(F.col("ref").alias("at"), F.lit(True).alias("record")).distinct(), "at", "left")
    part = F.col("fragment") != ""
    problem = (
        F.when(F.col("slugs").isNotNull(), F.when(part & ~F.array_contains("slugs", F.col("fragment")), "missing section"))
        .when(F.col("record").isNotNull(), F.when(part, "a record has no sections")).otherwise("unresolved")
    )
    return held.select("value", problem.alias("problem")).where("problem is not null").distinct(), foreign


def report(parts: dict[str, DataFrame], cap: int = CAP) -> DataFrame:
    """check, problem: the first `cap` problems of all checks (name: rows whose
    columns are told together)."""
    both = None
    for name, rows in parts.items():
        told = rows.select(F.lit(name).alias("check"), F.concat_ws(": ", *[F.col(c).cast("string") for c in rows.columns]).alias("problem"))
        both = told if both is None else both.unionByName(told)
    return both.orderBy("check", "problem").limit(cap)


# --- retrieval cases ---


def matches(expected: Column, ref: Column) -> Column:
    """A note's path without a section matches any of its sections."""
    return (ref == expected) | (is_authored(expected) & (split_ref(ref)[0] == expected))


def evaluate(cases: DataFrame, found: DataFrame, problems: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """case, passed, missing, forbidden, absent (counts). cases: case, expect, forbid,
    text (arrays), empty; found: case, ref, text, rank. A case with a problem fails;
    `empty` fails when anything is returned; texts are found in any case of letters."""
    hits = found if depth is None else found.where(F.col("rank") <= depth)
    held = hits.groupBy("case").agg(F.collect_list("ref").alias("refs"), F.lower(F.concat_ws("\n", F.collect_list("text"))).alias("told"))  # returned rows: a page a case
    both = cases.join(held, "case", "left")
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    met = lambda e: F.exists(refs, lambda r: matches(e, r))
    count = lambda c, bad: F.size(F.filter(F.coalesce(c, none), bad))
    both = both.select(
        "case", count("expect", lambda e: ~met(e)).alias("missing"), count("forbid", met).alias("forbidden"),
        count("text", lambda t: ~F.coalesce(F.contains(F.col("told"), F.lower(t)), F.lit(False))).alias("absent"), (F.coalesce("empty", F.lit(False)) & (F.size(refs) > 0)).alias("full"),
    )
    if problems is not None:
        both = both.join(problems.select("case", F.lit(True).alias("broken")).distinct(), "case", "left")
    else:
        both = both.withColumn("broken", F.lit(None).cast("boolean"))
    fine = (F.col("missing") + F.col("forbidden") + F.col("absent") == 0) & ~F.col("full") & F.col("broken").isNull()
    return both.select("case", fine.alias("passed"), "missing", "forbidden", "absent")


def score(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def load_cases(spark: SparkSession, suites: dict[str, dict]) -> DataFrame:
    """Cases of YAML suites (name: mapping) as a table; an error for a repeated name
    or a case that asks for nothing, for both or for neither."""
    rows = []
    for suite, data in suites.items():
        cases = data.get("cases", [])
        if len({c["name"] for c in cases}) != len(cases) or not 1 <= len(cases) <= 200:
            raise ValueError(f"{suite}: repeated names, none, or more than 200 cases")
        for c in cases:
            if bool(c.get("empty")) == bool(c.get("expect") or c.get("text")) or (c.get("read") is None) == (not str(c.get("query", "")).strip()):
                raise ValueError(f"{suite}: {c['name']}: use expect or text, or empty; and a query or a read")
            rows.append((f"{posixpath.basename(suite)}/{c['name']}", c.get("query"), c.get("scope", ""), c.get("read"), c.get("limit", 10), c.get("expect", []), c.get("forbid", []), c.get("text", []), bool(c.get("empty"))))
    return spark.createDataFrame(rows, "case string, query string, scope string, read string, limit int, expect array<string>, forbid array<string>, text array<string>, empty boolean")


def strings(value: object) -> list[str]:
    """Every text in a reply, at any depth."""
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for part in parts for s in strings(part)]


# --- evidence and usage ---


def evidence(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, state (changed, unchanged, unknown) by digest of the columns."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    was, now = old.select(key, digest.alias("was")), new.select(key, digest.alias("now"))
    state = F.when(F.col("now").isNull(), "unknown").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return was.join(now, key, "left").select(key, state.alias("state"))


def usage(events: DataFrame, now: datetime) -> DataFrame:
    """Counts of searches, empty searches and reads in the 7 and 30 days, to the
    second, that end now. events: at (UTC), op, results."""
    counts, end = [], bound(now)
    for days in (7, 30):
        inside = (F.col("at") <= end) & (F.col("at") >= end - F.expr(f"INTERVAL {days} DAYS"))
        counts += [
            F.count_if(inside & (F.col("op") == "search")).alias(f"search_{days}d"),
            F.count_if(inside & (F.col("op") == "search") & (F.col("results") == 0)).alias(f"empty_{days}d"),
            F.count_if(inside & (F.col("op") == "read")).alias(f"read_{days}d"),
        ]
    return events.agg(*counts)
