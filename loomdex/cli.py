"""Thin commands over the library: search, read, status, validate, eval, schema.

`python -m loomdex.cli --brain DIR search "words" --scope 7d` prints one JSON reply.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from loomdex import sinks
from loomdex.operators import checks, pages, retrieve
from loomdex.sources import adapters, brain, config


def rows(df: DataFrame, most: int = 200) -> list[dict]:
    """Rows of a bounded answer without blanks."""
    return [{k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in r.asDict(recursive=True).items() if v not in (None, "", [])} for r in df.limit(most).collect()]


def opened(spark: SparkSession, folder: str) -> tuple[dict[str, brain.Brain], dict[str, str], dict[str, str]]:
    """(brains by name, why others can't be opened, trust of sources)."""
    folders, problems = config.related(folder)
    found, broken, trust = {}, {p["brain"]: p["error"] for p in problems}, {}
    for name, at in folders.items():
        try:
            settings = config.open_brain(at)
            trust |= {n: p.trust for n, p in settings.sensors.items()}
            found[name] = brain.open_brain(spark, at, settings)
        except (OSError, ValueError) as error:
            broken[name] = str(error)
    return found, broken, trust


def answer(spark: SparkSession, folder: str, op: str, text: str = "", scope: str = "", limit: int = 10, now: datetime | None = None) -> dict:
    now = now or datetime.now(timezone.utc)
    settings = config.open_brain(folder)
    if op == "schema":
        return {"fields": {k: vars(f) for k, f in settings.schema.items()}}
    found, broken, trust = opened(spark, folder)
    if op == "search":
        reply = retrieve.federated(found, retrieve.ask(text, now, scope, limit), trust, broken)
        return {"items": rows(reply.items.orderBy("rank")), **({"identity": reply.identity} if reply.identity else {}), **({"problems": reply.problems} if reply.problems else {})}
    if op == "read":
        reply = retrieve.read(found, text, now)
        flat = reply["parts"] if reply["kind"] == "item" else {f"{b}.{k}": v for b, p in reply["parts"].items() for k, v in p.items()}
        return {**{k: v for k, v in reply.items() if k != "parts"}, **{k: rows(v) for k, v in flat.items()}}
    if op == "validate":
        told = problems_of(spark, folder, settings)
        return {"valid": told.isEmpty(), "problems": [r.problem for r in told.collect()]}
    if op == "eval":
        cases = checks.load_cases(spark, adapters.read_suites(os.path.join(folder, text or "evals")))
        return {"cases": rows(run_cases(spark, found, cases, now).orderBy("case"))}
    if op == "status":
        own = found[settings.name]
        return {"brain": settings.name, "sources": rows(pages.sources(brain.dated(own.items))), "problems": rows(own.problems)}
    raise ValueError(f"unknown operation {op}")


def problems_of(spark: SparkSession, folder: str, settings: config.Config) -> DataFrame:
    """Every check of a folder in one report."""
    files = brain.files(spark, folder)
    notes = brain.read_notes(spark, folder)
    good = notes.where("problem is null")
    own = brain.open_brain(spark, folder, settings)
    records, bad = brain.read_records(spark, f"{folder}/memories") if os.path.isdir(f"{folder}/memories") else (None, None)
    names = own.names
    edges = own.edges.select("subject", "target")
    refs = own.items.where("kind = 'record'").select("ref")
    texts = spark.read.text(f"{folder}/concepts", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md") if os.path.isdir(f"{folder}/concepts") else None
    parts = {
        "notes": notes.where("problem is not null").select("problem"), "actions": checks.action_problems(files), "links": checks.broken_links(good, files),
        "addresses": checks.unresolved_addresses(edges, names, good, refs, settings)[0], "names": own.names.groupBy("name").agg({"item": "count"}).where("`count(item)` > 1"),
    }
    if texts is not None:
        parts["concepts"] = checks.concept_problems(texts.select(brain._inside(texts["_metadata.file_path"], folder).alias("path"), texts["value"].alias("text")))
    if records is not None:
        placed = brain.in_partitions(records)
        parts["records"] = bad.select("file", "problem")
        parts["partitions"] = checks.wrong_partition(placed).select("source", "partition", "id")
        parts["ids"] = placed.groupBy("source", "id").count().where("count > 1")
        known = [r.source for r in placed.select("source").distinct().limit(10_000).collect()]
        parts["cited"] = checks.missing_records(good, refs, sorted({*known, *settings.sensors}))
        parts["fields"] = checks.field_problems(placed.selectExpr("concat_ws(':', source, id) as ref", "fields"), settings)
    return checks.report(parts)


def run_cases(spark: SparkSession, found: dict[str, brain.Brain], cases: DataFrame, now: datetime) -> DataFrame:
    """Ask every case (at most 200 a suite) and judge the answers."""
    told, broken = [], []
    for c in cases.collect():
        try:
            if c.read is not None:
                reply = retrieve.read(found, c.read, now)
                held = rows(reply["parts"]["passages"]) if reply["kind"] == "item" else []
                told += [(c.case, "#".join(x for x in (h["ref"], h.get("fragment")) if x), "\n".join(checks.strings(h)), n + 1) for n, h in enumerate(held)]
            else:
                reply = retrieve.federated(found, retrieve.ask(c.query, now, c.scope, c.limit))
                told += [(c.case, "#".join(x for x in (h["ref"], h.get("fragment")) if x), "\n".join([h.get("title", ""), h.get("excerpt", "")]), h["rank"]) for h in rows(reply.items)]
        except LookupError as error:
            if not str(error).startswith("reference not found"):
                broken.append((c.case,))
    schema = "case string, ref string, text string, rank int"
    return checks.evaluate(cases, spark.createDataFrame(told, schema), spark.createDataFrame(broken, "case string"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomdex")
    parser.add_argument("--brain", default="")
    parser.add_argument("op", choices=["search", "read", "validate", "eval", "status", "schema"])
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--scope", default="")
    parser.add_argument("--limit", type=int, default=10)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        folder = config.select(args.brain, env=dict(os.environ))
        print(sinks.encode(answer(spark, folder, args.op, args.text, args.scope, args.limit)))
    except (ValueError, LookupError, OSError) as error:
        print(sinks.encode({"error": str(error)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
