"""Pages: what a brain shows at a place. Each part of a page is one plan; rows that
arrive at the driver are bounded by the page's limits.

items: ref, path, kind, source, title, type, status, ts (UTC, null: undated),
changed, weight and, for several brains, brain.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.identity import AUTHORED, address, is_authored, split_ref
from loomdex.functions.temporal import Scope, below, changed_elsewhere, in_scope, period
from loomdex.operators import graph

SECTION, PAGE, LISTING, PARTITIONS, ACTIONS = 20, 50, 200, 400, 10
CLOSED = ("done", "archived")


def is_action(path: Column) -> Column:
    return path.rlike(r"^actions/[^/]+/ACTION\.md$")


def listing(items: DataFrame, where: Column, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first rows with their rank, one row with the total before the limit)."""
    found = items.where(F.coalesce(where, F.lit(False)))
    top = found.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))), found.agg(F.count(F.lit(1)).alias("total"))


def newest(column: str = "ts") -> list[Column]:
    return [F.desc(column), F.asc("ref")]




def activity(items: DataFrame, since: datetime, until: datetime, name: str) -> DataFrame:
    """Records of each source in a window, most first, with the page that lists them."""
    inside = items.where((F.col("kind") == "record") & in_scope(Scope(since, until), F.col("ts"), F.col("path")))
    counts = inside.groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    page = F.concat(F.lit("memories/"), "source", F.lit(f"/{name}"))
    return counts.withColumn("page", page).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("records"), "source")))


def home(items: DataFrame, links: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """projects (due for review first), actions, changed, activity, upcoming."""
    week = timedelta(days=7)
    open_ = items.where((F.col("kind") == "note") & (F.col("type") == "project") & F.col("status").isin("active", "blocked"))
    dated = open_.where("ts is not null").select("ref", F.to_date("ts").alias("updated"))
    judged = graph.review(open_, graph.newer_links(dated, links), now)
    projects, _ = listing(judged, F.lit(True), [F.desc("review"), *newest()], LISTING)
    note = F.col("kind") == "note"
    return {
        "projects": projects,
        "actions": listing(items, is_action(F.col("path")), [F.desc("path")], ACTIONS)[0],
        "changed": listing(items, note & in_scope(Scope(now - week, now), F.col("ts"), F.col("path")), newest(), SECTION)[0],
        "activity": activity(items, now - timedelta(days=1), now, "24h"),
        "upcoming": listing(items, in_scope(Scope(now, now + week), F.col("ts"), F.col("path")), [F.asc("ts"), F.asc("ref")], SECTION)[0],
    }


def timeline(items: DataFrame, found: Scope, name: str) -> dict[str, DataFrame]:
    """items and total of a period, what changed in it but lies elsewhere, shares, and
    for days and months one row of `around`: the periods before and after."""
    inside = in_scope(found, F.col("ts"), F.col("path"))
    rows, total = listing(items, inside, newest(), PAGE)
    moved, _ = listing(items, changed_elsewhere(found, F.col("ts"), F.col("changed")), newest("changed"), SECTION)
    page_ = {"items": rows, "total": total, "changed": moved, "sources": activity(items, found.since, found.until, name)}
    if found.previous:
        page_["around"] = items.sparkSession.createDataFrame([(found.previous, found.next)], "previous string, next string")
    return page_


def folder_order(top: str) -> list[Column]:
    """Projects: closed last, then newest; concepts by title; actions newest path
    first; else by path."""
    return {
        "projects": [F.col("status").isin(*CLOSED), F.desc("ts"), F.asc("ref")],
        "concepts": [F.asc("title"), F.asc("ref")],
        "actions": [F.desc("path")],
    }.get(top, [F.asc("path")])


def folder(items: DataFrame, path: str) -> dict[str, DataFrame]:
    """Notes at or below a folder; the folder of actions lists one file of each."""
    where = is_action(F.col("path")) if path == "actions" else (F.col("kind") == "note") & below(F.col("path"), path)
    rows, total = listing(items, where, folder_order(path.split("/")[0]), LISTING)
    return {"items": rows, "total": total}


def sources(items: DataFrame) -> DataFrame:
    return items.where("kind = 'record'").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.max("ts").alias("latest"))


def partitions(items: DataFrame, source: str) -> DataFrame:
    """The files of a source with their records, newest name first."""
    counts = items.where((F.col("kind") == "record") & (F.col("source") == source)).groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("path")).limit(PARTITIONS).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("path"))))


def memories(items: DataFrame, path: str, now: datetime, tz: str = "UTC", health: DataFrame | None = None, declared: tuple[str, ...] = ()) -> dict[str, DataFrame] | None:
    """All sources; one source with its files and latest records; or one source in a
    period or a file. None for a source that is neither stored nor declared."""
    parts = path.split("/")
    if len(parts) == 1:
        rows = sources(items)
        return {"sources": rows if health is None else health.join(rows, "source", "left").withColumn("records", F.coalesce("records", F.lit(0)))}
    source = parts[1]
    mine = (F.col("kind") == "record") & (F.col("source") == source)
    if len(parts) > 3 or (source not in declared and items.where(mine).isEmpty()):
        return None
    if len(parts) == 2:
        rows, total = listing(items, mine, newest(), SECTION)
        return {"sources": sources(items.where(mine)), "partitions": partitions(items, source), "items": rows, "total": total}
    name = parts[2]
    if name.endswith(".jsonl") or re.fullmatch(r"snapshot|undated", name):
        where = mine & (F.col("path") == f"memories/{source}/{name.removesuffix('.jsonl')}.jsonl")
    elif found := period(name, now, tz):
        where = mine & in_scope(found, F.col("ts"), F.col("path"))
    else:
        return None
    rows, total = listing(items, where, newest(), PAGE)
    return {"items": rows, "total": total}


def page(items: DataFrame, links: DataFrame, ref: str, now: datetime, tz: str = "UTC") -> dict[str, DataFrame] | None:
    """The page that a ref names; None where it names a note, a record or an identity."""
    if not ref:
        return home(items, links, now)
    if found := period(ref, now, tz):
        return timeline(items, found, ref)
    path = ref.rstrip("/")
    parts = path.split("/")
    if any(p in ("", ".", "..") for p in parts):
        raise ValueError("a page's path has no empty, . or .. steps")
    if parts[0] == "memories":
        return memories(items, path, now, tz)
    if parts[0] in AUTHORED and not path.split("#")[0].endswith(".md") and not (parts[0] == "actions" and len(parts) == 2):
        if path in AUTHORED or not items.where(below(F.col("path"), path)).isEmpty():
            return folder(items, path)
    return None


def context(brain, ref: str, names_of: list[str], exclude: str = "") -> dict[str, DataFrame]:
    """Backlinks by relation and the typed claims of a whole note or record, or of
    an identity that nothing owns. `names_of`: what it expands to."""
    wanted = [r.ref for r in graph.local_refs(brain.graph.names, names_of).limit(graph.ALIASES + 1).collect()]
    if len(wanted) > graph.ALIASES:
        raise ValueError(f"more than {graph.ALIASES} owners")
    totals, latest = graph.backlinks(brain.graph.edges, brain.graph.links, wanted, exclude=exclude or ref)
    why = graph.explanations(brain.graph.edges, latest.select("item").distinct(), wanted)
    return {"backlinks": totals, "items": latest, "explanations": why, "claims": graph.claims(brain.graph.claims, wanted)}


def action_context(brain, path: str) -> dict[str, DataFrame]:
    """The files kept with an action, and the projects that its ACTION.md links to."""
    folder_ = path.rsplit("/", 1)[0]
    files = brain.items.where(below(F.col("path"), folder_) & (F.col("path") != path)).select("path").distinct().orderBy("path").limit(LISTING)
    said = brain.links.where(F.col("item") == path).select(F.col("target").alias("t"))
    at = F.regexp_extract("t", rf"^[a-z]+://{brain.name}/(.*)$", 1)
    projects = said.select(split_ref(F.when(at != "", F.try_url_decode(at)).otherwise(F.col("t")))[0].alias("ref")).where(F.col("ref").startswith("projects/") & is_authored(F.col("ref"))).distinct()
    return {"files": files, "projects": brain.items.join(F.broadcast(projects), "ref", "left_semi").orderBy("ref").limit(SECTION)}


def identity_page(brain, identity: str) -> tuple[dict[str, DataFrame] | None, list[dict]]:
    """(what links to an identity and what it claims, problems); None where nothing
    does, and an error if that could be because something could not be read."""
    expanded, problems = graph.expanded({brain.name: brain.graph}, identity)
    found = context(brain, identity, expanded)
    if found["backlinks"].isEmpty() and found["claims"].isEmpty():
        if problems or (brain.problems is not None and not brain.problems.isEmpty()):
            raise LookupError("the identity may exist: something could not be read")
        return None, problems
    return found, problems


def labelled(rows: DataFrame, brain: str, fragment: str | None = None) -> DataFrame:
    """Rows with their brain and portable address."""
    part = F.col(fragment) if fragment else None
    return rows.withColumns({"brain": F.lit(brain), "uri": address(brain, F.col("ref"), part)})


def guarded(rows: DataFrame, trust: dict[str, str], searched: bool = False) -> DataFrame:
    """`external` marks records of sources that are not the owner's; pages show them
    without an excerpt, searches with it."""
    own = [s for s, t in trust.items() if t == "owner"]
    out = rows.withColumn("external", (F.col("kind") == "record") & ~(F.col("source").isin(own) if own else F.lit(False)))
    if searched or "excerpt" not in rows.columns:
        return out
    return out.withColumn("excerpt", F.when(~F.col("external"), F.col("excerpt")))


def reply_rows(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """`json`: each row as its reply, blanks left out, open and done tasks together,
    without the source and revision of notes. At most MAX_REPLY in all, see sinks."""
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    note = F.col("kind") == "note"
    text = [blank(c).alias(c) for c in ("ref", "path", "kind", "title", "type", "status", "lead", "url") if c in rows.columns]
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")
    more = [F.when(~note, blank("source")).alias("source"), time]
    if "updated" in rows.columns:
        more.append(F.when(~note, F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("updated"))
    if "tasks_open" in rows.columns:
        tasks = F.struct(F.col("tasks_open").alias("open"), F.col("tasks_done").alias("done"), F.col("next"))
        more.append(F.when(F.col("tasks_open") + F.col("tasks_done") > 0, tasks).alias("tasks"))
    return rows.select("ref", F.to_json(F.struct(*text, *more), {"ignoreNullFields": "true"}).alias("json"))
