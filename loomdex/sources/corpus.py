"""The driver's tables as a brain: notes, records, names, links and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.markdown import parse_notes
from loomdex.functions.text import html_text
from loomdex.sources.brain import ITEM, Brain, distilled
from loomdex.sources.config import Config, Field, Program

#: The brain that the tables are projected to.
CONFIG = Config(
    "demo",
    schema={"located-in": Field("identity", relation=True), "k": Field("integer", "one"), "user": Field("identity", relation=True), "tags": Field("string", "many")},
    sensors={
        "click": Program(refresh=3600, trust="owner"), "view": Program(refresh=86_400), "purchase": Program(enabled=False, refresh=3600, mode="snapshot"),
        "mail": Program(refresh=3600, fields={"k": {"path": "/props/k"}}), "notes": Program(),
    },
    routines={"weekly": Program(refresh=604_800, lookback=604_800), "daily": Program(refresh=86_400), "manual": Program()},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: path, status from labels, weight."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "stable").when(F.col("quality") == 0, "draft").otherwise("")
    path = F.concat(F.lit("concepts/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", path.alias("ref"), "lang", "source", "text", status.alias("status"))


def document_passages(items: DataFrame) -> DataFrame:
    """A passage for each line, numbered from 0."""
    return items.select("ref", "status", F.posexplode(F.split("text", "\n")).alias("fragment", "text"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", ref.alias("ref"), F.col("event_type").alias("source"), F.col("ts").alias("time"), "user_id", "value", "props", F.date_format("ts", "yyyy-MM").alias("month"))


def _name(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, subject, relation, target, origin, time of the star schema's keys."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("timestamp_ntz")
    parts = [
        t("orders").select(_name("orders", "o_orderkey").alias("s"), F.lit("placed-by").alias("r"), _name("customer", "o_custkey").alias("t"), F.col("o_orderdate").alias("time")),
        t("customer").select(_name("customer", "c_custkey").alias("s"), F.lit("located-in").alias("r"), _name("nation", "c_nationkey").alias("t"), none.alias("time")),
        t("supplier").select(_name("supplier", "s_suppkey").alias("s"), F.lit("located-in").alias("r"), _name("nation", "s_nationkey").alias("t"), none.alias("time")),
        t("nation").select(_name("nation", "n_nationkey").alias("s"), F.lit("part-of").alias("r"), _name("region", "n_regionkey").alias("t"), none.alias("time")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("s").alias("item"), F.col("s").alias("subject"), F.col("r").alias("relation"), F.col("t").alias("target"), F.col("s").alias("origin"), "time")


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of order_edges for the part and the supplier of each line item."""
    name = F.concat(F.lit("lineitem:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    ends = F.array(
        F.struct(F.lit("contains").alias("relation"), _name("part", "l_partkey").alias("target")),
        F.struct(F.lit("supplied-by").alias("relation"), _name("supplier", "l_suppkey").alias("target")),
    )
    rows = table(spark, sf_dir, "lineitem").select(name.alias("item"), F.explode(ends).alias("end"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"))
    return rows.select("item", F.col("item").alias("subject"), "end.relation", "end.target", F.col("item").alias("origin"), "time")


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_edges(spark, sf_dir).unionByName(line_edges(spark, sf_dir))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, target of every href, as a set."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("target"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


# --- the five tables ---

STATUSES = ("active", "blocked", "paused", "done", "archived")


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a Markdown note of each customer, with metadata, links, tasks and
    sections; every seventh has no date."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = lambda c: c.cast("string")
    status = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (k % 5 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd")
    parts = [
        F.lit("---\ntitle: "), name, F.lit("\nstatus: "), status, F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("\nupdated: "), day)), F.lit("\naliases: [customer:"), text(k), F.lit("]\n---\n# "), name,
        F.lit("\n\nHeld in [nation](../concepts/nations.md#n-"), text(F.col("c_nationkey")), F.lit(") by [desk](brain://demo/projects/"), text(k + 1), F.lit(".md?rel=located-in).\n\n## Orders\n- [ ] call "), text(k),
        F.lit("\n- [x] mail *"), text(k), F.lit("*\n"), F.when(k % 3 == 0, F.lit("- [ ] visit\n")).otherwise(F.lit("")), F.lit("\n## Next actions!\nBalance "), text(F.floor("c_acctbal")), F.lit(" `code [x](y)`.\n"),
    ]
    return table(spark, sf_dir, "customer").select(_project(k).alias("path"), F.concat(*parts).alias("text"))


def _project(key: Column) -> Column:
    return F.concat(F.lit("projects/"), key.cast("string"), F.lit(".md"))


def notes(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The struct of each customer's note, or the wanted columns, read from its Markdown."""
    return parse_notes(customer_notes(spark, sf_dir), *wanted)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITEM of customers (projects), suppliers (actions), documents (concepts) and
    events (records, every fourth revised 20 days later). No Markdown is read."""
    none = F.lit(None)
    blank = F.lit("")

    def row(rows: DataFrame, **columns: Column) -> DataFrame:
        fill = {"source": blank, "type": blank, "status": blank, "lead": blank, "url": blank, "next": none, "partial": F.lit(False), "weight": F.lit(1)}
        held = fill | columns
        return rows.select(*[held.get(c.split()[0], none).cast(c.split()[1]).alias(c.split()[0]) for c in ITEM.split(", ")])

    k, s = F.col("c_custkey"), F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (k % 5 + 1).cast("int"))
    day = F.when(k % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")))
    action = F.concat(F.lit("actions/2024-01-"), F.lpad((1 + s % 28).cast("string"), 2, "0"), F.lit("_s-"), s.cast("string"), F.lit("/ACTION.md"))
    docs, events = document_items(spark, sf_dir), event_items(spark, sf_dir)
    later = F.when(F.col("event_id") % 4 == 0, F.col("time") + F.expr("INTERVAL 20 DAYS"))
    parts = [
        row(table(spark, sf_dir, "customer"), ref=_project(k), path=_project(k), kind=F.lit("note"), title=F.col("c_name"), day=day, type=F.lit("project"), status=status, weight=F.lit(2)),
        row(table(spark, sf_dir, "supplier"), ref=action, path=action, kind=F.lit("note"), title=F.col("s_name"), day=F.date_add(F.lit("2024-01-01").cast("date"), (s % 28).cast("int")), type=F.lit("action"), weight=F.lit(2)),
        row(docs, ref=F.col("ref"), path=F.col("ref"), kind=F.lit("note"), title=F.concat(F.lit("Document "), F.col("doc_id").cast("string")), type=F.lit("concept"), status=F.col("status"), weight=distilled(F.col("ref"))),
        row(events, ref=F.col("ref"), path=F.concat(F.lit("memories/"), "source", F.lit("/"), "month", F.lit(".jsonl")), kind=F.lit("record"), source=F.col("source"), title=F.col("source"), time=F.col("time"), updated=later),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, item: a customer's identity and its market segment (shared) are names of
    its note, a supplier's of its action."""
    c = table(spark, sf_dir, "customer").select(_project(F.col("c_custkey")).alias("item"), F.array(_name("customer", "c_custkey"), F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("crm:"), F.col("c_custkey").cast("string"))).alias("n"))
    return c.select(F.explode("n").alias("name"), "item")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, target, time: every claim as a link, and untyped ones from each third
    order to a nation or to a section of its customer's identity."""
    every = order_edges(spark, sf_dir).select("item", "target", "time")
    third = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    section = F.concat(_name("customer", "o_custkey"), F.lit("#note-"), (F.col("o_orderkey") % 4).cast("string"))
    target = F.when(F.col("o_orderkey") % 2 == 0, section).otherwise(F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")))
    return every.unionByName(third.select(_name("orders", "o_orderkey").alias("item"), target.alias("target"), F.col("o_orderdate").alias("time"))).distinct()


def brain(spark: SparkSession, sf_dir: str) -> Brain:
    words = document_items(spark, sf_dir)
    passages = words.select("ref", F.lit("").alias("fragment"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("heading"), "text", F.concat_ws(" ", "lang", "source").alias("names"), distilled(F.col("ref")).alias("weight"), "status")
    return Brain(CONFIG.name, items(spark, sf_dir), passages, names(spark, sf_dir), links(spark, sf_dir), order_edges(spark, sf_dir))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, value: a JSON line of each event; seven of ten have a fault of their own."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    q = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    key, n = F.concat_ws(":", "event_type", F.col("event_id").cast("string")), F.col("event_id") % 10
    good = F.concat_ws(",", q("id", key), q("title", F.col("event_type")), q("time", F.concat(at, F.lit("+02:00"))), F.concat(F.lit('"links":["person:'), F.col("user_id").cast("string"), F.lit('"]')), F.concat(F.lit('"attributes":'), "props"))
    bad = [
        (1, F.concat(good, F.lit(',"extra":1'))), (2, F.concat_ws(",", q("id", key), q("title", F.col("event_type")), q("time", at))), (3, F.concat(F.lit('"id":'), F.col("event_id").cast("string"), F.lit(',"title":"x"'))),
        (4, F.concat_ws(",", q("id", key), F.lit('"title":"a\\u0007b"'))), (5, F.concat_ws(",", q("id", key), F.lit('"title":" "'))), (6, F.concat(good, F.lit(',"title":"again"'))), (7, F.concat_ws(",", q("id", key), q("title", F.col("event_type")), F.lit('"links":"x"'))),
    ]
    line = F.when(n == bad[0][0], bad[0][1])
    for k, v in bad[1:]:
        line = line.when(n == k, v)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), line.otherwise(good), F.lit("}")).alias("value"))
