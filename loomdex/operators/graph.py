"""Identities, links and claims over flat edge tables; single hop only.

Each function takes tables, or keyed tables of a store: there links and claims are
kept by every prefix of their target (`reach`), claims by subject, names by name and
by item, so a question about some names opens their folders only.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.temporal import bound
from loomdex.sources.segments import Keyed, Store

#: Wanted names that travel as literals, and as a broadcast table; more are shuffled.
LITERALS, BROADCAST = 1000, 200_000
ALIASES, CLAIMS, SECTION, GROUPS, REVIEW_DAYS = 1001, 50, 20, 64, 14

Wanted = DataFrame | list[str]
Rows = DataFrame | Keyed
#: Tables of a stored graph and the columns they are looked up by.
KEYS = {"items": "ref", "names": "name", "owned": "item", "reach": "key", "edges": "subject"}


def candidate_targets(target: Column) -> Column:
    """A target and every prefix of it that ends before a '#': a link to a section
    also reaches the whole. Equi-joins on these replace a range predicate."""
    parts = F.split(target, "#")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "#"))


def wanted_rows(rows: Rows, key: str, wanted: Wanted) -> DataFrame:
    """Rows whose `key` is wanted: a literal set is looked up in a keyed table, or is a
    filter that reaches the scan; a table of names is broadcast while it is small."""
    if isinstance(wanted, list):
        return rows.lookup(wanted) if isinstance(rows, Keyed) and rows.key == key else _all(rows).where(F.col(key).isin(wanted))
    names = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct()
    return _all(rows).join(_small(names), key, "left_semi")


def _all(rows: Rows) -> DataFrame:
    return rows.rows() if isinstance(rows, Keyed) else rows


def _small(names: DataFrame) -> DataFrame:
    """With a hint while it has BROADCAST rows at most; no more are counted."""
    return F.broadcast(names) if names.limit(BROADCAST + 1).count() <= BROADCAST else names


def linking(links: Rows, wanted: Wanted) -> DataFrame:
    """Links whose target, or the whole it is a section of, is wanted (a list, or a
    table with a column `target`); a row per link and wanted target. Literals are
    compared before links are exploded; a keyed table is exploded already."""
    if isinstance(links, Keyed):
        if isinstance(wanted, list):
            return links.lookup(wanted).withColumnRenamed("key", "wanted")
        asked = wanted.select(F.col("target").alias("key")).distinct()
        return links.rows().join(_small(asked), "key").withColumnRenamed("key", "wanted")
    candidates = candidate_targets(F.col("target"))
    if isinstance(wanted, list) and len(wanted) <= LITERALS:
        asked = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
        return links.where(F.arrays_overlap(candidates, asked)).withColumn("wanted", F.explode(F.array_intersect(candidates, asked)))
    table = links.sparkSession.createDataFrame([(w,) for w in wanted], "wanted string") if isinstance(wanted, list) else wanted.select(F.col("target").alias("wanted"))
    return links.withColumn("wanted", F.explode(candidates)).join(_small(table.distinct()), "wanted")


# --- the stored graph ---


def tables(items: DataFrame, names: DataFrame, links: DataFrame, edges: DataFrame, files: int = 0) -> dict[str, DataFrame]:
    """The tables of KEYS from items (ref, time, ...), names (name, item), links (item,
    target, time) and edges (item, subject, relation, target, origin, time). Names have
    their item's time; a link and a claim have a row for each prefix of their target
    that ends before a '#', the claim with its relation. `files`: for a store where all
    is dealt, into how many tasks links and claims are, before they are exploded."""
    deal = lambda df: df.repartition(files, "item") if files else df
    at = items.select(F.col("ref").alias("item"), "time").dropDuplicates(["item"])
    named = names.select("name", "item").join(at, "item", "left")
    none = F.lit(None).cast("string")
    bare = links.select("item", none.alias("subject"), none.alias("relation"), "target", none.alias("origin"), "time")
    said = edges.select("item", "subject", F.coalesce("relation", F.lit("")).alias("relation"), "target", "origin", "time")
    reach = deal(bare.unionByName(said)).withColumn("key", F.explode(F.array_distinct(candidate_targets(F.col("target")))))
    own = lambda df, c: df.withColumn("owner", F.col(c))
    return {"items": own(items, "ref"), "names": own(named, "item"), "owned": own(named, "item"), "reach": own(reach, "item"), "edges": own(deal(edges), "item")}


@dataclass(frozen=True)
class Graph:
    """Names, links and claims in the ways they are asked for."""

    items: Rows
    names: Rows
    owned: Rows  # names, by item
    links: Rows  # by target
    edges: Rows  # by target
    claims: Rows  # by subject

    @classmethod
    def of(cls, items: DataFrame, names: DataFrame, links: DataFrame, edges: DataFrame) -> Graph:
        return cls(items, names, names, links, edges, edges)

    @classmethod
    def stored(cls, store: Store, at: dict) -> Graph:
        reach = lambda where: Keyed(store, "reach", at, where)
        return cls(Keyed(store, "items", at), Keyed(store, "names", at), Keyed(store, "owned", at), reach("relation is null"), reach("relation is not null"), Keyed(store, "edges", at))


# --- identities ---


def unique_owners(names: DataFrame) -> DataFrame:
    """name, item of names with one owner; shared names never merge."""
    return names.groupBy("name").agg(F.countDistinct("item").alias("n"), F.min("item").alias("item")).where("n = 1").drop("n")


def ambiguous(names: DataFrame) -> DataFrame:
    return names.groupBy("name").agg(F.countDistinct("item").alias("owners")).where("owners > 1")


def expand(names: DataFrame, identity: str) -> DataFrame:
    """Aliases of the only owner of `identity`, without those that others claim."""
    sole = unique_owners(names)
    owner = sole.where(F.col("name") == identity).select("item")
    return names.join(owner, "item", "left_semi").join(sole.select("name"), "name", "left_semi").select("name").distinct()


def expanded(names: Rows | dict[str, Graph], identity: str) -> tuple[list[str], list[dict]]:
    """(the identity and what it expands to, problems). names: a table of name and
    item, or the graphs of several brains. An identity of several owners stays alone;
    aliases that others claim too are left out; more than ALIASES are an error."""
    graphs = names if isinstance(names, dict) else {"": Graph(names, names, names, names, names, names)}
    of = lambda wanted: [(b, r.item, r.name) for b, g in graphs.items() for r in wanted_rows(g.names, "name", wanted).select("item", "name").distinct().limit(ALIASES + 1).collect()]
    owners_ = sorted({(b, item) for b, item, _ in of([identity])})
    if len(owners_) > 1:
        return [identity], [{"error": f"ambiguous identity {identity}: use an exact reference"}]
    if not owners_:
        return [identity], []
    brain, item = owners_[0]
    held = [r.name for r in wanted_rows(graphs[brain].owned, "item", [item]).select("name").distinct().limit(ALIASES + 1).collect()]
    if len(held) > ALIASES:
        raise ValueError(f"{identity} has more than {ALIASES} aliases")
    # Another owner of an alias is enough; how many there are doesn't matter.
    others = [wanted_rows(g.names, "name", held).where((F.lit(b) != brain) | (F.col("item") != item)).select("name").distinct() for b, g in graphs.items()]
    shared = {r.name for rows in others for r in rows.collect()}
    problems = [{"error": f"{len(shared)} aliases have other owners too and were not expanded"}] if shared else []
    return sorted({identity} | (set(held) - shared)), problems


def local_refs(names: Rows, identities: Wanted) -> DataFrame:
    """ref: the identities, and the items that alone own one of them."""
    found = wanted_rows(names, "name", identities)
    owned = unique_owners(found).select(F.col("item").alias("ref"))
    asked = found.sparkSession.createDataFrame([(i,) for i in identities], "ref string") if isinstance(identities, list) else identities.select(F.col(identities.columns[0]).alias("ref"))
    return asked.union(owned).distinct()


def owners(names: Rows, identity: str) -> DataFrame:
    return wanted_rows(names, "name", [identity]).select(F.col("item").alias("ref")).distinct()


def identity_candidates(held: Graph, identity: str, aliases: list[str] | None = None) -> DataFrame:
    """ref, score, time: the item itself 2e6, an owner of a name 1e6, a linker 1e3,
    of the identity or of what it expands to. Names and links have the time of their
    item where they are stored; else it is joined to what was found."""
    wanted = sorted({identity, *(aliases or [])})
    exact = wanted_rows(held.items, "ref", wanted).select("ref", F.lit(2e6).alias("score"), "time")
    own = wanted_rows(held.names, "name", wanted)
    if "time" not in own.columns:
        own = own.join(_all(held.items).select(F.col("ref").alias("item"), "time"), "item", "left")
    own = own.select(F.col("item").alias("ref"), F.lit(1e6).alias("score"), "time")
    linkers = linking(held.links, wanted).select(F.col("item").alias("ref"), F.lit(1e3).alias("score"), "time")
    return exact.unionAll(own).unionAll(linkers).groupBy("ref").agg(F.max("score").alias("score"), F.max("time").alias("time"))


def identity_order(candidates: DataFrame, limit: int) -> DataFrame:
    """ref, score, rank: the item, then owners, then linkers, the newest first."""
    order = [F.desc("score"), F.desc("time"), F.asc("ref")]
    return candidates.orderBy(*order).limit(limit).select("ref", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def known(held: Graph, asked: list[str]) -> DataFrame:
    """name, is_known of the asked identities, whatever the scope."""
    said = wanted_rows(held.items, "ref", asked).select(F.col("ref").alias("name"))
    said = said.union(wanted_rows(held.names, "name", asked).select("name")).union(linking(held.links, asked).select(F.col("wanted").alias("name"))).distinct()
    names = said.sparkSession.createDataFrame([(a,) for a in asked], "name string")
    return names.join(said.withColumn("is_known", F.lit(True)), "name", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


# --- links and claims ---


def incoming(edges: Rows, links: Rows, wanted: Wanted, exclude: str = "") -> DataFrame:
    """item, relation, time of what links to the wanted: typed edges, and as
    untyped ('') the links of items without a typed one. The item itself is out."""
    typed = linking(edges, wanted).where("relation <> ''").select("item", "relation", "time", "wanted")
    bare = linking(links, wanted).select("item", F.lit("").alias("relation"), "time", "wanted")
    both = typed.unionByName(bare.join(typed.select("item").distinct(), "item", "left_anti"))
    return both.where((F.col("item") != F.col("wanted")) & (F.col("item") != exclude)).select("item", "relation", "time").distinct()


def grouped(found: DataFrame, newest: int = SECTION) -> tuple[DataFrame, DataFrame]:
    """(relation, total, place: typed relations first, GROUPS at most) and the
    newest items of each relation with their rank."""
    order = Window.partitionBy("relation").orderBy(F.desc("time"), "item")
    latest = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= newest)
    totals = found.groupBy("relation").agg(F.count(F.lit(1)).alias("total")).orderBy(F.col("relation") == "", "relation").limit(GROUPS)
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("relation") == "", "relation"))), latest


def backlinks(edges: Rows, links: Rows, wanted: Wanted, newest: int = SECTION, exclude: str = "") -> tuple[DataFrame, DataFrame]:
    return grouped(incoming(edges, links, wanted, exclude), newest)


def merged(parts: dict[str, DataFrame], newest: int = SECTION) -> tuple[DataFrame, DataFrame]:
    """Backlinks (rows of `incoming`) of several brains together: totals add up, the
    newest of all stay. The newest have their brain."""
    both = None
    for name, rows in parts.items():
        rows = rows.withColumn("brain", F.lit(name))
        both = rows if both is None else both.unionByName(rows)
    order = Window.partitionBy("relation").orderBy(F.desc("time"), "brain", "item")
    latest = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= newest)
    totals, _ = grouped(both, newest)
    return totals, latest


def claims(edges: Rows, subjects: Wanted, limit: int = CLAIMS) -> DataFrame:
    """Different typed claims of the subjects, at most `limit` of each, with their
    number `n` and whether there are more (`truncated`)."""
    said = wanted_rows(edges, "subject", subjects).where("relation <> ''").select("subject", "relation", "target", "origin").distinct()
    return _few(said, ["subject"], ["relation", "target", "origin"], limit)


def _few(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each group; one more is looked at to know of it."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    sentinel = rows.withColumn("n", number).where(F.col("n") <= limit + 1)
    more = F.max("n").over(Window.partitionBy(*group)) > limit
    return sentinel.withColumn("truncated", more).where(F.col("n") <= limit)


def explanations(edges: Rows, refs: Wanted, targets: Wanted, limit: int = CLAIMS) -> DataFrame:
    """Why the items `refs` are linked: their claims about the targets or sections
    of them, at most `limit` an item, with n and truncated."""
    near = linking(edges, targets) if isinstance(edges, Keyed) else linking(wanted_rows(edges, "item", refs), targets)
    said = (wanted_rows(near, "item", refs) if isinstance(edges, Keyed) else near).select("item", "subject", "relation", "target", "origin").distinct()
    return _few(said, ["item"], ["relation", "target", "origin", "subject"], limit)


def newer_links(projects: DataFrame, links: DataFrame) -> DataFrame:
    """ref, newer: links to a project dated from the day after its update on."""
    hits = linking(links, projects.select(F.col("ref").alias("target"))).select(F.col("wanted").alias("ref"), "item", "time").distinct()
    late = projects.join(hits, "ref").where(F.col("time") >= F.date_add("updated", 1).cast("timestamp_ntz"))
    return late.groupBy("ref").agg(F.countDistinct("item").alias("newer"))


def review(projects: DataFrame, newer: DataFrame, now: datetime) -> DataFrame:
    """projects (ref, type, status, ts) with `newer` and `review`: an open project
    is due without a date, after REVIEW_DAYS, or when newer items link to it."""
    both = projects.join(newer.select("ref", "newer"), "ref", "left").withColumn("newer", F.coalesce("newer", F.lit(0)))
    open_ = (F.col("type") == "project") & F.col("status").isin("active", "blocked")
    old = F.col("ts").isNull() | (F.col("ts") < bound(now - timedelta(days=REVIEW_DAYS)))
    return both.withColumn("review", open_ & (old | (F.col("newer") > 0)))
