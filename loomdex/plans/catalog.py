"""Named queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex import sinks
from loomdex.functions.identity import at_pointer, strict_json
from loomdex.functions.temporal import below, period
from loomdex.functions.text import STOP
from loomdex.operators import checks, graph, health, ingest, pages, search
from loomdex.sources import adapters, corpus
from loomdex.sources import brain as brains
from loomdex.sources.segments import Store

QUERY = "the and of tion hand eauxle"
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-01-31'"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


_ITEMS = """items AS (SELECT d.doc_id, 'concepts/' || lang || '/' || d.doc_id || '.md' AS ref, lang, source, text,
  CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 1 THEN 'stable' WHEN quality = 0 THEN 'draft' ELSE '' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = f"""{_ITEMS},
tok AS (SELECT *, {_TOKENS} AS toks FROM items),
stats AS (SELECT count(*) AS n_all, avg(len(toks)) AS avgd FROM tok),
terms AS (SELECT unnest(['tion', 'hand', 'eauxle']) AS term),
post AS (SELECT ref, lang, status, doc_id, len(toks) AS d, term, len(list_filter(toks, lambda w: w = term)) AS f FROM tok, terms),
hit AS (SELECT * FROM post WHERE f > 0),
df AS (SELECT term, count(*) AS n FROM hit GROUP BY term),
scored AS (SELECT ref, lang, status, doc_id,
  round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd))), 6) AS score
  FROM hit JOIN df USING (term), stats GROUP BY ALL)"""


def _index(spark: SparkSession, sf_dir: str, kind: str) -> search.Index:
    """The stored index of the documents, or of their lines: written once, read by
    every query, and written anew when the tables' files are others."""
    name = "".join(c if c.isalnum() else "-" for c in sf_dir)
    root = sinks.shared_folder(spark, f"index-{kind}-{name}")
    told = {"kind": kind, "manifest": " ".join(sinks.fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))}
    held = search.open_index(spark, root)
    if held is not None and told.items() <= held.at["note"].items():
        return held
    items = corpus.document_items(spark, sf_dir)
    if kind == "lines":
        passages = corpus.document_passages(items).drop("status").withColumn("fragment", F.format_string("%010d", "fragment"))
    elif kind == "weighted":
        passages = corpus.brain(spark, sf_dir).passages
    else:
        passages = items.drop("source").withColumn("fragment", F.lit(""))
    return search.build(passages, root, stemmed=kind == "words", note=told)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "words").find(QUERY, stemmed=False).drop("fragment")


@query(f"""WITH {_ITEMS}, tok AS (SELECT {_TOKENS} AS toks FROM items)
SELECT (SELECT count(*) FROM items) AS passages, sum(len(toks))::BIGINT AS tokens, (SELECT count(*) FROM (SELECT unnest(list_distinct(toks)) FROM tok))::BIGINT AS postings FROM tok""")
def index_build(spark, sf_dir):
    """Index the documents anew, as after a change of all tables; what it then holds."""
    items = corpus.document_items(spark, sf_dir).drop("source").withColumn("fragment", F.lit(""))
    name = "".join(c if c.isalnum() else "-" for c in sf_dir)
    index = search.build(items, sinks.shared_folder(spark, f"index-anew-{name}"))
    index.store.vacuum(0)
    held = index.store.table("postings", index.at).agg(F.count(F.lit(1)).alias("postings"), F.sum("n").alias("tokens"))
    return held.select(F.lit(index.at["sums"]["passages"]).cast("bigint").alias("passages"), "tokens", "postings")


@query(f"WITH {_BM25} SELECT ref, score, row_number() OVER (ORDER BY score DESC, ref) AS rank FROM scored ORDER BY score DESC, ref LIMIT 10")
def search_terms(spark, sf_dir):
    return search.ranked(_scored(spark, sf_dir).select("ref", "score"), 10)


_STATE = """state AS (SELECT event_type || ':' || event_id AS ref, CASE WHEN event_id % 2 = 0 THEN 'second ' || event_type || ' w' || event_id % 13 ELSE 'first ' || event_type || ' w' || event_id % 17 END AS text
  FROM events WHERE event_id % 2 = 0 OR (event_id % 3 <> 0 AND event_id % 5 <> 0)),
tok AS (SELECT ref, string_split(text, ' ') AS toks FROM state), n AS (SELECT count(*) AS n_all, avg(len(toks)) AS avgd FROM tok),
hit AS (SELECT ref, len(toks) AS d, term, len(list_filter(toks, lambda w: w = term)) AS f FROM tok, (SELECT unnest(['second', 'w3', 'click']) AS term)),
df AS (SELECT term, count(*) AS n FROM hit WHERE f > 0 GROUP BY term),
scored AS (SELECT ref, round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd))), 6) AS score FROM hit JOIN df USING (term), n WHERE f > 0 GROUP BY ref)"""


@query(f"WITH {_STATE} SELECT ref, score, (SELECT n_all FROM n) AS passages FROM scored ORDER BY score DESC, ref LIMIT 50")
def search_refreshed(spark, sf_dir):
    """An index after a change equals one of the state: two of three events are
    indexed, then every second one is new or changed and each odd fifth one goes."""
    e = corpus.event_items(spark, sf_dir)
    n, kind = F.col("event_id"), F.col("source")
    text = lambda word, m: F.concat(F.lit(f"{word} "), kind, F.lit(" w"), (n % m).cast("string")).alias("text")
    first = e.where(n % 3 != 0).select("ref", F.lit("").alias("fragment"), text("first", 17))
    second = e.where(n % 2 == 0).select("ref", F.lit("").alias("fragment"), text("second", 13))
    gone = e.where((n % 5 == 0) & (n % 2 != 0)).select("ref")
    name = "".join(c if c.isalnum() else "-" for c in sf_dir)
    index = search.build(first, sinks.shared_folder(spark, f"index-changed-{name}"))
    index.store.vacuum(0)
    index, _ = search.refresh(index, second, gone)
    top = search.ranked(index.find("second w3 click").select("ref", "score"), 50)
    return top.select("ref", "score", F.lit(index.statistics()[0]).cast("bigint").alias("passages"))


_STOPS = ", ".join(f"'{w}'" for w in STOP)


@query(rf"""WITH {_ITEMS}, tok AS (SELECT ref, status, {_TOKENS} AS toks FROM items), stats AS (SELECT count(*) AS n_all, avg(len(toks)) AS avgd FROM tok),
asked AS (SELECT item_id::VARCHAR AS name, list_distinct(regexp_extract_all(lower(left(text, 60)), '[\p{{L}}\p{{N}}]+')) AS words FROM benchmark),
terms AS (SELECT name, unnest(CASE WHEN len(list_filter(words, lambda w: NOT list_contains([{_STOPS}], w))) > 0 THEN list_filter(words, lambda w: NOT list_contains([{_STOPS}], w)) ELSE words END) AS term FROM asked),
post AS (SELECT ref, status, len(toks) AS d, unnest(toks) AS term FROM tok), hit AS (SELECT ref, status, d, term, count(*) AS f FROM post WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM hit GROUP BY term),
scored AS (SELECT name, ref, status, round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd))), 6) AS score FROM terms JOIN hit USING (term) JOIN df USING (term), stats GROUP BY ALL),
ranked AS (SELECT name, ref, score, row_number() OVER (PARTITION BY name ORDER BY status IN ('deprecated', 'archived'), score DESC, ref) AS rank FROM scored)
SELECT name, ref, score, rank FROM ranked WHERE rank <= 5""")
def search_batch(spark, sf_dir):
    """The beginning of every benchmark passage as a question, all in one plan."""
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.left("text", F.lit(60)).alias("query"))
    return search.find_all(_index(spark, sf_dir, "words"), asked, 5, stemmed=False).select("name", "ref", "score", "rank")


@query()
def search_stemmed(spark, sf_dir):
    """Stems and accents have no SQL: the tests compare them with brute force."""
    return search.ranked(_index(spark, sf_dir, "words").find(QUERY, stemmed=True).select("ref", "score"), 10)


_WEIGHED = _BM25.split("tok AS (")[0] + f"""tok AS (SELECT ref, status, {_TOKENS} AS toks, regexp_extract_all(lower('Document ' || doc_id), '[\\p{{L}}\\p{{N}}]+') AS head,
  regexp_extract_all(lower(concat_ws(' ', lang, source)), '[\\p{{L}}\\p{{N}}]+') AS nam FROM items),
stats AS (SELECT count(*) AS n_all, avg(len(toks) + len(head) + len(nam)) AS avgd FROM tok),
terms AS (SELECT unnest(['document', '17', 'src1', 'tion']) AS term),
post AS (SELECT ref, status, len(toks) + len(head) + len(nam) AS d, term, 10.0 * len(list_filter(head, lambda w: w = term)) + len(list_filter(toks, lambda w: w = term)) + 0.5 * len(list_filter(nam, lambda w: w = term)) AS f FROM tok, terms),
hit AS (SELECT * FROM post WHERE f > 0), df AS (SELECT term, count(*) AS n FROM hit GROUP BY term),
scored AS (SELECT ref, status, round(2 * sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd))), 6) AS score
  FROM hit JOIN df USING (term), stats GROUP BY ALL)"""


@query(f"WITH {_WEIGHED} SELECT ref, status, score, row_number() OVER (ORDER BY status IN ('deprecated', 'archived'), score DESC, ref) AS rank FROM scored ORDER BY rank LIMIT 20")
def search_weighted(spark, sf_dir):
    """Headings weigh 10, names half, distilled notes twice; deprecated ones come last."""
    found = _index(spark, sf_dir, "weighted").find("document 17 src1 tion")
    return search.ranked(found.select("ref", "status", "score"), 20, status="status")


@query(rf"""WITH {_BM25}, top AS (SELECT ref, row_number() OVER (ORDER BY score DESC, ref) AS rank FROM scored ORDER BY score DESC, ref LIMIT 10),
w AS (SELECT rank, ref, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM top JOIN items USING (ref)),
each AS (SELECT rank, ref, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
hits AS (SELECT rank, ref, n, i, unnest(list_distinct(regexp_extract_all(lower(word), '[\p{{L}}\p{{N}}]+'))) AS term FROM each), few AS (SELECT * FROM hits WHERE term IN ('tion', 'hand', 'eauxle')),
windows AS (SELECT a.rank, a.ref, a.n, a.i, count(DISTINCT b.term) AS terms, max(b.i) AS last FROM few a JOIN few b ON a.rank = b.rank AND b.i BETWEEN a.i AND a.i + 47 GROUP BY ALL),
best AS (SELECT *, greatest(0, i - least(8, 48 - (last - i + 1))) AS start FROM windows QUALIFY row_number() OVER (PARTITION BY rank ORDER BY terms DESC, i) = 1)
SELECT rank, ref, CASE WHEN start > 0 THEN ' … ' ELSE '' END || array_to_string(list_slice(words, start + 1, start + 48), ' ') || CASE WHEN n > start + 48 THEN ' … ' ELSE '' END AS excerpt FROM best JOIN w USING (rank, ref)""")
def search_excerpt(spark, sf_dir):
    """The first ten with the 48 words that hold most of the different words asked
    for; only the texts of these ten are read."""
    index = _index(spark, sf_dir, "words")
    top = search.ranked(index.find(QUERY, stemmed=False).select("ref", "fragment", "score"), 10)
    texts = corpus.document_items(spark, sf_dir).select("ref", F.lit("").alias("fragment"), "text")
    return index.returned(top, QUERY, texts, stemmed=False).select("rank", "ref", "excerpt")


@query(f"WITH {_BM25} SELECT ref, score, row_number() OVER (ORDER BY score DESC, ref) AS rank FROM scored WHERE ref LIKE 'concepts/fr/%' ORDER BY score DESC, ref LIMIT 10")
def search_scoped_lang(spark, sf_dir):
    return search.ranked(_scored(spark, sf_dir).where(below(F.col("ref"), "concepts/fr")).select("ref", "score"), 10)


@query(f"""WITH {_BM25}, o AS (SELECT ref, status, score, row_number() OVER (ORDER BY status IN ('deprecated', 'archived'), score DESC, ref) AS rank FROM scored)
SELECT * FROM o WHERE rank <= 50""")
def search_demoted(spark, sf_dir):
    return search.ranked(_scored(spark, sf_dir).select("ref", "status", "score"), 50, status="status")


@query(f"""WITH {_BM25}, r AS (SELECT ref, score, doc_id % 2 AS brain, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY score DESC, ref) AS rank_in_brain FROM scored)
SELECT ref, brain, rank_in_brain, row_number() OVER (ORDER BY rank_in_brain, brain) AS rank FROM r WHERE rank_in_brain <= 5""")
def interleave(spark, sf_dir):
    order = Window.partitionBy("brain").orderBy(F.desc(F.round("score", 6)), "ref")
    rows = _scored(spark, sf_dir).withColumn("brain", F.col("doc_id") % 2).withColumn("rank_in_brain", F.row_number().over(order)).where("rank_in_brain <= 5")
    return search.interleave(rows.select("ref", "brain", "rank_in_brain"), 10)


@query(rf"""WITH {_ITEMS}, ps AS (SELECT ref, status, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS fragment FROM items),
tok AS (SELECT ref, fragment, {_TOKENS} AS toks FROM ps),
stats AS (SELECT count(*) AS n_all, avg(len(toks)) AS avgd FROM tok),
hit AS (SELECT * FROM (SELECT ref, fragment, len(toks) AS d, term, len(list_filter(toks, lambda w: w = term)) AS f FROM tok, (SELECT unnest(['tion', 'hand', 'eauxle']) AS term)) WHERE f > 0),
df AS (SELECT term, count(*) AS n FROM hit GROUP BY term),
s AS (SELECT ref, fragment, round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd))), 6) AS score
  FROM hit JOIN df USING (term), stats GROUP BY ALL)
SELECT ref, fragment, score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, fragment) AS n FROM s) WHERE n = 1""")
def search_best_passage(spark, sf_dir):
    scored = _index(spark, sf_dir, "lines").find(QUERY).withColumn("score", F.round("score", 6))
    return search.best_passage(scored).select("ref", F.col("fragment").cast("int").alias("fragment"), "score")


@query(f"WITH {_ITEMS} SELECT count(*) AS n_passages, sum(len({_TOKENS})) AS n_tokens, round(avg(len({_TOKENS})), 4) AS avg_len FROM items")
def bm25_stats(spark, sf_dir):
    return search.statistics(corpus.table(spark, sf_dir, "documents").select("text")).withColumn("avg_len", F.round("avg_len", 4))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    from loomdex.functions.text import tokens

    rows = corpus.table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_EDGES = """edges AS (
  SELECT 'orders:' || o_orderkey AS item, 'placed-by' AS relation, 'customer:' || o_custkey AS target, o_orderdate AS time FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'located-in', 'nation:' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located-in', 'nation:' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'part-of', 'region:' || n_regionkey, NULL FROM nation)"""


@query(f"WITH {_EDGES} SELECT target, relation, count(DISTINCT item) AS total FROM edges GROUP BY target, relation")
def backlink_totals(spark, sf_dir):
    return corpus.order_edges(spark, sf_dir).groupBy("target", "relation").agg(F.countDistinct("item").alias("total"))


_ALL_EDGES = f"""{_EDGES}, lines AS (SELECT 'lineitem:' || l_orderkey || '-' || l_linenumber AS item, * FROM lineitem),
all_edges AS (SELECT item, relation, target FROM edges UNION ALL SELECT item, 'contains', 'part:' || l_partkey FROM lines
  UNION ALL SELECT item, 'supplied-by', 'supplier:' || l_suppkey FROM lines)"""


@query(f"WITH {_ALL_EDGES} SELECT target, relation, count(DISTINCT item) AS total FROM all_edges GROUP BY target, relation")
def backlink_totals_all(spark, sf_dir):
    return corpus.all_edges(spark, sf_dir).groupBy("target", "relation").agg(F.countDistinct("item").alias("total"))


_LINKS = """links AS (
  SELECT item, target, time FROM edges
  UNION SELECT 'orders:' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'customer:' || o_custkey || '#note-' || (o_orderkey % 4) ELSE 'nation:' || (o_custkey % 25) END, o_orderdate
    FROM orders WHERE o_orderkey % 3 = 0),
names AS (SELECT 'customer:' || c_custkey AS name, 'projects/' || c_custkey || '.md' AS item FROM customer
  UNION ALL SELECT 'segment:' || c_mktsegment, 'projects/' || c_custkey || '.md' FROM customer
  UNION ALL SELECT 'crm:' || c_custkey, 'projects/' || c_custkey || '.md' FROM customer)"""
_LINKING = """linking AS (SELECT item, target, time, target AS wanted FROM links
  UNION ALL SELECT item, target, time, split_part(target, '#', 1) FROM links WHERE contains(target, '#'))"""
_INCOMING = f"""{_EDGES}, {_LINKS}, {_LINKING}, found AS (
  SELECT DISTINCT item, relation, time FROM edges WHERE target IN ('customer:7', 'nation:3')
  UNION SELECT DISTINCT item, '', time FROM linking WHERE wanted IN ('customer:7', 'nation:3') AND item NOT IN (SELECT item FROM edges WHERE target IN ('customer:7', 'nation:3')))"""
_WANTED = ["customer:7", "nation:3"]


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The stored graph of the star schema's keys, written once for the tables' files."""
    name = "".join(c if c.isalnum() else "-" for c in sf_dir)
    kept = Store(spark, sinks.shared_folder(spark, f"graph-{name}"), graph.KEYS, (), tuple(graph.KEYS))
    told = {"format": "2", "manifest": " ".join(sinks.fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "supplier", "nation"))}
    held = kept.head()
    if held is None or held["note"] != told:
        held = _graph_build(spark, sf_dir, kept, told)
    return graph.Graph.stored(kept, held)


#: Rows of the tables that one task of the stored graph makes its rows of.
GRAPH_ROWS = 500_000


def _graph_build(spark: SparkSession, sf_dir: str, kept: Store, told: dict) -> dict:
    """All rows stay with their item: nothing is shuffled by what it is looked up by, and
    no task makes more than it sorts in memory."""
    edges = corpus.order_edges(spark, sf_dir)
    n = edges.count()
    files = max(1, -(-n // GRAPH_ROWS), min(spark.sparkContext.defaultParallelism, n // 20_000))
    items = edges.select(F.col("item").alias("ref"), "time").repartition(files, "ref").distinct()
    owners = items.select(F.col("ref").alias("name"), F.lit("").alias("digest"))
    return kept.apply({"owners": owners, **graph.tables(items, corpus.names(spark, sf_dir), corpus.links(spark, sf_dir), edges, files)}, note=told, fresh=True)


@query(f"WITH {_INCOMING} SELECT * FROM (SELECT relation, item, row_number() OVER (PARTITION BY relation ORDER BY time DESC NULLS LAST, item) AS rank FROM found) WHERE rank <= 20")
def backlinks_grouped(spark, sf_dir):
    """Typed edges, and as untyped the links of items without one (sections count)."""
    held = _graph(spark, sf_dir)
    return graph.backlinks(held.edges, held.links, _WANTED)[1].select("relation", "item", "rank")


@query(f"WITH {_INCOMING} SELECT relation, count(*) AS total, row_number() OVER (ORDER BY relation = '', relation) AS place FROM found GROUP BY relation")
def backlink_groups(spark, sf_dir):
    held = _graph(spark, sf_dir)
    return graph.backlinks(held.edges, held.links, _WANTED)[0]


@query(f"""WITH {_INCOMING}, parts AS (SELECT *, 'a' AS brain FROM found WHERE right(item, 1) IN ('1', '3', '5', '7', '9') UNION ALL SELECT *, 'b' FROM found WHERE right(item, 1) NOT IN ('1', '3', '5', '7', '9'))
SELECT * FROM (SELECT relation, brain, item, row_number() OVER (PARTITION BY relation ORDER BY time DESC NULLS LAST, brain, item) AS rank FROM parts) WHERE rank <= 20""")
def backlinks_merged(spark, sf_dir):
    """Two brains' backlinks together, the newest of both."""
    odd = F.substring("item", -1, 1).isin("1", "3", "5", "7", "9")
    found = graph.incoming(corpus.order_edges(spark, sf_dir), corpus.links(spark, sf_dir), _WANTED)
    return graph.merged({"a": found.where(odd), "b": found.where(~odd)})[1].select("relation", "brain", "item", "rank")


@query(f"WITH {_EDGES}, {_LINKS}, {_LINKING} SELECT wanted, count(DISTINCT item) AS linkers FROM linking WHERE wanted IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY wanted")
def section_links(spark, sf_dir):
    wanted = corpus.table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("target"))
    return graph.linking(corpus.links(spark, sf_dir), wanted).groupBy("wanted").agg(F.countDistinct("item").alias("linkers"))


@query(f"""WITH {_EDGES}, said AS (SELECT DISTINCT item AS subject, relation, target FROM edges WHERE target IN ('nation:3', 'nation:4', 'region:1'))
SELECT target AS about, subject, relation, n, most > 50 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY relation, subject) AS n, count(*) OVER (PARTITION BY target) AS most FROM said) WHERE n <= 50""")
def claims_truncated(spark, sf_dir):
    """At most 50 claims about each identity, and whether there are more. The edges
    are turned round: who says something of a nation."""
    turned = corpus.order_edges(spark, sf_dir).select(F.col("target").alias("subject"), "relation", F.col("subject").alias("target"), F.lit("").alias("origin"))
    return graph.claims(turned, ["nation:3", "nation:4", "region:1"]).select(F.col("subject").alias("about"), F.col("target").alias("subject"), "relation", "n", "truncated")


@query(f"WITH {_EDGES} SELECT item AS subject, relation, target FROM edges WHERE item IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 9000)")
def claims_outgoing(spark, sf_dir):
    rich = corpus.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject"))
    return graph.claims(corpus.order_edges(spark, sf_dir), rich).select("subject", "relation", "target")


@query(f"WITH {_EDGES} SELECT item, relation, target FROM edges WHERE item LIKE 'nation:%' AND target IN ('region:1', 'region:2')")
def claims_explaining(spark, sf_dir):
    """Why nations are linked to two regions: the claims that say so."""
    refs = corpus.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("item"))
    return graph.explanations(corpus.order_edges(spark, sf_dir), refs, ["region:1", "region:2"]).select("item", "relation", "target")


@query("SELECT name, count(DISTINCT item) AS owners FROM (SELECT 'segment:' || c_mktsegment || '-' || c_nationkey AS name, c_custkey AS item FROM customer) GROUP BY name HAVING count(DISTINCT item) > 1")
def identity_ambiguous(spark, sf_dir):
    name = F.concat(F.lit("segment:"), "c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))
    return graph.ambiguous(corpus.table(spark, sf_dir, "customer").select(name.alias("name"), F.col("c_custkey").alias("item")))


@query(f"""WITH {_EDGES}, {_LINKS}, {_LINKING}, mine AS (SELECT name FROM names WHERE item = 'projects/7.md' AND name NOT IN (SELECT name FROM names GROUP BY name HAVING count(DISTINCT item) > 1))
SELECT name FROM mine""")
def identity_expanded(spark, sf_dir):
    """What an identity's only owner is also called; shared names never merge."""
    found, _ = graph.expanded({"demo": _graph(spark, sf_dir)}, "customer:7")
    return spark.createDataFrame([(n,) for n in found], "name string")


@query(f"""WITH {_EDGES}, {_LINKS}, {_LINKING}, c AS (SELECT ref, max(score) AS score FROM (SELECT item AS ref, 2000000.0::DOUBLE AS score FROM edges WHERE item IN ('customer:7', 'crm:7') UNION ALL SELECT item, 1000000.0::DOUBLE FROM names WHERE name IN ('customer:7', 'crm:7')
  UNION ALL SELECT item, 1000.0::DOUBLE FROM linking WHERE wanted IN ('customer:7', 'crm:7')) GROUP BY ref)
SELECT * FROM (SELECT ref, score, row_number() OVER (ORDER BY score DESC, t.time DESC NULLS LAST, ref) AS rank FROM c LEFT JOIN (SELECT DISTINCT item, time FROM edges) t ON t.item = ref) WHERE rank <= 30""")
def identity_search(spark, sf_dir):
    """Owners of the identity or an alias, then what links to it, the newest first."""
    held = _graph(spark, sf_dir)
    return graph.identity_order(graph.identity_candidates(held, "customer:7", graph.expanded({"demo": held}, "customer:7")[0]), 30)


@query(f"""WITH {_EDGES}, {_LINKS}, {_LINKING} SELECT name, name IN (SELECT item FROM edges UNION SELECT wanted FROM linking UNION SELECT name FROM names) AS is_known
FROM (SELECT unnest(['customer:1', 'nation:2', 'nation:99', 'region:1', 'crm:5', 'crm:none', 'segment:BUILDING']) AS name)""")
def identity_known(spark, sf_dir):
    return graph.known(_graph(spark, sf_dir), ["customer:1", "nation:2", "nation:99", "region:1", "crm:5", "crm:none", "segment:BUILDING"])


@query(f"""WITH {_EDGES}, {_LINKS}, o AS (SELECT name, min(item) AS item FROM names GROUP BY name HAVING count(DISTINCT item) = 1)
SELECT unnest(['crm:4', 'segment:BUILDING', 'crm:none']) AS ref UNION SELECT item FROM o WHERE name IN ('crm:4', 'segment:BUILDING', 'crm:none')""")
def identity_local_refs(spark, sf_dir):
    return graph.local_refs(_graph(spark, sf_dir).names, ["crm:4", "segment:BUILDING", "crm:none"])


@query("SELECT item AS ref FROM (SELECT 'segment:' || c_mktsegment AS name, 'projects/' || c_custkey || '.md' AS item FROM customer) WHERE name = 'segment:BUILDING'")
def identity_owners(spark, sf_dir):
    return graph.owners(_graph(spark, sf_dir).names, "segment:BUILDING")


@query("""SELECT c.c_custkey, count(*) AS newer FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_nationkey = 3 AND o.o_orderdate >= TIMESTAMP '1997-01-02' GROUP BY c.c_custkey""")
def newer_links(spark, sf_dir):
    projects = corpus.table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("ref"), F.lit("1997-01-01").cast("date").alias("updated"))
    edges = corpus.order_edges(spark, sf_dir).where("relation = 'placed-by'").select("item", "target", "time")
    return graph.newer_links(projects, edges).join(projects, "ref").select("c_custkey", "newer")


@query("SELECT event_type AS source, count(*) AS records, max(ts) AS latest FROM events GROUP BY event_type")
def sources_overview(spark, sf_dir):
    return corpus.event_items(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.max("time").alias("latest"))


@query("SELECT event_type AS source, strftime(ts, '%Y-%m') AS month, count(*) AS records FROM events GROUP BY ALL")
def source_partitions(spark, sf_dir):
    return corpus.event_items(spark, sf_dir).groupBy("source", "month").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT event_type AS source, count(*) AS items FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY event_type")
def activity_24h(spark, sf_dir):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    rows = corpus.event_items(spark, sf_dir).where((F.col("time") >= now - F.expr("INTERVAL 1 DAY")) & (F.col("time") < now))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("items"))


@query("SELECT event_type || ':' || event_id AS ref, row_number() OVER (ORDER BY ts DESC, event_type || ':' || event_id) AS rank FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' QUALIFY rank <= 50")
def timeline_day(spark, sf_dir):
    rows = corpus.event_items(spark, sf_dir).where("time >= timestamp_ntz'2024-01-15' and time < timestamp_ntz'2024-01-16'")
    top = rows.select("ref", "time").orderBy(F.desc("time"), "ref").limit(50)
    return top.select("ref", F.row_number().over(Window.orderBy(F.desc("time"), "ref")).alias("rank"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 200")
def folder_listing_closed_last(spark, sf_dir):
    closed = F.col("o_orderstatus") == "F"
    top = corpus.table(spark, sf_dir, "orders").select("o_orderkey", closed.alias("c"), "o_orderdate").orderBy("c", F.desc("o_orderdate"), "o_orderkey").limit(200)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("c", F.desc("o_orderdate"), "o_orderkey")).alias("rank"))


def _revisions(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), F.col("props").alias("body"), F.col("ts").alias("updated"), F.col("ts").alias("observed"), "ts")
    late = F.col("updated") + F.expr("INTERVAL 1 HOUR")
    stored = rows.where("id % 3 <> 0")
    fresh = rows.where("id % 2 = 0").withColumn("body", F.when(F.col("id") % 4 == 0, F.lit("{}")).otherwise(F.col("body"))).withColumn("updated", F.when(F.col("id") % 4 == 0, late).otherwise(F.col("updated")))
    return stored, fresh


_UPSERT = """SELECT event_type AS source, count(*) FILTER (event_id % 3 = 0 AND event_id % 2 = 0) AS added,
 count(*) FILTER (event_id % 3 <> 0 AND event_id % 4 = 0) AS updated,
 count(*) FILTER (event_id % 3 <> 0 AND event_id % 2 = 0 AND event_id % 4 <> 0) AS unchanged,
 {removed} AS removed FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY event_type"""


@query(_UPSERT.format(removed="0::BIGINT"))
def upsert_counts(spark, sf_dir):
    return ingest.counters(ingest.upsert(*_revisions(spark, sf_dir)))


@query(_UPSERT.format(removed="count(*) FILTER (event_id % 3 <> 0 AND event_id % 2 <> 0)"))
def upsert_snapshot(spark, sf_dir):
    return ingest.counters(ingest.upsert(*_revisions(spark, sf_dir), snapshot=True))


@query("SELECT user_id AS id, event_type AS source, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return ingest.guard_ids(corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id")))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def map_pointer_field(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", at_pointer(strict_json(F.col("props")), "/k", "bigint").alias("k"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def validate_missing_target(spark, sf_dir):
    edges = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("target"))
    names = corpus.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("name"))
    return checks.missing_targets(edges, names).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m') <> strftime(ts + INTERVAL 5 DAY, '%Y-%m')")
def validate_partition(spark, sf_dir):
    rows = corpus.event_items(spark, sf_dir).withColumn("partition", F.date_format(F.col("time") + F.expr("INTERVAL 5 DAYS"), "yyyy-MM"))
    return checks.wrong_partition(rows).select("event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 AND text <> text || '!' THEN 'changed' ELSE 'unchanged' END AS state FROM documents")
def evidence_changed(spark, sf_dir):
    old = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    new = old.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return checks.evidence(old, new, "doc_id", ["text", "lang"])


@query("""SELECT count(*) FILTER (seven AND op = 'search') AS search_7d, count(*) FILTER (seven AND op = 'search' AND r = 0) AS empty_7d, count(*) FILTER (seven AND op = 'read') AS read_7d,
count(*) FILTER (thirty AND op = 'search') AS search_30d, count(*) FILTER (thirty AND op = 'search' AND r = 0) AS empty_30d, count(*) FILTER (thirty AND op = 'read') AS read_30d
FROM (SELECT ts BETWEEN TIMESTAMP '2024-01-23 12:30:00' AND TIMESTAMP '2024-01-30 12:30:00' AS seven, ts BETWEEN TIMESTAMP '2023-12-31 12:30:00' AND TIMESTAMP '2024-01-30 12:30:00' AS thirty,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read' ELSE event_type END AS op, event_id % 4 AS r FROM events)""")
def usage_summary(spark, sf_dir):
    op = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "read").otherwise(F.col("event_type"))
    calls = corpus.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), op.alias("op"), (F.col("event_id") % 4).alias("results"))
    return checks.usage(calls, datetime(2024, 1, 30, 12, 30, tzinfo=timezone.utc))


@query("""SELECT page_id, target FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)""")
def page_links(spark, sf_dir):
    return corpus.page_links(spark, sf_dir)


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'gis'), '<(p|div|br|li|h1|h2|h3|tr)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'gs') AS t FROM pages),
told AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM bare)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g')) AS text FROM told""")
def html_text(spark, sf_dir):
    return corpus.page_text(spark, sf_dir)


@query("""WITH d AS (SELECT DISTINCT event_type AS source, ts::DATE AS day FROM events WHERE day(ts) % 9 <> 4),
g AS (SELECT source, day, day - (row_number() OVER (PARTITION BY source ORDER BY day))::INTEGER AS island FROM d),
i AS (SELECT source, island, min(day) AS a, max(day) + 1 AS b FROM g GROUP BY ALL)
SELECT source, epoch(a)::DOUBLE AS start_s, epoch(b)::DOUBLE AS end_s FROM i QUALIFY row_number() OVER (PARTITION BY source ORDER BY b DESC) = 1""")
def coverage_merge(spark, sf_dir):
    """One interval of each source, folded in run order from its daily windows (every
    ninth day is missing): a newer window apart from the kept one replaces it. A
    source has one row a day, grouped before the fold."""
    rows = corpus.event_items(spark, sf_dir).where("day(time) % 9 <> 4")
    days = rows.groupBy("source", F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")

    at = F.unix_timestamp(F.col("day").cast("timestamp")).cast("double")
    run = F.struct(at.alias("start"), (at + 86400).alias("end"), (at + 86400).alias("observed"))
    kept = days.groupBy("source").agg(ingest.coverage_of(F.sort_array(F.collect_list(run))).alias("k"))
    return kept.select("source", F.col("k.start").alias("start_s"), F.col("k.end").alias("end_s"))


@query()
def stemmed_terms(spark, sf_dir):
    """Stems have no SQL: the tests compare them with brute force."""
    from loomdex.functions.text import stem_of, tokens

    # Each different word meets the stemmer once; its occurrences are counted before.
    words = corpus.table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(stem_of(F.col("word")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


# --- pages over the items of all tables ---

_BRAIN = f"""{_ITEMS}, b AS (
  SELECT 'projects/' || c_custkey || '.md' AS ref, 'projects/' || c_custkey || '.md' AS path, 'note' AS kind, '' AS source, c_name AS title, 'project' AS type,
    ['active', 'blocked', 'paused', 'done', 'archived'][c_custkey % 5 + 1] AS status, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INTEGER) END AS ts, NULL::TIMESTAMP AS updated FROM customer
  UNION ALL SELECT a, a, 'note', '', s_name, 'action', '', TIMESTAMP '2024-01-01' + to_days((s_suppkey % 28)::INTEGER), NULL
    FROM (SELECT *, 'actions/2024-01-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') || '_s-' || s_suppkey || '/ACTION.md' AS a FROM supplier)
  UNION ALL SELECT ref, ref, 'note', '', 'Document ' || doc_id, 'concept', status, NULL, NULL FROM items
  UNION ALL SELECT event_type || ':' || event_id, 'memories/' || event_type || '/' || strftime(ts, '%Y-%m') || '.jsonl', 'record', event_type, event_type, '', '', ts,
    CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 20 DAY END FROM events),
brain AS (SELECT *, CASE WHEN kind = 'note' THEN ts ELSE coalesce(updated, ts) END AS changed FROM b)"""


def _rank(order: str, limit: int, where: str = "true", what: str = "ref") -> str:
    return f"WITH {_BRAIN} SELECT {what}, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM brain WHERE {where}) WHERE rank <= {limit}"


def _items(spark: SparkSession, sf_dir: str, tz: str = "UTC") -> DataFrame:
    return brains.dated(corpus.items(spark, sf_dir), tz)


def _project_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link to the note of their customer, dated 27 years later."""
    o = corpus.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("item"), F.concat(F.lit("projects/"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("target"), (F.col("o_orderdate") + F.expr("INTERVAL 27 YEARS")).alias("time"))


_HOME = f"""{_BRAIN}, newer AS (SELECT ref, count(DISTINCT o_orderkey) AS newer FROM brain JOIN orders ON ref = 'projects/' || o_custkey || '.md'
  WHERE o_orderdate + INTERVAL 27 YEAR >= ts + INTERVAL 1 DAY GROUP BY ref),
judged AS (SELECT brain.*, coalesce(newer, 0) > 0 OR ts IS NULL OR ts < {NOW_SQL} - INTERVAL 14 DAY AS review FROM brain LEFT JOIN newer USING (ref)
  WHERE type = 'project' AND status IN ('active', 'blocked'))"""


@query(f"WITH {_HOME} SELECT * FROM (SELECT ref, review, row_number() OVER (ORDER BY review DESC, ts DESC NULLS LAST, ref) AS rank FROM judged) WHERE rank <= 200")
def home_projects(spark, sf_dir):
    """Open projects, those due for review first."""
    return pages.home(_items(spark, sf_dir), _project_links(spark, sf_dir), NOW)["projects"].select("ref", "review", "rank")


@query(_rank("path DESC", 10, "type = 'action'"))
def home_actions(spark, sf_dir):
    return pages.home(_items(spark, sf_dir), _project_links(spark, sf_dir), NOW)["actions"].select("ref", "rank")


@query(_rank("ts DESC, ref", 20, f"kind = 'note' AND ts >= {NOW_SQL} - INTERVAL 7 DAY AND ts < {NOW_SQL}"))
def home_changed(spark, sf_dir):
    return pages.home(_items(spark, sf_dir), _project_links(spark, sf_dir), NOW)["changed"].select("ref", "rank")


@query(f"WITH {_BRAIN}, c AS (SELECT source, count(*) AS records FROM brain WHERE kind = 'record' AND ts >= {NOW_SQL} - INTERVAL 1 DAY AND ts < {NOW_SQL} GROUP BY source) SELECT source, records, 'memories/' || source || '/24h' AS page, row_number() OVER (ORDER BY records DESC, source) AS rank FROM c")
def home_activity(spark, sf_dir):
    return pages.home(_items(spark, sf_dir), _project_links(spark, sf_dir), NOW)["activity"]


@query(_rank("ts, ref", 20, f"ts >= {NOW_SQL} AND ts < {NOW_SQL} + INTERVAL 7 DAY"))
def upcoming_7d(spark, sf_dir):
    return pages.home(_items(spark, sf_dir), _project_links(spark, sf_dir), NOW)["upcoming"].select("ref", "rank")


_JANUARY = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"


@query(_rank("ts DESC, ref", 50, _JANUARY))
def timeline_month(spark, sf_dir):
    return pages.timeline(_items(spark, sf_dir), period("2024-01", NOW), "2024-01")["items"].select("ref", "rank")


@query(f"WITH {_BRAIN} SELECT count(*) AS total FROM brain WHERE {_JANUARY}")
def timeline_total(spark, sf_dir):
    return pages.timeline(_items(spark, sf_dir), period("2024-01", NOW), "2024-01")["total"]


@query(_rank("changed DESC, ref", 20, "changed >= TIMESTAMP '2024-02-01' AND changed < TIMESTAMP '2024-03-01' AND NOT coalesce(ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-03-01', false)"))
def timeline_changed(spark, sf_dir):
    """What February changed but other months hold."""
    return pages.timeline(_items(spark, sf_dir), period("2024-02", NOW), "2024-02")["changed"].select("ref", "rank")


@query(f"WITH {_BRAIN} SELECT source, count(*) AS records FROM brain WHERE kind = 'record' AND {_JANUARY} GROUP BY source")
def timeline_sources(spark, sf_dir):
    return pages.timeline(_items(spark, sf_dir), period("2024-01", NOW), "2024-01")["sources"].select("source", "records")


@query("SELECT count(*) AS items FROM customer WHERE c_custkey % 7 <> 0 AND (DATE '2024-01-01' + (c_custkey % 60)::INTEGER) = DATE '2024-01-15'")
def timeline_local_day(spark, sf_dir):
    """A day in Paris holds the notes of that date, which begin at 23:00 UTC before it."""
    items = _items(spark, sf_dir, "Europe/Paris").where("type = 'project'")
    return pages.timeline(items, period("2024-01-15", NOW, "Europe/Paris"), "2024-01-15")["total"].select(F.col("total").alias("items"))


@query(_rank("status IN ('done', 'archived'), ts DESC NULLS LAST, ref", 200, "path LIKE 'projects/%'"))
def folder_projects(spark, sf_dir):
    return pages.folder(_items(spark, sf_dir), "projects")["items"].select("ref", "rank")


@query(_rank("title, ref", 200, "path LIKE 'concepts/fr/%'"))
def folder_concepts(spark, sf_dir):
    return pages.folder(_items(spark, sf_dir), "concepts/fr")["items"].select("ref", "rank")


@query(_rank("path DESC", 200, "path LIKE 'actions/%'"))
def folder_actions(spark, sf_dir):
    return pages.folder(_items(spark, sf_dir), "actions")["items"].select("ref", "rank")


@query(f"WITH {_BRAIN} SELECT count(*) AS total FROM brain WHERE path LIKE 'concepts/%'")
def folder_total(spark, sf_dir):
    return pages.folder(_items(spark, sf_dir), "concepts")["total"]


@query(_rank("ts DESC, ref", 20, "source = 'click'"))
def memory_latest(spark, sf_dir):
    return pages.memories(_items(spark, sf_dir), "memories/click", NOW)["items"].select("ref", "rank")


@query(f"WITH {_BRAIN} SELECT path, count(*) AS records, row_number() OVER (ORDER BY path DESC) AS rank FROM brain WHERE source = 'click' GROUP BY path")
def memory_partitions(spark, sf_dir):
    return pages.memories(_items(spark, sf_dir), "memories/click", NOW)["partitions"]


@query(_rank("ts DESC, ref", 50, "source = 'click' AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'"))
def memory_period(spark, sf_dir):
    return pages.memories(_items(spark, sf_dir), "memories/click/1w", NOW)["items"].select("ref", "rank")


@query(f"WITH {_BRAIN} SELECT count(*) AS total FROM brain WHERE path = 'memories/view/2024-01.jsonl'")
def memory_file(spark, sf_dir):
    return pages.memories(_items(spark, sf_dir), "memories/view/2024-01.jsonl", NOW)["total"]


@query(f"WITH {_BRAIN} SELECT ref, kind = 'record' AND source <> 'click' AS external FROM brain")
def external_guard(spark, sf_dir):
    """Records of sources that are not the owner's are marked."""
    trust = {n: p.trust for n, p in corpus.CONFIG.sensors.items()}
    return pages.guarded(_items(spark, sf_dir), trust).select("ref", "external")


@query(f"""WITH {_BRAIN} SELECT ref, 'brain://demo/' || replace(ref, ' ', '%20') AS uri FROM brain""")
def labels_of_items(spark, sf_dir):
    return pages.labelled(_items(spark, sf_dir), "demo").select("ref", "uri")


@query(f"WITH {_BRAIN} SELECT kind, type, count(*) AS n FROM brain WHERE changed >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def items_modified(spark, sf_dir):
    """When an item last changed: a note's date, else its revision, else its time."""
    return _items(spark, sf_dir).where("changed >= timestamp_ntz'2024-01-10'").groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))


# --- notes read from Markdown ---

_NOTES = """n AS (SELECT *, 'projects/' || c_custkey || '.md' AS path, 'brain://demo/projects/' || c_custkey || '.md' AS uri,
  ['active', 'blocked', 'paused', 'done', 'archived'][c_custkey % 5 + 1] AS status FROM customer)"""


@query(f"""WITH {_NOTES} SELECT path AS ref, c_name AS title, 'project' AS type, status, CASE WHEN c_custkey % 7 <> 0 THEN DATE '2024-01-01' + (c_custkey % 60)::INTEGER END AS day, 'Held in nation by desk.' AS lead,
(1 + (c_custkey % 3 = 0)::INTEGER)::INTEGER AS tasks_open, 1::INTEGER AS tasks_done, 'call ' || c_custkey AS next, 2::INTEGER AS weight FROM n""")
def note_items(spark, sf_dir):
    return brains.note_items(corpus.notes(spark, sf_dir, "title", "updated", "type", "status", "lead", "tasks_open", "tasks_done", "next")).select("ref", "title", "type", "status", "day", "lead", "tasks_open", "tasks_done", "next", "weight")


@query(f"""WITH {_NOTES} SELECT path AS ref, '' AS fragment, c_name AS heading, 'Held in [nation](../concepts/nations.md#n-' || c_nationkey || ') by [desk](brain://demo/projects/' || (c_custkey + 1) || '.md?rel=located-in).' AS text FROM n
UNION ALL SELECT path, 'orders', 'Orders', '- [ ] call ' || c_custkey || chr(10) || '- [x] mail *' || c_custkey || '*' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '- [ ] visit' || chr(10) ELSE '' END || chr(10) FROM n
UNION ALL SELECT path, 'next-actions', 'Next actions!', 'Balance ' || floor(c_acctbal)::BIGINT || ' `code [x](y)`.' || chr(10) FROM n""")
def note_passages(spark, sf_dir):
    return brains.note_passages(corpus.notes(spark, sf_dir)).select("ref", "fragment", "heading", "text")


@query(f"""WITH {_NOTES} SELECT path AS item, uri AS subject, '' AS relation, 'brain://demo/concepts/nations.md#n-' || c_nationkey AS target, uri || '#' || lower(replace(c_name, '#', '')) AS origin FROM n
UNION ALL SELECT path, uri, 'located-in', 'brain://demo/projects/' || (c_custkey + 1) || '.md', uri || '#' || lower(replace(c_name, '#', '')) FROM n""")
def note_claims(spark, sf_dir):
    return brains.note_claims(corpus.notes(spark, sf_dir, "entity", "contexts"), corpus.CONFIG)


@query(f"WITH {_NOTES} SELECT uri AS name, path AS item FROM n UNION ALL SELECT 'customer:' || c_custkey, path FROM n")
def note_names(spark, sf_dir):
    return brains.note_names(corpus.notes(spark, sf_dir, "entity", "aliases"), corpus.CONFIG)


@query("""SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'unknown keys' WHEN 2 THEN 'time needs ISO 8601 and a zone' WHEN 3 THEN 'id is a nonempty text without control characters'
 WHEN 4 THEN 'title is a nonempty text without control characters' WHEN 5 THEN 'title is a nonempty text without control characters' WHEN 6 THEN 'not one JSON object' WHEN 7 THEN 'links is a list of texts' END AS problem FROM events""")
def record_contract(spark, sf_dir):
    return corpus.record_lines(spark, sf_dir).select("event_id", brains.record_problem(F.col("value")).alias("problem"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.event_items(spark, sf_dir)
    fields = F.create_map(F.lit("user"), F.concat(F.lit('"person:'), F.col("user_id").cast("string"), F.lit('"')), F.lit("k"), F.get_json_object("props", "$.k"))
    return e.select(
        "source", F.col("month").alias("partition"), F.col("event_id").cast("string").alias("id"), F.col("source").alias("title"), F.concat(F.lit("value "), F.col("value").cast("int").cast("string")).alias("text"), "time",
        F.lit("").alias("url"), F.array(F.concat(F.lit("person:"), F.col("user_id").cast("string"))).alias("links"), F.array().cast("array<string>").alias("aliases"), F.lit("{}").alias("attributes"), fields.alias("fields"),
    )


@query("""SELECT event_type || ':' || event_id AS item, r AS relation, 'person:' || user_id AS target FROM events, (SELECT unnest(['user', '']) AS r)""")
def record_claims(spark, sf_dir):
    """A relation field and a link of each record."""
    return brains.record_claims(_records(spark, sf_dir), corpus.CONFIG).select("item", "relation", "target")


@query("""SELECT event_type || ':' || event_id AS ref, 'value ' || trunc(value)::INTEGER AS text, event_type || '  person:' || user_id || '  ' || (props->>'$.k') || ' person:' || user_id AS names FROM events""")
def record_passages(spark, sf_dir):
    """One passage a record, named by source, aliases, links, url and field values."""
    return brains.record_passages(_records(spark, sf_dir), corpus.CONFIG).select("ref", "text", "names")


# --- validation, evaluation, health ---


@query("""SELECT event_id, f AS field, p AS problem FROM (
  SELECT event_id, 'k' AS f, CASE WHEN event_id % 3 = 0 THEN 'expected integer' END AS p FROM events
  UNION ALL SELECT event_id, 'user', CASE WHEN event_id % 5 = 0 THEN 'expected an identity' END FROM events
  UNION ALL SELECT event_id, 'tags', CASE WHEN event_id % 4 = 0 THEN 'expected string' WHEN event_id % 4 = 1 THEN 'expected a list of at most 1000 values' END FROM events
  UNION ALL SELECT event_id, 'mood', 'undeclared' FROM events WHERE event_id % 7 = 0) WHERE p IS NOT NULL""")
def validate_fields(spark, sf_dir):
    """Values of another kind than the schema declares, and undeclared ones."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    user = F.concat(F.lit('"'), F.when(n % 5 == 0, F.lit("no identity")).otherwise(F.concat(F.lit("person:"), F.col("user_id").cast("string"))), F.lit('"'))
    tags = F.when(n % 4 == 0, '["a",1]').when(n % 4 == 1, '"a"').otherwise('["a","b"]')
    fields = F.create_map(F.lit("k"), F.when(n % 3 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k), F.lit("user"), user, F.lit("tags"), tags, F.when(n % 7 == 0, F.lit("mood")).otherwise(F.lit("none")), F.when(n % 7 == 0, F.lit('"x"')).otherwise(F.lit(None).cast("string")))
    rows = corpus.table(spark, sf_dir, "events").select(n.alias("ref"), F.map_filter(fields, lambda key, v: v.isNotNull()).alias("fields"))
    return checks.field_problems(rows, corpus.CONFIG).select(F.col("ref").alias("event_id"), "field", "problem")


@query("""SELECT folder, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'name it YYYY-MM-DD_slug' WHEN s_suppkey % 4 = 3 THEN 'no ACTION.md' END AS problem FROM (
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'Action_' || s_suppkey WHEN 2 THEN '2024-02-30_s-' || s_suppkey ELSE '2024-02-01_s-' || s_suppkey END AS folder FROM supplier) WHERE s_suppkey % 4 <> 0""")
def validate_actions(spark, sf_dir):
    """Folders of actions that are misnamed, have no such day or lack their file."""
    k = F.col("s_suppkey")
    folder = F.when(k % 4 == 1, F.concat(F.lit("Action_"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("2024-02-30_s-"), k.cast("string"))).otherwise(F.concat(F.lit("2024-02-01_s-"), k.cast("string")))
    name = F.explode(F.when(k % 4 == 3, F.array(F.lit("notes.md"))).otherwise(F.array(F.lit("ACTION.md"), F.lit("more/notes.md"))))
    files = corpus.table(spark, sf_dir, "supplier").select(folder.alias("f"), name.alias("n")).select(F.concat(F.lit("actions/"), "f", F.lit("/"), "n").alias("path"))
    return checks.action_problems(files)


@query("""SELECT 'projects/' || c_custkey || '.md' AS path, CASE c_custkey % 4 WHEN 0 THEN '../../out.md' WHEN 1 THEN '../concepts/nations.md#n-' || c_nationkey WHEN 2 THEN 'missing-' || c_custkey || '.md' ELSE '../concepts/a%20b.md' END AS target,
 CASE c_custkey % 4 WHEN 0 THEN 'leaves the brain' WHEN 1 THEN 'missing heading' WHEN 2 THEN 'broken link' END AS problem FROM customer WHERE c_custkey % 4 <> 3 AND NOT (c_custkey % 4 = 1 AND c_nationkey = 3)""")
def validate_links(spark, sf_dir):
    """Relative links that leave the brain, name no file, or no heading of a note."""
    k = F.col("c_custkey")
    target = F.when(k % 4 == 0, "../../out.md").when(k % 4 == 1, F.concat(F.lit("../concepts/nations.md#n-"), F.col("c_nationkey").cast("string"))).when(k % 4 == 2, F.concat(F.lit("missing-"), k.cast("string"), F.lit(".md"))).otherwise("../concepts/a%20b.md")
    mine = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("projects/"), k.cast("string"), F.lit(".md")).alias("path"), F.array(target, F.lit("https://x.example/y")).alias("targets"), F.array().cast("array<string>").alias("slugs"))
    others = spark.createDataFrame([("concepts/nations.md", [], ["n-3"]), ("concepts/a b.md", [], [])], "path string, targets array<string>, slugs array<string>")
    notes = mine.unionByName(others)
    return checks.broken_links(notes, notes.select("path"))


@query(f"""WITH {_NOTES} SELECT 'brain://demo/concepts/nations.md#n-' || n AS value, 'unresolved' AS problem FROM (SELECT DISTINCT c_nationkey AS n FROM customer)
UNION ALL SELECT 'brain://demo/projects/' || (max(c_custkey) + 1) || '.md', 'unresolved' FROM customer""")
def validate_addresses(spark, sf_dir):
    """Addresses of this brain that name nothing."""
    notes = lambda *wanted: corpus.notes(spark, sf_dir, *wanted)
    claims, named = brains.note_claims(notes("entity", "contexts"), corpus.CONFIG), brains.note_names(notes("entity", "aliases"), corpus.CONFIG)
    return checks.unresolved_addresses(claims, named, notes("slugs"), spark.createDataFrame([], "ref string"), corpus.CONFIG)[0]


@query("""SELECT 'concepts/' || lang || '/' || doc_id || '.md' AS path, CASE doc_id % 3 WHEN 0 THEN 'a concept needs a type' ELSE 'a concept''s status is draft, stable or deprecated' END AS problem FROM documents WHERE doc_id % 3 <> 2""")
def validate_concepts(spark, sf_dir):
    """Concepts without a type, or with a status that is none of theirs."""
    n = F.col("doc_id")
    head = F.when(n % 3 == 0, "status: stable").when(n % 3 == 1, "type: concept\nstatus: active").otherwise("type: concept\nsources:\n- resource: https://x.example")
    docs = corpus.document_items(spark, sf_dir)
    return checks.concept_problems(docs.select(F.col("ref").alias("path"), F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("text")))


@query("""SELECT * FROM (SELECT 'duplicates' AS "check", user_id || ': ' || event_type || ': ' || count(*) AS problem FROM events GROUP BY user_id, event_type HAVING count(*) > 1) ORDER BY problem LIMIT 200""")
def validate_report(spark, sf_dir):
    """All problems together, 200 at most."""
    twice = ingest.guard_ids(corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"))).select("id", "source", "copies")
    return checks.report({"duplicates": twice})


@query(f"""WITH t AS (SELECT item_id, item_id % 4 AS k, 'concepts/x/' || item_id || '.md' AS note FROM benchmark)
SELECT item_id::VARCHAR AS "case", k = 0 OR k = 3 AS passed, (k = 1)::INTEGER AS missing, (k = 2)::INTEGER AS forbidden, 0::INTEGER AS absent FROM t""")
def eval_cases(spark, sf_dir):
    """Cases that expect a note (any section counts), forbid one, ask for a text, or
    for nothing; every kind occurs."""
    b = corpus.table(spark, sf_dir, "benchmark")
    n, none = F.col("item_id"), F.array().cast("array<string>")
    note = F.concat(F.lit("concepts/x/"), n.cast("string"), F.lit(".md"))
    cases = b.select(
        n.cast("string").alias("case"), F.when(n % 4 == 1, F.array(F.lit("concepts/none.md"))).when(n % 4 == 3, none).otherwise(F.array(note)).alias("expect"), F.when(n % 4 == 2, F.array(note)).otherwise(none).alias("forbid"),
        F.when(n % 4 == 3, none).otherwise(F.array(F.lower("text"))).alias("text"), (n % 4 == 3).alias("empty"),
    )
    found = b.where(n % 4 != 3).select(n.cast("string").alias("case"), F.concat(note, F.lit("#part")).alias("ref"), "text", F.lit(1).alias("rank"))
    return checks.evaluate(cases, found)


@query("SELECT count(*) FILTER (item_id % 4 IN (0, 3)) AS passed, count(*) AS total FROM benchmark")
def eval_score(spark, sf_dir):
    return checks.score(eval_cases(spark, sf_dir))


def _runs(spark: SparkSession) -> DataFrame:
    """The last run of each program: an hour, three days and no success ago, a failure."""
    hour, day = datetime(2024, 1, 30, 23), datetime(2024, 1, 28)
    rows = [("click", hour, day, hour, "", ""), ("view", day, day, hour, "", ""), ("purchase", hour, None, None, "", ""), ("mail", hour, day, hour, "refused", ""), ("weekly", day, day, day, "", "actions/2024-01-28_weekly"), ("daily", None, None, None, "", "")]
    return spark.createDataFrame(rows, health.RUNS)


_HEALTH = """h(source, state, freshness, trust, failed) AS (VALUES ('click', 'active', 'fresh', 'owner', false), ('view', 'active', 'stale', 'external', false), ('purchase', 'disabled', 'unknown', 'external', false),
  ('mail', 'active', 'fresh', 'external', true), ('notes', 'active', 'manual', 'external', false)),
c AS (SELECT event_type AS source, count(*) AS records FROM events GROUP BY event_type),
s AS (SELECT coalesce(h.source, c.source) AS source, coalesce(state, 'historical') AS state, coalesce(freshness, 'unknown') AS freshness, coalesce(trust, 'external') AS trust, coalesce(failed, false) AS failed, coalesce(records, 0) AS records
  FROM h FULL JOIN c ON h.source = c.source)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.event_items(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.max("time").alias("latest"))
    return health.source_health(health.declared(spark, corpus.CONFIG.sensors), _runs(spark), counts, NOW)


@query(f"WITH {_HEALTH} SELECT * FROM s")
def health_sources(spark, sf_dir):
    """Declared, disabled and historical sources with their freshness and records."""
    return _sources(spark, sf_dir).select("source", "state", "freshness", "trust", "failed", "records")


@query(f"WITH {_HEALTH} SELECT x.state, count(s.source) AS sources, coalesce(sum(records), 0)::BIGINT AS records FROM (SELECT unnest(['active', 'disabled', 'historical']) AS state) x LEFT JOIN s USING (state) GROUP BY x.state")
def health_coverage(spark, sf_dir):
    return health.coverage(_sources(spark, sf_dir))


#: Each kind of event of each user is a program that ran when its last event of an even number came.
_PROGRAMS = """programs AS (SELECT event_type || '-' || user_id AS name, any_value(user_id) AS k, max(ts) FILTER (event_id % 2 = 0) AS success, max(ts) AS last_end, max(event_id) % 11 = 0 AS failed FROM events GROUP BY event_type, user_id),
p AS (SELECT *, k % 9 <> 4 AS enabled, 21600 * (k % 5) AS refresh, date_diff('microsecond', success, TIMESTAMP '2024-01-31') / 1e6 AS age FROM programs)"""


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, k and last run of each, and what is declared for it."""
    e = corpus.table(spark, sf_dir, "events").withColumn("name", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    runs = e.groupBy("name").agg(F.first("user_id").alias("k"), F.max(F.when(F.col("event_id") % 2 == 0, F.col("ts"))).alias("success"), F.max("ts").alias("end"), (F.max("event_id") % 11 == 0).alias("failed"))
    error = F.when(F.col("failed"), "refused").otherwise("")
    return runs.select(
        "name", "k", "success", F.col("end").alias("start"), "end", error.alias("error"), F.lit("").alias("action"), (F.col("k") % 9 != 4).alias("enabled"), (21600 * (F.col("k") % 5)).cast("bigint").alias("refresh"),
        F.when(F.col("k") % 7 == 0, "snapshot").otherwise("window").alias("mode"), F.lit("external").alias("trust"), F.lit(86400).alias("lookback"), F.lit(300).alias("overlap"),
    )


@query(f"""WITH {_PROGRAMS}, q AS (SELECT *, CASE WHEN refresh = 0 THEN 'manual' WHEN age IS NULL THEN 'never' WHEN age <= 2 * refresh THEN 'fresh' ELSE 'stale' END AS freshness FROM p WHERE enabled)
SELECT 'sensor' AS kind, name, freshness, failed FROM q WHERE refresh > 0 AND (failed OR freshness IN ('never', 'stale'))""")
def health_attention(spark, sf_dir):
    """What runs on a schedule here and failed or is late."""
    held = _programs(spark, sf_dir)
    counts = spark.createDataFrame([], "source string, records bigint, latest timestamp_ntz")
    known = held.select("name", "enabled", "refresh", "mode", "trust")
    return health.attention(health.source_health(known, held.select("name", "success", "start", "end", "error", "action"), counts, NOW))


@query(f"WITH {_BRAIN} SELECT count(*) FILTER (kind = 'note') AS notes, count(*) FILTER (kind = 'record') AS records, 0::BIGINT AS skipped, 2::BIGINT AS late, false AS healthy FROM brain")
def health_report(spark, sf_dir):
    return health.report(corpus.items(spark, sf_dir), spark.createDataFrame([], "file string, problem string"), _sources(spark, sf_dir))


# --- collection ---


@query(f"""WITH {_PROGRAMS} SELECT name, CASE WHEN k % 7 = 0 OR last_end - INTERVAL 300 SECOND >= TIMESTAMP '2024-01-31' THEN TIMESTAMP '2024-01-30' ELSE greatest(last_end - INTERVAL 300 SECOND, TIMESTAMP '2024-01-01') END AS since
FROM p WHERE enabled AND refresh > 0 AND (success IS NULL OR floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(success)) >= refresh)""")
def due_sensors(spark, sf_dir):
    """Enabled, scheduled, elapsed; from the last end less the overlap."""
    return ingest.due(_programs(spark, sf_dir).withColumnRenamed("end", "last_end"), NOW)


@query(f"""WITH {_PROGRAMS} SELECT name, CASE WHEN last_end < TIMESTAMP '2024-01-31' THEN last_end ELSE TIMESTAMP '2024-01-30' END AS since
FROM p WHERE enabled AND refresh > 0 AND (success IS NULL OR floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(success)) >= refresh)""")
def due_routines(spark, sf_dir):
    """Due programs cover the time since their last reviewed end."""
    return ingest.due_routines(_programs(spark, sf_dir).withColumnRenamed("end", "last_end"), NOW)


@query("""SELECT event_type AS source, event_id AS id, '2024-01' AS was, '2024-02' AS now FROM events WHERE event_id % 3 <> 0 AND event_id % 4 = 0 AND ts + INTERVAL 10 DAY >= TIMESTAMP '2024-02-01'""")
def partition_moves(spark, sf_dir):
    """Records whose new time lies in another month move there."""
    from loomdex.functions.temporal import month

    stored, fresh = _revisions(spark, sf_dir)
    later = fresh.withColumn("ts", F.when(F.col("id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("ts")))
    return ingest.moved(stored, ingest.upsert(stored, later), month)


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'again ' || event_type ELSE event_type END AS title FROM events WHERE event_id % 6 <> 0")
def projection_refreshed(spark, sf_dir):
    """A projection follows its files: changed ones are read again, removed ones go,
    the rows of the others stay."""
    rows = corpus.event_items(spark, sf_dir).select("event_id", F.col("event_id").cast("string").alias("path"), F.col("source").alias("title"))
    old = rows.select("path", F.lit("1").alias("digest"))
    new = old.where("cast(path as bigint) % 6 <> 0").withColumn("digest", F.when(F.col("path").cast("bigint") % 2 == 0, "2").otherwise("1"))
    again = rows.withColumn("title", F.concat(F.lit("again "), "title"))
    return ingest.refreshed(rows, again, ingest.changed_files(old, new)).select("event_id", "title")


@query("SELECT event_id, (props->>'$.k') AS k, '[\"a\",\"b\"]' AS tags FROM events")
def map_fields(spark, sf_dir):
    """Declared fields from pointers and literals; lists keep the first of equals."""
    from loomdex.sources.config import Program

    program = Program(fields={"k": {"path": "/attributes/k"}, "tags": {"value": ["a", "b", "a"]}, "user": {"path": "/none"}})
    doc = F.parse_json(F.concat(F.lit('{"attributes":'), "props", F.lit("}")))
    rows = ingest.mapped(corpus.table(spark, sf_dir, "events").select("event_id", doc.alias("document")), program, corpus.CONFIG)
    return rows.select("event_id", F.col("fields")["k"].alias("k"), F.col("fields")["tags"].alias("tags"))


@query("""SELECT 'demo@' || event_id AS id, event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM events WHERE event_id % 9 <> 0 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""")
def git_commits(spark, sf_dir):
    """A day of a log of commits, without those of bots."""
    who = F.when(F.col("event_id") % 9 == 0, "build[bot]").otherwise("someone")
    line = F.concat_ws("\x1f", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), who, F.lit("a@x.example"), "event_type")
    log = corpus.table(spark, sf_dir, "events").select(F.lit("demo").alias("repo"), line.alias("value"))
    day = period("2024-01-10", NOW)
    return adapters.git_commits(log, day.since, day.until).select("id", "title", "time")


@query("""WITH o AS (SELECT *, o_orderdate::DATE AS d, make_date(year(o_orderdate), 3, 31) AS m, CASE WHEN year(o_orderdate) < 1996 THEN make_date(year(o_orderdate), 9, 30) ELSE make_date(year(o_orderdate), 10, 31) END AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title, strftime(d::TIMESTAMP - CASE WHEN d > m - (isodow(m) % 7)::INTEGER AND d <= n - (isodow(n) % 7)::INTEGER THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM o""")
def calendar_all_day(spark, sf_dir):
    """All-day events begin at midnight in Paris, one or two hours before UTC's: the
    clocks change after the midnight of a last Sunday. Cancelled ones go. A calendar
    page holds the events of one day."""
    o = corpus.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("confirmed")
    event = F.struct(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("summary"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("start"))
    page = F.to_json(F.struct(F.lit("Europe/Paris").alias("timeZone"), F.collect_list(event).alias("items")))
    return adapters.calendar_events(o.groupBy(F.to_date("o_orderdate").alias("day")).agg(page.alias("value"))).select("id", "title", "time")


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS title, 'drive:' || p_brand AS link FROM part""")
def drive_folders(spark, sf_dir):
    """A whole listing of folders with their parents, in pages of one type each."""
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("parents"))
    listed = corpus.table(spark, sf_dir, "part").groupBy("p_type").agg(F.to_json(F.struct(F.lit(False).alias("incompleteSearch"), F.collect_list(item).alias("files"))).alias("value"))
    return adapters.drive_folders(listed).select("id", "title", F.col("links")[0].alias("link"))
