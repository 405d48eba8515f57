from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomdex.functions import identity, markdown, temporal, text
from loomdex.operators import graph, ingest, search
from loomdex.sources.brain import resolved_path

NOW = datetime(2026, 9, 22, 15, 30, tzinfo=timezone.utc)


@pytest.mark.parametrize(("value", "want"), [("7d", "2026-09-15T15:30"), ("12h", "2026-09-22T03:30"), ("2w", "2026-09-08T15:30"), ("2026-09-01T00:00:00+02:00", "2026-08-31T22:00")])
def test_moments(value, want):
    assert temporal.moment(value, NOW).isoformat()[:16] == want


@pytest.mark.parametrize("value", ["soon", "2026-13-01", "2026-09-01T00:00:00"])
def test_bad_moments(value):
    with pytest.raises(ValueError):
        temporal.moment(value, NOW)


def test_local_days(spark):
    assert temporal.moment("today", NOW, "America/New_York").isoformat()[:16] == "2026-09-22T04:00" and temporal.moment("yesterday", NOW, "Europe/Paris").isoformat()[:16] == "2026-09-20T22:00"
    row = spark.sql("select date'2026-03-29' d, date'2026-09-23' e").select(*[temporal.note_time(F.col(c), z).cast("string").alias(c + z[0]) for c in "de" for z in ("Europe/Paris", "America/New_York")]).first()
    assert (row.dE, row.eE, row.eA) == ("2026-03-28 23:00:00", "2026-09-22 22:00:00", "2026-09-23 04:00:00")
    assert (temporal.period("2026-03", NOW).previous, temporal.period("2026-12", NOW).next, temporal.period("2026-03-01", NOW).previous, temporal.period("7d", NOW).next) == ("2026-02", "2027-01", "2026-02-28", None)


def test_scopes():
    assert temporal.period("2026-03-29", NOW, "Europe/Paris").since.isoformat()[:16] == "2026-03-28T23:00"
    assert temporal.scope("memories/meetings/2026-08", NOW).prefix == "memories/meetings"
    assert temporal.scope("repo:example/project", NOW).target == "repo:example/project"
    for word, day in (("today", "2026-09-22"), ("yesterday", "2026-09-21")):
        assert temporal.scope(word, NOW) == temporal.scope(day, NOW) == temporal.period(word, NOW) and temporal.period(word, NOW).previous < day
    assert temporal.period("today", datetime(2026, 3, 29, 23, 30, tzinfo=timezone.utc), "Europe/Paris") == temporal.period("2026-03-30", NOW, "Europe/Paris")
    prefixes = {"memories/meetings/undated": "memories/meetings/undated.jsonl", "memories/meetings/snapshot": "memories/meetings/snapshot.jsonl", "memories/meetings/2026-08.jsonl": "memories/meetings/2026-08.jsonl", "memories/meetings/": "memories/meetings", "projects/a": "projects/a"}
    assert {v: temporal.scope(v, NOW).prefix for v in prefixes} == prefixes and temporal.scope("memories/meetings/2026-08.jsonl", NOW).since is None
    assert temporal.scope("memories/meetings/2026-08-30", NOW).since.isoformat()[:16] == "2026-08-30T00:00"
    for bad in ("brain.yaml", "sensors", "../x", "soon", "memories/../x"):
        with pytest.raises(ValueError):
            temporal.scope(bad, NOW)


BAD = ["brain://u@x/y", "brain://x:1/y", "brain://x/../y", "brain://x/a%zz", "brain://x/a?b=c", "brain://x", "brain:x", "brain://x/a b", "brain://x/a//b", "brain://x/a\\b", "brain://X/a", "brain://x/a%00", "brain://x/" + "a" * 9000]
GOOD = {"brain://b/p/a%20b.md?rel=role#s": ("b", "p/a b.md", "s", "role"), "BRAIN://b/mail:a/../b": ("b", "mail:a/../b", "", ""), "brain://b/a%23b+c.md": ("b", "a#b+c.md", "", "")}


def test_addresses(spark):
    rows = spark.createDataFrame([(v,) for v in [*BAD, *GOOD, "https://x"]], "v string").select("v", identity.parse_address(F.col("v")).alias("a")).collect()
    got = {r.v: r.a for r in rows}
    assert all(not got[v].valid for v in BAD) and got["https://x"] is None
    assert {v: tuple(got[v])[:4] for v in GOOD} == GOOD and all(got[v].valid for v in GOOD)
    made = spark.range(1).select(identity.address("b", F.lit("p/a b#*~.md"), F.lit("x y")).alias("a"), identity.target_of(F.lit("brain://b/a%20b.md?rel=x#s")).alias("t")).first()
    assert made.a == "brain://b/p/a%20b%23%2A~.md#x%20y" and made.t == "brain://b/a%20b.md#s"
    cases = {("projects/a.md", "../concepts/b%20c.md#x%20y"): ("concepts/b c.md", "x y"), ("projects/a.md", "../../out.md"): ("../out.md", ""), ("concepts/d/a.md", "/x.md"): ("concepts/x.md", ""), ("projects/a.md", "#s"): ("projects/a.md", "s"), ("projects/a.md", "data%231.csv"): ("projects/data#1.csv", "")}
    for (path, link), want in cases.items():
        assert tuple(spark.range(1).select(*resolved_path(F.lit(path), F.lit(link))).first()) == want


@pytest.mark.parametrize(("ref", "want"), [("concepts/a.md#x", ("concepts/a.md", "x")), ("projects/C# guide.md", ("projects/C# guide.md", "")), ("projects/C# guide.md#s", ("projects/C# guide.md", "s")), ("plain", ("plain", ""))])
def test_split_ref(spark, ref, want):
    path, fragment = identity.split_ref(F.lit(ref))
    assert tuple(spark.range(1).select(path, fragment).first()) == want


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("generalizations", "gener"), ("oscillators", "oscil"), ("happy", "happi"), ("rate", "rate"), ("controll", "control")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_terms_and_json(spark):
    assert text.query_terms("the retention guide") == ["retention", "guide"] and text.query_terms("the") == ["the"]
    row = spark.sql("select '{\"a\":1,\"a\":2}' as dup, '{\"a/b\":{\"~\":[\"ok\"]}}' as deep").select(
        identity.strict_json(F.col("dup")).isNull().alias("bad"), identity.at_pointer(F.try_parse_json("deep"), "/a~1b/~0/0").alias("v"),
        markdown.slug(F.lit("Next actions!")).alias("s"), markdown.plain(F.lit("## A [b](c) *d*")).alias("p"), temporal.canonical(F.lit("2026-09-01T02:00:00+02:00")).alias("t"), temporal.canonical(F.lit("2026-09-01T02:00:00")).alias("n"),
    ).first()
    assert (row.bad, row.v, row.s, row.p, row.t, row.n) == (True, "ok", "next-actions", "A b d", "2026-09-01T00:00:00.000000Z", None)


def test_pointers(spark):
    doc = F.parse_json(F.lit('{"a":{"b":[1,{"c":2}]},"s":"x"}'))
    want = {"/a/b/1/c": (False, "2"), "/a/b/7": (False, None), "/none/x": (False, None), "/s/x": (True, None), "/a/b/x": (True, None), "/a/b/01": (True, None)}
    row = spark.range(1).select(*[F.struct(identity.bad_traversal(doc, p), identity.at_pointer(doc, p)).alias(p) for p in want]).first()
    assert {p: tuple(row[p]) for p in want} == want


def test_bm25_weighs_titles_and_keeps_best_passage(spark):
    rows = [("a", "0", "needle", "hay", ""), ("a", "1", "", "needle hay", ""), ("b", "0", "", "needle hay hay", ""), ("c", "0", "hay", "hay", "")] + [(f"x{i}", "0", "", "hay", "") for i in range(6)]
    passages = spark.createDataFrame(rows, "ref string, fragment string, title string, text string, names string")
    best = search.best_passage(search.bm25(passages, "needle", ["ref", "fragment"])).collect()
    assert {(r.ref, r.fragment) for r in best} == {("a", "0"), ("b", "0")}
    assert search.ranked(spark.createDataFrame(best), 1).first().ref == "a"


def test_stemmed_search_finds_inflected_and_accented_words(spark):
    rows = [("a", "Decisions made"), ("b", "the CAFÉS of Paris"), ("c", "one decision"), ("d", "hay"), ("e", None)]
    passages = spark.createDataFrame(rows, "ref string, text string")
    found = lambda q, **how: {r.ref for r in search.bm25(passages, q, ["ref"], **how).collect()}
    assert found("decision", stemmed=True) == found("the deciSIONS", stemmed=True) == {"a", "c"} and found("decision") == {"c"}
    assert found("cafe", stemmed=True) == found("café", stemmed=True) == {"b"} and found("cafe") == set()


def test_totals_of_all_edges_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = [tuple(r) for r in entry.queries()["backlink_totals_all"](spark, sf).select("target", "relation", "total").collect()]
    assert sorted(got) == sorted(db.execute(entry.oracle_sql()["backlink_totals_all"]).fetchall())
    assert {"contains", "supplied-by"} < {r[1] for r in got}


def test_section_links_and_ambiguity(spark):
    links = spark.createDataFrame([("m", "projects/x.md#decision"), ("n", "projects/x.md"), ("o", "projects/xy.md")], "item string, target string")
    wanted = spark.createDataFrame([("projects/x.md",)], "target string")
    assert {r.item for r in graph.linking(links, wanted).collect()} == {"m", "n"}
    names = spark.createDataFrame([("k", "a"), ("k", "b"), ("solo", "a"), ("me", "a")], "name string, item string")
    assert {r.name for r in graph.expand(names, "solo").collect()} == {"solo", "me"} and graph.expand(names, "k").count() == 0
    assert [r.name for r in graph.ambiguous(names).collect()] == ["k"]


def test_upsert_guards(spark):
    schema = "source string, id string, body string, updated int, observed int, ts int"
    stored = spark.createDataFrame([("s", "same", "x", 1, 2, 1), ("s", "stale", "x", 5, 9, 1), ("s", "clock", "x", 30, 26, 1), ("s", "gone", "x", 1, 1, 1), ("s", "moved", "x", 1, 1, 1)], schema)
    new = spark.createDataFrame([("s", "same", "x", 1, 3, 1), ("s", "stale", "y", 4, 9, 1), ("s", "clock", "y", 27, 27, 1), ("s", "moved", "x", 2, 2, 2), ("s", "new", "x", 1, 1, 1)], schema)
    got = {r.id: r.action for r in ingest.upsert(stored, new, snapshot=True).collect()}
    assert got == {"same": "unchanged", "stale": "unchanged", "clock": "updated", "moved": "updated", "new": "added", "gone": "removed"}


def test_coverage():
    assert ingest.coverage([(0, 5, 9), (5, 8, 9)]) == (0, 8)
    assert ingest.coverage([(5, 8, 9), (0, 2, 9)]) == (5, 8)
    assert ingest.coverage([(0, 2, 9), (5, 8, 9)]) == (5, 8)
    assert ingest.coverage([(0, 9, 4), (20, 30, 4)]) == (0, 4)
    assert ingest.covered((5, 8), 0, 2, 9) == ((5, 8), False) and ingest.covered((5, 8), 8, 9, 9) == ((5, 9), True) and ingest.covered((5, 20), 0, 2, 9) == ((5, 9), False)


def test_stored_search_equals_search_without_an_index(spark, tmp_path):
    rows = [(f"concepts/{i}.md", str(j), f"head {i % 3}", " ".join(f"word{(i * j + k) % 23} cafés" for k in range(i % 9)), "names and words", 2 if i % 2 else 1, "archived" if i % 5 == 0 else "") for i in range(60) for j in range(3)]
    passages = spark.createDataFrame(rows, "ref string, fragment string, heading string, text string, names string, weight int, status string")
    for stemmed, query in ((False, "word3 head words cafés"), (True, "word3 heads cafe")):
        index = search.build(passages, str(tmp_path / f"i{stemmed}"), stemmed)
        want = {(r.ref, r.fragment): round(r.score * r.weight, 9) for r in search.bm25(passages, query, ["ref", "fragment", "weight"], stemmed).collect()}
        got = {(r.ref, r.fragment): round(r.score, 9) for r in index.find(query).collect()}
        assert got == want and len(got) > 50
    assert search.open_index(spark, str(tmp_path / "iTrue")).stemmed and search.open_index(spark, str(tmp_path / "none")) is None
    top = search.ranked(search.best_passage(index.find("cafes")), 3, status="status").select("ref", "fragment", "rank")
    assert all("cafés" in r.excerpt for r in index.returned(top, "cafés", passages).collect())


def test_stems_equal_brute_force(spark):
    texts = ["Decisions, relational caresses!", "cafés naïve Hopping", None, "", "a_b x2"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.stems("t").alias("s")).orderBy("i").collect()]
    assert got == [["decis", "relat", "caress"], ["cafe", "naiv", "hop"], [], [], ["a", "b", "x2"]]


def test_excerpts(spark):
    long = " ".join(f"w{i}" for i in range(200))
    cut = lambda t, terms: spark.createDataFrame([(t,)], "t string").select(text.excerpt(F.col("t"), {t: [t] for t in terms})).first()[0]
    assert cut(long, ["w100"]).startswith(" … w92 ") and cut(long, ["w100"]).endswith(" … ") and len(cut(long, ["w100"]).split()) <= 50
    assert cut("short text", ["none"]) == "short text" and cut("", ["x"]) == ""


def test_upsert_ends_on_repeated_ids(spark):
    schema = "source string, id string, body string, updated int, observed int, ts int"
    one, two = spark.createDataFrame([("s", "a", "x", 1, 1, 1)], schema), spark.createDataFrame([("s", "b", "x", 1, 1, 1), ("s", "b", "y", 1, 1, 1)], schema)
    for stored, new in ((one, two), (two, one)):
        with pytest.raises(Exception, match="more than one record"):
            ingest.upsert(stored, new).collect()
    kept = ingest.upsert(spark.createDataFrame([("s", "a", "x", 1, None, 1)], schema), one).first()
    assert (kept.action, kept.observed) == ("unchanged", 1)


def test_streaming_upsert(spark, tmp_path):
    from loomdex.streaming.upserts import newest_reliable, upsert_stream

    schema = "source string, id string, body string, updated int, observed int, ts int"
    rows = [("s", "a", "old", 1, 9, 1), ("s", "a", "new", 5, 9, 1), ("s", "a", "clock", 99, 9, 1), ("t", "b", "x", 1, 1, 1)]
    assert {r.body for r in newest_reliable(spark.createDataFrame(rows, schema)).collect()} == {"new", "x"}
    out = str(tmp_path / "out")
    held = lambda: {(r.source, r.id): r.body for r in ingest.stored(spark, out).collect()}

    def run(new):
        if new:
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination(120)
        return held()

    assert run(rows) == {("s", "a"): "new", ("t", "b"): "x"}
    first = ingest.record_store(spark, out).head()
    assert run([("s", "a", "stale", 2, 9, 1), ("s", "c", "z", 1, 1, 1)]) == {("s", "a"): "new", ("t", "b"): "x", ("s", "c"): "z"}
    # The second batch wrote its new row alone, and the first segment is as it was.
    second = ingest.record_store(spark, out).head()
    assert second["segments"][0] == first["segments"][0] and second["sums"]["owners"] == 3 and len(second["segments"]) == 2
    # Started again without new rows, nothing changes; a repeated batch changes nothing either.
    assert run([]) == held() and ingest.record_store(spark, out).head()["number"] == second["number"]
    assert run([("s", "c", "z", 1, 1, 1)]) == held() and len(ingest.record_store(spark, out).head()["segments"]) == 2
    # The stream equals one batch upsert after the other.
    batch = ingest.upsert(newest_reliable(spark.createDataFrame(rows, schema)), spark.createDataFrame([("s", "a", "stale", 2, 9, 1), ("s", "c", "z", 1, 1, 1)], schema))
    assert {(r.source, r.id): r.body for r in batch.collect()} == held()


def test_a_snapshot_writes_only_what_differs(spark, tmp_path):
    at = str(tmp_path / "r")
    schema = "source string, id string, body string, updated int, observed int, ts int"
    make = lambda rows: spark.createDataFrame(rows, schema)
    columns = make([]).columns
    ingest.store(spark, at, "s", make([("s", "a", "1", 1, 1, 1), ("s", "b", "1", 1, 1, 1)]), make([]))
    ingest.store(spark, at, "t", make([("t", "a", "1", 1, 1, 1)]), ingest.stored(spark, at).select(columns))
    files = {p for p in (tmp_path / "r").rglob("*.parquet")}
    body = ingest.store(spark, at, "s", make([("s", "b", "2", 1, 1, 1), ("s", "c", "1", 1, 1, 1)]), ingest.stored(spark, at).select(columns))
    assert {(r.source, r.id): r.body for r in ingest.stored(spark, at).collect()} == {("s", "b"): "2", ("s", "c"): "1", ("t", "a"): "1"}
    assert all(p.exists() for p in files) and body["sums"]["owners"] == 3


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_html_characters(spark):
    cases = {
        "a &amp;copy; b &copy; &#233;&#xE9;&#x1F600; &nope; &#0; &#xD800; & x &amp": "a &copy; b © éé😀 &nope; &#0; &#xD800; & x &amp",
        "<!-- a > b --><p>one<!-- x -->two</p><script>if (a<b) {}</script>&lt;b&gt;": "\nonetwo<b>", "x<!-- open": "x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "html string").select("html", text.html_text(F.col("html")).alias("t")).collect()
    assert {r.html: r.t for r in rows} == cases


def brute_excerpt(words, wanted):
    import re

    terms = [{t for x in re.findall(r"[^\W_]+", w.lower()) for t in wanted.get(x, [])} for w in words]
    best, at = 0, None
    for i, t in enumerate(terms):
        n = len(set().union(*terms[i : i + 48]))
        if t and n > best:
            best, at = n, i
    last = max((j for j in range(at, min(at + 48, len(words))) if terms[j]), default=at) if at is not None else None
    start = 0 if at is None else max(0, at - min(8, 48 - (last - at + 1)))
    return (" … " if start else "") + " ".join(words[start : start + 48]) + (" … " if len(words) > start + 48 else "")


def test_excerpts_show_the_window_with_most_terms(spark):
    import random

    rng, wanted = random.Random(2), {"decision": ["decis"], "decisions": ["decis"], "café": ["cafe"], "red": ["red"], "x": ["x", "red"]}
    texts = [" ".join(rng.choices(["hay", "Decisions,", "café", "red-hot", "x"], [60, 1, 1, 1, 1], k=rng.choice([0, 3, 60, 300]))) for _ in range(25)] + ["hay " * 60 + "red", "red " * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.excerpt(F.col("t"), wanted).alias("e")).collect()
    for r in rows:
        assert r.e == brute_excerpt(r.t.split(), wanted), r.t


def test_coverage_as_an_expression(spark):
    import random

    rng = random.Random(9)
    runs = [[(a, a + rng.randrange(-1, 6), rng.randrange(0, 30)) for a in (rng.randrange(0, 20) for _ in range(rng.randrange(0, 7)))] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(runs)), "i int, runs array<struct<start:int,end:int,observed:int>>")
    for r in rows.select("i", ingest.coverage_of(F.col("runs")).alias("k")).collect():
        assert (tuple(r.k) if r.k else None) == ingest.coverage(runs[r.i]), runs[r.i]


def test_stems_of_a_vocabulary_equal_those_of_all_words(spark):
    texts = ["Decisions decided CAFÉ Café", "straße decide", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    each = rows.select(F.explode(text.stems("text")).alias("s")).groupBy("s").count()
    once = rows.select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").count().select(text.stem_of(F.col("w")).alias("s"), "count").groupBy("s").agg(F.sum("count").alias("count"))
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, once.collect()))
