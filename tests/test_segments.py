"""Stores of segments: any sequence of changes equals a full build, and a lookup
opens few files."""

import json
import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomdex import sinks
from loomdex.operators import graph, retrieve, search
from loomdex.sources import brain, config, segments

NOW = datetime(2026, 9, 25, 12, tzinfo=timezone.utc)


def rows(spark, held):
    t = spark.createDataFrame([(f"o{i}", f"k{i % 5}", v) for i, v in held.items()], "owner string, k string, v int")
    owners = t.select(F.col("owner").alias("name"), F.lit("").alias("digest"), F.lit(2).cast("bigint").alias("n"))
    return {"t": t, "owners": owners, "words": t.select(F.col("k").alias("w")).distinct()}


@pytest.mark.parametrize("fan", [2, 4])
def test_store_equals_its_history(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(segments, "FAN", fan)
    store, state, rng = segments.Store(spark, str(tmp_path / "s"), {"t": "k", "words": "w"}, ("words",)), {}, random.Random(fan)
    for step in range(7):
        new, gone = {i: step for i in rng.sample(range(20), 5)}, set(rng.sample(range(20), 3))
        state = {i: v for i, v in state.items() if i not in gone} | new
        marks = spark.createDataFrame([(f"o{i}",) for i in gone | set(new)], "owner string")
        body = store.apply(rows(spark, new), marks)
        assert body["sums"] == {"owners": len(state), "n": 2 * len(state)}
    want = sorted((f"k{i % 5}", v) for i, v in state.items())
    assert sorted(map(tuple, store.table("t").collect())) == want
    assert sorted(map(tuple, store.lookup("t", ["k1", "k3", "none"]).collect())) == [x for x in want if x[0] in ("k1", "k3")]
    assert {r.w for r in store.table("words").collect()} >= {k for k, _ in want}
    # Segments of one size are merged, and marks go with the rows that they mark.
    assert len(body["segments"]) < 7 and len(body["marks"]) < 7
    gone = store.vacuum(0)
    assert gone and sorted(map(tuple, store.table("t").collect())) == want and store.vacuum(0) == []


def test_one_of_two_writers_wins(spark, tmp_path):
    at = str(tmp_path / "c")
    sinks.publish(spark, at, 1, {"by": "a"})
    with pytest.raises(sinks.Conflict):
        sinks.publish(spark, at, 1, {"by": "b"})
    (tmp_path / "c" / "000000000002").write_text("")  # a writer that died after taking its number
    assert sinks.latest(spark, at)["by"] == "a" and sinks.next_number(spark, at) == 3
    sinks.replace_text(spark, f"{at}/x", "one")
    sinks.replace_text(spark, f"{at}/x", "two")
    assert sinks.read_text(spark, f"{at}/x") == "two"


def passages(spark, texts):
    return spark.createDataFrame([(r, "", t, "") for r, t in texts.items()], "ref string, fragment string, text string, status string")


def scores(index, query, **more):
    return {r.ref: round(r.score, 9) for r in index.find(query, **more).collect()}


def test_refresh_equals_a_full_build(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["decide", "decision", "decisions", "café", "straße", "alpha", "beta", "gamma"])
    texts = {f"r{i}": " ".join(word() for _ in range(rng.randrange(1, 9))) for i in range(30)}
    index = search.build(passages(spark, texts), str(tmp_path / "i"), stemmed=True)
    for step in range(5):
        new = {f"r{rng.randrange(40)}": " ".join(word() for _ in range(4)) for _ in range(4)}
        same = {r: texts[r] for r in rng.sample(sorted(texts), 3) if r not in new}
        gone = [r for r in rng.sample(sorted(texts), 2) if r not in new and r not in same]
        want = {"added": sum(r not in texts for r in new), "changed": sum(r in texts and texts[r] != t for r, t in new.items()), "unchanged": len(same) + sum(texts.get(r) == t for r, t in new.items()), "removed": len(gone)}
        index, told = search.refresh(index, passages(spark, new | same), spark.createDataFrame([(r,) for r in gone], "ref string"))
        texts = {r: t for r, t in texts.items() if r not in gone} | new
        assert told == want
    full = search.build(passages(spark, texts), str(tmp_path / "full"), stemmed=True)
    assert index.statistics() == full.statistics()
    for query in ("decisions cafe", "alpha straße", "STRASSE", "nothing"):
        for stemmed in (True, False):
            assert scores(index, query, stemmed=stemmed) == scores(full, query, stemmed=stemmed)
            assert scores(index, query, stemmed=stemmed) == {r.ref: round(r.score, 9) for r in search.bm25(passages(spark, texts), query, ["ref"], stemmed).collect()}
    assert scores(index, "straße", stemmed=False) and set(scores(index, "deciding")) == set(scores(index, "decided"))
    # Nothing is written when nothing has changed.
    again, told = search.refresh(index, passages(spark, texts))
    assert again.at["number"] == index.at["number"] and told == {"added": 0, "changed": 0, "unchanged": len(texts), "removed": 0}


def test_a_change_writes_what_changed(spark, tmp_path):
    texts = {f"r{i}": " ".join(f"w{(i * 7 + j) % 997}" for j in range(60)) for i in range(800)}
    index = search.build(passages(spark, texts), str(tmp_path / "i"))
    size = lambda s: sum(p.stat().st_size for p in (tmp_path / "i" / s["id"]).rglob("*.parquet"))
    whole = size(index.at["segments"][0])
    index, _ = search.refresh(index, passages(spark, {"r5": "one new text"}))
    assert len(index.at["segments"]) == 2 and size(index.at["segments"][1]) < whole / 5 and index.statistics()[0] == 800


def test_many_questions_in_one_plan(spark, tmp_path):
    rng = random.Random(7)
    texts = {f"r{i:03d}": " ".join(rng.choice(["decide", "decisions", "alpha", "beta", "gamma", "delta", "the"]) for _ in range(12)) for i in range(60)}
    index = search.build(passages(spark, texts).withColumn("status", F.when(F.col("ref") < "r010", "archived").otherwise("")), str(tmp_path / "q"), stemmed=True)
    asked = {f"q{i}": " ".join(rng.sample(["deciding", "alpha", "beta", "gamma", "none", "the"], 2)) for i in range(40)}
    table = spark.createDataFrame(sorted(asked.items()), "name string, query string")
    for stemmed in (True, False):
        got: dict = {}
        for r in search.find_all(index, table, 5, stemmed).collect():
            got.setdefault(r.name, []).append((r["rank"], r.ref, r.score))
        for name in sorted(asked)[:6]:
            found = search.ranked(search.best_passage(index.find(asked[name], stemmed=stemmed)), 5, status="status")
            assert sorted(got.get(name, [])) == sorted((r["rank"], r.ref, r.score) for r in found.collect())


def test_postings_stay_with_their_passages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FILE_TOKENS", 200)
    texts = {f"r{i}": " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(30)) for i in range(40)}
    index = search.build(passages(spark, texts), str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / index.at["segments"][0]["id"] / "postings")).select("ref", "term", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    homes, order = {}, {}
    for r in sorted(rows, key=lambda r: r["at"]):
        homes.setdefault(r.ref, set()).add(r.file)
        order.setdefault(r.file, []).append(r.term)
    assert len(order) > 2 and all(len(h) == 1 for h in homes.values()) and all(t == sorted(t) for t in order.values())
    assert scores(index, "w1 w2 none") == {r.ref: round(r.score, 9) for r in search.bm25(passages(spark, texts), "w1 w2 none", ["ref"]).collect()}


def test_questions_deal_their_postings_once(spark, tmp_path):
    index = search.build(passages(spark, {f"r{i}": f"alpha w{i}" for i in range(9)}), str(tmp_path / "d"))
    found = search.find_all(index, spark.createDataFrame([("q", "alpha w1"), ("p", "alpha")], "name string, query string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Sums of a passage need no shuffle beside that by ref.
    assert "hashpartitioning(ref#" in plan and not any("fragment#" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    assert [(r.ref, r["rank"]) for r in found.where("name = 'q' and rank = 1").collect()] == [("r1", 1)]


def test_runs(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "w array<string>").select(search.runs(F.col("w")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in got] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


# --- a folder that changes ---

SETTINGS = "name: home\nschema:\n  role: {description: who, type: identity, relation: true}\n"


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def record(i, text="said", **more):
    return json.dumps({"id": i, "title": f"t {i}", "text": text, "time": "2026-08-01T00:00:00Z", **more})


def tables_of(b):
    out = {t: sorted(map(str, getattr(b, t).select(*sorted(getattr(b, t).columns)).collect())) for t in ("items", "passages", "names", "links", "edges", "problems")}
    out["words"] = {q: sorted((r.ref, r.fragment, round(r.score, 9)) for r in b.index.find(q).collect()) for q in ("note", "said", "again")}
    out["links_to"] = sorted(map(str, graph.incoming(b.graph.edges, b.graph.links, ["brain://home/projects/a.md", "x:1"]).collect()))
    return out


def test_a_brain_follows_its_files(spark, tmp_path):
    root, open_ = tmp_path / "home", lambda store: brain.open_brain(spark, str(tmp_path / "home"), settings, store=str(tmp_path / store))
    put(root, "brain.yaml", SETTINGS)
    settings = config.open_brain(str(root))
    put(root, "projects/a.md", "---\naliases: [x:1]\n---\n# A\nnote one, see [b](b.md)\n")
    put(root, "projects/b.md", "# B\nnote two [a](a.md#part)\n\n## Part\nsaid\n")
    put(root, "memories/mail/2026-08.jsonl", record("1", links=["x:1"]) + "\n" + record("2"))
    put(root, "memories/mail/2026-09.jsonl", record("3"))

    def refreshed():
        return brain.refresh(spark, str(root), settings, store=str(tmp_path / "kept"))

    def same(step):
        assert tables_of(open_("kept")) == tables_of(open_(f"full-{step}")), step

    assert refreshed()[2] == {"added": 5, "changed": 0, "unchanged": 0, "removed": 0}
    number = refreshed()[1]["number"]
    # Touched, but the same: it is looked at, and its items stay.
    put(root, "projects/a.md", (root / "projects/a.md").read_text())
    assert refreshed()[2] == {"added": 0, "changed": 0, "unchanged": 1, "removed": 0}
    # One edited, one new, one gone.
    put(root, "projects/a.md", "---\naliases: [x:1, y:2]\n---\n# A\nnote again\n")
    put(root, "concepts/c.md", "---\ntype: c\n---\n# C\nnote [a](../projects/a.md)\n")
    (root / "projects/b.md").unlink()
    assert refreshed()[2] == {"added": 1, "changed": 1, "unchanged": 0, "removed": 1}
    # Of a file of records only those that are others are written.
    put(root, "memories/mail/2026-08.jsonl", record("1", links=["x:1"]) + "\n" + record("2", "said again") + "\n" + record("4"))
    _, body, told = refreshed()
    assert told == {"added": 1, "changed": 1, "unchanged": 1, "removed": 0} and body["number"] > number
    same(2)
    # A bad file is a problem and is looked at again when anything changes.
    put(root, "projects/bad.md", "---\nstatus: odd\n---\n# Bad\n")
    assert refreshed()[2] == {"added": 0, "changed": 0, "unchanged": 0, "removed": 0}
    # A record that another file has already waits until that one goes.
    put(root, "memories/mail/undated.jsonl", record("3", "said of the other file"))
    assert open_("kept").problems.where("problem like '%more than once%'").count() == 1
    (root / "memories/mail/2026-09.jsonl").unlink()
    assert refreshed()[2]["changed"] == 1
    same(5)
    found = retrieve.federated({"home": open_("kept")}, retrieve.ask("said other", NOW)).items.orderBy("rank").collect()
    assert found[0].ref == "mail:3" and found[0].kind == "record" and "other file" in found[0].excerpt
    # Another schema makes everything anew.
    other = config.load(SETTINGS + "  n: {description: x, type: integer}\n")
    assert brain.refresh(spark, str(root), other, store=str(tmp_path / "kept"))[2]["added"] == 6


def test_lookups_read_few_rows(spark, tmp_path):
    n = 120_000
    links = spark.range(n).select(F.concat(F.lit("i:"), F.col("id").cast("string")).alias("item"), F.concat(F.lit("t:"), (F.col("id") % 30_000).cast("string"), F.when(F.col("id") % 2 == 0, "#s").otherwise("")).alias("target"), F.lit(None).cast("timestamp_ntz").alias("time"))
    items = links.select(F.col("item").alias("ref"), "time")
    names = links.select(F.concat(F.lit("n:"), "item").alias("name"), "item")
    edges = links.where("item = 'i:7'").select("item", F.col("item").alias("subject"), F.lit("r").alias("relation"), "target", F.col("item").alias("origin"), "time")
    store = segments.Store(spark, str(tmp_path / "g"), graph.KEYS)
    body = store.apply({"owners": items.select(F.col("ref").alias("name"), F.lit("").alias("digest")), **graph.tables(items, names, links, edges)}, fresh=True)
    held = graph.Graph.stored(store, body)
    found = graph.linking(held.links, ["t:7", "t:8"])
    assert {r.item for r in found.collect()} == {f"i:{i}" for i in range(n) if i % 30_000 in (7, 8)}
    scan = [x for x in _scans(found)]
    assert scan and sum(scan) < 0.01 * n, scan
    total, latest = graph.backlinks(held.edges, held.links, ["t:7"])
    assert {(r.relation, r.total) for r in total.collect()} == {("r", 1), ("", 3)}
    assert graph.expanded({"g": held}, "n:i:5")[0] == ["n:i:5"] and [r.ref for r in graph.owners(held.names, "n:i:5").collect()] == ["i:5"]


def _scans(df):
    """Rows that the scans of the plan that ran gave."""
    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(plan.executedPlan())
        elif name.startswith("Scan"):
            yield plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))
        if name.endswith("QueryStage"):
            yield from walk(plan.plan())

    df._jdf.queryExecution().executedPlan()
    df.count()
    again = df._jdf
    again.collectToPython()
    yield from walk(again.queryExecution().executedPlan())


def test_a_dealt_graph_answers_like_its_tables(spark, tmp_path):
    edges = spark.range(300).select(F.concat(F.lit("o:"), "id").alias("item"), F.concat(F.lit("o:"), "id").alias("subject"), F.lit("by").alias("relation"), F.concat(F.lit("c:"), F.col("id") % 7, F.when(F.col("id") % 3 == 0, F.lit("#part")).otherwise(F.lit(""))).alias("target"), F.lit("").alias("origin"), F.lit(None).cast("timestamp_ntz").alias("time"))
    links = edges.select(F.concat(F.lit("l"), "item").alias("item"), "target", "time")
    items, names = edges.select(F.col("item").alias("ref"), "time"), edges.select(F.concat(F.lit("n:"), "item").alias("name"), "item")
    store = segments.Store(spark, str(tmp_path / "g"), graph.KEYS, (), tuple(graph.KEYS))
    at = store.apply({"owners": items.select(F.col("ref").alias("name"), F.lit("").alias("digest")), **graph.tables(items, names, links, edges, 3)}, fresh=True)
    folder = tmp_path / "g" / at["segments"][0]["id"]
    assert len(list((folder / "reach").glob("*.parquet"))) == len(list((folder / "edges").glob("*.parquet"))) == 3 and not list(folder.rglob("folder=*"))
    held, plain = graph.Graph.stored(store, at), graph.Graph.of(items, names, links, edges)
    rows = lambda df: sorted(map(str, df.collect()))
    for wanted in (["c:3", "c:5#part"], ["none"]):
        for part in (0, 1):
            assert rows(graph.backlinks(held.edges, held.links, wanted)[part]) == rows(graph.backlinks(plain.edges, plain.links, wanted)[part])
    assert rows(graph.claims(held.claims, ["o:4"]).select("target")) == rows(graph.claims(plain.claims, ["o:4"]).select("target")) and graph.expanded({"d": held}, "n:o:9") == graph.expanded({"d": plain}, "n:o:9")
