"""A small brain on disk: search, read, pages, validation, collection, adapters."""

import io
import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomdex import cli, sinks
from loomdex.functions import markdown
from loomdex.functions.temporal import period
from loomdex.operators import checks, graph, health, ingest, pages, retrieve, reviews
from loomdex.sources import adapters, brain, config

NOW = datetime(2026, 9, 25, 12, tzinfo=timezone.utc)
CONFIG = """
version: 5
name: home
brains: {other: {path: ../other}}
schema:
  role: {description: what someone is, type: identity, relation: true}
  n: {description: a number, type: integer, cardinality: one}
sensors:
  meetings: {command: [x], refresh: 3600, trust: owner}
  mail: {command: [x], fields: {n: {path: /attributes/n}}}
"""
NOTES = {
    "projects/offline.md": "---\ntype: project\nstatus: active\nupdated: 2026-09-01\ntags: [retention]\naliases: [repo:example/project]\n---\n# Offline retrieval\nWork from [the decision](meetings:decision-1).\n\n## Decision\nKeep originals.\n\n## Next actions\n- [ ] write the retention guide\n- [x] ask\n",
    "projects/old.md": "---\nstatus: archived\n---\n# Offline archive\nretrieval retrieval\n",
    "concepts/evidence.md": "---\ntype: concept\nstatus: stable\n---\n# Durable evidence\nOriginals outlive providers. See [why](../projects/offline.md#decision) and [role](brain://home/projects/offline.md?rel=role).\n",
    "actions/2026-09-24_review/ACTION.md": "---\ntype: action\nupdated: 2026-09-24\n---\n# Review\nOf [offline](../../projects/offline.md).\n",
    "actions/2026-09-24_review/data.txt": "1",
}
RECORDS = {
    "memories/meetings/2026-08.jsonl": [
        {"id": "decision-1", "title": "Decision", "text": "offline retrieval was decided", "time": "2026-08-31T12:00:00Z", "links": ["repo:example/project"], "aliases": ["meeting:decision-1"]},
        {"id": "lunch", "title": "Tuesday lunch", "time": "2026-08-30T14:00:00+02:00", "attributes": {"updated": "2026-09-20T00:00:00Z"}},
    ],
}


def make(root, name, notes, records, settings):
    folder = root / name
    for path, text in {**notes, "brain.yaml": settings, **{p: "\n".join(json.dumps(r) for r in rows) + "\n\n" for p, rows in records.items()}}.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tmp_path_factory.mktemp("brains")


@pytest.fixture(scope="module")
def folder(root):
    make(root, "other", {"projects/offline.md": "# Offline retrieval\nof the other brain, twice: retrieval\n"}, {}, "name: other\n")
    return make(root, "home", NOTES, RECORDS, CONFIG)


@pytest.fixture(scope="module")
def home(spark, folder):
    return brain.open_brain(spark, folder, config.open_brain(folder))


def found(home, text, scope="", **more):
    return [r.ref + (f"#{r.fragment}" if r.fragment else "") for r in retrieve.federated({"home": home}, retrieve.ask(text, NOW, scope), **more).items.orderBy("rank").collect()]


def test_search(home):
    hits = found(home, "offline retrieval")
    assert hits[0] == "projects/offline.md" and hits[-1] == "projects/old.md" and "meetings:decision-1" in hits
    assert found(home, "retention guide") == ["projects/offline.md#next-actions"] and found(home, "Tuesday lunch")[0] == "meetings:lunch"
    assert found(home, "zzabsent") == [] and found(home, "repo:example/project")[0] == "projects/offline.md" and "meetings:decision-1" in found(home, "repo:example/project")
    assert found(home, "offline", "memories/meetings/2026-08") == ["meetings:decision-1"] and found(home, "offline", "projects/") == ["projects/offline.md", "projects/old.md"]
    assert set(found(home, "decision", "repo:example/project")) == {"concepts/evidence.md", "meetings:decision-1"}
    for bad in (("",), ("x", "", 0), ("x", "", 51)):
        with pytest.raises(ValueError):
            retrieve.ask(bad[0], NOW, *bad[1:])
    reply = retrieve.federated({"home": home}, retrieve.ask("nobody:here", NOW), trust={"meetings": "owner"}, broken={"gone": "no such folder"})
    assert reply.identity == "unknown" and reply.problems[0] == {"brain": "gone", "error": "no such folder"}


def test_federation(spark, root, folder, home):
    other = brain.open_brain(spark, str(root / "other"), config.open_brain(str(root / "other")))
    rows = retrieve.federated({"home": home, "other": other}, retrieve.ask("retrieval", NOW)).items.orderBy("rank").collect()
    assert [r.brain for r in rows][:3] == ["home", "other", "home"] and rows[1].uri == "brain://other/projects/offline.md"
    with pytest.raises(LookupError, match="several brains"):
        retrieve.read({"home": home, "other": other}, "projects/offline.md", NOW)
    with pytest.raises(LookupError):
        retrieve.federated({}, retrieve.ask("x", NOW), broken={"home": "unreadable"})


def test_read(home):
    one = lambda ref: retrieve.read({"home": home}, ref, NOW)
    whole = one("projects/offline.md")
    assert whole["kind"] == "item" and {r.fragment for r in whole["parts"]["passages"].collect()} >= {""}
    assert {(r.relation, r.total) for r in whole["parts"]["backlinks"].collect()} == {("role", 1), ("", 2)}
    assert [r.heading for r in one("brain://home/projects/offline.md#decision")["parts"]["passages"].collect()] == ["Decision"]
    assert one("meeting:decision-1")["parts"]["passages"].first().ref == "meetings:decision-1" and one("2026-08")["kind"] == "page" and one("")["kind"] == "page"
    action = one("actions/2026-09-24_review/ACTION.md")["parts"]
    assert [r.ref for r in action["projects"].collect()] == ["projects/offline.md"] and action["files"].count() == 0
    for bad in ("projects/none.md", "nobody:here", "meetings:none"):
        with pytest.raises(LookupError, match="not found"):
            one(bad)


def test_pages(home):
    items = brain.dated(home.items)
    page = pages.home(items, home.links, NOW)
    assert [(r.ref, r.review) for r in page["projects"].collect()] == [("projects/offline.md", True)] and [r.ref for r in page["actions"].collect()] == ["actions/2026-09-24_review/ACTION.md"]
    month = pages.page(items, home.links, "2026-08", NOW)
    assert [r.ref for r in month["items"].orderBy("rank").collect()] == ["meetings:decision-1", "meetings:lunch"] and month["total"].first().total == 2
    assert [r.ref for r in pages.page(items, home.links, "2026-09", NOW)["changed"].collect()] == ["meetings:lunch"]
    assert pages.page(items, home.links, "memories/nothing", NOW) is None and pages.page(items, home.links, "projects/offline.md", NOW) is None
    assert [r.ref for r in pages.page(items, home.links, "projects", NOW)["items"].orderBy("rank").collect()] == ["projects/offline.md", "projects/old.md"]
    held = pages.page(items, home.links, "memories/meetings", NOW)
    assert [(r.path, r.records) for r in held["partitions"].collect()] == [("memories/meetings/2026-08.jsonl", 2)]
    with pytest.raises(ValueError):
        pages.page(items, home.links, "memories/../x", NOW)
    told = json.loads(pages.reply_rows(items.where("ref = 'projects/offline.md'")).first().json)
    assert told["tasks"] == {"open": 1, "done": 1, "next": "write the retention guide"} and "source" not in told and "url" not in told
    text = reviews.weekly_review(page, pages.timeline(items, period("7d", NOW), "7d"), "2026-09-25")
    assert "(review)" in text and "- meetings" not in text and reviews.code("a`b") == "``a`b``"
    said = pages.context(home, "projects/offline.md", ["repo:example/project", "brain://home/projects/offline.md"])
    assert "role 1" in reviews.session_context("Offline", said["backlinks"], said["items"])


def test_identities(spark, home):
    names = home.names.unionByName(spark.createDataFrame([("repo:example/project", "projects/copy.md")], "name string, item string"))
    assert graph.expanded(names, "repo:example/project")[0] == ["repo:example/project"] and "ambiguous" in graph.expanded(names, "repo:example/project")[1][0]["error"]
    assert graph.expanded(home.names, "repo:example/project")[0] == ["brain://home/projects/offline.md", "repo:example/project"]
    page, _ = pages.identity_page(home, "repo:example/project")
    assert {r.item for r in page["items"].collect()} == {"meetings:decision-1", "actions/2026-09-24_review/ACTION.md", "concepts/evidence.md"}


def test_unreadable_files_are_problems(spark, root):
    bad = make(root, "bad", {"projects/a.md": "---\nstatus: perhaps\n---\n# A\nx\n", "projects/b.md": "# B\nfine words\n", "projects/c.md": "---\nx: 1\n"}, {"memories/m/2026-08.jsonl": [{"id": "a", "title": "t"}, {"id": 1, "title": "t"}], "memories/n/undated.jsonl": [{"id": "a", "title": "t"}]}, "name: bad\n")
    held = brain.open_brain(spark, bad, config.open_brain(bad))
    assert {r.file for r in held.problems.collect()} == {"projects/a.md", "projects/c.md", "memories/m/2026-08.jsonl"}
    assert found(held, "fine words") == ["projects/b.md"] and {r.ref for r in held.items.collect()} == {"projects/b.md", "n:a"}
    records, problems = brain.read_records(spark, f"{bad}/memories")
    assert brain.find_record(brain.in_partitions(records), problems, "n", "a").count() == 1
    with pytest.raises(LookupError):
        brain.find_record(brain.in_partitions(records), problems, "m", "a")
    with pytest.raises(LookupError, match="may exist"):
        retrieve.read({"bad": held}, "m:a", NOW)
    listed = brain.files(spark, bad)
    assert brain.inputs(listed).count() == 5 and [r.source for r in brain.partitions(listed, "n").collect()] == ["n"] and brain.bounded(listed, 3)[1].count() == listed.count()


def test_validation_tells_everything(spark, root):
    notes = {"projects/a.md": "# A\n[x](none.md) [y](b.md#none) [z](../../x) [r](mail:none) [w](brain://v/projects/none.md)\n", "projects/b.md": "---\naliases: [k:1]\n---\n# B\n", "projects/c.md": "---\naliases: [k:1]\n---\n# C\n", "concepts/d.md": "# no type\n", "actions/x/ACTION.md": "# X\n"}
    records = {"memories/mail/2026-08.jsonl": [{"id": "a", "title": "t", "time": "2026-07-01T00:00:00Z", "fields": {"n": "x"}}, {"id": "a", "title": "u", "time": "2026-08-01T00:00:00Z"}]}
    at = make(root, "v", notes, records, CONFIG.replace("name: home", "name: v").replace("brains: {other: {path: ../other}}", ""))
    told = {(r.check, r.problem) for r in cli.problems_of(spark, at, config.open_brain(at)).collect()}
    assert {c for c, _ in told} == {"links", "actions", "addresses", "names", "concepts", "partitions", "ids", "cited", "fields"}
    assert sum(c == "links" for c, _ in told) == 3
    assert cli.answer(spark, at, "validate")["valid"] is False


def test_commands(spark, folder):
    reply = cli.answer(spark, folder, "search", "offline retrieval", now=NOW)
    assert reply["items"][0]["ref"] == "projects/offline.md" and "excerpt" in reply["items"][0]
    assert cli.answer(spark, folder, "validate")["problems"] == [] and cli.answer(spark, folder, "schema")["fields"]["role"]["relation"] is True
    assert cli.answer(spark, folder, "read", "2026-08", now=NOW)["kind"] == "page"
    assert cli.answer(spark, folder, "status")["sources"][0]["records"] == 2


def test_cases(spark, folder, home):
    suite = {"cases": [
        {"name": "a", "query": "retention guide", "expect": ["projects/offline.md"], "text": ["RETENTION"]}, {"name": "b", "query": "zzabsent", "empty": True}, {"name": "c", "query": "offline", "expect": ["none"], "forbid": ["projects/old.md"]},
        {"name": "d", "read": "meetings:lunch", "expect": ["meetings:lunch"]}, {"name": "e", "read": "projects/none.md", "empty": True}, {"name": "f", "query": "offline", "text": ["not there"]},
    ]}
    got = {r.case: (r.passed, r.missing, r.forbidden, r.absent) for r in cli.run_cases(spark, {"home": home}, checks.load_cases(spark, {"s.yaml": suite}), NOW).collect()}
    assert got == {"s.yaml/a": (True, 0, 0, 0), "s.yaml/b": (True, 0, 0, 0), "s.yaml/c": (False, 1, 1, 0), "s.yaml/d": (True, 0, 0, 0), "s.yaml/e": (True, 0, 0, 0), "s.yaml/f": (False, 0, 0, 1)}
    for bad in ([{"name": "x", "query": "q"}], [{"name": "x", "query": "q", "empty": True}] * 2, [{"name": "x", "query": "q", "read": "r", "empty": True}]):
        with pytest.raises(ValueError):
            checks.load_cases(spark, {"s": {"cases": bad}})


def read_note(spark, path, text):
    return markdown.parse_notes(spark.createDataFrame([(path, text)], "path string, text string")).first()


def test_notes(spark):
    note = read_note(spark, "projects/some-name.md", "Intro\r\n\n## Same\n## Same\nx y\n\n```\n# no\n- [ ] no\n```\n### Last {#end}\n")
    assert note.title == "some name" and [p.fragment for p in note.passages] == ["", "same", "same-1", "end"] and "x y" in note.passages[2].text and note.tasks_open == 0
    assert note.passages[2].text == "x y\n\n```\n# no\n- [ ] no\n```\n" and note.passages[0].text == "Intro" and note.lead == "Intro"
    files = lambda *texts: spark.createDataFrame([(f"projects/{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    assert [r.text for r in markdown.sections(files("# A\n## B\nx\n### C\ny\n## D\n", "# A\n"), "b").collect()] == ["## B\nx\n### C\ny\n"]
    bad = ("---\nx: 1\n", "# A {#a.md}\n", "# A {#a}\n# A {#a}\n", "---\nupdated: 2026-13-01\n---\n", "---\nstatus: odd\n---\n", "---\na: &x 1\nb: *x\n---\n", "---\na: 1\na: 2\n---\n", "---\ntags: x\n---\n", "x" * (markdown.MAX_NOTE + 1))
    rows = markdown.parse_notes(files(*bad)).collect()
    assert len(rows) == len(bad) and all(r.problem and r.problem.startswith(r.path) and r.title is None for r in rows)
    concepts = {"concepts/index.md": "---\ntype: x\n---\n", "concepts/log.md": "## soon\n", "concepts/a.md": "---\ntype: c\nverified: {by: x}\n---\n", "concepts/b.md": "---\ntype: c\nsources: [x]\n---\n", "concepts/c.md": "# no type\n"}
    fine = {"concepts/x/log.md": "## 2026-09-01\n", "concepts/x/index.md": "# only a title\n", "concepts/d.md": "---\ntype: c\nstatus: stable\n---\n", "projects/e.md": "# E\n"}
    told = markdown.concept_problems(spark.createDataFrame([*concepts.items(), *fine.items()], "path string, text string"))
    assert {r.path for r in told.collect()} == set(concepts)
    assert markdown.concept_problems(spark.createDataFrame([("concepts/index.md", "---\nokf_version: 1\n---\n")], "path string, text string")).count() == 0


def test_headings(spark):
    note = read_note(spark, "projects/x.md", "# snake_case *name*\n## `code` and __bold__\nTitle\n=====\nsub\n---\n> ## quoted\n\n    # code\n\n- item\n\n    ## in a list\n\n## a\n## a\n## a-1\n## a\n##\n## Ends ##\n#no\n\n---\n")
    assert [p.fragment for p in note.passages] == ["", "code-and-bold", "sub", "quoted", "in-a-list", "a", "a-1", "a-1-1", "a-2", "section", "ends"]
    assert note.title == "snake_case name" and set(note.slugs) >= {"snake_case-name", "title"} and note.passages[2].text == "> ## quoted\n"[:0]
    assert [p.heading for p in note.passages][1:3] == ["code and bold", "sub"]
    assert read_note(spark, "projects/a-b.md", "Big\n===\nrest\n").passages[0].asDict() == {"fragment": "", "title": "Big", "heading": "Big", "text": "rest"}


def test_links(spark):
    text = (
        "[one](a.md) ![no](i.png) `[no](b.md)` \\[no\\](c.md) <!-- [no](d.md) --> <https://e.org/x>\n[two\nlines](two.md \"title\") ``a ` [no](f.md)\nover`` [ref][Key] and [key] [none][x]\n\n"
        "    [no](code.md)\n    - [ ] no\n\n## Part\n> [quoted](q.md) [angle](<a b.md>) [par](p(1).md) [nest [x] y](n.md)\n\n<!--\n[no](g.md)\n-->\n[key]: k.md 'K'\n\n- a\n    - [ ] deep [t](t.md)\n> - [x] done *it*\n~~~ x\n[no](h.md)\n~~~\n#### [head](h1.md)\n"
    )
    note = read_note(spark, "projects/x.md", text)
    got = {(c.target, c.fragment) for c in note.contexts}
    assert got == {("a.md", ""), ("https://e.org/x", ""), ("two.md", ""), ("k.md", ""), ("q.md", "part"), ("a b.md", "part"), ("p(1).md", "part"), ("n.md", "part"), ("t.md", "part"), ("h1.md", "head")}
    assert note.targets == sorted({t for t, _ in got}) and (note.tasks_open, note.tasks_done, note.next) == (1, 1, "deep t")


def test_long_and_odd_notes(spark):
    texts = ["", None, "\n", "# " + "a" * 100_000, "[" * 50_000, "`" * 20_001, "```\n" + "x\n" * 100_000, "[a](" * 20_000, "- [ ] t\n" * 3000, "<!-- " * 10_000, "> " * 20_000, "*" * 50_000 + "\n" + "_" * 50_000]
    rows = markdown.parse_notes(spark.createDataFrame([(f"projects/n{i}.md", t) for i, t in enumerate(texts)], "path string, text string")).collect()
    assert len(rows) == len(texts) and all(r.problem is None for r in rows)
    assert {r.path: r.tasks_open for r in rows}["projects/n8.md"] == 3000


def test_config(root, folder, tmp_path):
    found, problems = config.related(folder)
    assert sorted(found) == ["home", "other"] and problems == []
    for bad in ("name: X", "name: a\nextra: 1", "name: a\nschema: {r: {type: string, relation: true}}", "name: a\nsensors: {s: {fields: {n: {path: /x}}}}", "name: a\nbrains: {a: {path: x}}", "[1]", "a: [" * 40):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.select(folder) == folder and config.select("", here=folder + "/projects") == folder and config.select("", here="/", registry={"h": folder}) == folder
    with pytest.raises(ValueError):
        config.select("nowhere", here="/")
    registry = str(tmp_path / "r.json")
    config.register(registry, "home", folder, collect=True)
    assert config.may_collect(registry, "home", folder) and not config.may_collect(registry, "home", "/x")
    with pytest.raises(ValueError):
        config.register(registry, "home", "/x")
    one = config.load("name: a")
    assert config.signature(one) != config.signature(config.load("name: a\nschema: {r: {type: string}}")) and config.load("name: a") is one


def stored(spark):
    return spark.createDataFrame([], "source string, id string, body string, updated timestamp_ntz, observed timestamp_ntz, ts timestamp_ntz")


def test_collect(spark, tmp_path):
    settings = config.load(CONFIG)
    lines = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    good = [{"id": "a", "title": "t", "time": "2026-08-01T00:00:00Z", "attributes": {"n": 1}}, {"id": "b", "title": "t", "attributes": {"n": 2}}]
    run = lambda rows, before, name="mail", program=None: ingest.collect(spark, lines(rows), name, before, program or settings.sensors[name], settings, NOW)
    held, told = run(good, stored(spark))
    assert told == {"source": "mail", "added": 2, "updated": 0, "unchanged": 0, "removed": 0}
    at = str(tmp_path / "records")
    ingest.store(spark, at, "mail", held, stored(spark))
    kept = ingest.stored(spark, at).select(*stored(spark).columns)
    assert run(good, kept)[1]["unchanged"] == 2 and {r.id: str(r.ts)[:10] for r in kept.collect()} == {"a": "2026-08-01", "b": "None"}
    snapshot = config.Program(mode="snapshot", fields=settings.sensors["mail"].fields)
    assert run(good[:1], kept, program=snapshot)[1]["removed"] == 1
    empty = spark.createDataFrame([], "value string")
    for bad, message in (([{"id": "a"}], "title"), ([{"id": "a", "title": "t", "attributes": {}}], "missing"), ([{"id": "a", "title": "t", "attributes": {"n": "x"}}], "integer"), (good + good[:1], "more than one")):
        with pytest.raises(Exception, match=message):
            run(bad, kept)
    with pytest.raises(ValueError, match="empty snapshot"):
        ingest.collect(spark, empty, "mail", kept, snapshot, settings, NOW)
    done, problems = ingest.update({"a": lambda: 1, "b": lambda: 1 / 0, "c": lambda: 2})
    assert done == {"a": 1, "c": 2} and problems[0]["step"] == "b"


def test_gate_and_versions(spark, tmp_path):
    at, manifest = str(tmp_path / "p"), spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string")
    assert ingest.gate(spark, at, manifest, "s") == "rebuild"
    note = {"signature": "s", "manifest": ingest.manifest_digest(manifest)}
    for _ in range(3):
        sinks.commit(spark, at, {"t": manifest}, note)
    assert ingest.gate(spark, at, manifest.orderBy("path"), "s") == "ready" and ingest.gate(spark, at, manifest.limit(1), "s") == "stale" and ingest.gate(spark, at, manifest, "other") == "rebuild"
    manifest.write.parquet(f"{at}/v-lost/t")
    # Versions stay while queries may read them.
    assert sinks.recover(spark, at) == [] and sinks.read_table(spark, at, "t").count() == 2
    gone = sinks.recover(spark, at, keep_seconds=0)
    assert "v-lost" in gone and len(gone) == 3 and sinks.read_table(spark, at, "t").count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2026-08", str(i % 7), i) for i in range(50)], "source string, month string, id string, ts int")
    sinks.write_partitions(rows, str(tmp_path / "j"), part_rows=20)
    assert spark.read.json(str(tmp_path / "j")).count() == 50 and (tmp_path / "j/source=s/month=2026-08").is_dir()
    assert sinks.encode({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and sinks.tool_reply({"a": 1})["structuredContent"] == {"a": 1}
    with pytest.raises(ValueError):
        sinks.encode({"a": float("nan")})
    with pytest.raises(ValueError):
        sinks.encode({"a": "x" * (5 << 20)})
    log = str(tmp_path / "usage.jsonl")
    for i in range(3):
        sinks.note_usage(log, NOW, "search", i)
    assert checks.usage(adapters.read_usage(spark, log), NOW).first().asDict() == {"search_7d": 3, "empty_7d": 1, "read_7d": 0, "search_30d": 3, "empty_30d": 1, "read_30d": 0}
    assert sinks.write_action(str(tmp_path), "2026-09-25", "weekly", "# W\n") and sinks.write_action(str(tmp_path), "2026-09-25", "weekly", "# X\n") is None and sinks.write_action(str(tmp_path), "2026-09-25", "b", " ") is None


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in parts.items():
            box.writestr(name, text)
    return out.getvalue()


def test_documents(spark, tmp_path):
    p = "<w:p xmlns:w='w'><w:r><w:t>{}</w:t></w:r></w:p>"
    held = {
        "a.docx": office({"word/document.xml": "<w:d xmlns:w='w'>" + p.format("one") + p.format("two") + "</w:d>", "word/header1.xml": p.format("top")}),
        "b.pptx": office({"ppt/slides/slide10.xml": "<a:p xmlns:a='a'><a:t>ten</a:t></a:p>", "ppt/slides/slide2.xml": "<a:p xmlns:a='a'><a:t>two</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p xmlns:a='a'><a:t>note</a:t></a:p>"}),
        "c.xlsx": office({"xl/sharedStrings.xml": "<s xmlns='s'><si><t>name</t></si></s>", "xl/worksheets/sheet1.xml": "<s xmlns='s'><row><c t='s'><v>0</v></c><c><f>A1+1</f><v>3</v></c></row></s>"}),
        "d.html": b"<style>x</style><p>one</p><script>y</script><li>two", "e.txt": b"x" * 70_000, "f.pdf": b"%PDF\nstream\nBT (shown \\(text\\)) Tj ET\nendstream", "g.docx": b"no zip", "h.txt": b"\xff", "i.bin": b"x",
    }
    for name, raw in held.items():
        (tmp_path / name).write_bytes(raw)
    rows, problems = adapters.read_documents(spark, str(tmp_path))
    got = {r.id: r for r in rows.collect()}
    assert {k: v.text for k, v in got.items() if k != "e.txt"} == {"a.docx": "one\ntwo\ntop", "b.pptx": "two\nten\nnote", "c.xlsx": "name\t3 [formula: A1+1]", "d.html": "one\ntwo", "f.pdf": "shown (text)"}
    assert got["e.txt"].partial and len(got["e.txt"].text) == 64 << 10 and {r.file for r in problems.collect()} == {"g.docx", "h.txt"}


def test_producers(spark):
    class Mail(adapters.Sensor):
        @staticmethod
        def produce(start, end, part):
            yield json.dumps({"id": f"{start}-{part}", "title": "t"})

        @classmethod
        def name(cls):
            return "mail"

    spark.dataSource.register(Mail)
    lines = spark.read.format("mail").options(start="s", end="e", parts="3").load()
    assert {json.loads(r.value)["id"] for r in adapters.checked_lines(lines).collect()} == {"s-0", "s-1", "s-2"}
    array = spark.createDataFrame([('[{"id":"a","title":"t"},{"id":"b","title":"t"}]',)], "value string")
    assert adapters.from_array(array).count() == 2
    for bad in ('{"id":"a"}', "[1", ""):
        with pytest.raises(Exception, match="one JSON array"):
            adapters.from_array(spark.createDataFrame([(bad,)], "value string")).collect()
    assert adapters.arguments(["x", "{{start}}/{{end}}"], {"start": "a", "end": "b"}) == ["x", "a/b"]
    with pytest.raises(ValueError):
        adapters.arguments(["{{other}}"], {})
    with pytest.raises(Exception, match="incomplete"):
        adapters.drive_folders(spark.createDataFrame([('{"incompleteSearch":true,"files":[]}',)], "value string")).collect()
    with pytest.raises(Exception, match="twice"):
        adapters.drive_folders(spark.createDataFrame([('{"files":[{"id":"a","name":"x"},{"id":"a","name":"y"}]}',)], "value string")).collect()


def test_a_log_of_very_many_commits_is_read_whole(spark):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_844_800) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    log = spark.range(10_050).select(F.lit("demo").alias("repo"), F.concat_ws("\x1f", F.col("id").cast("string"), stamp, F.lit("someone"), F.lit("a@x.example"), F.lit("fix")).alias("value"))
    found = adapters.git_commits(log, datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 11, tzinfo=timezone.utc))
    assert found.select("id").distinct().count() == found.count() == 10_050


def test_wanted_columns_of_notes_equal_those_of_all(spark):
    notes = {**{p: t for p, t in NOTES.items() if p.endswith(".md")}, "projects/bad.md": "---\nstatus: what\n---\n# x\n", "projects/links.md": "# T\n\nSee [a](b.md) and [c].\n\n[c]: d.md\n\n## S\n- [ ] one\n- [x] two\n"}
    files = spark.createDataFrame(sorted(notes.items()), "path string, text string")
    whole = {r.path: r for r in markdown.parse_notes(files).collect()}
    for wanted in (("entity", "aliases"), ("slugs",), ("entity", "contexts"), ("title", "lead", "tasks_open", "tasks_done", "next"), ("targets",), ("passages",)):
        part = markdown.parse_notes(files, *wanted)
        assert {*part.columns} == {"path", "problem", *wanted} and "REPARTITION_BY_NUM" in part._jdf.queryExecution().executedPlan().toString()
        assert {r.path: tuple(r) for r in part.collect()} == {p: tuple(r[c] for c in part.columns) for p, r in whole.items()}


def test_state(spark, tmp_path):
    (tmp_path / "state.jsonl").write_text('{"name":"mail","success":"2026-09-25T11:00:00Z"}\nnot json\n{"x":1}\n')
    runs = adapters.read_state(spark, str(tmp_path / "state.jsonl"))
    programs = {"mail": config.Program(refresh=600), "feed": config.Program(refresh=600), "off": config.Program(enabled=False)}
    counts = spark.createDataFrame([("mail", 3, None), ("gone", 2, None)], "source string, records bigint, latest timestamp_ntz")
    rows = health.source_health(health.declared(spark, programs), runs, counts, NOW)
    assert {r.source: (r.state, r.freshness, r.records) for r in rows.collect()} == {"mail": ("active", "stale", 3), "feed": ("active", "never", 0), "off": ("disabled", "unknown", 0), "gone": ("historical", "unknown", 2)}
    assert {r.name for r in health.attention(rows).collect()} == {"mail", "feed"} and health.attention(rows, trusted=False).count() == 0
    assert health.source_health(health.declared(spark, programs), runs, counts, NOW, trusted=False).where("freshness = 'unknown'").count() == 3
