"""Filter audit, context-tree model and divergence audit against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import contexts, divergence, filters

LONG = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest " * 12
ROWS = [
    (0, None, None, "s1"), (1, "", "en", "s1"), (2, LONG, "en", None), (3, LONG, "en", "s1"), (3, LONG, "en", "s1"), (4, LONG, "fr", "s2"),
    (5, "A|B C", "fr", "s2"), (6, " ".join(f"w{i}" for i in range(120)), "fr", "s3"), (7, " \t\n\x0b\x0c\r", "", "s3"), (None, "no id Here é日本", "en", "s3"),
    (None, LONG, "en", "s1"), (8, "X" * 300 + " # " + LONG, "en", "s1"), (9, "é日本 Émile\nthe lazy dog", "de", "s1"), (10, "É日本 the dog", "de", "s2"), (11, "é日本 THE dog", "de", "s3"),
    (12, "brown fox dog", "en", "s2"), (13, "brown\x00fox", "en", "s2"), (14, " ".join(f"w{i} the" for i in range(60)), "fr", "s1"), (-7, LONG, "en", "s1"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
LABELS = [(2, 1, 0), (3, 0, 1), (3, 1, None), (4, 1, 1), (5, None, None), (8, 1, 1), (None, 1, 1), (99, 1, 1), (12, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    more = {"part": F.lit("x"), "mask": F.lit(1), "n": F.lit(2), "block": F.lit("b"), "word": F.lit("w"), "term": F.lit("t"), "held_out": F.lit(3), "quality": F.lit(1)}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(more)


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, lang, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = ""
        own += "A" if len(w) < 100 else ""
        own += "B" if 100 * len(set(w)) < 80 * len(w) else ""
        own += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        own += "D" if re.search(r"[#$%&*|]", text) else ""
        own += "E" if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows) else ""
        fails.append((lang or "", own, doc_id in good, doc_id in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                reach = [x for x in mine if not set(order[:step]) & set(x[1])]
                gone = [x for x in reach if f in x[1]]
                share[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(reach) - len(gone), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == f for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone), f,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = share[out[key][-1]]
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("labels", [LABELS, []])
def test_filter_audit(spark, docs, labels):
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("p"))
    found = filters.audit(docs, known).select("part", "filter_order", "step", *filters.COUNTS).collect()
    assert sorted(map(tuple, found)) == brute_audit(ROWS, labels)
    assert len(found) == 600 * 4


def test_lattice_has_eighty_edges(spark):
    edges = filters.on_edges(spark.range(1)).collect()
    assert len(edges) == 80 and len({(e.applied, e.next) for e in edges}) == 80
    assert len(filters.steps()) == 600 and {(a, f) for _, _, a, f in filters.steps()} == {(e.applied, e.next) for e in edges}
    assert sum(e.paths for e in edges) == 600


def test_filter_audit_of_nothing(docs, spark):
    assert filters.audit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def brute_model(rows):
    """Context-tree weighting by its definition: recursive, with exact counts."""
    depth, taught = contexts.DEPTH, defaultdict(lambda: [0, 0])
    text_of = lambda t: b" ".join((t or "").encode().translate(contexts.LOWER).split()) + b"\n"
    teach = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0

    def path(text, at, bit):
        """Keys of the nodes from the root down, and the decision."""
        context = (b"\n" * depth + text)[at : at + depth][::-1]
        return [(context[:d], bit, text[at] >> (8 - bit)) for d in range(depth + 1)], text[at] >> (7 - bit) & 1

    for i, text, *_ in rows:
        if teach(i):
            text = text_of(text)
            for at in range(len(text)):
                for bit in range(8):
                    keys, x = path(text, at, bit)
                    for k in keys:
                        taught[k][x] += 1
    children = defaultdict(set)
    for context, bit, before in taught:
        if context:
            children[context[:-1], bit, before].add((context, bit, before))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    logs, weight = {}, {}
    for k in sorted(taught, key=lambda k: -len(k[0])):
        own = kt(*taught[k])
        if len(k[0]) == depth:
            logs[k], weight[k] = own, 1.0
        else:
            below = sum(logs[c] for c in children[k])
            high = max(own, below)
            logs[k] = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
            weight[k] = math.exp(own - math.log(2) - logs[k])

    def chance(keys):
        here, rest = keys[0], keys[1:]
        if here not in taught:
            return 0.5
        own = (taught[here][1] + 0.5) / (sum(taught[here]) + 1)
        return own if not rest or rest[0] not in taught else weight[here] * own + (1 - weight[here]) * chance(rest)

    words = Counter(w for i, t, *_ in rows if teach(i) for w in [*text_of(t).split(), b"\n"])
    total, different = sum(words.values()), len(words)
    out = []
    for i, text, *_ in rows:
        text = text_of(text)
        own = [*text.split(), b"\n"]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (different + 1))) for w in own)
        model = 0.0
        for at in range(len(text)):
            for bit in range(8):
                keys, x = path(text, at, bit)
                p = chance(keys)
                model += math.log10(p if x else 1 - p)
        out.append((i, not teach(i), len(own), sum(words[w] > 0 for w in own), total, base, model))
    return sorted(out, key=str)


def test_held_out_ids_of_the_fixture():
    assert [i for i, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 10 == 0], "some row must be held out"


@pytest.mark.parametrize("block, shard, piece", [(contexts.BLOCK, contexts.SHARD, contexts.PIECE), (700, 300, 64)])
def test_context_trees(docs, monkeypatch, block, shard, piece):
    monkeypatch.setattr(contexts, "BLOCK", block)
    monkeypatch.setattr(contexts, "SETTLED", block // 4)
    monkeypatch.setattr(contexts, "SHARD", shard)
    monkeypatch.setattr(contexts, "PIECE", piece)
    found = sorted((tuple(r)[:7] for r in contexts.score(docs).collect()), key=str)
    want = brute_model(ROWS)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-7)  # logs travel as 32-bit floats


def test_context_trees_without_teaching(spark):
    i = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = spark.createDataFrame([(i, "ab", "en", "s")], SCHEMA)
    r = contexts.score(rows).first()
    assert r.held_out and r.train_tokens == 0 and r.base_score == 0 and math.isclose(r.score, 24 * math.log10(0.5), rel_tol=1e-7) and math.isclose(r.bits_per_byte, 8, rel_tol=1e-7)
    assert contexts.score(rows.limit(0)).count() == 0


def test_probabilities_of_the_next_byte_sum_to_one():
    keys, n = np.unique(contexts.grams(LONG.encode() + b"\n"), return_counts=True)
    tree = contexts.Subtrees(keys, n.astype(float))
    two = tree.above(keys, n.astype(float)).groupby("node").sum().reset_index()
    w, p, log = contexts.weighted(two.zeros.to_numpy(), two.ones.to_numpy(), two.log.to_numpy())
    node = two.node.to_numpy().astype(contexts.U)
    one = two.assign(node=contexts.up(node), log=log).groupby("node").sum().reset_index()
    top = contexts.Top.of(*[one[c].to_numpy() for c in ("node", "zeros", "ones", "log")])
    mixed, left = top.through(contexts.up(node))
    known = two.assign(mixed=mixed + left * w * p, left=left * (1 - w), stop=mixed + left * p).sort_values("node")
    for context in (b"the lazy", b"e quick ", b"zzzzzz", b"qqthe "):
        last = np.array([contexts.grams(context + bytes([x]))[-1] for x in range(256)], contexts.U)
        assert math.isclose((10 ** tree.log10(last, top, known)).sum(), 1, rel_tol=1e-9)


def test_very_long_text_in_the_model(spark):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 250_000))
    r = {x.doc_id: x for x in contexts.score(spark.createDataFrame([(1, text, "en", "s"), (2, "alpha beta", "en", "s")], SCHEMA)).collect()}
    assert r[1].n_tokens == 250_001 and r[1].n_bytes == len(text) + 1
    assert r[1].bits_per_byte < 2.2 * 250_000 / len(text)


def brute_divergence(rows, least_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        held = Counter(t for *_, ts in mine for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= least_docs)
        counts = {s: Counter(t for _, g, ts in mine if g == s for t in ts) for s in {x[1] for x in mine}}
        whole = Counter(t for *_, ts in mine for t in ts)
        total = lambda c: sum(c[t] for t in kept)
        p = lambda c, t: 1 + (10**9 * (c[t] + 1)) // (total(c) + len(kept))
        f = lambda a, b: math.floor(Fraction((a - b) ** 2, b))
        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            found = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("least_docs, top", [(3, 200), (1, 200), (1, 3), (2, 1), (99, 5)])
def test_divergence(docs, least_docs, top):
    found = divergence.audit(docs, least_docs, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == brute_divergence(ROWS, least_docs, top)


def test_divergence_of_many_buckets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{'abcdefghij'[int(x) % 10]}{'abcdefghij'[int(x) // 10 % 10]}" for x in rng.zipf(1.4, 150)), "en", f"s{i % 3}") for i in range(40)]
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), 1, 4)
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 1, 4)
    assert divergence.audit(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
