"""Placement of the k-d tree and scores of the classifier against plain loops."""

import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from loomdex.llm import quality, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute_shards(rows, shards):
    """The tree by sorted lists: widest dimension, weighted median by (place, checksum)."""
    size = lambda t: len((t or "").encode()) + 16
    total = sum(size(t) for _, t, *_ in rows)
    target = max(1, -(-total // shards))
    ids, sizes = [i for i, *_ in rows if i is not None], [size(t) for _, t, *_ in rows]
    low, width = min(ids), max(1, max(ids) - min(ids))
    small, steps = math.log2(min(sizes)), max(1e-9, math.log2(max(sizes)) - math.log2(min(sizes)))
    top = sharding.CELLS - 1

    def ranks(values):
        held = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
        return {None: 0, **{v: math.floor((n + 1) * top / max(1, len(held))) for n, v in enumerate(held)}}

    sources, langs = ranks(r[3] for r in rows), ranks(r[2] for r in rows)
    units = []
    for i, t, lang, source in rows:
        by_size = min(max(math.floor((math.log2(size(t)) - small) / steps * top), 0), top)
        by_id = 0 if i is None else min(math.floor((i - low) / width * top), top)
        crc = zlib.crc32((t or "").encode())
        units.append({"dims": (by_size, sources[source], langs[lang], by_id), "text": crc >> 16, "size": size(t), "row": (i, crc)})
    out = {}

    def reach(items, key, goal):
        """Value of `key` at which the running size reaches the goal, and the size before it."""
        run = 0
        for value in sorted({key(u) for u in items}):
            held = sum(u["size"] for u in items if key(u) == value)
            if run + held >= goal:
                return value, run, held
            run += held

    def split(items, leaves, first):
        if leaves == 1:
            out.update({u["row"]: first for u in items})
            return
        half = leaves // 2
        if not items:
            return
        spans = [max(u["dims"][d] for u in items) - min(u["dims"][d] for u in items) for d in range(4)]
        d = spans.index(max(spans))
        goal = sum(u["size"] for u in items) * half / leaves
        value, before, _ = reach(items, lambda u: u["dims"][d], goal)
        text, inner, held = reach([u for u in items if u["dims"][d] == value], lambda u: u["text"], goal - before)
        cut = (value, text + (goal - before - inner > held / 2))
        left = [u for u in items if (u["dims"][d], u["text"]) < cut]
        split(left, half, first)
        split([u for u in items if (u["dims"][d], u["text"]) >= cut], leaves - half, first + half)

    split(units, max(1, -(-total // target)), 0)
    return out


@pytest.mark.parametrize("seed, shards", [(1, 7), (2, 12), (3, 1)])
def test_placement_equals_a_plain_tree(spark, seed, shards):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i * 31]), f"text {i} " + "é" * rng.randrange(1, 400), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ß", None])) for i in range(250)]
    found = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=shards).collect()}
    assert found == brute_shards(rows, shards)


def brute_score(model, text):
    body, sums = (text or "").encode(), [0, 0, 0]
    for n, held in enumerate((model.good, model.bad, b"")):
        kind = {"dict_data": zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if held else {}
        for at in range(0, len(body), quality.PIECE):
            sums[n] += len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, **kind).compress(body[at : at + quality.PIECE]))
    good, bad, none = sums
    seen = [(bad - good) / (bad + good), good / len(body), bad / len(body), none / len(body)] if body else [0, 1, 1, 1]
    z = model.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(model.weights[1:], seen, model.mean, model.scale, strict=True))
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_scores_equal_a_plain_loop(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges"]) for _ in range(rng.randrange(5, 200)))
    bad = lambda: " ".join(rng.choice(["BUY", "now!!!", "$$$", "click", "###", "free"]) for _ in range(rng.randrange(5, 200)))
    rows = [(i, good() if i % 2 else bad(), "en", "s") for i in range(120)] + [(500, None, "en", "s"), (501, "", "en", "s"), (None, "the river", "en", "s"), (502, "x" * 300_000, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    model = quality.fit(quality.teaching_rows(docs, labels))
    assert model.good and model.bad and len(model.weights) == 5
    found = {(r.doc_id, r.score, r.predicted) for r in quality.score(docs, model).collect()}
    want = {(i, brute_score(model, t)) for i, t, *_ in rows}
    assert {(i, round(s, 9)) for i, s, _ in found} == {(i, round(s, 9)) for i, s in want}
    assert all(p == (s >= 0.5) for _, s, p in found)
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    # Rows that taught nothing are told apart too.
    own = {i: p for i, _, p in found if i is not None and i < 120 and held[i]}
    assert sum(p == i % 2 for i, p in own.items()) >= 0.9 * len(own)
