"""Small cases for every operator, against brute force where it is short."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import bpe, jaccard, lines, minhash, mixing, nearest, quality, sharding, suffixes, warc

LONG = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest " * 4
ROWS = [
    (0, None, None, "s1"), (1, "", "en", "s1"), (2, LONG, "en", None), (3, LONG, "en", "s1"), (3, LONG, "en", "s1"),
    (4, LONG.replace("lazy", "LAZY"), "en", "s2"), (5, "one two", "fr", "s2"), (6, "one  TWO", "fr", "s2"),
    (7, " \t\n\n", None, "s3"), (None, "no id here", "en", "s3"), (8, "x" * 5000 + LONG, "en", "s1"), (9, "é日本\n" + LONG, "de", "s1"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"key": F.lit(1), "n": F.lit(2), "shard": F.lit("x"), "label": F.lit(0), "row": F.lit(9)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_equals_the_library(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, pattern)
    for _, text, *_ in ROWS:
        assert list(codec.encode(text or "")) == library.encode_ordinary(text or "")
    found = bpe.round_trip(docs, ranks, pattern).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert sorted(r.decoded_sha256 for r in found) == want
    assert bpe.round_trip(empty, ranks, pattern).count() == 0
    again = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()
    assert sorted(bytes(r.body) for r in again) == sorted((t or "").encode() for _, t, *_ in ROWS)


def brute_lines(rows, min_docs, min_chars):
    held = {}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).encode().lower()
    for i, (doc, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k.decode()) >= min_chars:
                held.setdefault(k, {})[i] = -1 if doc is None else doc
    hot = {k: max(v.values()) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc, text, *_ in rows:
        kept = [x for x in (text or "").split("\n") if hot.get(key(x), -1 if doc is None else doc) == (-1 if doc is None else doc)]
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(docs, empty):
    got = lines.LineIndex.build(docs, 3, 40).apply(docs).select("doc_id", "text").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == brute_lines(ROWS, 3, 40)
    assert lines.LineIndex.build(empty, 3, 40).apply(empty).count() == 0


def test_lines_keep_columns_with_the_names_of_counts(docs, monkeypatch):
    odd = docs.withColumns({"n_lines": F.lit("mine"), "n_dropped": F.lit("too"), "lines_id": F.lit(1)})
    monkeypatch.setattr(lines, "HOT", 1)
    index = lines.LineIndex.build(odd, 3, 40)
    plain, counted = index.apply(odd, counts=False), index.apply(odd)
    assert plain.columns == odd.columns and {r.n_lines for r in plain.collect()} == {"mine"}
    assert len(counted.columns) == len(odd.columns) and {r.n_lines for r in counted.where("doc_id = 9").collect()} == {2}
    assert sorted([(r.doc_id, r.text) for r in plain.collect()], key=str) == brute_lines(ROWS, 3, 40)


def test_line_index_is_reversible(docs):
    some, rest = docs.where("doc_id < 4"), docs.where("doc_id >= 4")
    index = lines.LineIndex.build(some, 3, 40)
    both = index.insert(rest)
    state = lambda x: sorted(map(tuple, x.refs.select("h1", "h2", "refs", "holder").collect()))
    assert state(both) == state(lines.LineIndex.build(docs.where("doc_id is not null"), 3, 40))
    assert state(both.delete(rest, some)) == state(index)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**62), 2**62, (3000, 2))
    held = lines.built(h[:, 0], h[:, 1])
    assert held.contains(h[:, 0], h[:, 1]).all()
    other = rng.integers(-(2**62), 2**62, (3000, 2))
    assert held.contains(other[:, 0], other[:, 1]).mean() < 0.01
    held.delete(h[:1500, 0], h[:1500, 1])
    assert held.contains(h[1500:, 0], h[1500:, 1]).all() and held.contains(h[:1500, 0], h[:1500, 1]).mean() < 0.02


def _h64(*values):
    """Spark's xxhash64: each value's hash is the seed of the next one."""
    import xxhash

    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8 if abs(v) >= 1 << 31 or isinstance(v, Long) else 4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


class Long(int):
    """A number that Spark holds in eight bytes."""


def brute_signature(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(words) - 2, min(len(words), 1))
    turns, hashed = {}, []
    for at in range(n):
        kmer = _h64(*words[at : at + 3]) & 0xFFFFFFFF
        turns[kmer] = turn = turns.get(kmer, -1) + 1
        hashed.append((_h64(Long(kmer), turn) & 0xFFFFFFFF, at))
    out = []
    for cell in range(64):
        least = sorted((h, at) for h, at in hashed if h >> 26 == cell)[:2]
        if least:
            pair = [Long(h) for h, _ in sorted(least, key=lambda x: x[1])]
            out.append(cell << 26 | _h64(*pair) & ((1 << 26) - 1))
    return out


def brute_fingerprints(rows):
    import xxhash

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    out = []
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        sig, other, then = brute_signature(text), brute_signature(edited), brute_signature(after)
        near = lambda x, y: len(set(x) & set(y)) / len({v >> 26 for v in x + y}) if x or y else 1.0
        hexed = lambda x: "".join(f"{v:08x}" for v in x)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(sig), hexed(other), near(sig, other), near(sig, then)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_in_cell", [minhash.CELL_ROWS, 2])
def test_minhash(spark, docs, empty, monkeypatch, rows_in_cell):
    monkeypatch.setattr(minhash, "CELL_ROWS", rows_in_cell)
    got = [tuple(r) for r in minhash.fingerprints(docs).collect()]
    assert sorted(got, key=str) == brute_fingerprints(ROWS)
    by = {r[0]: r for r in got}
    assert by[2][3] == by[3][3] != by[4][3] and by[0][3] == "" and minhash.fingerprints(empty).count() == 0
    # Ids far apart, and one id that very many rows share.
    far = [(i if i is None else 77 if i % 2 else i * 2**55 - 2**58, t) for i, t, *_ in ROWS] + [(77, f"w{k} x y z") for k in range(30)] + [(k * 2**50, "a b c d e") for k in range(40)]
    got = [tuple(r) for r in minhash.fingerprints(spark.createDataFrame(far, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == brute_fingerprints(far)


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    taught = [(i, " ".join(rng.choice(words) for _ in range(60)) if i % 2 else " ".join(rng.choice("#$%") * 5 for _ in range(60)), i % 2) for i in range(200)]
    model = quality.fit(spark.createDataFrame(taught, "doc_id bigint, text string, quality int"))
    found = {r.doc_id: r.score for r in quality.score(spark.createDataFrame([(1, taught[1][1]), (2, taught[2][1])], "doc_id bigint, text string"), model).collect()}
    assert found[1] > 0.5 > found[2]
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(empty, model).count() == 0
    untaught = quality.fit(spark.createDataFrame([], "doc_id bigint, text string, quality int"))
    assert {r.score for r in quality.score(docs, untaught).collect()} == {0.5}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(range(0, 400, 50))
    hit = 0
    for q, found in got.items():
        s = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        s[q] = -9
        s = np.round(s, 12)
        hit += len(set(found.values()) & set(np.lexsort((np.arange(400), -s))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(got) and [got[50][k] for k in range(1, 6)] == [51, 52, 53, 54, 55]
    assert nearest.search(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") >= 0).count() == 0


def test_nearest_odd_rows(spark):
    rows = [(0, [2.0**660, 2.0**660, 0.0]), (1, [2.0**-660, 2.0**-660, 0.0]), (2, [1.0, 0.9, 0.0]), (3, [0.0, 0.0, 1.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (50, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0])]
    found = nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    assert [got[0, k][0] for k in (1, 2, 3, 4)] == [1, 50, 2, 3] and [got[50, k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert abs(got[0, 1][1] - 1) < 1e-12 and len(got) == 8


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(8)
    x, y = nearest.unit(rng.standard_normal((2000, 64))), nearest.unit(rng.standard_normal((1, 64)))[0]
    far = ((x - y) ** 2).sum(1)
    found, kth = nearest.scan(x, y, 6)
    assert kth == pytest.approx(np.sort(far)[5]) and len(found) < 1500
    again, same = nearest.scan(x, y, 6, kth)
    assert set(np.argsort(far)[:6]) <= set(again) and len(again) < len(found) and same == kth


def test_nearest_keeps_its_recall_with_many_lists(spark, monkeypatch):
    fit, x = nearest.fit, np.random.default_rng(2).standard_normal((3000, 64))
    monkeypatch.setattr(nearest, "fit", lambda entries, n, d: fit(entries, 30 * n, d))  # 300 lists
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest.search(rows, F.col("vec_id") % 30 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 30):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[q] & set(np.argpartition(-s, 5)[:5].tolist()))
    assert hit >= 0.9 * 5 * len(got) and len(got) == 100


def test_warc(spark):
    big = "<html>" + "word " * 50 + "\r\n\r\nWARC/1.1\r\n</html>"
    pages = [(1, "https://a.example/x", big), (2, "http://b.example/y?q=1", big), (3, None, None), (4, "https://a.example/x", "tiny"), (5, "u\r\nv", "tiny"), (6, "https://a.example/é", "é" * 200)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = warc.archive(frame).collect()
    got = {r.page_id: r for r in rows}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), **{k: ("response", None) for k in (3, 4, 5, 6)}}
    for k, _, html in pages:
        body = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert [r.url_key for r in rows] == sorted(r.url_key for r in rows)
    assert warc.archive(frame.limit(0)).count() == 0


def test_warc_index_finds_records_alone(spark, tmp_path, monkeypatch):
    import gzip

    pages = [(i % 40, f"http://h{i % 7}.example/{i}", f"<p>{i}</p>" * (20_000 if i == 5 else 30)) for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    warc.write(frame, str(tmp_path / "w"), archive_bytes=2000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    rows = warc.merge(warc.runs(spark, str(tmp_path / "w")), 6).collect()
    assert len(rows) == 60 and len({r.run for r in rows}) > 3
    assert [(r.url_key, r.captured, r.page_id) for r in rows] == sorted((r.url_key, r.captured, r.page_id) for r in rows)
    for r in rows:
        held = open(r.run.removeprefix("file:"), "rb").read()
        heads, block = warc.record_at(held, r.record_offset, r.record_length)
        assert heads["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and gzip.decompress(held).count(heads["WARC-Target-URI"].encode()) >= 1
        assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest


def test_loser_tree():
    rng = random.Random(5)
    for k in range(0, 9):
        parts = [sorted(rng.randrange(50) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(p) for p in parts], lambda v: v)) == sorted(sum(parts, []))


def test_sharding(spark, docs, empty):
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").alias("source"))
    rows = sharding.shard(many, shards=7).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r.shard, []).append(r)
    assert set(sums) == set(range(7)) and len(rows) == 600
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in sums.values())
    totals = [sum(r["size"] for r in v) for v in sums.values()]
    assert max(totals) - min(totals) < 0.1 * sum(totals) / 7
    assert sharding.shard(docs, shards=5).count() == len(ROWS) and sharding.shard(empty).count() == 0


def test_sharding_keeps_equal_texts_together(spark):
    rows = [(None if i % 50 == 0 else i * 7919 % 100_003, f"text {i % 90} " * (1 + i % 5), ("en", None, "fr")[i % 3], f"s{i % 11}") for i in range(900)]
    rows += [(10**9 + i, "the very common one " * 20, "en", "s1") for i in range(900)] + [(5, "repeated row", "de", None)] * 40
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=6).collect()
    import zlib

    places, sums, slots = {}, {}, {}
    for r in found:
        places.setdefault(r.text_crc32, set()).add(r.shard)
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r)
    hot = zlib.crc32(("the very common one " * 20).encode())
    limit = sharding.WHOLE * sum(sums.values()) / 6
    for crc, held in places.items():
        if crc != hot and sum(r["size"] for r in found if r.text_crc32 == crc) <= limit:
            assert len(held) == 1
    assert len(found) == len(rows) and len(places[hot]) > 1 and max(sums.values()) < 1.1 * min(sums.values())
    for held in slots.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found) == want


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard(spark, empty, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    for i in range(20, 80):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    sets = {}
    for i, t in rows:
        sets[i] = brute_sets(t)
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    rows += [(500 + k, LONG) for k in range(5)] + [(None, LONG), (None, None)]
    for i, t in rows:
        if i is not None and i >= 500:
            sets[i], up[i] = brute_sets(t), root(2)
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "c1": F.lit(1), "label": F.lit(2), "copies": F.lit(0)})
    found = jaccard.link(odd).members.collect()
    assert sorted((r.n_shingles, r.component_id) for r in found if r.doc_id is None) == [(0, None), (len(brute_sets(LONG)), None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jaccard.link(empty).members.count() == 0


def brute_classes(rows):
    """Copies that all documents of a source and size take together."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s] for s in sources}
    total = [sum(sizes[s]) for s in sources]
    goals = mixing.targets(total, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(total))
    out = {}
    for s, goal, whole in zip(sources, goals, total, strict=True):
        mean = max(whole, 1) / len(sizes[s])
        rate = lambda lam, n: min(2.0, np.exp(min(700, lam * n / mean)))
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, n) * n for n in sizes[s]) < goal else (low, mid)
        debt = 0.0
        for n in sorted({n for n in sizes[s] if n}, reverse=True):
            held = sizes[s].count(n)
            want = debt + held * n * (2.0 if goal >= 2 * whole else rate(low, n))
            out[s, n] = min(2 * held, max(0, int(np.floor(want / n + 0.5))))
            debt = want - out[s, n] * n
    return out, dict(zip(sources, goals, strict=True))


MIXED = random.Random(9)
MANY = [(i, " ".join(["w"] * MIXED.choice([0, 1, 3, 5, 8, 40, 90])), "en", (None, "a", "b", "c", "d")[i % 5 if i % 3 else 1]) for i in range(400)] + [(7, "one two three", "en", "b")] * 50


@pytest.mark.parametrize(("part_rows", "rows"), [(mixing.PART_ROWS, ROWS), (3, MANY)])
def test_mixing(spark, monkeypatch, part_rows, rows):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    monkeypatch.setattr(mixing, "BLOCK", 50)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"s": F.lit(1), "part": F.lit(2), "m": F.lit(3), "total": F.lit("x")})
    found = mixing.shares(table).collect()
    got, of, taken = {}, {}, {}
    for r in found:
        got[r.source, r["size"]] = got.get((r.source, r["size"]), 0) + r.total
        of.setdefault((r.source, r["size"]), []).append(r)
        taken[r.source] = taken.get(r.source, 0) + r.total * r["size"]
    want, goals = brute_classes(rows)
    assert {k: v for k, v in got.items() if k[1]} == want and all(v == 0 for k, v in got.items() if not k[1])
    for key, held in of.items():
        share = got[key] / sum(r.m for r in held)
        assert all(abs(r.total - share * r.m) < 1 for r in held)
    for source, goal in goals.items():
        least = min([n for s, n in want if s == source], default=0)
        # A source of a few rows may have no small document left to take the rest.
        assert rows is ROWS or abs(taken[source] - goal) <= least / 2 + 1e-3 * goal
    each = mixing.mix(table).collect()
    assert len(each) == len(rows) and all(r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in each)
    # Another run, from its own files, gives the same.
    total = {}
    for r in each:
        total[r.doc_id, r["size"], r.row] = total.get((r.doc_id, r["size"], r.row), 0) + r.copies
    first = {}
    for r in found:
        first[r.doc_id, r["size"], r.row] = first.get((r.doc_id, r["size"], r.row), 0) + r.total
    assert total == first


def test_mixing_of_nothing(empty):
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.mix(empty).count() == 0


def test_the_dual_converges(spark):
    ratios, sizes = [0.1, 0.5, 0.99, 1.0, 1.3, 1.68, 1.7, 1.9, 1.999, 2.0], [(1, 500), (5, 300), (40, 100), (900, 20), (20_000, 1)]
    mean, whole = sum(n * m for n, m in sizes) / sum(m for _, m in sizes), sum(n * m for n, m in sizes)
    rows = spark.createDataFrame([(s, n / mean, n, m) for s in range(len(ratios)) for n, m in sizes], "s int, x double, size bigint, n bigint")
    lam, steps = mixing.solve(rows, {s: r * whole for s, r in enumerate(ratios)})
    for s, r in enumerate(ratios):
        got = sum(min(2, np.exp(min(700, lam[s] * n / mean))) * n * m for n, m in sizes)
        assert abs(got - r * whole) <= 1e-6 * r * whole
    assert steps < 40


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("hot", "chunk"), [(1, 1 << 22), (suffixes.HOT, 1 << 22), (1, 97), (suffixes.HOT, 300)])
def test_suffix_dedup(docs, empty, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "OFTEN", hot)
    width, seen, want = suffixes.WIDTH, {}, []
    bodies = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    for _, b in bodies:
        for k in range(len(b) - width + 1):
            seen[b[k : k + width]] = seen.get(b[k : k + width], 0) + 1
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in suffixes.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.dedup(empty).count() == 0


def test_minhash_deals_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_ROWS", 4)
    rows = [(None if i % 3 else i, f"word{i} and word{i % 7} then {i}", "en", "s") for i in range(90)] + [(500, f"same id {i} of many rows", "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("row"))
    sizes = keyed.select(minhash._cells(keyed).alias("cell"), "key").groupBy("cell", F.col("key").isNull().alias("none"), (F.col("key") == 500).alias("hot")).count().collect()
    assert sum(r["count"] for r in sizes if r.none) == 60 and max(r["count"] for r in sizes if r.none) <= 12
    assert max(r["count"] for r in sizes if r.hot) <= 12
    found = [tuple(r)[:7] for r in minhash.fingerprints(docs).collect()]
    assert sorted(found, key=str) == brute_fingerprints(rows)


def test_warc_of_one_payload_on_very_many_pages(spark, monkeypatch):
    body = "<p>" + "shared " * 30
    pages = spark.createDataFrame([(i if i else None, f"http://h/{i}", body if i % 3 else f"<p>{i % 2} " + "x" * 200) for i in range(60)], "page_id bigint, url string, html string")
    plain = sorted(map(tuple, warc.records(pages).select("page_id", "value").collect()), key=str)
    assert sorted(map(tuple, warc.records(pages, often=5).select("page_id", "value").collect()), key=str) == plain
    assert sum("WARC-Type: revisit" in v for _, v in plain) == 59 - 3


def test_columns_of_one_row_are_left_out():
    for f in ([], [5], [7, 1, 7, 9, 1, 3], [2, 2], [1 << 63, 4, (1 << 64) - 1, 1 << 63]):
        assert jaccard.repeated(np.array(f, np.uint64)).tolist() == [f.count(x) > 1 for x in f]


def test_scratch_is_given_back(spark):
    from loomdex.llm import common

    before = common.held()
    one, two = common.written(spark.range(3)), common.written(spark.range(4))
    assert len(common.held() - before) == 2
    common.tidy(before, two)
    assert common.held() - before == {two._written_at} and two.count() == 4
    common.release(two)
    assert common.held() == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(one._written_at)
