"""The stages on a small table, in order, without writing between them."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_operators import brute_classes, brute_lines, brute_sets

import corpus_pipeline
from loomdex.llm import bpe, quality
from loomdex.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "quality":
            assert 0.6 * before < docs.count() < before
    assert docs.select("doc_id").distinct().count() <= before
    tokens = corpus_pipeline.token_stage(spark, docs, SF)
    assert tokens.count() == docs.count() and tokens.where("n_tokens <> size(ids)").count() == 0


def stage_rows():
    rng = random.Random(4)
    base, shared = [f"w{rng.randrange(300)}" for _ in range(70)], "This line is held by many of the documents and by far too many of them."
    rows = [(None, "no id here", "en", "s1"), (200, None, "fr", "s2"), (201, "", "en", None), (202, "one two", "de", "s3"), (203, "one  TWO", "de", "s3")]
    for i in range(100):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(40, 90))]
        if i % 4 == 1:
            words = ["".join(rng.choice("#$%&") for _ in range(6)) for _ in range(60)]
        elif i % 10 == 0:
            words = [f"z{rng.randrange(9)}" if rng.random() < 0.02 else w for w in base]
        rows.append((i, " ".join(words) + (f"\n{shared}\n" if i % 7 == 0 else ""), ("en", "fr")[i % 2], (None, "s1", "s2", "s3")[i % 4]))
    rows.append(rows[-2])
    return [(*r, len(r[1] or "")) for r in rows]


def brute_quality(rows, model):
    import zstandard

    def size(content, body):
        held = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
        packer = zstandard.ZstdCompressor(level=5, write_content_size=False, **held)
        return sum(len(packer.compress(body[k : k + 512])) for k in range(0, len(body), 512))

    for r in rows:
        body = (r[1] or "").encode()
        good, bad, none = (size(c, body) for c in (model.good, model.bad, b""))
        x = ((bad - good) / (bad + good), good / len(body), bad / len(body), none / len(body)) if body else (0.0, 1.0, 1.0, 1.0)
        if model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True)) >= 0:
            yield r


def brute_near(rows):
    sets = {r[0]: brute_sets(r[1]) for r in rows if r[0] is not None}
    least = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = min(least[i], least[j])
    return sorted({r for r in rows if r[0] is not None and least[r[0]] == r[0]}, key=str) + [r for r in rows if r[0] is None]


def agrees_with_brute_mix(rows, mixed):
    """Copies by source and size as brute force has them, dealt evenly inside."""
    classes, _ = brute_classes(rows)
    size, got, held = (lambda r: len((r[1] or "").split())), Counter(), Counter()
    for r, n in mixed.items():
        got[r[3], size(r)] += n
    for r in rows:
        held[r[3], size(r)] += 1
    assert +got == +Counter(classes)
    for r, m in Counter(rows).items():
        key = r[3], size(r)
        assert abs(mixed[r] - m * got[key] / held[key]) < 1


def test_every_stage_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rows, sf = stage_rows(), str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(100)], "doc_id bigint, quality int")
    labels.write.parquet(f"{sf}/labels.parquet")
    run = lambda stage: Counter(map(tuple, stage(spark, docs, sf).collect()))

    kept = run(corpus_pipeline.quality_stage)
    model = quality.fit(quality.teaching_rows(docs, labels))
    assert model.weights and kept == Counter(brute_quality(rows, model))
    assert {r[0] for r in kept if r[0] is not None and r[0] < 100} == {i for i in range(100) if i % 4 != 1}

    of = {r[0]: r[2:4] for r in rows}
    want = Counter((i, t, *of[i], len(t)) for i, t in brute_lines(rows, 5, 40))
    assert run(corpus_pipeline.line_stage) == want != Counter(rows)

    want = Counter(brute_near(rows))
    assert run(corpus_pipeline.near_stage) == want and len(want) < len(set(rows)) - 5

    agrees_with_brute_mix(rows, run(corpus_pipeline.mix_stage))
    thrice = rows + [rows[7]] * 30
    again = spark.createDataFrame(thrice, docs.schema)
    agrees_with_brute_mix(thrice, Counter(map(tuple, corpus_pipeline.mix_stage(spark, again, sf).collect())))

    ranks, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.token_stage(spark, docs, sf).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), lang, source) for i, t, lang, source, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.lang, r.source) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_take_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column and columns with the stages' own names."""
    docs = spark.createDataFrame(stage_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(None, None), (3, None)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = {c: F.lit(7) for c in ("n_lines", "n_dropped", "row", "total", "m", "mix_id", "mix_row", "text_key", "label", "features", "score", "copies")}
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        wide = stage(spark, docs.withColumns(clash), str(tmp_path))
        assert wide.columns == docs.withColumns(clash).columns and wide.count() > 0, name
        assert {tuple(r)[:1] for r in stage(spark, nothing, str(tmp_path)).collect()} <= {(None,)}, name
    assert corpus_pipeline.token_stage(spark, nothing, str(tmp_path)).count() == 3
