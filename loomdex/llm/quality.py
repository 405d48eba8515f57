"""Compression classifier.

Two zstandard dictionaries are built from labelled text: pieces of good
documents and pieces of bad ones. A text is cut into pieces of PIECE bytes, each
compressed with the good, the bad and no dictionary; the sums over the whole
text give the normalised difference (bad - good) / (bad + good) and the three
ratios to the text's length. A logistic model, fitted by Newton steps on
labelled rows that gave no dictionary piece, calibrates them to a score.

Bounds of the fit (parameters of `fit`): `pieces` dictionary pieces of SAMPLE
bytes for each class, `each` of them at most from one document, `rows` calibration
rows for each class. They are the smallest by hash, so a rerun fits the same model.
Scoring reads every row.

Defined cases: a null or empty text has the score the model gives to zero
difference and ratio one; without labelled rows of both classes the score is
the share of good rows (0.5 when there are none); rows with a null label do not
teach; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, table, texts, written

PIECE, SAMPLE, LEVEL = 512, 256, 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # intercept first; empty: constant score `prior`
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        z = (features - np.array(self.mean)) / np.array(self.scale)
        t = self.weights[0] + z @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


class Scales:
    """The three compressors of one model; made once in each task."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(content: bytes):
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False)

        self.good, self.bad, self.none = compressor(good), compressor(bad), compressor(b"")

    def features(self, body: bytes) -> tuple[float, float, float, float]:
        good = bad = none = 0
        for at in range(0, len(body), PIECE):
            piece = body[at : at + PIECE]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
            none += len(self.none.compress(piece))
        n = len(body)
        return ((bad - good) / (bad + good), good / n, bad / n, none / n) if n else (0.0, 1.0, 1.0, 1.0)


def _held(state: dict, good: bytes, bad: bytes) -> Scales:
    if not state:
        state["scales"] = Scales(good, bad)
    return state["scales"]


def _measured(docs: DataFrame, good: bytes, bad: bytes, column: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        scales = _held(state, *shared.value)
        rows = [scales.features(b) for b in batch.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column(column), pa.array([list(r) for r in rows], pa.list_(pa.float64()))],
            ["doc_id", column, "features"],
        )

    kind = docs.schema[column].dataType.simpleString()
    return arrow_map(texts(docs, column), run, f"doc_id bigint, `{column}` {kind}, features array<double>")


@dataclass(frozen=True)
class Teaching:
    """Texts and labels apart: rows are chosen by id and length, and only the
    chosen ids (bounded) meet the texts."""

    docs: DataFrame  # doc_id, text
    labels: DataFrame  # doc_id, quality


def _pieces(docs: DataFrame, rows: DataFrame, n: int, each: int) -> bytes:
    """The n pieces of smallest hash, at most `each` from a document. `rows` has
    the ids and sizes of the documents that may give pieces."""

    def cut(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        import xxhash

        keys, ids, places = [], [], []
        for doc_id, size in zip(batch.column("doc_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
            found = ((xxhash.xxh64_intdigest(f"{doc_id}/{at}") >> 1, at) for at in range(0, size, SAMPLE))
            for key, at in heapq.nsmallest(each, found):
                keys.append(key)
                ids.append(doc_id)
                places.append(at)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["key", "doc_id", "at"])

    best = arrow_map(rows.select("doc_id", "size"), cut, "key bigint, doc_id bigint, at int").distinct().orderBy("key", "doc_id", "at").limit(n)
    piece = F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.lit(SAMPLE)).alias("piece")
    found = docs.join(F.broadcast(best), "doc_id").select("key", piece).orderBy("key", "piece").limit(n)
    return b"".join(bytes(r.piece) for r in found.collect())


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, hold = np.zeros(a.shape[1]), ridge * len(y) * np.r_[0, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold + 1e-9), a.T @ (p - y) + hold * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(labelled: DataFrame | Teaching, pieces: int = 2048, rows: int = 3000, each: int = 8) -> Model:
    """`labelled`: doc_id, text, quality (1 good, 0 bad, null: ignored), together
    or as Teaching."""
    if isinstance(labelled, DataFrame):
        labelled = Teaching(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    docs = labelled.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = labelled.labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("turn")), F.lit(2))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    may = written(sizes.join(known, "doc_id").withColumn("turn", turn))
    counts = {r.quality: r["count"] for r in may.groupBy("quality").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = n_good / (n_good + n_bad) if counts else 0.5
    content = [_pieces(docs, may.where(f"quality = {q} and turn = 0"), pieces, each) for q in (1, 0)]
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("row"))
    taught = []
    for q in (1, 0):
        some = may.where(f"quality = {q} and turn = 1").select("doc_id", "quality").distinct().orderBy(order, "doc_id").limit(rows)
        found = _measured(docs.join(F.broadcast(some), "doc_id"), *content, "quality")
        taught.append(np.array([r.features for r in found.orderBy(order, "doc_id", "features").limit(rows).collect()], dtype=float).reshape(-1, 4))
    if not all(content) or min(map(len, taught)) < 2:
        return Model(*content, (), (), (), prior)
    x = np.concatenate(taught)
    y = np.r_[np.ones(len(taught[0])), np.zeros(len(taught[1]))]
    w, mean, scale = _newton(x, y)
    # The calibration rows are balanced by class as far as they go; the intercept
    # is moved back to the classes' shares among all labelled rows.
    w[0] += np.log(n_good / n_bad) - np.log(len(taught[0]) / len(taught[1]))
    return Model(*content, tuple(w), tuple(mean), tuple(scale), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        held = Model(*shared.value)
        scales = _held(state, held.good, held.bad)
        x = np.array([scales.features(b) for b in batch.column("body").to_pylist()], dtype=float).reshape(-1, 4)
        s = held.score(x)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
            ["doc_id", "score", "predicted"],
        )

    return arrow_map(texts(docs), run, "doc_id bigint, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all columns, whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        held = Model(*shared.value)
        scales = _held(state, held.good, held.bad)
        x = [scales.features((t or "").encode()) for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array(held.score(np.array(x, dtype=float).reshape(-1, 4)) >= 0.5))

    return arrow_map(docs, run, schema)


def teaching_rows(docs: DataFrame, labels: DataFrame) -> Teaching:
    """Documents with a label, without those held out: crc32(doc_id) mod 3 is 1."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    return Teaching(docs.select("doc_id", "text"), known)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(teaching_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
