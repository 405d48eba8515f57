"""From raw documents to token ids: five stages, each written and read again.

Part of the training-data subpackage. Every stage works on all rows that its
predecessor kept and returns the columns of documents; the last returns ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import bpe, jaccard, lines, mixing, quality
from loomdex.llm.common import held, release, table, tidy, written


def _own(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null and empty texts
    have the score of no text at all; repeated rows go or stay together; without
    labels of both classes the share of good labels decides (0.5 without any, which
    rejects nothing); an empty table stays empty; further columns stay."""
    model = quality.fit(quality.teaching_rows(docs, table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that five documents share stay in the
    document with the largest doc_id; n_chars follows the text. Null texts become
    empty; every row is a document, rows that share the largest id all keep the
    line; no row goes; further columns stay."""
    out = lines.LineIndex.build(docs, min_docs=5, min_chars=40).apply(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays, once for each of
    its different texts. Texts without words link with nothing and stay, rows with
    a null doc_id too; further columns stay, of equal rows those of any one."""
    members = written(jaccard.link(docs).members)
    stay = members.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    key = _own(docs, "text_key")
    kept = jaccard.with_rows(docs, stay).withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Rows equal in doc_id,
    source and text take their copies together (further columns: those of the
    least of them); documents without words are not taken; null ids and sources
    are values like others; an empty table stays empty."""
    names = {c: _own(docs, f"mix_{c}") for c in ("id", "source", "row", "m", "total", "text", "least", "copy")}
    taken = mixing.shares(docs).where("total > 0")
    taken = taken.select(*[F.col(a).alias(names[b]) for a, b in (("doc_id", "id"), ("source", "source"), ("row", "row"), ("m", "m"), ("total", "total"))])
    keyed = docs.withColumn(names["text"], F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (
        keyed.doc_id.cast("bigint").eqNullSafe(F.col(names["id"])) & keyed.source.cast("string").eqNullSafe(F.col(names["source"]))
        & (F.col(names["text"]) == F.col(names["row"]))
    )
    repeated = taken.where(F.col(names["m"]) > 1)
    n = repeated.count()
    each = keyed.join(taken.where(F.col(names["m"]) == 1), same).select(*docs.columns, names["total"])
    if n:
        # The rows of a group are one row here, and its copies come from that.
        groups = keyed.join(F.broadcast(repeated) if n <= jaccard.SENT // 4 else repeated, same)
        groups = groups.groupBy(names["id"], names["source"], names["row"], names["total"]).agg(F.min(F.struct(*docs.columns)).alias(names["least"]))
        each = each.unionByName(groups.select(f"{names['least']}.*", names["total"]))
    times = F.sequence(F.lit(1).cast("bigint"), F.col(names["total"]))
    return each.select(*docs.columns, F.explode(times).alias(names["copy"])).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, ids, n_tokens, and lang and source where
    they exist. Null and empty texts have no ids; repeated rows give equal results."""
    keep = tuple(c for c in ("lang", "source") if c in docs.columns)
    return bpe.encode(docs, *bpe.vocabulary(), keep=keep)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("mixing", mix_stage),
    ("tokens", token_stage),
]

#: The classifier, the entropy balance and the encoder have no SQL form; the
#: stages are tested against brute force and exact round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = held()
        after = written(stage(spark, docs, sf_dir))
        tidy(before, after)
        release(docs)
        docs = after
    return docs
