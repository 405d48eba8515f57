"""Streaming face of the window upsert: the state is a store of segments by key, so
each micro-batch writes the rows that it changes and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.ingest import _judged, apply_changes, record_store
from loomdex.sources.segments import BROADCAST


def newest_reliable(batch: DataFrame) -> DataFrame:
    """One revision of each id of a batch: the last update among those whose clock
    holds (not after their own observation), else the last observed."""
    sure = F.coalesce(F.col("updated") <= F.col("observed"), F.col("updated").isNull())
    order = Window.partitionBy("source", "id").orderBy(F.desc(sure), F.desc(F.when(sure, F.col("updated"))), F.desc("observed"), F.desc("ts"), F.desc("body"))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """stream: source, id, body, updated, observed, ts. A micro-batch meets the stored
    rows of its own keys, and commits a segment of the rows that become others; one
    that is run again finds its number in the commit and changes nothing."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        kept = record_store(spark, path)
        held = kept.head()
        if held is not None and held["note"].get("epoch", -1) >= epoch:
            return
        batch = newest_reliable(batch).persist()
        try:
            keys = batch.select("source", "id")
            few = batch.count() <= BROADCAST
            mine = batch.limit(0)
            if held is not None:
                mine = kept.table("records", held).select(*batch.columns).join(F.broadcast(keys) if few else keys, ["source", "id"], "left_semi")
            apply_changes(spark, path, _judged(mine, batch, False), {"epoch": epoch})
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
