"""What the operators of this subpackage share: tables, scratch space, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: a bound on what a Python worker holds at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder. Where that is
    unset, a session on one machine (tests) gets a temporary folder; any other
    master is an error, since its executors see no local folder of the driver."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        here = tempfile.mkdtemp(prefix="loomdex-")
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        base = "file://" + here
        sc.setCheckpointDir(base)
    return f"{base}/loomdex-{uuid.uuid4().hex}"


#: Tables of `written` that nobody has released yet, in order.
_HELD: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark)
    _HELD[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more; others are left."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path is not None:
            _HELD.pop(path, None)
            remove(df.sparkSession, path)


def held() -> set[str]:
    """The tables that are held now; see `tidy`."""
    return set(_HELD)


def tidy(before: set[str], *keep: DataFrame) -> None:
    """Delete what was written after `before` was taken, but for `keep`: for callers
    that have written what they made of it."""
    stay = before | {getattr(df, "_written_at", "") for df in keep}
    for path, spark in [(p, s) for p, s in _HELD.items() if p not in stay]:
        del _HELD[path]
        remove(spark, path)


@atexit.register
def _tidy_at_exit() -> None:
    """Results that were handed out lazily read these tables until the session ends."""
    for path, spark in list(_HELD.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended already
            return


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch, dict], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """mapInArrow over small batches; `fn` sees one batch and a dict that lasts
    for the task, and may return None. The session bounds what arrives at once
    (rows and bytes); slices of BATCH_ROWS bound what `fn` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(at, BATCH_ROWS), state)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Rows of a key from which it is joined by broadcast, and most keys joined so.
OFTEN, MANY = 1000, 50_000


def spread_left(rows: DataFrame, table: DataFrame, on: tuple[str, str], count: str, salt: str, often: int = OFTEN) -> DataFrame:
    """`rows` left joined with `table`, which has one row a key (two longs) and in
    `count` how many rows the key has. Keys of very many rows, MANY keys at most,
    meet them by broadcast; the rows are then dealt by `salt`, so that none of these
    keys fills a task of the other keys' join."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    big = F.col(count) > max(often, total // MANY)
    values = [c for c in table.columns if c not in on]
    one, two = on
    named = lambda part, tag: part.select(F.col(one).alias("key_1"), F.col(two).alias("key_2"), *[F.col(v).alias(f"{tag}_{v}") for v in values])
    met = rows.join(F.broadcast(named(table.where(big), "hot")), (F.col(one) == F.col("key_1")) & (F.col(two) == F.col("key_2")), "left").drop("key_1", "key_2")
    met = met.withColumn("dealt", F.when(F.col(f"hot_{count}").isNotNull(), F.xxhash64(salt, one)).otherwise(F.col(one)))
    both = met.join(named(table.where(~big), "own"), (F.col("dealt") == F.col("key_1")) & (F.col(two) == F.col("key_2")), "left")
    return both.select(*rows.columns, *[F.coalesce(f"hot_{v}", f"own_{v}").alias(v) for v in values])


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and `more` columns."""
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), *more
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def shards_for(df_bytes: float, each: float = 24e6) -> int:
    """How many shards keep each at about `each` bytes."""
    return max(8, int(df_bytes / each) + 1)
