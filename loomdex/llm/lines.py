"""Reversible line dedup.

State: an exact reference-count table (128-bit key digest, documents that hold
the key, the largest doc_id holding it), cut into shards by digest, and one
cuckoo filter per shard that holds the digests of the repeated keys. A line is
first asked of the filters; what they pass is joined with the exact table, so a
false positive costs a row and never a line. Deleting documents lowers the
counts; a key that falls below the threshold leaves its filter again, so an
insertion followed by the deletion of the same documents gives the old state.

The filters travel to the mappers only while all of them together are below
FILTER_BYTES (about 28 million repeated keys); beyond that they stay stored and
every long line goes to the exact join, which needs no filter to be right. A key
that very many documents hold is not one task's work: keys with more than HOT
references (more, if that were more than HOT_KEYS keys) meet their lines by
broadcast, the others by shuffle.

Defined cases: a null or empty text is one empty line; every row counts as a
document, repeated rows included (and so in the SQL beside the query); rows with
the largest doc_id of a key all keep its lines; a null doc_id is smaller than any
other; further columns are kept by `apply`, but those named as its counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, mix64, table, written

STRIP = " \t\n\x0b\x0c\r"
FILTER_BYTES = 64 << 20
#: Keys with more references than HOT, and at most HOT_KEYS of them, are joined by broadcast.
HOT, HOT_KEYS = 10_000, 50_000
KEYS_PER_SHARD = 200_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints, two buckets for each digest."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        n = 1
        while n * 4 * 0.84 < max(capacity, 1):
            n *= 2
        self.mask = np.uint64((n if slots is None else len(slots)) - 1)
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else slots

    @classmethod
    def load(cls, payload: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(payload, np.uint16).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (h2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1  # 0 is a free slot
        one = mix64(h1.astype(np.uint64)) & self.mask
        return prints, one, one ^ (mix64(prints.astype(np.uint64)) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(h1, h2)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if a fingerprint found no place; a larger filter is needed."""
        prints, one, two = (x.tolist() for x in self.places(h1, h2))
        jump = np.uint64(0)
        for f, a, b in zip(prints, one, two, strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = f
                    break
            else:
                for kick in range(500):
                    slot = (f + kick) % 4
                    f, self.slots[b, slot] = int(self.slots[b, slot]), f
                    jump = mix64(np.array([f], np.uint64))[0] & self.mask
                    b = int(np.uint64(b) ^ jump)
                    free = np.flatnonzero(self.slots[b] == 0)
                    if len(free):
                        self.slots[b, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only for digests that were inserted."""
        prints, one, two = (x.tolist() for x in self.places(h1, h2))
        for f, a, b in zip(prints, one, two, strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.slots[at] == f)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break


def built(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    size = len(h1)
    while True:
        made = CuckooFilter(size)
        if made.insert(h1, h2):
            return made
        size = max(8, size * 2)


def line_keys(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """Digest of each long enough key: the numbers of its lines."""
    import xxhash

    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.split("\n")):
        key = line.strip(STRIP)
        if len(key) >= min_chars:
            # bytes.lower changes A-Z alone
            found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(number)
    return found


def _row(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("row"), text.alias("text"))


def _lines(docs: DataFrame, min_chars: int, filters: dict[int, bytes] | None = None, shards: int = 1) -> DataFrame:
    """doc_id, row, h1, h2, numbers: a row for each key that `filters` pass."""
    shared = None if filters is None else docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        places, digests, numbers = [], [], []
        for at, text in enumerate(batch.column("text").to_pylist()):
            for digest, held in line_keys(text, min_chars).items():
                places.append(at)
                digests.append(digest)
                numbers.append(held)
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = np.array(places, np.int64)
        if shared is not None and len(h):
            if not state:
                state |= {k: CuckooFilter.load(v) for k, v in shared.value.items()}
            home, passed = h[:, 0] % shards, np.zeros(len(h), bool)
            for shard in np.unique(home).tolist():
                if shard in state:
                    mine = home == shard
                    passed[mine] = state[shard].contains(h[mine, 0], h[mine, 1])
            h, at, numbers = h[passed], at[passed], [x for x, ok in zip(numbers, passed, strict=True) if ok]
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(numbers, pa.list_(pa.int32()))],
            ["doc_id", "row", "h1", "h2", "numbers"],
        )

    return arrow_map(_row(docs), run, "doc_id bigint, row bigint, h1 bigint, h2 bigint, numbers array<int>")


@dataclass
class LineIndex:
    """refs: h1, h2, refs, holder. filters: shard, payload."""

    refs: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> LineIndex:
        refs = written(_counted(docs, min_chars))
        return cls._with_filters(refs, min_docs, min_chars)

    @classmethod
    def _with_filters(cls, refs: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        hot = refs.where(F.col("refs") >= min_docs)
        shards = int(hot.count() / KEYS_PER_SHARD) + 1
        made = cls(refs, refs, min_docs, min_chars, shards)
        sharded = made.repeated().withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

        def fill(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            keys = keys.sort_values(["h1", "h2"])
            return pd.DataFrame({"shard": [key[0]], "payload": [built(keys.h1.to_numpy(), keys.h2.to_numpy()).dump()]})

        made.filters = written(sharded.groupBy("shard").applyInPandas(fill, "shard int, payload binary"))
        return made

    def repeated(self, least: int | None = None) -> DataFrame:
        return self.refs.where(F.col("refs") >= (least or self.min_docs)).select("h1", "h2", "holder")

    def _changed(self, refs: DataFrame) -> LineIndex:
        """Only keys that cross the threshold enter or leave their filter."""
        refs = written(refs)
        old, new = self.repeated(), refs.where(F.col("refs") >= self.min_docs).select("h1", "h2")
        moves = (
            new.join(old, ["h1", "h2"], "left_anti").withColumn("step", F.lit(1))
            .unionByName(old.drop("holder").join(new, ["h1", "h2"], "left_anti").withColumn("step", F.lit(-1)))
            .withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))
        )
        shards_now = new.count() / KEYS_PER_SHARD
        if shards_now > 2 * self.shards:
            return LineIndex._with_filters(refs, self.min_docs, self.min_chars)
        all_keys = new.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int")).withColumn("step", F.lit(0))

        def move(key: tuple, stored: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            keys = keys.sort_values(["h1", "h2"])
            held = CuckooFilter.load(stored.payload.iloc[0]) if len(stored) else CuckooFilter(8)
            out, into = keys[keys.step == -1], keys[keys.step == 1]
            held.delete(out.h1.to_numpy(), out.h2.to_numpy())
            if not held.insert(into.h1.to_numpy(), into.h2.to_numpy()):
                stay = keys[keys.step == 0]  # all keys after the change
                held = built(stay.h1.to_numpy(), stay.h2.to_numpy())
            return pd.DataFrame({"shard": [key[0]], "payload": [held.dump()]})

        filters = written(
            self.filters.groupBy("shard").cogroup(moves.unionByName(all_keys).groupBy("shard"))
            .applyInPandas(move, "shard int, payload binary")
        )
        return LineIndex(refs, filters, self.min_docs, self.min_chars, self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        both = self.refs.unionByName(_counted(docs, self.min_chars))
        return self._changed(both.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.max("holder").alias("holder")))

    def delete(self, docs: DataFrame, remaining: DataFrame) -> LineIndex:
        """`docs`: documents that were inserted; `remaining`: those that stay, read
        only to find the next holder of keys whose holder goes."""
        gone = _counted(docs, self.min_chars).select("h1", "h2", F.col("refs").alias("less"), F.col("holder").alias("left_by"))
        left = (
            self.refs.join(gone, ["h1", "h2"], "left")
            .withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0)))
            .where("refs > 0")
        )
        lost = left.where(F.col("left_by").eqNullSafe(F.col("holder")) & F.col("less").isNotNull())
        heirs = (
            _lines(remaining, self.min_chars).join(lost.select("h1", "h2"), ["h1", "h2"], "left_semi")
            .groupBy("h1", "h2").agg(F.max("doc_id").alias("heir"))
        )
        is_lost = F.col("left_by").eqNullSafe(F.col("holder")) & F.col("less").isNotNull()
        return self._changed(
            left.join(heirs, ["h1", "h2"], "left")
            .select("h1", "h2", "refs", F.when(is_lost, F.col("heir")).otherwise(F.col("holder")).alias("holder"))
        )

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc_id, row, drop (array of line numbers) of documents that lose lines."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
        filters = {r.shard: bytes(r.payload) for r in self.filters.collect()} if size <= FILTER_BYTES else None
        asked = written(_lines(docs, self.min_chars, filters, self.shards))
        exact, met = self.repeated(), self._hot()
        lost = asked.join(exact, ["h1", "h2"])
        if met is not None:
            often = F.broadcast(met)
            lost = asked.join(often, ["h1", "h2"]).unionByName(
                asked.join(often.select("h1", "h2"), ["h1", "h2"], "left_anti").join(exact, ["h1", "h2"])
            )
        lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        return lost.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("drop"))

    def _hot(self) -> DataFrame | None:
        """h1, h2, holder of the keys that too many lines hold for one task: at
        most HOT_KEYS rows, since no more keys can have that share of all references."""
        total = self.refs.where(F.col("refs") >= max(HOT, self.min_docs)).agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
        least = max(HOT, total // HOT_KEYS)
        return self.repeated(least + 1) if total else None

    def apply(self, docs: DataFrame, counts: bool = True) -> DataFrame:
        """Every row of `docs` with `text` rewritten; with `counts`, n_lines and
        n_dropped are added in place of input columns with these names."""
        own = {c: f"lines_{c}" + "_" * sum(x.startswith(f"lines_{c}") for x in docs.columns) for c in ("id", "row", "drop", "key")}
        drops = self.drops(docs).select(F.col("doc_id").alias(own["id"]), F.col("row").alias(own["row"]), F.col("drop").alias(own["drop"]))
        text = F.coalesce("text", F.lit(""))
        whole = docs.withColumn(own["key"], F.xxhash64(text))
        joined = whole.join(
            drops, whole.doc_id.cast("bigint").eqNullSafe(drops[own["id"]]) & (whole[own["key"]] == drops[own["row"]]), "left"
        )
        lines, lost = F.split(text, "\n"), F.col(own["drop"])
        # The numbers of the lines that stay, by a hash set of those that go.
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
        n = F.when(F.col("text").isNull(), 1).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        added = [n.cast("bigint").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("bigint").alias("n_dropped")] if counts else []
        names = ("n_lines", "n_dropped") if counts else ()
        return joined.select(
            *[F.when(lost.isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in names], *added
        )


def _counted(docs: DataFrame, min_chars: int) -> DataFrame:
    return _lines(docs, min_chars).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("holder"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = LineIndex.build(docs, min_docs=5, min_chars=40).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op2_lines": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM rows),
keyed AS (
  SELECT r, doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
hot AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT r) >= 5),
judged AS (
  SELECT y.r, y.doc_id, y.n, y.line, hot.k IS NOT NULL AND y.doc_id IS DISTINCT FROM hot.holder AS gone
  FROM keyed y LEFT JOIN hot ON y.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
""",
}
