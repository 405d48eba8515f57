"""Tables that follow change by change: immutable segments and marks of what is gone.

A store is a folder. A commit adds one segment (rows of new and changed owners in
all its tables) and one list of marks (owners whose rows in older segments no longer
count), so it writes as much as has changed. Readers take the segments of one commit
and leave out what is marked; nothing is rewritten in place. When FAN segments of a
size have come together they are merged into one without their dead rows, so there
are about FAN segments for each power of FAN.

A table with a key lies in folders by a hash of the key and in its order there, in
short pages: a lookup of some keys opens their folders and reads their pages. Each
segment chooses its number of folders by its rows. A `dealt` table stays with its owners
instead: nothing is shuffled by the key, each file is in its order, and a lookup reads
the key's pages of all files.

Every owned table has the column `owner`; the table `owners` (owner, path, digest and
what is summed over live owners) tells what a segment holds. Commits are numbered and
published by `sinks.publish`, which lets one of two writers win.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex import sinks

#: Segments of one size that are merged, and the size below which all are of one.
FAN, LEAST_BYTES = 4, 1 << 20
#: Marks that are broadcast, keys that are literals, tables that are written at once.
BROADCAST, LITERALS, WRITERS = 200_000, 1000, 8
#: Rows of a folder and of a page of a keyed table; most folders.
FOLDER_ROWS, PAGE_ROWS, FOLDERS = 100_000, 200, 4096
#: Rows of a page and about those of a file of a dealt table.
DEALT_PAGE, DEALT_ROWS = 2000, 1_500_000
#: A key with more than a folder's rows is dealt over several files by its owners.
FILE_ROWS = 20_000_000


def folder_of(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class Store:
    """`keys`: the key column of each table that has one; `unowned`: tables whose rows
    outlive their owners (vocabularies); `dealt`: tables with a key whose rows come in
    tasks of some owners each and are written so."""

    spark: SparkSession
    root: str
    keys: dict[str, str] = field(default_factory=dict)
    unowned: tuple[str, ...] = ()
    dealt: tuple[str, ...] = ()

    # --- what is committed ---

    def head(self) -> dict | None:
        return sinks.latest(self.spark, f"{self.root}/commits")

    def _head(self) -> dict:
        held = self.head()
        if held is None:
            raise LookupError(f"nothing is committed below {self.root}")
        return held

    def table(self, name: str, at: dict | None = None) -> DataFrame:
        """All live rows of a table."""
        return self._live_of(name, at or self._head())

    def _live_of(self, name: str, held: dict, where: Column | None = None) -> DataFrame:
        parts = [s for s in held["segments"] if name in s["tables"]]
        rows = self._read(held, parts, name, [f"{self.root}/{s['id']}/{name}" for s in parts])
        return self._live(rows if where is None else rows.where(where), held, name)

    def lookup(self, name: str, wanted: list[str], at: dict | None = None) -> DataFrame:
        """Live rows whose key is wanted: only their folders are opened. Many keys
        are joined with the whole table."""
        held, key = at or self._head(), self.keys[name]
        if len(wanted) > LITERALS:
            asked = self.spark.createDataFrame([(w,) for w in set(wanted)], f"{key} string")
            return self.table(name, held).join(F.broadcast(asked) if len(wanted) <= BROADCAST else asked, key, "left_semi")
        if name in self.dealt:
            return self._live_of(name, held, F.col(key).isin(wanted))
        parts = [s for s in held["segments"] if name in s["tables"]]
        homes = self._homes(wanted, sorted({s["tables"][name]["folders"] for s in parts}))
        paths = []
        for s in parts:
            t = s["tables"][name]
            paths += [f"{self.root}/{s['id']}/{name}/folder={b}" for b in sorted(homes[t["folders"]] & set(t["filled"]))]
        rows = self._read(held, parts, name, paths).where(F.col(key).isin(wanted))
        return self._live(rows, held, name)

    def _homes(self, wanted: list[str], counts: list[int]) -> dict[int, set[int]]:
        """Folders of the keys for each number of folders, by Spark's own hash but
        without a job: the expression is folded over literals."""
        jvm = self.spark._jvm
        hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64Function
        string = jvm.org.apache.spark.sql.types.DataTypes.StringType
        collation = {}
        out: dict[int, set[int]] = {n: set() for n in counts}
        for w in wanted:
            h = collation.setdefault(w, _hash(jvm, hashed, string, w))
            for n in counts:
                out[n].add(h % n)
        return out

    def _read(self, held: dict, parts: list[dict], name: str, paths: list[str]) -> DataFrame:
        if not parts:
            raise LookupError(f"no table {name} below {self.root}")
        schema = StructType.fromJson(json.loads(parts[0]["tables"][name]["schema"]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Folders are not columns: the number of a segment's folders is its own affair.
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _live(self, rows: DataFrame, held: dict, name: str) -> DataFrame:
        if name not in self.unowned and held["marks"]:
            marks = self._marks(held)
            few = sum(m["rows"] for m in held["marks"]) <= BROADCAST
            dead = (rows.owner == marks.gone) & (rows._seq < marks.before)
            rows = rows.join(F.broadcast(marks) if few else marks, dead, "left_anti")
        return rows.drop("_seq") if name in self.unowned else rows.drop("_seq", "owner")

    def _marks(self, held: dict) -> DataFrame:
        paths = [f"{self.root}/{m['id']}" for m in held["marks"]]
        each = self.spark.read.schema("gone string, before int").parquet(*paths)
        return each if len(paths) == 1 else each.groupBy("gone").agg(F.max("before").alias("before"))

    def owners(self, at: dict | None = None) -> DataFrame:
        """name, digest, ... of all live owners."""
        return self.table("owners", at)

    # --- changing it ---

    def apply(self, add: dict[str, DataFrame], gone: DataFrame | None = None, note: dict | None = None, fresh: bool = False, sizes: dict[str, int] | None = None) -> dict:
        """Commit new rows (tables with `owner`; `owners` has name instead) and forget
        older rows of the owners `gone` (a column owner). `fresh`: forget all that
        there was. `sizes`: about how many rows a table has, where that is known; others
        with a key are counted."""
        before = None if fresh else self.head()
        number = sinks.next_number(self.spark, f"{self.root}/commits")
        segments, marks = (before["segments"], before["marks"]) if before else ([], [])
        sums = dict(before["sums"]) if before else {}
        if gone is not None and segments:
            path = f"m-{uuid.uuid4().hex}"
            gone.select(F.col("owner").alias("gone"), F.lit(number).alias("before")).distinct().write.parquet(f"{self.root}/{path}")
            n = self.spark.read.parquet(f"{self.root}/{path}").count()
            if n:
                dead = self._sums(self.owners(before).join(self._asked(path, n), F.col("name") == F.col("gone"), "left_semi"))
                sums = {k: sums.get(k, 0) - dead.get(k, 0) for k in sums}
                marks = [*marks, {"id": path, "rows": n, "before": number}]
            else:
                sinks.remove(self.spark, f"{self.root}/{path}")
        if add:
            segment = self._written(add, number, sizes or {})
            new = self._sums(self._read({}, [segment], "owners", [f"{self.root}/{segment['id']}/owners"]))
            if new["owners"]:
                sums = {k: sums.get(k, 0) + new.get(k, 0) for k in {**sums, **new}}
                segments = [*segments, segment]
            else:
                sinks.remove(self.spark, f"{self.root}/{segment['id']}")
        body = {"segments": segments, "marks": marks, "sums": sums, "note": note or {}}
        body = self._merged(body, number)
        sinks.publish(self.spark, f"{self.root}/commits", number, body)
        return {**body, "number": number}

    def _asked(self, path: str, n: int) -> DataFrame:
        marks = self.spark.read.parquet(f"{self.root}/{path}")
        return F.broadcast(marks) if n <= BROADCAST else marks

    def _sums(self, owners: DataFrame) -> dict[str, int]:
        """Rows and whatever numbers the table of owners has."""
        numbers = [f.name for f in owners.schema if f.dataType.typeName() == "long"]
        row = owners.agg(F.count(F.lit(1)).alias("owners"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).first()
        return {k: int(v) for k, v in row.asDict().items()}

    def _written(self, tables: dict[str, DataFrame], number: int, sizes: dict[str, int]) -> dict:
        """Write the tables of a segment side by side: they are jobs of their own."""
        at = f"s-{uuid.uuid4().hex}"

        def one(name: str) -> dict:
            path = f"{self.root}/{at}/{name}"
            df = tables[name].withColumn("owner", F.col("name")) if name == "owners" else tables[name]
            df = df.withColumn("_seq", F.lit(number))
            told = {"schema": df.schema.json(), "rows": sizes.get(name)}
            if name in self.dealt:
                df.sortWithinPartitions(self.keys[name]).write.options(**_pages(DEALT_PAGE)).parquet(path)
            elif name in self.keys:
                told["rows"] = df.count() if told["rows"] is None else told["rows"]
                told["folders"] = self._keyed(df, self.keys[name], path, told["rows"])
                told["filled"] = sinks.subfolders(self.spark, path, "folder=")
            else:
                df.write.parquet(path)
            return told

        with ThreadPoolExecutor(WRITERS) as pool:
            told = dict(zip(tables, pool.map(one, tables), strict=True))
        return {"id": at, "seq": number, "tables": told, "bytes": sinks.size_of(self.spark, f"{self.root}/{at}")}

    def _keyed(self, df: DataFrame, key: str, path: str, rows: int) -> int:
        """Write in folders by key, in its order, with short pages."""
        folders = min(FOLDERS, 1 << math.ceil(math.log2(rows / FOLDER_ROWS))) if rows > FOLDER_ROWS else 1
        dealt = df.withColumn("folder", folder_of(F.col(key), folders))
        if rows > FILE_ROWS:
            # Of keys that alone exceed a file: as many parts as they need, by owner.
            often = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FILE_ROWS).select(F.col(key).alias("often"), F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("deal"))
            dealt = dealt.join(F.broadcast(often), F.col(key) == F.col("often"), "left")  # at most rows / FILE_ROWS keys
            salt = F.col("owner") if "owner" in df.columns else F.col(key)
            dealt = dealt.withColumn("deal", F.pmod(F.xxhash64(salt), F.coalesce("deal", F.lit(1)))).drop("often")
            dealt = dealt.repartition(max(folders, rows // FILE_ROWS), "folder", "deal").drop("deal")
        else:
            dealt = dealt.repartitionById(folders, "folder") if folders > 1 else dealt.coalesce(1)
        dealt.sortWithinPartitions("folder", key).write.options(**_pages(PAGE_ROWS)).partitionBy("folder").parquet(path)
        return folders

    def _merged(self, body: dict, number: int) -> dict:
        """Merge the segments of a size of which there are FAN; forget marks that no
        segment needs."""
        tiers: dict[int, list[dict]] = {}
        for s in body["segments"]:
            tiers.setdefault(int(math.log(max(s["bytes"], LEAST_BYTES), FAN)), []).append(s)
        due = next((t for t in tiers.values() if len(t) >= FAN), None)
        if due is None:
            return body
        names = dict.fromkeys(n for s in due for n in s["tables"])
        view = {**body, "segments": due}
        rows, sizes = {}, {}
        for name in names:
            parts = [s for s in due if name in s["tables"]]
            found = self._read(view, parts, name, [f"{self.root}/{s['id']}/{name}" for s in parts])
            found = found.drop("_seq").distinct() if name in self.unowned else self._dead_out(found, view)
            rows[name] = (found.drop("owner") if name == "owners" else found).drop("_seq")
            sizes[name] = sum(s["tables"][name]["rows"] or 0 for s in parts)
            if name in self.dealt:
                rows[name] = rows[name].repartition(max(1, -(-sizes[name] // DEALT_ROWS)), "owner")
        merged = self._written(rows, number, sizes)
        segments = [*[s for s in body["segments"] if s not in due], merged]
        oldest = min((s["seq"] for s in segments), default=number)
        return {**body, "segments": segments, "marks": [m for m in body["marks"] if m["before"] > oldest]}

    def _dead_out(self, rows: DataFrame, view: dict) -> DataFrame:
        if not view["marks"]:
            return rows
        marks = self._marks(view)
        few = sum(m["rows"] for m in view["marks"]) <= BROADCAST
        return rows.join(F.broadcast(marks) if few else marks, (rows.owner == marks.gone) & (rows._seq < marks.before), "left_anti")

    def vacuum(self, keep_seconds: float = 3600.0) -> list[str]:
        """Delete segments and marks that neither the last commit nor one younger than
        `keep_seconds` names; a query that runs longer than that must be kept for."""
        named: set[str] = set()
        for body in sinks.commits_since(self.spark, f"{self.root}/commits", keep_seconds):
            named |= {s["id"] for s in body["segments"]} | {m["id"] for m in body["marks"]}
        return sinks.sweep(self.spark, self.root, ("s-", "m-"), named, keep_seconds)


@dataclass(frozen=True)
class Keyed:
    """A table of one commit that is looked up by its key; `where` leaves rows out."""

    store: Store
    name: str
    at: dict
    where: str | None = None

    @property
    def key(self) -> str:
        return self.store.keys[self.name]

    def _some(self, rows: DataFrame) -> DataFrame:
        return rows if self.where is None else rows.where(self.where)

    def rows(self) -> DataFrame:
        return self._some(self.store.table(self.name, self.at))

    def lookup(self, wanted: list[str]) -> DataFrame:
        return self._some(self.store.lookup(self.name, wanted, self.at))


def _pages(rows: int) -> dict[str, str]:
    return {"parquet.page.row.count.limit": str(rows), "parquet.page.size.row.check.min": "100"}


def _hash(jvm, hashed, string, text: str) -> int:
    value = jvm.org.apache.spark.unsafe.types.UTF8String.fromString(text)
    return hashed.hash(value, string, 42, True, False)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change (added, changed, removed) between owners (name, digest) of the
    same files before and after."""
    both = old.select("name", F.col("digest").alias("was")).join(new.select("name", F.col("digest").alias("is")), "name", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")
