"""Where results go: versioned tables with a pointer, partitions of records, replies, logs.

A table is written as a new version and becomes current by one numbered file that
is created once, so a reader sees all of the old version or all of the new one, a job
that dies leaves the old one, and of two writers one is told that it came second.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_REPLY, MAX_USAGE, MAX_PARTITION = 4 << 20, 1 << 20, 256 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors see: below spark.checkpoint.dir;
    a session on one machine without that setting gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_loomdex_folder", None)
        if base is None:
            base = sc._loomdex_folder = tempfile.mkdtemp(prefix="loomdex-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = sc._loomdex_folder = f"file://{base}"
    return f"{base.rstrip('/')}/{name}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there in one step."""
    fs, at = _fs(spark, path)
    if fs.exists(at) and not fs.getFileStatus(at).isFile():
        raise ValueError(f"{path} is no file")
    jvm = spark._jvm
    scratch = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    _put(fs, scratch, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(scratch, fs.makeQualified(at), over)


def _put(fs, at, text: str, overwrite: bool = True) -> None:
    out = fs.create(at, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, read by the driver without a job; None where there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path, without a job."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a table's files, without a job: their number, bytes and last change."""
    fs, at = _fs(spark, path)
    held = fs.getContentSummary(at)
    return f"{held.getFileCount()}-{held.getLength()}-{fs.getFileStatus(at).getModificationTime()}"


# --- numbered commits ---


class Conflict(RuntimeError):
    """Another writer has published the same number first."""


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders `prefix`N below a path."""
    return sorted(int(n.removeprefix(prefix)) for n in _names(spark, path) if n.startswith(prefix))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted((int(n) for n in _names(spark, folder) if n.isdigit()), reverse=True)


def next_number(spark: SparkSession, folder: str) -> int:
    return max(_numbers(spark, folder), default=0) + 1


def publish(spark: SparkSession, folder: str, number: int, body: dict) -> None:
    """Make `body` the commit of this number. The body is written whole first; then
    the number's file is created, which fails where it exists, so of two writers one
    wins and readers see the old commit or the new one."""
    name = f"body-{uuid.uuid4().hex}"
    fs, at = _fs(spark, f"{folder}/{name}")
    _put(fs, at, json.dumps({**body, "number": number}, sort_keys=True))
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:012d}")
    try:
        _put(fs, pointer, name, overwrite=False)
    except Exception as error:
        fs.delete(at, False)
        if fs.exists(pointer):
            raise Conflict(f"commit {number} of {folder} exists already") from None
        raise error


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The body of the greatest number whose file is complete."""
    for number in _numbers(spark, folder):
        name = read_text(spark, f"{folder}/{number:012d}")
        text = read_text(spark, f"{folder}/{name}") if name else None
        if text:
            return json.loads(text)
    return None


def commits_since(spark: SparkSession, folder: str, seconds: float) -> list[dict]:
    """The last commit, and those that were current within the last `seconds`."""
    out, fs = [], None
    for number in _numbers(spark, folder):
        path = f"{folder}/{number:012d}"
        fs, at = _fs(spark, path)
        if text := read_text(spark, f"{folder}/{read_text(spark, path)}"):
            out.append(json.loads(text))
            # The one before was current until this one came.
            if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > seconds:
                break
    return out


def sweep(spark: SparkSession, root: str, prefixes: tuple[str, ...], named: set[str], seconds: float = 0.0) -> list[str]:
    """Delete the folders below `root` with these prefixes that are not named and
    older than `seconds` (a job may be writing younger ones)."""
    fs, at = _fs(spark, root)
    gone = []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        name = status.getPath().getName()
        if name.startswith(prefixes) and name not in named and time.time() - status.getModificationTime() / 1000 >= seconds:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


# --- versions of several tables ---


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], note: dict | None = None, partition: dict[str, list[str]] | None = None) -> str:
    """Write all tables as one version below `root` and make it current. Older
    versions stay until `recover`, since queries may still read them."""
    number, version = next_number(spark, f"{root}/commits"), f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        out = df.write.mode("error")
        if partition and name in partition:
            out = out.partitionBy(*partition[name])
        out.parquet(f"{root}/{version}/{name}")
    publish(spark, f"{root}/commits", number, {"version": version, "note": note or {}})
    return f"{root}/{version}"


def current(spark: SparkSession, root: str) -> dict | None:
    return latest(spark, f"{root}/commits")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    held = current(spark, root)
    if held is None:
        raise LookupError(f"nothing is committed below {root}")
    return spark.read.parquet(f"{root}/{held['version']}/{name}")


def recover(spark: SparkSession, root: str, keep_seconds: float = 3600.0) -> list[str]:
    """Delete versions that were not current within the last `keep_seconds`, and what
    failed jobs left."""
    named = {b["version"] for b in commits_since(spark, f"{root}/commits", keep_seconds)}
    return sweep(spark, root, ("v-",), named, keep_seconds)


# --- records as files ---


def write_partitions(rows: DataFrame, path: str, part_rows: int = 200_000) -> None:
    """source/month partitions as JSON Lines, each file ordered by (ts, id). A month
    with very many rows is several files, dealt by id."""
    counts = rows.groupBy("source", "month").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("files"))
    big = counts.where("files > 1")  # bounded by rows / part_rows
    dealt = rows.join(F.broadcast(big), ["source", "month"], "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("files", F.lit(1))).cast("int").alias("part")
    dealt = dealt.withColumn("part", part).drop("files")
    dealt.repartition("source", "month", "part").sortWithinPartitions("source", "month", "part", "ts", "id").drop("part").write.partitionBy("source", "month").json(path)


def canonical_line(rows: DataFrame) -> DataFrame:
    """`line`: compact JSON of each row with its keys in order; nulls are left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "true"}).alias("line"))


# --- replies, usage, routine output ---


def encode(reply: dict) -> str:
    """Canonical JSON of a reply; more than MAX_REPLY bytes or NaN are errors."""
    text = json.dumps(reply, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if len(text.encode()) > MAX_REPLY:
        raise ValueError(f"the reply is above {MAX_REPLY} bytes: narrow the scope")
    return text


def tool_reply(reply: dict) -> dict:
    """The reply as text and as structure, for hosts that call tools."""
    return {"content": [{"type": "text", "text": encode(reply)}], "structuredContent": reply}


def note_usage(path: str, at: datetime, op: str, results: int) -> None:
    """Append one call to a log on the driver; beyond MAX_USAGE the newer half stays."""
    log = Path(path)
    log.parent.mkdir(parents=True, exist_ok=True)
    with log.open("a") as out:
        out.write(json.dumps({"at": at.isoformat(), "op": op, "results": results}) + "\n")
    if log.stat().st_size > MAX_USAGE:
        lines = log.read_text().splitlines(keepends=True)
        scratch = log.with_suffix(".new")
        scratch.write_text("".join(lines[len(lines) // 2 :]))
        scratch.replace(log)


def write_action(root: str, day: str, name: str, text: str) -> str | None:
    """actions/<day>_<name>/ACTION.md of a routine's output; never overwritten: None
    where the day's action exists, and nothing for blank output."""
    if not text.strip():
        return None
    folder = Path(root, "actions", f"{day}_{name}")
    folder.mkdir(parents=True, exist_ok=True)
    try:
        with (folder / "ACTION.md").open("x") as out:
            out.write(text if text.startswith("---\n") else f"---\ntype: action\nupdated: {day}\n---\n{text}")
    except FileExistsError:
        return None
    return f"actions/{day}_{name}/ACTION.md"
