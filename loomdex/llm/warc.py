"""WARC archives with an external index merge.

Each record is a gzip member of its own, so its offset and length in the archive
find it without what lies before (`record_at`). Members are packed in the task that
makes them and rolled into archives of ARCHIVE_BYTES; Spark's text sink writes them
as they are, with an empty gzip member as the line separator, so archives appear
through the commit protocol of a shared store and survive lost executors.

Each archive read back, a member at a time, yields one run of captures, sorted
locally by URL key and timestamp, and runs are stored. They are dealt by ranges of
(key, timestamp, page) without sorting them again: what a range gets of a run is
still sorted. In each range a loser tree merges these k stretches, so that the
ranges in turn are one globally ordered capture history. A range has about
RANGE_ROWS captures and lies in memory; a hot URL key is cut by timestamp and page.

Defined cases: null html is an empty payload; a null url writes no target URI
and has an empty key; line breaks in a url become spaces; rows that repeat a
page_id write a record each; a record equal to its response's page_id is a
response; rows with a null page_id are archived without a reference to them and
never serve as the response of others; an archive ends after the record that
passes ARCHIVE_BYTES, so a very long page has one of its own; an empty table gives
no captures; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import MANY, OFTEN, arrow_map, remove, scratch, table, written

LEAST = 100
#: Bytes of an archive, and the share of its pages' bytes that compression leaves.
ARCHIVE_BYTES, PACKED = 16 << 20, 0.25
RANGE_ROWS = 50_000
END = "\r\n\r\n"
#: An empty gzip member: archives are valid gzip with or without it.
NOTHING = gzip.compress(b"", mtime=0)
#: Capture time of page 0; a page's own is so many seconds later as its id says.
EPOCH = 1_704_067_200
CAPTURES = (
    "run string, url_key string, captured string, page_id bigint, payload_bytes bigint, "
    "payload_digest string, record_type string, refers_to bigint, record_offset bigint, record_length bigint"
)


def records(pages: DataFrame, least: int = LEAST, parts: int | None = None, often: int = OFTEN) -> DataFrame:
    """page_id and `value`: the WARC record, dealt in `parts` by page. Payloads of more
    than `often` pages meet them by broadcast."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    first = (
        base.where(F.col("n") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    # Only ids and digests meet the groups; the payloads move once, by page. A page of a
    # very common payload meets its group by broadcast, the others are dealt by digest.
    first = written(first)
    own = base.select("page_id", "digest").where("page_id is not null")
    common = first.where(F.col("copies") > often).drop("copies")
    rare = first.where(F.col("copies") <= often).drop("copies")
    refers = own.join(F.broadcast(common.select("digest")), "digest", "left_anti").join(rare, "digest").unionByName(own.join(F.broadcast(common), "digest"))
    refers = refers.where("page_id <> response").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("response").alias("refers_to")).distinct()
    refers = written(refers)  # a plan of its own, so the payloads are dealt once
    if parts:
        base, refers = base.repartition(parts, "page_id", "digest"), refers.repartition(parts, "p", "d")
    whole = base.join(refers, (base.page_id == refers.p) & (base.digest == refers.d), "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    stamp = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        line("WARC-Date", stamp),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return whole.select("page_id", F.concat(head, block, F.lit(END)).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    held, rows = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 500), F.lit(0)), F.count(F.lit(1))).first()
    often = max(OFTEN, rows // MANY)  # so MANY payloads at most are common
    parts = int(held * PACKED / archive_bytes) + 1

    def pack(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        members, roll = [], []
        for value in batch.column("value"):
            if state.get("bytes", 0) >= archive_bytes:
                state["roll"], state["bytes"] = state.get("roll", 0) + 1, 0
            members.append(gzip.compress(value.as_buffer(), 6, mtime=0))
            roll.append(state.get("roll", 0))
            state["bytes"] = state.get("bytes", 0) + len(members[-1]) + len(NOTHING)
        return pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(roll, pa.int32())], ["value", "roll"])

    packed = arrow_map(records(pages, least, max(8, parts), often).select(F.col("value").cast("binary").alias("value")), pack, "value binary, roll int")
    (
        packed.select(F.col("value").cast("string").alias("value"), "roll").write.partitionBy("roll")
        .option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    )


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record, a gzip member at a time."""
    at, whole = 0, memoryview(archive)
    while at < len(archive):
        record, n = _member(whole, at)
        if record:
            yield at, n, *_record(record, at)
        at += n


def record_at(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record of the index, from its own bytes alone."""
    return _record(gzip.decompress(archive[offset : offset + length]), offset)


def _member(whole: memoryview, at: int) -> tuple[bytes, int]:
    unpack, out, read = zlib.decompressobj(31), [], at
    while not unpack.eof:
        piece = whole[read : read + (1 << 16)]
        if not len(piece):
            raise ValueError(f"the archive ends inside the member at byte {at}")
        out.append(unpack.decompress(piece))
        read += len(piece)
    return b"".join(out), read - len(unpack.unused_data) - at


def _record(record: bytes, at: int) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    heads = dict(x.split(": ", 1) for x in lines[1:])
    n = int(heads["Content-Length"])
    if rest[n:] != END.encode():
        raise ValueError(f"damaged record at byte {at}")
    return heads, rest[:n]


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _page(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of captures for each archive below `path`."""

    def read(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        rows = []
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            own = []
            for at, length, heads, block in parse(content.as_buffer()):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = heads["WARC-Type"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if heads["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"damaged record at byte {at} of {name}")
                else:
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = heads["WARC-Payload-Digest"].removeprefix("sha256:")
                own.append((name, url_key(heads.get("WARC-Target-URI")), heads["WARC-Date"], _page(heads.get("WARC-Record-ID")), size, digest, kind, _page(heads.get("WARC-Refers-To")), at, length))
            rows += sorted(own, key=_order)
        columns = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CAPTURES.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return arrow_map(files.select("path", "content"), read, CAPTURES)


def _order(row: tuple) -> tuple:
    return (row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[8])


class LoserTree:
    """Tournament of k sorted iterators: each `next` replays one path of losers."""

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int, filling: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.losers[node] == -1 and filling:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = head = next(self.sources[w], None)
            self.keys[w] = None if head is None else self.key(head)
            self._replay(w)


def merge(captures: DataFrame, ranges: int) -> DataFrame:
    """Captures (rows of sorted runs) in `ranges` partitions, globally ordered by
    (url_key, captured, page_id): partition by partition, each in the order of its
    loser tree. A new stretch begins wherever the arriving rows stop ascending, so
    the result doesn't depend on the order in which parts of runs arrive."""
    order = [F.col(c) for c in ("url_key", "captured", "page_id", "run", "record_offset")]
    dealt = captures.repartitionByRange(ranges, *order)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = [_order(row) for row in zip(*(rows.column(c).to_pylist() for c in rows.column_names), strict=True)]
        starts = [0, *[i for i in range(1, len(keys)) if keys[i] < keys[i - 1]], len(keys)]
        tree = LoserTree([iter(range(a, b)) for a, b in zip(starts, starts[1:], strict=False)], keys.__getitem__)
        yield from rows.take(pa.array(list(tree), pa.int64())).combine_chunks().to_batches()

    return dealt.mapInArrow(merged, CAPTURES)


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write `pages` as WARC below `path`, read the archives back and return the
    capture history. Without `path` the archives go after they were read."""
    spark = pages.sparkSession
    at = path or scratch(spark)
    write(pages, at, least)
    captures = written(runs(spark, at))
    if path is None:
        remove(spark, at)
    return merge(captures, max(8, captures.count() // RANGE_ROWS + 1))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


ORACLE = {
    "op6_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT payload_digest, min(page_id) AS resp FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
j AS (SELECT d.*, CASE WHEN r.resp <> d.page_id THEN r.resp END AS refers_to
      FROM d LEFT JOIN r ON d.payload_digest = r.payload_digest AND d.payload_bytes >= 100)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
       lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.')), ',')
             || ')' || regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)) AS url_key,
       strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM j
""",
}
