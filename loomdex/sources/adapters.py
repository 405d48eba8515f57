"""Records out of what providers return: git logs, calendars, folder listings, local
documents, pages; a data source for any producer of records; and readers of logs.

An adapter reads text or bytes that are already there (a column), and gives the
columns of a record. None starts a program or calls a provider.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomdex.functions.identity import strict_json
from loomdex.functions.temporal import bound, canonical
from loomdex.sources.brain import record_problem

RECORD = "id string, title string, text string, time string, url string, links array<string>, partial boolean"
MAX_TEXT = 64 << 10
PLAIN = ("txt", "md", "rst", "org", "csv", "tsv")
KINDS = (*PLAIN, "html", "htm", "docx", "pptx", "xlsx", "pdf")


def _record(**columns: Column) -> list[Column]:
    none = {"text": F.lit(""), "time": F.lit(""), "url": F.lit(""), "links": F.array().cast("array<string>"), "partial": F.lit(False)}
    return [(none | columns)[c.split()[0]].alias(c.split()[0]) for c in RECORD.split(", ")]


# --- a sensor as a data source ---


class Sensor(DataSource):
    """Reads records from `produce(start, end, part)`, a function that yields one JSON
    text a record, over [start, end) in `parts` parts. Register a subclass that sets it."""

    produce: Callable[[str, str, int], Iterator[str]] | None = None

    @classmethod
    def name(cls) -> str:
        return "sensor"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self).produce, self.options.get("start", ""), self.options.get("end", ""), int(self.options.get("parts", "1")))


class _Reader(DataSourceReader):
    def __init__(self, produce, start: str, end: str, parts: int):
        self.produce, self.start, self.end, self.parts = produce, start, end, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line in self.produce(self.start, self.end, partition.value):
            yield (line,)


def arguments(command: list[str], values: dict[str, str]) -> list[str]:
    """A declared command with its placeholders filled; others are errors."""
    out = []
    for word in command:
        for name in re.findall(r"\{\{(.*?)\}\}", word):
            if name not in values:
                raise ValueError(f"unknown placeholder {name}")
            word = word.replace("{{" + name + "}}", values[name])
        out.append(word)
    return out


def from_array(reply: DataFrame, column: str = "value") -> DataFrame:
    """`value`: each element of one JSON array that a producer printed; an error for
    anything else."""
    v = strict_json(F.col(column))
    fine = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("ARRAY"), F.raise_error(F.lit("a producer prints one JSON array")).cast("variant")).otherwise(v)
    return reply.select(F.explode(F.try_variant_get(fine, "$", "array<variant>")).alias("v")).select(F.to_json("v").alias("value"))


# --- git, calendar, folders ---


def git_commits(log: DataFrame, start: datetime, end: datetime, bots: str = r"(?i)\[bot\]|(^|[^a-z])bot@") -> DataFrame:
    """Records of commits in [start, end) that people made. log: repo, value, with
    value = sha, ISO time, name, email and subject between U+001F. A log is read whole,
    however many commits the window has."""
    part = lambda i: F.split("value", "\x1f")[i]
    rows = log.where(F.size(F.split("value", "\x1f")) == 5).select("repo", part(0).alias("sha"), F.try_to_timestamp(canonical(part(1))).cast("timestamp_ntz").alias("at"), part(2).alias("name"), F.lower(part(3)).alias("email"), part(4).alias("subject"))
    rows = rows.where((F.col("at") >= bound(start)) & (F.col("at") < bound(end)) & ~F.concat_ws(" ", "name", "email").rlike(bots)).dropDuplicates(["repo", "sha"])
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    links = F.array_sort(F.array(F.concat(F.lit("repo:"), "repo"), F.concat(F.lit("person:"), "email")))
    return rows.select(*_record(id=F.concat_ws("@", "repo", "sha"), title=F.col("subject"), text=F.concat_ws(" ", "name", "subject"), time=stamp, links=links))


_EVENT = "id string, status string, summary string, description string, htmlLink string, organizer struct<email:string>, attendees array<struct<email:string>>, start struct<dateTime:string,date:string,timeZone:string>"


def calendar_events(pages: DataFrame, tz: str = "UTC") -> DataFrame:
    """Records of events of calendar pages (`value`: JSON with items and the
    calendar's timeZone). All-day events begin at midnight there; cancelled ones go."""
    page = F.from_json("value", f"timeZone string, items array<struct<{_EVENT.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>")
    rows = pages.select(page.alias("p")).select(F.coalesce("p.timeZone", F.lit(tz)).alias("zone"), F.explode("p.items").alias("e")).where(F.coalesce("e.status", F.lit("")) != "cancelled")
    allday = F.convert_timezone(F.coalesce("e.start.timeZone", "zone"), F.lit("UTC"), F.to_date("e.start.date").cast("timestamp_ntz"))
    at = F.coalesce(F.try_to_timestamp(canonical(F.col("e.start.dateTime"))).cast("timestamp_ntz"), allday)
    people = F.transform(F.concat(F.array("e.organizer.email"), F.coalesce(F.transform("e.attendees", lambda a: a["email"]), F.array().cast("array<string>"))), F.lower)
    links = F.array_sort(F.array_distinct(F.transform(F.filter(people, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("person:"), x))))
    return rows.select(*_record(
        id=F.col("e.id"), title=F.coalesce(F.nullif("e.summary", F.lit("")), F.lit("(untitled)")), text=F.coalesce("e.description", F.lit("")),
        time=F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), url=F.coalesce("e.htmlLink", F.lit("")), links=links,
    ))


def drive_folders(pages: DataFrame) -> DataFrame:
    """Records of a whole listing of folders (pages of `value`: JSON with files and
    incompleteSearch). A repeated id or an incomplete page ends the job: a snapshot is
    whole or nothing."""
    page = F.from_json("value", "incompleteSearch boolean, files array<struct<id:string,name:string,modifiedTime:string,webViewLink:string,parents:array<string>>>")
    rows = pages.select(page.alias("p"))
    whole = F.when(F.col("p").isNull() | F.col("p.files").isNull() | F.coalesce("p.incompleteSearch", F.lit(False)), F.raise_error(F.lit("the listing is incomplete"))).otherwise(F.col("p.files"))
    rows = rows.select(F.explode(whole).alias("f"))
    one = rows.groupBy("f.id").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("n"))
    fine = F.when(F.col("n") > 1, F.raise_error(F.lit("a folder is listed twice")).cast("string")).otherwise(F.col("id"))
    links = F.array_sort(F.transform(F.coalesce("f.parents", F.array().cast("array<string>")), lambda p: F.concat(F.lit("drive:"), p)))
    return one.select(*_record(id=fine, title=F.col("f.name"), time=F.coalesce(canonical(F.col("f.modifiedTime")), F.lit("")), url=F.coalesce("f.webViewLink", F.lit("")), links=links))


# --- documents ---


def _xml_text(raw: bytes, block: str, run: str) -> str:
    root = ElementTree.fromstring(raw)
    lines = []
    for p in root.iter():
        if p.tag.rpartition("}")[2] == block:
            lines.append("".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == run))
    return "\n".join(x for x in lines if x.strip())


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _sheet(raw: bytes, shared: list[str]) -> str:
    rows = []
    for row in (e for e in ElementTree.fromstring(raw).iter() if e.tag.endswith("}row")):
        cells = []
        for cell in (e for e in row if e.tag.endswith("}c")):
            part = {e.tag.rpartition("}")[2]: e for e in cell}
            value = (part["v"].text or "") if "v" in part else ""
            if cell.get("t") == "s" and value:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr" and "is" in part:
                value = "".join(t.text or "" for t in part["is"].iter() if t.tag.endswith("}t"))
            if "f" in part and part["f"].text:
                value = f"{value} [formula: {part['f'].text}]".strip()
            cells.append(value)
        if any(cells):
            rows.append("\t".join(cells))
    return "\n".join(rows)


def office_text(kind: str, raw: bytes, most: int = 64 << 20) -> str:
    """Paragraphs, headers and footers of docx, slides and then notes of pptx, cells
    of xlsx. An archive that unpacks to more than `most` bytes is an error."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        if sum(i.file_size for i in box.infolist()) > most:
            raise ValueError("the document unpacks to too much")
        names = box.namelist()
        if kind == "docx":
            parts = ["word/document.xml", *_numbered(names, r"word/header(\d+)\.xml"), *_numbered(names, r"word/footer(\d+)\.xml")]
            return "\n".join(x for n in parts if n in names and (x := _xml_text(box.read(n), "p", "t")))
        if kind == "pptx":
            parts = [*_numbered(names, r"ppt/slides/slide(\d+)\.xml"), *_numbered(names, r"ppt/notesSlides/notesSlide(\d+)\.xml")]
            return "\n".join(x for n in parts if (x := _xml_text(box.read(n), "p", "t")))
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in (e for e in ElementTree.fromstring(box.read("xl/sharedStrings.xml")) if e.tag.endswith("}si")):
                shared.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
        return "\n".join(x for n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml") if (x := _sheet(box.read(n), shared)))


def pdf_text(raw: bytes) -> str:
    """Text of shown strings, where a PDF's streams are plain or deflated."""
    import zlib

    out = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        for shown in re.findall(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*Tj", stream, re.S):
            texts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", shown[0]) if shown[0] else [shown[1]]
            out.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(texts)).decode("latin-1"))
    return "\n".join(out)


def document_text(path: str, raw: bytes) -> str:
    """The text of one document, by its ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in PLAIN:
        return raw.decode("utf-8")
    if kind in ("html", "htm"):
        return _html(raw.decode("utf-8", "replace"))
    return pdf_text(raw) if kind == "pdf" else office_text(kind, raw)


def _html(text: str) -> str:
    from html.parser import HTMLParser

    out: list[str] = []

    class Visible(HTMLParser):
        hidden = 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "tr"):
                out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                out.append(data)

    Visible().feed(text)
    return re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def read_documents(spark: SparkSession, root: str, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(records of the documents below a folder; file, problem of those that can't be
    read). Text is cut at MAX_TEXT bytes, and `partial` says so."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    mine = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*KINDS))
    held = mine.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("at"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                text = problem = None
                try:
                    if not raw.is_valid:
                        raise ValueError(f"above {max_bytes} bytes")
                    text = document_text(path, raw.as_py())
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    problem = f"{type(error).__name__}: {str(error)[:200]}"
                cut = None if text is None else text.encode()[:MAX_TEXT].decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([cut], pa.string()), pa.array([text is not None and cut != text]), pa.array([problem], pa.string())],
                    ["path", "text", "partial", "problem"],
                )

    texts = held.select("path", "content").mapInArrow(run, "path string, text string, partial boolean, problem string").join(held.select("path", "at"), "path")
    folder = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    inside = F.substring_index("path", folder, -1)
    name = F.regexp_replace(F.regexp_replace(inside, r"^.*/", ""), r"\.[^.]*$", "")
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    good = texts.where("problem is null").select(*_record(id=inside, title=name, text=F.col("text"), time=stamp, partial=F.col("partial")))
    return good, texts.where("problem is not null").select(inside.alias("file"), "problem")


# --- state, usage, suites ---


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """name, success, start, end, error, action of the last runs (JSON lines); what is
    no JSON object counts as no run, since a state only saves work."""
    lines = spark.read.text(path).where(strict_json(F.col("value")).isNotNull())
    text = lambda k: F.get_json_object("value", f"$.{k}")
    at = lambda k: F.try_to_timestamp(canonical(text(k))).cast("timestamp_ntz").alias(k)
    return lines.select(text("name").alias("name"), at("success"), at("start"), at("end"), F.coalesce(text("error"), F.lit("")).alias("error"), F.coalesce(text("action"), F.lit("")).alias("action")).where("name is not null")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """at, op, results of the calls that can be read."""
    lines = spark.read.text(path).where(strict_json(F.col("value")).isNotNull())
    at = F.try_to_timestamp(canonical(F.get_json_object("value", "$.at"))).cast("timestamp_ntz")
    return lines.select(at.alias("at"), F.get_json_object("value", "$.op").alias("op"), F.expr("try_cast(get_json_object(value, '$.results') as int)").alias("results")).where("at is not null")


def read_suites(folder: str) -> dict[str, dict]:
    """Cases of the YAML files of a folder on the driver: at most 100 files of 1 MiB."""
    from pathlib import Path

    from loomdex.sources.config import yaml_object

    files = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml"))
    if not 1 <= len(files) <= 100:
        raise ValueError(f"{folder} has {len(files)} suites")
    return {posixpath.basename(str(p)): yaml_object(p.read_bytes()) for p in files}


def checked_lines(lines: DataFrame) -> DataFrame:
    """Lines of a producer; a line that is no record ends the job."""
    problem = record_problem(F.col("value"))
    return lines.withColumn("value", F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("value")))
