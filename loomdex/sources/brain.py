"""A brain: notes and records as five tables (items, passages, names, links, edges).

Files are listed and read by Spark's own sources, so a brain may lie in any store.
What cannot be read is a row of `problems` and never silently absent.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex import sinks
from loomdex.functions.identity import AUTHORED, MAX_VALUE, address, clean, is_authored, parse_address, strict_json
from loomdex.functions.markdown import MAX_NOTE, parse_notes
from loomdex.functions.temporal import canonical, modified, note_time
from loomdex.functions.text import lead
from loomdex.operators import graph, search
from loomdex.sources.config import Config, signature
from loomdex.sources.segments import Store

MAX_FILES, MAX_LEVELS, MAX_PARTITION = 100_000, 64, 256 << 20
RECORD_KEYS = ("id", "title", "text", "time", "url", "links", "aliases", "attributes", "fields")
RECORD = "id string, title string, text string, time string, url string, links array<string>, aliases array<string>, attributes string, fields map<string,variant>"
ITEM = (
    "ref string, path string, kind string, source string, title string, day date, time timestamp_ntz, type string, status string, lead string, url string, "
    "updated timestamp_ntz, observed timestamp_ntz, partial boolean, tasks_open int, tasks_done int, next string, weight int"
)


TABLES = ("items", "passages", "names", "links", "edges", "problems")
#: Tables of a stored brain that are looked up by a column, and their format.
KEYS = {"passages": "ref", "links": "item", **graph.KEYS, **search.KEYS}
FORMAT = 3
#: Changed files that are named to Spark; of more, the whole folder is read.
NAMED_FILES = 1000
#: Items of a change whose tables are not counted before they are written.
FEW_ITEMS = 500

@dataclass(frozen=True)
class Brain:
    name: str
    items: DataFrame  # ITEM
    passages: DataFrame  # ref, fragment, heading, text, names, weight, status
    names: DataFrame  # name, item
    links: DataFrame  # item, target, time
    edges: DataFrame  # item, subject, relation, target, origin, time
    problems: DataFrame | None = None  # file, problem
    index: search.Index | None = None  # of the passages
    stored: graph.Graph | None = None  # names, links and claims by what is asked of them

    @property
    def graph(self) -> graph.Graph:
        return self.stored or graph.Graph.of(self.items, self.names, self.links, self.edges)


# --- files ---


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (inside the brain), size, modified of the regular files below `root`; an
    error beyond MAX_FILES or MAX_LEVELS. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    listed = found.select(_inside(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    seen = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("path", "/"))).alias("levels")).first()
    if seen.n > MAX_FILES or (seen.levels or 0) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_FILES} files or {MAX_LEVELS} levels below {root}")
    return listed


def _inside(path: Column, root: str) -> Column:
    """The part of a file's address below the brain's folder."""
    folder = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return F.substring_index(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), folder, -1)


def bounded(listed: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Files within `limit` bytes, and file, problem of the others."""
    over = F.col("size") > limit
    return listed.where(~over), listed.where(over).select(F.col("path").alias("file"), F.concat("path", F.lit(f": above {limit} bytes")).alias("problem"))


def inputs(listed: DataFrame) -> DataFrame:
    """The files a projection is made of, with a fingerprint: notes and partitions."""
    mine = is_authored(F.col("path")) | F.col("path").rlike(r"^memories/[^/]+/[^/]+\.jsonl$")
    return listed.where(mine).select("path", F.concat_ws("-", F.col("size").cast("string"), F.unix_micros("modified").cast("string")).alias("digest"))


def partitions(listed: DataFrame, source: str | None = None) -> DataFrame:
    """path, source, partition of the files of one source or of all."""
    part = lambda i: F.regexp_extract("path", r"^memories/([^/]+)/([^/]+)\.jsonl$", i)
    found = listed.select("path", part(1).alias("source"), part(2).alias("partition")).where("source <> ''")
    return found if source is None else found.where(F.col("source") == source)


def read_notes(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """One row of the note struct for each file below the authored folders, or of
    those paths among them."""
    folders = [f"{root}/{name}" for name in AUTHORED if _exists(spark, f"{root}/{name}")] if only is None else [f"{root}/{p}" for p in only]
    if not folders:
        return parse_notes(spark.createDataFrame([], "path string, text string"))
    text = spark.read.text(folders, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    # A file above the limit is not parsed: its struct says so.
    body = F.when(F.col("_metadata.file_size") <= MAX_NOTE, F.col("value")).otherwise(F.repeat(F.lit(" "), MAX_NOTE + 1))
    return parse_notes(text.select(_inside(F.col("_metadata.file_path"), root).alias("path"), body.alias("text")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# --- records ---


def record_problem(line: Column) -> Column:
    """Why a line is no record; null for a good one. Values never enter the text."""
    v = strict_json(line)
    kind = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")), F.lit("absent"))
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    strings = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    at = F.coalesce(text("time"), F.lit(""))
    out = F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not one JSON object")
    out = out.when(F.size(F.array_except(F.json_object_keys(line), F.array(*[F.lit(k) for k in RECORD_KEYS]))) > 0, "unknown keys")
    for key in ("id", "title"):
        out = out.when((kind(key) != "STRING") | ~F.coalesce(clean(text(key)), F.lit(False)), f"{key} is a nonempty text without control characters")
    for key in ("text", "time", "url"):
        out = out.when(~kind(key).isin("STRING", "absent"), f"{key} is a text")
    out = out.when((at != "") & canonical(at).isNull(), "time needs ISO 8601 and a zone")
    for key in ("links", "aliases"):
        bad = ~kind(key).isin("absent", "ARRAY<VOID>", "ARRAY<STRING>") | F.exists(strings(key), lambda x: x.isNull() | (F.length(x) > MAX_VALUE) | (x == ""))
        out = out.when(bad, f"{key} is a list of texts")
    for key in ("attributes", "fields"):
        out = out.when(~(kind(key).startswith("OBJECT") | (kind(key) == "absent")), f"{key} is an object")
    return out


def read_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with their file, problems) of a folder or of some files. A file with a bad line is rejected as a
    whole; blank lines are skipped; times are canonical, links and aliases sorted sets."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    marked = lines.withColumn("problem", record_problem(F.col("value")))
    problems = marked.where("problem is not null").groupBy("file").agg(F.count(F.lit(1)).alias("bad_lines"), F.min("problem").alias("problem"))
    good = marked.join(F.broadcast(problems.select("file")), "file", "left_anti")  # at most a row a file, and files are bounded
    parsed = good.select("file", F.from_json("value", RECORD).alias("r")).select("file", "r.*")
    some = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)), F.array().cast("array<string>"))
    return parsed.withColumns({
        "text": F.coalesce("text", F.lit("")), "url": F.coalesce("url", F.lit("")), "links": some("links"), "aliases": some("aliases"),
        "time": F.try_to_timestamp(canonical(F.col("time"))).cast("timestamp_ntz"), "fields": F.coalesce(F.transform_values("fields", lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>")),
    }), problems


def in_partitions(records: DataFrame) -> DataFrame:
    """With source and partition, from the file's place in the brain."""
    part = lambda i: F.regexp_extract("file", r"memories/([^/]+)/([^/]+)\.jsonl$", i)
    return records.withColumns({"source": part(1), "partition": part(2)})


def find_record(records: DataFrame, problems: DataFrame, source: str, key: str) -> DataFrame:
    """The record with this id; an error when it is not found and a partition of its
    source cannot be read: incomplete is not absent. `problems`: file, ..."""
    found = records.where((F.col("source") == source) & (F.col("id") == key)).orderBy(F.desc("partition")).limit(1)
    if found.isEmpty() and not problems.where(F.col("file").contains(f"memories/{source}/")).isEmpty():
        raise LookupError(f"{source}: a partition cannot be read, so {key} may exist")
    return found


# --- the projection ---


def distilled(path: Column) -> Column:
    """Two for what people condensed: projects, concepts without their index and
    log, and the ACTION.md of an action; else one."""
    concept = path.startswith("concepts/") & ~path.rlike(r"(^|/)(index|log)\.md$")
    return F.when(path.startswith("projects/") | concept | path.rlike(r"^actions/[^/]+/ACTION\.md$"), 2).otherwise(1)


def note_items(notes: DataFrame) -> DataFrame:
    none = F.lit(None)
    return notes.where("problem is null").select(
        F.col("path").alias("ref"), "path", F.lit("note").alias("kind"), F.lit("").alias("source"), "title", F.to_date(F.nullif("updated", F.lit(""))).alias("day"),
        none.cast("timestamp_ntz").alias("time"), "type", "status", "lead", F.lit("").alias("url"), none.cast("timestamp_ntz").alias("updated"), none.cast("timestamp_ntz").alias("observed"),
        F.lit(False).alias("partial"), "tasks_open", "tasks_done", "next", distilled(F.col("path")).alias("weight"),
    )


def note_passages(notes: DataFrame) -> DataFrame:
    """The preamble, named by type, tags, aliases and links, and each section, named
    by its note."""
    held = notes.where("problem is null")
    many = F.concat_ws(" ", F.col("type"), F.array_join("tags", " "), F.array_join("aliases", " "), F.array_join("targets", " "))
    each = held.select("path", "title", "status", many.alias("own"), F.explode("passages").alias("p"))
    return each.select(
        F.col("path").alias("ref"), "p.fragment", "p.heading", "p.text", F.when(F.col("p.fragment") == "", F.col("own")).otherwise(F.col("title")).alias("names"),
        distilled(F.col("path")).alias("weight"), "status",
    )


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: a generator is not inlined, so what is
    said of it later doesn't multiply its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def note_names(notes: DataFrame, config: Config) -> DataFrame:
    own = F.array(address(config.name, F.col("path")), F.nullif("entity", F.lit("")))
    each = notes.where("problem is null").select(F.explode(F.array_distinct(F.concat(own, "aliases"))).alias("said"), F.col("path").alias("item")).where("said is not null")
    return _canonical(each, "said").select(F.col("to").alias("name"), "item").distinct()


def _canonical(rows: DataFrame, column: str) -> DataFrame:
    """Adds `at`, the parts of an address, and `to`, the address without its relation
    or, of anything else, the text itself."""
    rows = once(rows, "at", parse_address(F.col(column)))
    return rows.withColumn("to", F.when(F.col("at.valid"), address(F.col("at.brain"), F.col("at.path"), F.col("at.fragment"))).otherwise(F.col(column)))


def resolved_path(path: Column, target: Column) -> tuple[Column, Column]:
    """The file and the fragment that a relative link names, split at its first #
    before anything is decoded; a file outside the brain begins with '..'."""
    file, part = F.substring_index(target, "#", 1), F.when(target.contains("#"), F.regexp_replace(target, r"^[^#]*#", "")).otherwise(F.lit(""))
    decode = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    top = F.when(path.startswith("concepts/"), F.concat(F.lit("concepts"), decode(file))).otherwise(F.ltrim(decode(file), F.lit("/")))
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))
    joined = F.when(file == "", path).when(file.startswith("/"), top).otherwise(F.concat_ws("/", folder, decode(file)))
    # a/b/../c is a/c: one step back goes with the step before it.
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))

    def walk(done: Column, step: Column) -> Column:
        back = (step == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"), decode(part)


def _aimed(rows: DataFrame, config: Config) -> DataFrame:
    """rows: path, raw. Adds `target`, the address or file that a link names, and
    `relation`, where an address asks for one that the schema declares."""
    whole, part = resolved_path(F.col("path"), F.col("raw"))
    rows = once(_canonical(rows, "raw"), "spot", F.struct(whole.alias("file"), part.alias("part")))
    plain = F.concat("spot.file", F.when(F.col("spot.part") == "", F.lit("")).otherwise(F.concat(F.lit("#"), "spot.part")))
    near = F.when(is_authored(F.col("spot.file")), address(config.name, F.col("spot.file"), F.col("spot.part"))).otherwise(plain)
    far = F.col("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return rows.withColumns({"target": F.when(far, F.col("to")).otherwise(near), "relation": _relation(config)})


def _relation(config: Config) -> Column:
    said = [k for k, f in config.schema.items() if f.relation]
    asked = F.col("at.relation")
    return F.coalesce(F.when(asked.isin(*said), asked), F.lit("")) if said else F.lit("")


def note_claims(notes: DataFrame, config: Config) -> DataFrame:
    """item, subject, relation, target, origin: what each link of a note claims. The
    subject is its entity or the file, the origin the section."""
    each = notes.where("problem is null").select("path", "entity", F.explode("contexts").alias("c")).select("path", "entity", F.col("c.target").alias("raw"), F.col("c.fragment").alias("fragment"))
    return _aimed(each, config).select(
        F.col("path").alias("item"), F.coalesce(F.nullif("entity", F.lit("")), address(config.name, F.col("path"))).alias("subject"), "relation", "target",
        address(config.name, F.col("path"), F.col("fragment")).alias("origin"),
    ).distinct()


def note_links(notes: DataFrame, config: Config) -> DataFrame:
    each = notes.where("problem is null").select("path", F.explode("targets").alias("raw"))
    return _aimed(each, config).select(F.col("path").alias("item"), "target").distinct()


def _values(config: Config, keys: list[str]) -> Column:
    """(field, value) of the declared fields `keys`, whose map holds JSON texts; a
    list gives a row each."""
    none = F.array().cast("array<struct<field:string,value:string>>")
    out = [none]
    for key in keys:
        held = strict_json(F.try_element_at(F.col("fields"), F.lit(key)))
        many = F.try_variant_get(held, "$", "array<string>") if config.schema[key].cardinality == "many" else F.array(F.try_variant_get(held, "$", "string"))
        out.append(_named(many, key))
    return F.concat(*out)


def _named(many: Column, key: str) -> Column:
    held = F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.transform(held, lambda x: F.struct(F.lit(key).alias("field"), x.alias("value")))


def record_items(records: DataFrame) -> DataFrame:
    """`records`: source, partition and the columns of RECORD."""
    attribute = lambda key: F.get_json_object("attributes", f"$.{key}")
    none = F.lit(None)
    return records.select(
        F.concat_ws(":", "source", "id").alias("ref"), F.concat(F.lit("memories/"), "source", F.lit("/"), "partition", F.lit(".jsonl")).alias("path"), F.lit("record").alias("kind"), "source",
        "title", none.cast("date").alias("day"), "time", F.lit("").alias("type"), F.lit("").alias("status"), lead(F.col("text")).alias("lead"), "url",
        F.try_to_timestamp(canonical(attribute("updated"))).cast("timestamp_ntz").alias("updated"), F.try_to_timestamp(canonical(attribute("observed"))).cast("timestamp_ntz").alias("observed"),
        F.coalesce(attribute("partial") == "true", F.lit(False)).alias("partial"), none.cast("int").alias("tasks_open"), none.cast("int").alias("tasks_done"), none.cast("string").alias("next"), F.lit(1).alias("weight"),
    )


def record_passages(records: DataFrame, config: Config) -> DataFrame:
    said = F.transform(_values(config, sorted(config.schema)), lambda v: v["value"])
    names = F.concat_ws(" ", "source", F.array_join("aliases", " "), F.array_join("links", " "), "url", F.array_join(said, " "))
    return records.select(F.concat_ws(":", "source", "id").alias("ref"), F.lit("").alias("fragment"), F.col("title").alias("heading"), "text", names.alias("names"), F.lit(1).alias("weight"), F.lit("").alias("status"))


def record_names(records: DataFrame, config: Config) -> DataFrame:
    ref = F.concat_ws(":", "source", "id")
    each = records.select(ref.alias("item"), F.explode(F.array_distinct(F.concat(F.array(address(config.name, ref)), "aliases"))).alias("said"))
    return _canonical(each, "said").select(F.col("to").alias("name"), "item")


def record_claims(records: DataFrame, config: Config) -> DataFrame:
    """Relation fields, links and the url of each record, which is subject and origin."""
    ref = F.concat_ws(":", "source", "id")
    relations = _values(config, [k for k, f in config.schema.items() if f.relation])
    plain = F.transform(F.concat("links", F.filter(F.array("url"), lambda u: u != "")), lambda x: F.struct(F.lit("").alias("field"), x.alias("value")))
    each = records.select(ref.alias("item"), address(config.name, ref).alias("subject"), F.explode(F.concat(relations, plain)).alias("v"))
    each = _canonical(each.select("item", "subject", "v.field", "v.value"), "value")
    relation = F.when(F.col("field") != "", F.col("field")).otherwise(_relation(config))
    return each.select("item", "subject", relation.alias("relation"), F.col("to").alias("target"), F.col("subject").alias("origin")).distinct()


def with_times(rows: DataFrame, items: DataFrame, tz: str = "UTC") -> DataFrame:
    """Links or edges with the time of the item that says them."""
    at = items.select(F.col("ref").alias("item"), F.coalesce("time", note_time(F.col("day"), tz)).alias("time"))
    return rows.join(at, "item", "left")


def project(notes: DataFrame, records: DataFrame, config: Config, tz: str = "UTC") -> Brain:
    """The five tables of a brain's notes and records. A record that another file has
    already is a problem: the least path stays."""
    records, problems = sole(records)
    items = note_items(notes).unionByName(record_items(records))
    problems = notes.where("problem is not null").select(F.col("path").alias("file"), "problem").unionByName(problems.select("file", "problem"))
    edges = note_claims(notes, config).unionByName(record_claims(records, config))
    links = note_links(notes, config).unionByName(edges.select("item", "target")).distinct()
    return Brain(
        config.name, items.select(*[c.split()[0] for c in ITEM.split(", ")]), note_passages(notes).unionByName(record_passages(records, config)),
        note_names(notes, config).unionByName(record_names(records, config)).distinct(), with_times(links, items, tz), with_times(edges, items, tz), problems,
    )


def sole(records: DataFrame, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records without those whose id a lesser path has too, problems: file, problem,
    again). `taken`: ref, path of records that are stored; `again` is the file to look
    at when the one that stays changes."""
    path = F.concat(F.lit("memories/"), "source", F.lit("/"), "partition", F.lit(".jsonl"))
    here = records.select(F.concat_ws(":", "source", "id").alias("ref"), path.alias("path"))
    every = here if taken is None else here.unionByName(taken.select("ref", "path"))
    twice = every.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).where("n > 1")
    marked = records.withColumn("_path", path).withColumn("_ref", F.concat_ws(":", "source", "id"))
    kept = marked.join(twice.select(F.col("ref").alias("_ref"), "first"), "_ref", "left").where("first is null or _path = first")
    kept = kept.dropDuplicates(["_ref"]).drop("_ref", "_path", "first")
    return kept, twice.select(F.col("first").alias("file"), F.concat("ref", F.lit(": stored more than once")).alias("problem"), F.col("last").alias("again"))


# --- a brain that follows its files ---


def _changes(listed: DataFrame, store: Store, held: dict | None) -> tuple[dict[str, str], DataFrame]:
    """(path: digest of the files to read; the paths that are new, others or gone).
    Files with a problem are read again whenever anything has changed."""
    now = inputs(listed)
    if held is None:
        return {r.path: r.digest for r in now.collect()}, now.select("path")  # at most MAX_FILES
    was = store.table("files", held)
    both = was.withColumnRenamed("digest", "was").join(now.withColumnRenamed("digest", "is"), "path", "full_outer")
    rows = both.where("was is null or is is null or was <> is").collect()
    if rows:
        again = {p for r in store.table("problems", held).select("file", "again").collect() for p in (r.file, r.again) if p}
        rows += both.where(F.col("path").isin(sorted(again - {r.path for r in rows}))).collect() if again else []
    paths = store.spark.createDataFrame([(r.path,) for r in rows], "path string")
    return {r.path: r["is"] for r in rows if r["is"] is not None}, paths


def _read(spark: SparkSession, root: str, changed: dict[str, str], whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """notes, records, bad files of the files that are new or others."""
    notes = sorted(p for p in changed if p.split("/")[0] in AUTHORED)
    parts = sorted(p for p in changed if p.startswith("memories/"))
    blank = "file string, id string, title string, text string, time timestamp_ntz, url string, links array<string>, aliases array<string>, attributes string, fields map<string,string>, source string, partition string"
    found = read_notes(spark, root, None if whole and len(notes) > NAMED_FILES else notes)
    if not parts:
        return found, spark.createDataFrame([], blank), spark.createDataFrame([], "file string, problem string")
    records, bad = read_records(spark, f"{root}/memories" if whole and len(parts) > NAMED_FILES else [f"{root}/{p}" for p in parts])
    return found, in_partitions(records), bad.select(_inside(F.col("file"), root).alias("file"), "problem")


def refresh(spark: SparkSession, root: str, config: Config, tz: str = "UTC", store: str | None = None) -> tuple[Store, dict, dict[str, int]]:
    """Bring the stored tables of a folder up to its files. Only files that are new or
    others are read, and of them only notes and records that are others are written.
    Returns the store, its commit and how many items were added, changed, unchanged,
    removed."""
    at = store or sinks.shared_folder(spark, f"brain-{hashlib.sha256(root.encode()).hexdigest()[:16]}")
    kept = Store(spark, at, KEYS, ("vocabulary",), search.DEALT)
    told = {"format": FORMAT, "signature": f"{signature(config)}-{tz}"}
    held = kept.head()
    if held is not None and {k: held["note"].get(k) for k in told} != told:
        held = None
    counts = {k: 0 for k in ("added", "changed", "unchanged", "removed")}
    changed, paths = _changes(files(spark, root), kept, held)
    if held is not None and not changed and paths.isEmpty():
        return kept, held, counts
    step = f"{at}/read-{uuid.uuid4().hex}"
    notes, records, bad = _read(spark, root, changed, held is None)
    save = lambda df, name: (df.write.parquet(f"{step}/{name}"), spark.read.parquet(f"{step}/{name}"))[1]
    # Markdown and JSON are read once; everything else is made of what was read.
    with ThreadPoolExecutor(3) as pool:
        notes, records, bad = pool.map(save, (notes, records, bad), ("notes", "records", "bad"))
    before = kept.owners(held).select("name", "path", "digest") if held else spark.createDataFrame([], "name string, path string, digest string")
    # Stored owners of other files than those that are read now.
    elsewhere = before.join(paths, "path", "left_anti").where("path like 'memories/%' and name <> path").select(F.col("name").alias("ref"), "path")
    records, twice = sole(records, elsewhere)
    with ThreadPoolExecutor(2) as pool:
        records, twice = pool.map(save, (records, twice), ("sole", "twice"))
    brain = project(notes, records, config, tz)
    staged = save(search.counted(brain.passages), "counted")
    size = search.owners_of(staged).select("name", "passages", "tokens")
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    own = notes.where("problem is null").select(F.col("path").alias("name"), "path", digest(notes).alias("digest"))
    path = F.concat(F.lit("memories/"), "source", F.lit("/"), "partition", F.lit(".jsonl"))
    said = records.withColumn("fields", F.to_json("fields")).drop("file")
    own = own.unionByName(records.withColumn("fields", F.to_json("fields")).select(F.concat_ws(":", "source", "id").alias("name"), path.alias("path"), F.sha2(F.to_json(F.struct(*sorted(said.columns))), 256).alias("digest")))
    own = own.join(size, "name", "left").na.fill(0, ["passages", "tokens"])
    listed = spark.createDataFrame(sorted(changed.items()), "path string, digest string")
    fresh = save(own, "owners")
    kinds = fresh.join(before.select("name", F.col("digest").alias("was"), F.col("path").alias("old")), "name", "left")
    same = (F.col("was") == F.col("digest")) & (F.col("old") == F.col("path"))
    kinds = save(kinds.select("name", F.when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("changed").alias("kind")), "kinds")
    lost = before.join(paths, "path", "left_semi").where("name <> path or path not like 'memories/%'").select("name").join(fresh.select("name"), "name", "left_anti")
    counts |= {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()} | {"removed": lost.count()}
    new = kinds.where("kind <> 'unchanged'").select(F.col("name").alias("owner"))
    some = counts["added"] + counts["changed"]
    live = F.broadcast(new) if some <= 200_000 else new
    pick = lambda df, column: df.join(live, df[column] == live["owner"], "left_semi")
    items, edges = pick(brain.items, "ref"), pick(brain.edges, "item")
    tables = graph.tables(items, pick(brain.names, "item"), pick(brain.links, "item"), edges)
    tables |= {"passages": pick(brain.passages, "ref").withColumn("owner", F.col("ref")), "links": pick(brain.links, "item").withColumn("owner", F.col("item")), **search.tables(staged.join(live, "owner", "left_semi"), True, 1 if some <= FEW_ITEMS else search.files_for(staged)[0])}
    problems = notes.where("problem is not null").select(F.col("path").alias("file"), "problem").unionByName(bad).withColumn("again", F.lit(""))
    tables["problems"] = problems.unionByName(twice).withColumn("owner", F.concat(F.lit("!"), "file"))
    # A file is an owner of its line in the manifest, and of its problems.
    tables["files"] = listed.withColumn("owner", F.concat(F.lit("/"), "path"))
    tables["owners"] = pick(fresh, "name").select("name", "path", "digest", "passages", "tokens").unionByName(
        listed.select(F.concat(F.lit("/"), "path").alias("name"), F.lit("").alias("path"), "digest", F.lit(0).cast("bigint").alias("passages"), F.lit(0).cast("bigint").alias("tokens"))
    )
    old = kinds.where("kind = 'changed'").select(F.col("name").alias("owner")).unionByName(lost.select(F.col("name").alias("owner")))
    old = old.unionByName(paths.select(F.explode(F.array(F.concat(F.lit("/"), "path"), F.concat(F.lit("!"), "path"))).alias("owner")))
    # A change of few items is one folder of each table, and needs no counting.
    sizes = dict.fromkeys(tables, some) if some <= FEW_ITEMS else {}
    body = kept.apply(tables, old, {**told}, fresh=held is None, sizes=sizes)
    sinks.remove(spark, step)
    return kept, body, counts


def open_brain(spark: SparkSession, root: str, config: Config, tz: str = "UTC", store: str | None = None) -> Brain:
    """The tables of a folder as its files are now; see `refresh`. Unreadable files
    are problems beside the answer."""
    kept, body, _ = refresh(spark, root, config, tz, store)
    rows = [kept.table(t, body) for t in TABLES[:-1]]
    rows[TABLES.index("names")] = rows[TABLES.index("names")].drop("time")
    return Brain(config.name, *rows, kept.table("problems", body).select("file", "problem"), search.Index(kept, body, True), graph.Graph.stored(kept, body))


def manifest_digest(manifest: DataFrame) -> str:
    """Of all files (path, digest) together, in any order."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "path", "digest"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("s")).first()
    return f"{row.n}-{row.s or 0}"


def dated(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """ts: when an item lies; changed: when it last changed. Notes have local dates."""
    note = note_time(F.col("day"), tz)
    return items.withColumns({"ts": F.coalesce("time", note), "changed": modified(note, F.col("updated"), F.col("time"))})
