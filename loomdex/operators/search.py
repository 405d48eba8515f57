"""Word search: stored postings, corpus statistics, BM25, best passage, federation.

An index is a store of segments: postings (a row for each term of a passage and
field) in order of the term, a vocabulary from stems to words, and of
each ref how many passages and tokens it has, so that statistics follow every change.
Postings stay with their passage: a file holds some refs, in order of the term, so none
is shuffled, and a query reads its terms' pages of every file. A change writes the
passages of the refs that are new or others, and marks what is gone. Stems are looked
up in the vocabulary, so the same postings serve whole words and stems.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex import sinks
from loomdex.functions.text import excerpt, query_stems, query_terms, stem_of, stems, tokens
from loomdex.sources.segments import BROADCAST, LITERALS, Store

K1, B = 1.2, 0.75
WEIGHTS = {"heading": 10.0, "title": 10.0, "text": 1.0, "names": 0.5}
#: Status values that rank after all others.
DEMOTED = ("deprecated", "archived")


def _split(stemmed: bool):
    return stems if stemmed else tokens


def _fields(passages: DataFrame) -> list[str]:
    return [c for c in WEIGHTS if c in passages.columns]


def _tokened(passages: DataFrame, stemmed: bool) -> tuple[DataFrame, list[str], Column]:
    """(passages with an array of tokens for each searched column, the other
    columns, tokens in all)."""
    fields = _fields(passages)
    kept = [c for c in passages.columns if c not in fields]
    out = passages.select(*kept, *[_split(stemmed)(F.col(c)).alias(f"_{c}") for c in fields])
    return out, kept, sum((F.size(f"_{c}") for c in fields[1:]), F.size(f"_{fields[0]}"))


def lengths(passages: DataFrame, stemmed: bool = False) -> DataFrame:
    """Adds d: the tokens of a passage over its searched columns."""
    split, fields = _split(stemmed), _fields(passages)
    return passages.withColumn("d", sum((F.size(split(F.col(c))) for c in fields[1:]), F.size(split(F.col(fields[0])))))


def _counted(arrays: list[tuple[str, float]], term: Column) -> Column:
    hits = [F.lit(w) * F.size(F.filter(c, lambda x: x == term)) for c, w in arrays]
    return sum(hits[1:], hits[0])


def postings(passages: DataFrame, terms: list[str], stemmed: bool = False) -> DataFrame:
    """passage columns, term, f (weighted frequency), d; a row per matching term.
    Occurrences are counted inside the row, so texts are not exploded."""
    rows, kept, d = _tokened(passages, stemmed)
    arrays = [(f"_{c}", WEIGHTS[c]) for c in _fields(passages)]
    freq = F.array(*[F.struct(F.lit(t).alias("term"), _counted(arrays, F.lit(t)).alias("f")) for t in terms])
    return rows.withColumn("d", d).withColumn("m", F.explode(freq)).select(*kept, "d", "m.term", "m.f").where("f > 0")


def statistics(passages: DataFrame, stemmed: bool = False) -> DataFrame:
    return lengths(passages, stemmed).agg(F.count(F.lit(1)).alias("n_passages"), F.sum("d").alias("n_tokens"), F.avg("d").alias("avg_len"))


def _parts(found: DataFrame, n_passages: Column, avg_len: Column) -> DataFrame:
    """Postings (term, f, d) with `part`, what a term adds to a passage's score."""
    df = F.broadcast(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row for each query term
    idf = F.ln((n_passages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / avg_len))
    return found.join(df, "term").withColumn("part", part)


def _scores(found: DataFrame, n_passages: Column, avg_len: Column, keep: list[str]) -> DataFrame:
    """keep..., score of postings (term, f, d)."""
    return _parts(found, n_passages, avg_len).groupBy(*keep).agg(F.sum("part").alias("score"))


def bm25(passages: DataFrame, query: str, keep: list[str], stemmed: bool = False) -> DataFrame:
    """keep..., score, without an index. Statistics span all passages, whatever the
    scope; a term in half of them or more scores next to nothing but still matches.
    `stemmed` matches words by their stems without accents, in texts and query alike."""
    terms = query_stems(query) if stemmed else query_terms(query)
    held = postings(passages, terms, stemmed).join(F.broadcast(statistics(passages, stemmed)))  # one row
    return _scores(held, F.col("n_passages"), F.col("avg_len"), keep)


# --- the stored index ---

#: Tables of an index in a store, and the columns they are looked up by.
KEYS = {"postings": "term", "vocabulary": "stem"}
#: Of what is stored; an index of another format is built anew.
FORMAT = 4
#: Tables whose rows stay with their owners, in order of the key; tokens of a file of them.
DEALT, FILE_TOKENS, LEAST_TOKENS = ("postings",), 1_500_000, 100_000
#: A run of equal words in a sorted text of words with one blank between them.
_RUN = r"([^ ]++)(?: \1(?= |\z))*+"


@dataclass(frozen=True)
class Index:
    """The index of one commit of a store: every read of a query sees that commit.
    Owners are refs; passages are (ref, fragment)."""

    store: Store
    at: dict
    stemmed: bool = False

    def statistics(self) -> tuple[int, float]:
        """Live passages and their mean length."""
        n = self.at["sums"].get("passages", 0)
        return n, self.at["sums"].get("tokens", 0) / n if n else 0.0

    def hits(self, wanted: dict[str, list[str]]) -> DataFrame:
        """Postings of the terms that `wanted` gives for each term of the store: a row
        a term and passage, summed over fields and over words of one stem."""
        rows = self.store.lookup("postings", list(wanted), self.at)
        if all(to == [word] for word, to in wanted.items()):
            named = rows
        elif len(wanted) <= LITERALS:
            pairs = [x for word, to in wanted.items() for x in (F.lit(word), F.array(*[F.lit(t) for t in to]))]
            named = rows.withColumn("term", F.explode(F.element_at(F.create_map(*pairs), F.col("term"))))
        else:
            said = self.store.spark.createDataFrame([(word, t) for word, to in wanted.items() for t in to], "term string, stem string")
            named = rows.join(F.broadcast(said), "term").drop("term").withColumnRenamed("stem", "term")
        keep = [c for c in named.columns if c not in ("f", "n")]
        return named.groupBy(*keep).agg(F.sum("f").alias("f"))

    def words_of(self, stems_: list[str]) -> dict[str, list[str]]:
        """The words of the texts that have one of these stems. A stem has few words;
        they choose the folders that are opened."""
        rows = self.store.lookup("vocabulary", stems_, self.at).select("stem", "term").distinct().collect() if stems_ else []
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r.term, []).append(r.stem)
        return out

    def wanted(self, query: str, stemmed: bool) -> dict[str, list[str]]:
        """The terms that the words of the texts stand for in this query."""
        return self.words_of(query_stems(query)) if stemmed else {t: [t] for t in query_terms(query)}

    def find(self, query: str, where: Column | None = None, stemmed: bool | None = None) -> DataFrame:
        """ref, fragment, score of every matching passage. The score is doubled for
        distilled notes; `where` filters on the columns of passages, not the statistics."""
        stemmed = self.stemmed if stemmed is None else stemmed
        hit = self.hits(self.wanted(query, stemmed))
        keep = [c for c in hit.columns if c not in ("term", "f", "d")]
        n, mean = self.statistics()
        scored = _scores(hit, F.lit(n), F.lit(mean), keep)
        if "weight" in keep:
            scored = scored.withColumn("score", F.col("score") * F.col("weight"))
        return scored if where is None else scored.where(where)

    def returned(self, top: DataFrame, query: str, texts: DataFrame, stemmed: bool | None = None) -> DataFrame:
        """`top` (bounded rows) with an excerpt: only their texts are read again."""
        stemmed = self.stemmed if stemmed is None else stemmed
        few = F.broadcast(top.select("ref", "fragment").distinct())
        held = texts.join(few, ["ref", "fragment"], "left_semi").select("ref", "fragment", excerpt(F.col("text"), self.wanted(query, stemmed)).alias("excerpt"))
        return top.join(F.broadcast(held), ["ref", "fragment"], "left")


def runs(words: Column) -> Column:
    """term, n of the different words (without blanks) of an array, counted in the row."""
    each = F.get(F.transform(F.array(_sorted(words)), lambda s: F.arrays_zip(_found(s, 1).alias("term"), _found(s, 0).alias("run"))), 0)
    return F.transform(each, lambda x: F.struct(x["term"].alias("term"), _length_of(x["run"], x["term"]).alias("n")))


def _sorted(words: Column) -> Column:
    """The words in order as one text: equal ones are neighbours, and a run of them is
    found by one regular expression, without a lambda for each word."""
    return F.array_join(F.sort_array(words), " ")


def _found(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(group))


def _length_of(run: Column, term: Column) -> Column:
    """How often the run repeats its term."""
    return ((F.octet_length(run) + 1) / (F.octet_length(term) + 1)).cast("int")


def counted(passages: DataFrame) -> DataFrame:
    """owner (the ref), the other columns of passages, digest (of the whole row), d
    and of each searched column its words in order (`_sorted`). Texts are tokenised here
    and only here."""
    fields = _fields(passages)
    kept = [c for c in passages.columns if c not in fields]
    out = passages.select(F.col("ref").alias("owner"), *kept, F.xxhash64(*passages.columns).alias("digest"), *[_sorted(tokens(F.col(c))).alias(f"words_{c}") for c in fields])
    each = [F.when(F.col(f"words_{c}") == "", 0).otherwise(F.octet_length(f"words_{c}") - F.octet_length(F.replace(F.col(f"words_{c}"), F.lit(" "), F.lit(""))) + 1) for c in fields]
    return out.withColumn("d", sum(each[1:], each[0]))


def owners_of(staged: DataFrame) -> DataFrame:
    """name, digest, passages, tokens of each ref."""
    digest = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string"))
    return staged.groupBy(F.col("owner").alias("name")).agg(digest.alias("digest"), F.count(F.lit(1)).alias("passages"), F.sum("d").cast("bigint").alias("tokens"))


def tables(staged: DataFrame, stemmed: bool, files: int) -> dict[str, DataFrame]:
    """Postings, a task for each of `files`, and, for stemmed search, the vocabulary: each
    different word meets the stemmer once, whatever its occurrences. The counted passages
    are dealt, not their postings."""
    fields = [c for c in WEIGHTS if f"words_{c}" in staged.columns]
    kept = [c for c in staged.columns if c != "digest" and c not in [f"words_{f}" for f in fields]]
    rows = staged.repartition(files, "owner").select(*kept, *[_found(F.col(f"words_{c}"), 0).alias(f"_runs_{c}") for c in fields])
    # The runs of all fields follow each other; where a field's runs end tells their weight.
    ends = [sum((F.size(f"_runs_{c}") for c in fields[1 : i + 1]), F.size(f"_runs_{fields[0]}")).alias(f"_end_{c}") for i, c in enumerate(fields[:-1])]
    rows = rows.select(*kept, *ends, F.concat(*[F.col(f"_runs_{c}") for c in fields]).alias("_runs"))
    rows = rows.select(*kept, *[f"_end_{c}" for c in fields[:-1]], F.posexplode("_runs").alias("_at", "_run")).withColumn("term", F.substring_index("_run", " ", 1))
    weight = F.coalesce(*[F.when(F.col("_at") < F.col(f"_end_{c}"), WEIGHTS[c]) for c in fields[:-1]], F.lit(WEIGHTS[fields[-1]]))
    rows = rows.withColumns({"n": _length_of(F.col("_run"), F.col("term")), "_weight": weight})
    out = {"postings": rows.select(*kept, "term", "n", (F.col("_weight") * F.col("n")).alias("f"))}
    if stemmed:
        words = staged.select(F.explode(F.concat(*[_found(F.col(f"words_{c}"), 1) for c in fields])).alias("term")).distinct()
        out["vocabulary"] = words.select("term", stem_of(F.col("term")).alias("stem"))
    return out


def store_at(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, KEYS, ("vocabulary",), DEALT)


def files_for(staged: DataFrame) -> tuple[int, int]:
    """Into how many files the postings are dealt, so that a task sorts them in memory,
    and how many tokens there are."""
    n = int(staged.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0])
    few = min(staged.sparkSession.sparkContext.defaultParallelism, n // LEAST_TOKENS)
    return max(1, few, -(-n // FILE_TOKENS)), n


def _stage(passages: DataFrame, root: str) -> tuple[DataFrame, str, tuple[int, int]]:
    """The counted passages, written once below the store; their folder and
    `files_for`."""
    spark, path = passages.sparkSession, f"{root}/stage-{uuid.uuid4().hex}"
    counted(passages).write.parquet(path)
    staged = spark.read.parquet(path)
    return staged, path, files_for(staged)


def build(passages: DataFrame, root: str, stemmed: bool = False, note: dict | None = None) -> Index:
    """Index `passages` (ref, fragment, further columns to filter on, and the searched
    ones) anew: one tokenisation, one shuffle of the passages' words."""
    spark, store = passages.sparkSession, store_at(passages.sparkSession, root)
    staged, path, (files, n) = _stage(passages, root)
    at = store.apply({"owners": owners_of(staged), **tables(staged, stemmed, files)}, note={"format": FORMAT, "stemmed": stemmed, **(note or {})}, fresh=True, sizes={"postings": n, "vocabulary": n // 20})
    sinks.remove(spark, path)
    return Index(store, at, stemmed)


def refresh(index: Index, passages: DataFrame, removed: DataFrame | None = None, note: dict | None = None) -> tuple[Index, dict[str, int]]:
    """The index after a change: `passages` has all passages of the refs that may be
    new or changed, `removed` the refs (ref) that are gone. Only refs whose passages
    are others than before are written. Returns how many were added, changed,
    unchanged and removed."""
    store, spark = index.store, index.store.spark
    staged, path, (files, size) = _stage(passages, store.root)
    fresh, before = owners_of(staged), index.store.owners(index.at)
    told = fresh.select("name", F.col("digest").alias("is")).join(before.select("name", F.col("digest").alias("was")), "name", "left")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    told.select("name", kind.alias("kind")).write.parquet(f"{path}-kinds")
    kinds = spark.read.parquet(f"{path}-kinds")
    counts = {k: 0 for k in ("added", "changed", "unchanged", "removed")} | {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    new = kinds.where("kind <> 'unchanged'").select(F.col("name").alias("owner"))
    gone = kinds.where("kind = 'changed'").select(F.col("name").alias("owner"))
    if removed is not None:
        lost = removed.select(F.col("ref").alias("owner")).distinct().join(before.select(F.col("name").alias("owner")), "owner", "left_semi")
        lost = lost.join(fresh.select(F.col("name").alias("owner")), "owner", "left_anti")
        counts["removed"] = lost.count()
        gone = gone.unionByName(lost)
    some = counts["added"] + counts["changed"]
    if some or counts["removed"]:
        live = staged.join(F.broadcast(new) if some <= BROADCAST else new, "owner", "left_semi")
        add = {"owners": owners_of(live), **tables(live, index.stemmed, files)} if some else {}
        at = store.apply(add, gone, {**index.at["note"], **(note or {})}, sizes={"postings": size, "vocabulary": size // 20})
        index = Index(store, at, index.stemmed)
    sinks.remove(spark, path)
    sinks.remove(spark, f"{path}-kinds")
    return index, counts


def open_index(spark: SparkSession, root: str) -> Index | None:
    store = store_at(spark, root)
    held = store.head()
    return Index(store, held, bool(held["note"].get("stemmed"))) if held and held["note"].get("format") == FORMAT else None


# --- many questions at once ---


def find_all(index: Index, queries: DataFrame, limit: int, stemmed: bool | None = None) -> DataFrame:
    """name, ref, fragment, score, rank of the first `limit` refs of every query (name,
    query): a table of queries and terms meets the postings once, and all queries are
    scored and cut in one plan. The order is that of `ranked` with one best passage. What
    was found is dealt by ref once; all sums of a passage and its ref are made there, and
    `limit` rows a task and query are left to meet."""
    spark = index.store.spark
    stemmed = index.stemmed if stemmed is None else stemmed
    cut = query_stems if stemmed else query_terms

    @F.udf("array<string>")
    def terms_of(text: str) -> list[str]:
        return cut(text or "")

    asked = queries.select("name", F.explode(terms_of("query")).alias("term")).distinct()
    # A query has MAX_TERMS terms at most, so this is bounded by the queries.
    if stemmed:
        words = index.store.table("vocabulary", index.at).select("stem", "term").distinct()
        asked = asked.withColumnRenamed("term", "stem").join(words, "stem").select("name", F.col("stem").alias("as"), "term")
    else:
        asked = asked.select("name", F.col("term").alias("as"), "term")
    few = asked.limit(BROADCAST + 1).count() <= BROADCAST
    posts = index.store.table("postings", index.at)
    wanted = asked.select("term", "as").distinct()
    hit = posts.join(F.broadcast(wanted) if few else wanted, "term").drop("term", "n").withColumnRenamed("as", "term").repartition("ref")
    keep = [c for c in hit.columns if c not in ("term", "f", "d")]
    hit = hit.groupBy(*keep, "d", "term").agg(F.sum("f").alias("f"))
    n, mean = index.statistics()
    parts = _parts(hit, F.lit(n), F.lit(mean))
    asks = asked.select("name", F.col("as").alias("term")).distinct()
    scored = parts.join(F.broadcast(asks) if few else asks, "term").groupBy("name", *keep).agg(F.sum("part").alias("score"))
    if "weight" in keep:
        scored = scored.withColumn("score", F.col("score") * F.col("weight"))
    scored = scored.withColumn("score", F.round("score", 6))
    best = Window.partitionBy("name", "ref").orderBy(F.desc("score"), "fragment")
    late = F.coalesce(F.col("status").isin(*DEMOTED), F.lit(False)) if "status" in keep else F.lit(False)
    order = Window.partitionBy("name").orderBy(late, F.desc("score"), "ref")
    one = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("name", "ref", "fragment", "score", "rank")


# --- what is returned ---


def best_passage(scored: DataFrame) -> DataFrame:
    """The highest passage of each ref, ties to the smaller fragment."""
    order = Window.partitionBy("ref").orderBy(F.desc("score"), F.asc("fragment"))
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """The first `limit` by (demoted, score, ref) with their rank. The sort keeps
    `limit` rows of each task; only those meet in one."""
    late = F.coalesce(F.col(status).isin(*DEMOTED), F.lit(False)) if status else F.lit(False)
    top = rows.withColumn("_late", late).withColumn("score", F.round("score", 6)).orderBy("_late", F.desc("score"), "ref").limit(limit)
    order = Window.orderBy("_late", F.desc("score"), "ref")
    return top.withColumn("rank", F.row_number().over(order)).drop("_late")


def interleave(rows: DataFrame, limit: int) -> DataFrame:
    """Scores of different corpora don't compare: first ranks first, by brain."""
    order = Window.orderBy("rank_in_brain", "brain")
    top = rows.orderBy("rank_in_brain", "brain").limit(limit)
    return top.withColumn("rank", F.row_number().over(order))
