"""Order MinHash fingerprints, in DataFrame functions alone.

The k-mers of a text are runs of K words. Each is numbered by its occurrence, so
(k-mer, occurrence) is unique in the text; its hash falls in one of BINS bins. In
each bin the two smallest are selected, put back into text order and hashed as a
pair: moving a passage changes the pairs although the set of k-mers is the same,
which makes the signature sensitive to edit distance. A packed long (hash above
position) lets one primitive sort group equal k-mers in text order and a second
one order the bins, so a text costs O(n log n) and nothing is exploded.

Likeness: equal pairs over the bins that either text fills.

Each document meets the next one by descending doc_id. All documents are cut into
CELLS at most by quantiles of their ids (an id that very many rows share, and rows
without one, have cells of their own, cut by the texts' hashes), whatever ids look like; the first document of
the next cell visits each cell as a guest. A cell has about CELL_ROWS documents, or
1 / CELLS of all, and a text moves once.

Defined cases: null and empty texts have an empty fingerprint; two empty ones
are alike by 1, an empty and another by 0; fewer than K words make one k-mer;
a bin with one k-mer hashes it alone; documents with a null doc_id follow those
with the least one; rows that repeat a doc_id follow each other in the order of
their text's hash; the only row of a table is its own next; further columns are
ignored. Hashes have 32 bits and places 31, as many as a string can have words.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import table

K, BINS = 3, 64
#: Bits of a place in the text, below those of a hash, in one long.
PLACE, HASH = 31, 32
_POS, _HASH = (1 << PLACE) - 1, (1 << HASH) - 1
#: Documents of a cell, in which the next document is found by a window; most cells.
CELL_ROWS, CELLS = 4096, 1 << 16
#: Most cells of an id that more rows share than a cell should have: by top bits of a hash.
SHARED_BITS = 16


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: generators are not inlined."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: array<int>, one entry for each filled bin (bin above hash)."""
    columns = df.columns
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    df = _held(df, "_w", F.coalesce(words, F.array().cast("array<string>")))
    w = F.col("_w")
    n = F.when(F.size(w) >= K, F.size(w) - (K - 1)).otherwise(F.least(F.size(w), F.lit(1)))
    packed = F.transform(
        _upto(n),
        lambda i: F.shiftleft(F.xxhash64(*[F.get(w, i + j) for j in range(K)]).bitwiseAND(F.lit(_HASH)), PLACE).bitwiseOR(i.cast("bigint")),
    )
    df = _held(df, "_s", F.sort_array(packed)).drop("_w")
    s = F.col("_s")
    of = lambda i, bits: F.shiftrightunsigned(F.get(s, i), bits)
    df = _held(df, "_r", F.filter(_upto(F.size(s)), lambda i: (i == 0) | (of(i, PLACE) != of(i - 1, PLACE))))
    runs = F.col("_r")
    numbered = F.flatten(
        F.transform(
            runs,
            lambda start, r: F.transform(
                F.slice(s, start + 1, F.coalesce(F.get(runs, r + 1), F.size(s)) - start),
                lambda x, turn: F.shiftleft(
                    F.xxhash64(F.shiftrightunsigned(x, PLACE), turn).bitwiseAND(F.lit(_HASH)), PLACE
                ).bitwiseOR(x.bitwiseAND(F.lit(_POS))),
            ),
        )
    )
    df = _held(df, "_o", F.sort_array(numbered)).drop("_s", "_r")
    o = F.col("_o")
    bin_bits = PLACE + HASH - (BINS - 1).bit_length()
    cell = lambda i: F.shiftrightunsigned(F.get(o, i), bin_bits)
    df = _held(df, "_b", F.filter(_upto(F.size(o)), lambda i: (i == 0) | (cell(i) != cell(i - 1))))

    def pair(i: Column) -> Column:
        first, second = F.get(o, i), F.when(cell(i + 1) == cell(i), F.get(o, i + 1))
        ahead = second.isNull() | (first.bitwiseAND(F.lit(_POS)) <= second.bitwiseAND(F.lit(_POS)))
        one, two = F.shiftrightunsigned(first, PLACE), F.shiftrightunsigned(second, PLACE)
        tuple_hash = F.xxhash64(F.when(ahead, one).otherwise(two), F.when(ahead, two).otherwise(one))
        low = tuple_hash.bitwiseAND(F.lit((1 << 26) - 1))
        # bin above hash in 32 bits, moved into the range of int
        return (F.shiftleft(cell(i), 26).bitwiseOR(low) - F.lit(1 << 31)).cast("int")

    return _held(df, name, F.transform(F.col("_b"), pair)).select(*columns, name)


def likeness(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    bins = F.size(F.array_distinct(F.transform(F.concat(x, y), lambda v: F.shiftright(v, 26))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / bins)


def text_of(signature: str) -> Column:
    return F.array_join(
        F.transform(F.col(signature), lambda v: F.lpad(F.lower(F.hex(v.cast("bigint") + F.lit(1 << 31))), 8, "0")), ""
    )


def _place(bounds: list[int]) -> Column:
    """How many of the sorted `bounds` are at most `key`: two steps over a literal
    array of arrays, each of about the square root of their number."""
    wide = max(1, math.isqrt(len(bounds)))
    cut = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    tops = F.from_json(F.lit(json.dumps([x[0] for x in cut])), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps(cut)), "array<array<bigint>>")
    upto = lambda held: F.size(F.filter(held, lambda x: x <= F.col("key")))
    row = upto(tops)
    return F.when(row > 0, (row - 1) * F.lit(wide) + upto(F.get(parts, row - 1))).otherwise(0)


def _cells(docs: DataFrame) -> Column:
    """The cell of a row (columns key and row); greater cells come first."""
    keys = docs.where("key is not null").select("key")
    n = keys.count()
    cells = min(CELLS, n // CELL_ROWS)
    bounds: set[int] = set()
    if cells > 1:
        found = keys.agg(F.percentile_approx("key", [i / cells for i in range(1, cells)], max(10_000, 4 * cells))).first()[0]
        bounds |= set(found)
    # Ids with more rows than four cells should have (at most CELLS / 4 of them), and
    # rows without an id: as many cells as their rows ask for, by the top bits of the hash.
    each = max(CELL_ROWS, n // CELLS)
    bits = lambda m: min(SHARED_BITS, max(0, math.ceil(math.log2(max(1, m / each)))))
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * each).collect()
    parts = {r.key: bits(r.n) for r in often}
    bounds |= {k for x in parts for k in (x, x + 1) if k < 1 << 63}
    cell = (_place(sorted(bounds)) if bounds else F.lit(0)).cast("bigint")
    # Rows of one id follow each other by ascending hash, so the least comes first.
    top = F.lit((1 << SHARED_BITS) - 1) - (F.shiftright("row", 64 - SHARED_BITS) + F.lit(1 << (SHARED_BITS - 1)))
    cut = lambda held: F.call_function("shiftright", top.cast("bigint"), F.lit(SHARED_BITS) - held)
    part = F.lit(0).cast("bigint")
    if parts:
        shared = F.from_json(F.lit(json.dumps({str(k): v for k, v in sorted(parts.items())})), "map<string,int>")
        part = F.coalesce(cut(F.element_at(shared, F.col("key").cast("string"))), part)
    none = cut(F.lit(bits(docs.where("key is null").count()))) - F.lit(1 << SHARED_BITS)
    return F.when(F.col("key").isNull(), none).otherwise(F.shiftleft(cell, SHARED_BITS) + part)


def with_next(docs: DataFrame, columns: list[str], add) -> DataFrame:
    """Each row of `docs` (doc_id, row, ...), after `add`, beside `next_<column>`
    of the next by descending doc_id, nulls last, the first after the last. The
    first row of the next cell visits each cell as a guest; first rows are found on
    ids alone, before `add` computes anything, and are one for each cell."""
    docs = docs.withColumn("key", F.col("doc_id"))
    docs = docs.withColumn("cell", _cells(docs)).drop("key")
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    # Sorts like `order`, descending: nulls are less than any value in a struct.
    rank = F.struct("doc_id", F.bitwise_not("row").alias("turned"))
    heads = docs.groupBy("cell").agg(F.max(rank).alias("head"))
    down = Window.orderBy(F.desc("cell"))  # one row a cell: at most CELLS and those of shared ids
    around = F.max(F.struct("cell", "head")).over(Window.partitionBy())
    heads = heads.select(F.col("cell").alias("host"), F.coalesce(F.lead(F.struct("cell", "head")).over(down), around).alias("next"))
    visits = F.broadcast(heads.select("host", F.col("next.cell").alias("home"), F.col("next.head.doc_id").alias("id"), F.bitwise_not("next.head.turned").alias("hash")))
    met = (F.col("cell") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("hash"))
    guests = docs.join(visits, met).dropDuplicates(["host"]).withColumn("cell", F.col("host")).drop("host", "home", "id", "hash")
    both = add(docs.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1))))
    inside = Window.partitionBy("cell").orderBy("guest", *order)
    return both.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns]).where("guest = 0").drop("guest", "cell")


def fingerprints(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    base = with_next(base, ["text", "sig"], lambda rows: with_signature(rows, "text", "sig"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    base = _held(base.select("doc_id", n.cast("bigint").alias("n_chars"), "sig", "next_sig", edited.alias("_e")), "edited", F.col("_e")).drop("_e")
    base = with_signature(base.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_sig")
    return base.select(
        "doc_id", "n_chars", "edited_sha256", text_of("sig").alias("fingerprint"), text_of("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
