"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are the different word sequences, columns are the
n-grams. The matrix is cut into blocks of columns; in a block the product of the
matrix with its transpose counts, for each pair of rows, the columns they share,
and the counts of all blocks are added. Bounds from the set sizes keep the
product sparse without losing a link:

* a set of n needs only its first n - ceil(t n) + 1 columns in a fixed order of
  all n-grams (a partner shares one of them); of the smaller set the first
  n - ceil(2 t n / (1 + t)) + 1 do;
* sizes must lie within t of each other;
* parity bitmaps bound the symmetric difference from below, and so the overlap
  from above; pairs under the needed overlap are discarded;
* pairs that are left are counted exactly on their whole sets.

The order puts n-grams that many first columns hold last (counted over all rows,
twice, as new ones move up). Groups of near copies are tied to one of their own
before the product, by exact counts in a few rounds of pivots; columns whose rows are
all tied together need no pairs, nor do two rows tied together. Rows with many
common columns bring their bitmaps into the product. Equal word sequences are one row of the matrix.

Defined cases: null and blank texts have no n-grams and link with nothing; fewer
words than `width` make one n-gram of the whole sequence; rows with a null
doc_id take no part and have a null component; rows that repeat a doc_id are one
node; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import OFTEN, arrow_map, mix64, release, shards_for, spread_left, table, texts, written

WIDTH, PERCENT = 5, 80
#: Columns that more first columns hold than this go last in the order.
COMMON = 16
#: Values sent to the mappers at once (common n-grams, row ids): above it, the
#: threshold doubles for n-grams and ids are joined instead.
SENT = 2_000_000
KEYS = 6
#: Cells for each element in the bitmaps that the product reads.
FINE = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Words(dict):
    """Hash of each word met so far, as eight bytes."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_digest(word)
        return found


def grams(body: bytes, width: int = WIDTH, known: Words | None = None) -> tuple[np.ndarray, bytes]:
    """Sorted different n-gram hashes of a text and the digest of its words.
    bytes.lower and bytes.split know ASCII alone: A-Z and [\\x20\\x09-\\x0D]."""
    import xxhash

    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64), b""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    known = Words() if known is None else known
    h = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64)
    if len(words) < width:
        return mix64(np.frombuffer(digest[:8], np.uint64) ^ np.uint64(len(words))), digest
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += mix64(h[j : j + n] * _ODD[j % len(_ODD)] + np.uint64(j))
    return np.unique(mix64(total)), digest


def needed(total: int | np.ndarray, percent: int = PERCENT):
    """Least overlap of a link whose sizes add to `total`."""
    return -(-percent * total // (100 + percent))


def first_columns(sets: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, int, bool]:
    """The columns in which a partner must meet this set, how many of them serve
    as the smaller side, and whether a tenth of its columns are common."""
    n = len(sets)
    many = n - -(-percent * n // 100) + 1
    if len(common):
        at = np.searchsorted(common, sets)
        at[at == len(common)] = 0
        late = common[at] == sets
        sets = np.concatenate([sets[~late], sets[late]])
    rare = n - int(late.sum()) if len(common) else n
    return sets[:many], n - int(needed(2 * n, percent)) + 1, rare < many or 10 * rare <= 9 * n


def bitmap(sets: np.ndarray, scale: int = 1) -> bytes:
    """Parity of the elements in each of about scale * n cells; a finer map gives
    a tighter bound."""
    bits = max(64, min(1 << 16, scale << max(0, len(sets) - 1).bit_length()))
    odd = np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Most that the sets behind two bitmaps can share."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def repeated(f: np.ndarray) -> np.ndarray:
    """Which values of `f` it holds more than once."""
    s = np.sort(f)
    many = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(many):
        return np.zeros(len(f), bool)
    return many[np.minimum(np.searchsorted(many, f), len(many) - 1)] == f


class Bitmaps:
    """Bitmaps of the rows of a block, in a matrix for each length."""

    def __init__(self, bits: list[bytes]):
        self.size = np.array([len(b) for b in bits], np.int64)
        self.at = np.zeros(len(bits), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for n in np.unique(self.size[self.size > 0]).tolist():
            mine = np.flatnonzero(self.size == n)
            self.at[mine] = np.arange(len(mine))
            self.of[n] = np.frombuffer(b"".join([bits[i] for i in mine]), np.uint64).reshape(len(mine), -1)

    def overlap_bounds(self, i: int, js: np.ndarray, n: int, ns: np.ndarray) -> np.ndarray:
        """Most that row i can share with each of rows js; unbounded (the smaller
        size) where a row brought no bitmap."""
        out = np.minimum(n, ns)
        if not self.size[i]:
            return out
        for length in np.unique(self.size[js]).tolist():
            if not length:
                continue
            mine = np.flatnonzero(self.size[js] == length)
            x, y = self.of[int(self.size[i])][self.at[i]][None, :], self.of[length][self.at[js[mine]]]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[mine] = np.minimum(out[mine], (n + ns[mine] - np.bitwise_count(x ^ y).sum(1)) // 2)
        return out


_SIG = "doc_id bigint, c1 bigint, c2 bigint, n bigint, keys array<bigint>, bits binary, first binary"


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Digest, size, group keys, bitmap and first columns (in the order of the
    hashes alone) of every text: all that most rows need of their set."""

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        c, n, keys, bits, first = [], [], [], [], []
        edges = (np.arange(3 * KEYS, dtype=np.uint64) * np.uint64((1 << 64) // (3 * KEYS))).astype(np.uint64)
        for body in batch.column("body").to_pylist():
            sets, digest = grams(body, width, state.setdefault("words", Words()))
            c.append(np.frombuffer(digest or bytes(16), "<i8"))
            n.append(len(sets))
            first.append(first_columns(sets, np.zeros(0, np.uint64), percent)[0].tobytes() if len(sets) else b"")
            if not len(sets):
                keys.append([])
                bits.append(b"")
                continue
            least = sets[np.searchsorted(sets, edges) % len(sets)].reshape(KEYS, 3)
            turn = np.arange(KEYS, dtype=np.uint64)
            keys.append(mix64(least[:, 0] ^ mix64(least[:, 1] ^ mix64(least[:, 2] + turn))).view(np.int64).tolist())
            bits.append(bitmap(sets))
        c = np.array(c).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(first, pa.binary())],
            ["doc_id", "c1", "c2", "n", "keys", "bits", "first"],
        )

    return arrow_map(texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), run, _SIG)


def with_rows(docs: DataFrame, few: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of texts with a table of doc_ids: by broadcast while its rows
    are counted below SENT / 4, by shuffle beyond."""
    few = few.select("doc_id", *columns)
    return docs.join(F.broadcast(few) if few.count() <= SENT // 4 else few, "doc_id")


@dataclass
class Rows:
    """One row of the matrix for each word sequence."""

    docs: DataFrame  # doc_id, text
    sig: DataFrame  # of the rows alone
    first: DataFrame  # doc_id, n, first of at least the rows
    width: int
    percent: int

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs whose sets share enough: bitmaps first, then exact."""
        percent, width = self.percent, self.width
        side = lambda p: self.sig.select(F.col("doc_id").alias(p), F.col("n").alias(f"n{p}"), F.col("bits").alias(f"bits{p}"))
        held = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        held = held.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

        def bound(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
            cols = [batch.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")]
            ok = [overlap_bound(x, y, m, n) >= needed(m + n, percent) for x, y, m, n in zip(*cols, strict=True)]
            return batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

        left = written(arrow_map(held, bound, "a bigint, b bigint, na bigint, nb bigint"))
        asked = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()

        def collect(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
            sets = [grams(b, width, state.setdefault("words", Words()))[0].tobytes() for b in batch.column("body").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "sets"])

        sets = written(arrow_map(with_rows(texts(self.docs), asked).select("doc_id", "body"), collect, "doc_id bigint, sets binary"))

        def count(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        one = sets.select(F.col("doc_id").alias("a"), F.col("sets").alias("x"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("sets").alias("y"))
        return arrow_map(left.select("a", "b").join(one, "a").join(two, "b"), count, "a bigint, b bigint").distinct()

    def ties(self, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) of near copies to pivots of their groups, and the
        label (doc_id, label) that rows tied together share. A row has KEYS groups
        (by three least hashes of its set); each round takes another pivot of each
        group and asks the rows that don't share its label yet."""
        keyed = self.sig.select("doc_id", F.explode("keys").alias("key")).distinct()
        many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
        keyed = written(keyed.join(many, "key").withColumn("turn", F.xxhash64("doc_id", F.lit(5))))
        label = own = self.sig.select("doc_id").distinct().withColumn("label", F.col("doc_id"))
        links = self.sig.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
        for r in range(rounds):
            # The pivot: least in this round's order, different in every round.
            order = F.struct(F.xxhash64("turn", F.lit(r)), "doc_id")
            pivots = keyed.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.doc_id").alias("b"))
            near = keyed.join(pivots, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
            la = label.select(F.col("doc_id").alias("a"), F.col("label").alias("x"))
            lb = label.select(F.col("doc_id").alias("b"), F.col("label").alias("y"))
            new = written(self.verified(near.join(la, "a").join(lb, "b").where("x <> y").select("a", "b")))
            links = written(links.union(new))
            reached = components(links)
            label = own.select("doc_id").join(reached.withColumnRenamed("v", "doc_id"), "doc_id", "left")
            label = written(label.select("doc_id", F.coalesce("c", "doc_id").alias("label")))
        return links, label

    def _blobs(self, labels: DataFrame, common: np.ndarray, shards: int, whole: bool) -> DataFrame:
        """First columns by block of columns: shard, f, row (with the smaller-side
        bit), and the table of those rows. Rows none of whose first columns
        is common keep those that the signatures hold; the sets of the others are
        made again from their texts."""
        width, percent = self.width, self.percent
        shared = self.docs.sparkSession.sparkContext.broadcast(common)
        schema = "shard int, f binary, row binary, who binary, bits array<binary>"

        def pack(batch: pa.RecordBatch, firsts: list[np.ndarray], smalls: list[int], sizes: list[int], bits: list[bytes]) -> pa.RecordBatch:
            f = np.concatenate([np.zeros(0, np.uint64), *firsts])
            row = np.concatenate([np.zeros(0, np.uint16), *(np.full(len(x), i, np.uint16) | (np.arange(len(x)) < small).astype(np.uint16) * np.uint16(1 << 15) for i, (x, small) in enumerate(zip(firsts, smalls, strict=True)))]).astype(np.uint16)
            home = (f >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(shards + 1, dtype=np.uint64))
            spans = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]
            none = [b""] * len(spans)
            fs, rows, who, maps = [f[i].tobytes() for _, i in spans], none, none, [[]] * len(spans)
            if whole:
                # A shard gets the rows its columns lie in, not the batch's.
                ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label"))
                table, low, top = np.stack([ids, label, np.array(sizes, np.int64)], 1).astype("<i8"), np.uint16((1 << 15) - 1), np.uint16(1 << 15)
                met = [np.unique(row[i] & low, return_inverse=True) for _, i in spans]
                rows = [(at.astype(np.uint16) | (row[i] & top)).tobytes() for (_, i), (_, at) in zip(spans, met, strict=True)]
                who, maps = [table[own].tobytes() for own, _ in met], [[bits[k] for k in own.tolist()] for own, _ in met]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in spans], pa.int32()), pa.array(fs, pa.binary()), pa.array(rows, pa.binary()),
                 pa.array(who, pa.binary()), pa.array(maps, pa.list_(pa.binary()))],
                ["shard", "f", "row", "who", "bits"],
            )

        def touched(batch: pa.RecordBatch) -> np.ndarray:
            firsts = [np.frombuffer(x, np.uint64) for x in batch.column("first").to_pylist()]
            if not len(shared.value):
                return np.zeros(len(firsts), bool)
            f = np.concatenate([np.zeros(0, np.uint64), *firsts])
            at = np.searchsorted(shared.value, f)
            at[at == len(shared.value)] = 0
            row = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
            return np.bincount(row[shared.value[at] == f], minlength=len(firsts)) > 0

        def held(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch | None:
            batch = batch.filter(pa.array(~touched(batch)))
            sizes = batch.column("n").to_pylist()
            firsts = [np.frombuffer(x, np.uint64) for x in batch.column("first").to_pylist()]
            return pack(batch, firsts, [n - int(needed(2 * n, percent)) + 1 for n in sizes], sizes, [b""] * len(sizes)) if sizes else None

        def remade(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
            firsts, smalls, sizes, bits = [], [], [], []
            for body in batch.column("body").to_pylist():
                sets, _ = grams(body, width, state.setdefault("words", Words()))
                f, small, late = first_columns(sets, shared.value, percent) if len(sets) else (sets, 0, False)
                firsts.append(f)
                smalls.append(small)
                sizes.append(len(sets))
                bits.append(bitmap(sets, FINE) if whole and late else b"")
            return pack(batch, firsts, smalls, sizes, bits)

        def ask(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
            return batch.select(["doc_id", "label"]).filter(pa.array(touched(batch)))

        labelled = with_rows(self.first, labels, ("label",)).select("doc_id", "label", "n", "first")
        blobs = arrow_map(labelled, held, schema)
        if len(common):
            asked = written(arrow_map(labelled, ask, "doc_id bigint, label bigint")).distinct()
            blobs = blobs.unionByName(arrow_map(with_rows(texts(self.docs), asked, ("label",)), remade, schema))
        return blobs

    def common(self, labels: DataFrame, before: np.ndarray, shards: int) -> np.ndarray:
        """n-grams that more than COMMON rows hold among their first columns, with
        `before`; the threshold doubles until they are at most SENT."""

        def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            f, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.f]), return_counts=True)
            return pd.DataFrame({"f": f[n > COMMON].view(np.int64), "n": n[n > COMMON]})

        found = written(self._blobs(labels, before, shards, False).select("shard", "f").groupBy("shard").applyInPandas(count, "f bigint, n bigint"))
        least = COMMON
        while (many := found.where(F.col("n") > least)).count() > SENT:
            least *= 2
        new = np.array([r.f for r in many.select("f").collect()], np.int64).view(np.uint64)
        return np.unique(np.concatenate([before, new]))

    def product(self, labels: DataFrame) -> DataFrame:
        """a, b, shared: pairs of rows under different labels that share first
        columns, with the counts of all blocks added."""
        percent = self.percent
        columns = self.sig.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (100 - percent) / 100
        shards = shards_for(columns * 10, 12e6)
        common = self.common(labels, np.zeros(0, np.uint64), shards)
        common = self.common(labels, common, shards)

        def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            f = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.f])
            # Most columns have one row: of these nothing is made.
            kept = repeated(f)
            if not kept.any():
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "shared": np.zeros(0, np.int64)})
            cuts = np.cumsum([0, *(len(x) // 8 for x in rows.f)])
            row = [np.frombuffer(x, np.uint16)[kept[i:j]] for x, i, j in zip(rows.row, cuts[:-1], cuts[1:], strict=True)]
            f = f[kept]
            small = np.concatenate([r >> np.uint16(15) for r in row]).astype(bool)
            who = np.concatenate([np.frombuffer(w, "<i8").reshape(-1, 3)[r & np.uint16((1 << 15) - 1)] for w, r in zip(rows.who, row, strict=True)])
            base = np.cumsum([0, *map(len, rows.bits)])
            place = np.concatenate([(r & np.uint16((1 << 15) - 1)).astype(np.int64) + x for r, x in zip(row, base, strict=False)])
            met, place = np.unique(place, return_inverse=True)
            bits = [b for batch in rows.bits for b in batch]
            maps = Bitmaps([bits[i] for i in met.tolist()])
            order = np.lexsort((who[:, 0], who[:, 2], f))
            f, small, who, place = f[order], small[order], who[order], place[order]
            edge = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            stop = np.r_[edge[1:], len(f)]
            mixed = np.maximum.reduceat(who[:, 1], edge) != np.minimum.reduceat(who[:, 1], edge)
            out: list[np.ndarray] = []
            for x, y in zip(edge[mixed].tolist(), stop[mixed].tolist(), strict=True):
                ids, label, size, ok, at = who[x:y, 0], who[x:y, 1], who[x:y, 2], small[x:y], place[x:y]
                # Sizes ascend: a row's partners that are not smaller are one span.
                reach = np.searchsorted(size, size * 100 // percent, side="right")
                for i in np.flatnonzero(ok).tolist():
                    j = np.arange(i + 1, reach[i])
                    j = j[label[i + 1 : reach[i]] != label[i]]
                    if len(j):
                        most = maps.overlap_bounds(at[i], at[j], size[i], size[j])
                        j = j[most >= needed(size[i] + size[j], percent)]
                    if len(j):
                        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                        out.append(np.stack([a, b], 1))
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
            pairs, shared = np.unique(pairs, axis=0, return_counts=True)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "shared": shared})

        blocks = self._blobs(labels, common, shards, True).groupBy("shard").applyInPandas(multiply, "a bigint, b bigint, shared bigint")
        return blocks.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex reachable from v, for every vertex of `edges`
    (a, b). Each round takes the least label of the neighbours and jumps to the
    label's own label; it ends when no label changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = held = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        least = label.join(near, "v").select("v", "c", F.least("c", "m").alias("m"))
        own = label.select(F.col("v").alias("m"), F.col("c").alias("up"))
        new = written(least.join(own, "m").select("v", "c", F.least("m", "up").alias("m")))
        changed = new.where("m <> c").limit(1).count()
        release(held)
        held, label = new, new.select("v", F.col("m").alias("c"))
        if not changed:
            release(both)
            return label


@dataclass
class Linked:
    members: DataFrame  # doc_id, n_shingles, component_id of every row
    links: DataFrame  # a, b: verified links that span the components; not all links inside a group of near copies


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> Linked:
    sig = written(signatures(docs, width, percent))
    filled = sig.where("n > 0 and doc_id is not null")
    classes = written(filled.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    rows = written(filled.drop("first").join(classes.select("c1", "c2", F.col("rep").alias("doc_id")), ["doc_id", "c1", "c2"]).dropDuplicates(["doc_id", "c1", "c2"]))
    matrix = Rows(docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rows, filled.select("doc_id", "n", "first"), width, percent)
    ties, labels = matrix.ties()
    links = written(ties.union(matrix.verified(written(matrix.product(labels)))).distinct())
    reached = components(links)
    named = classes.join(reached.withColumnRenamed("v", "rep"), "rep", "left").select("c1", "c2", "copies", F.coalesce("c", "rep").alias("comp"))
    # A word sequence that very many rows hold fills no task.
    members = spread_left(sig.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2"), written(named), ("c1", "c2"), "copies", "doc_id", OFTEN)
    members = members.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return Linked(members.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), links)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).members
