"""Context-tree weighting as a language model of the corpus.

What is modelled is a text's tokens as bytes: its words (lower-case A-Z), a space
between two of them, a line feed at the end. A byte is eight binary decisions, most
significant bit first, each with a context tree of its own whose context is the
DEPTH bytes before (line feeds before a text). Every node of every depth has the
zeros and ones that followed it in the training texts and their Krichevsky-Trofimov
estimate; the weighted probability of a node is half its estimate and half the
product of its children's (its estimate alone at DEPTH). After training, a node's
weight is the share of its own estimate in that mixture, and the probability of
a decision mixes the estimates of all depths along its path by these weights. Where
the path leaves the tree (no training text had the context), the deepest node that
was seen takes what is left of the weight. The probability of a text is the product
over its bytes, so texts' probabilities sum to one.

How it runs. The probability of a byte depends on its gram alone: the byte and DEPTH
before it. A scan packs texts into blocks of about BLOCK bytes and stores each
block's texts, its distinct grams with their training counts, dealt into cells by
the three last bytes of the context, and its distinct words, dealt by a hash. Cells
of grams form shards of about SHARD grams; a shard holds whole subtrees from depth LOW on, and gives up the
sums for the nodes above, which have at most 2^24 keys and are summed by Spark, the
two upper levels (65,280 nodes at most) on the driver. With these, each shard scores the
distinct grams of all blocks, and each block adds up its texts. So the grams move
once for training and once for scoring, the texts once, and no task or broadcast
holds the model. Counts cover all training texts and nothing is cut off.

Defined cases: a null or empty text has one token, the end; null ids are not held
out and teach; repeated rows teach and are scored each; without training texts
every decision has probability 1/2 and every word count is 0; a text longer than a
block is a block of its own, read in pieces; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import mix64, release, table, written

DEPTH, LOW = 6, 3
#: Bytes of a block; positions whose grams are counted together, and of a text that
#: are looked at together.
BLOCK, SETTLED, PIECE = 16_000_000, 3_000_000, 1_000_000
#: Grams of a shard, blocks' repetitions counted, and most cells.
SHARD, CELLS = 500_000, 1 << 14
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)
U = np.uint64


def tokens(body: bytes) -> list[bytes]:
    """Words of a text; the end is not among them."""
    return body.translate(LOWER).split()


def grams(text: bytes, start: int = 0, stop: int | None = None, depth: int = DEPTH) -> np.ndarray:
    """The gram of each position: the context, last byte first, above the byte."""
    stop = len(text) if stop is None else stop
    buf = np.frombuffer(END * max(0, depth - start) + text[max(0, start - depth) : stop], np.uint8).astype(U)
    n = stop - start
    out = buf[depth:].copy()
    for back in range(1, depth + 1):
        out |= buf[depth - back : depth - back + n] << U(8 * (depth - back + 1))
    return out


def pieces(text: bytes) -> Iterator[np.ndarray]:
    for at in range(0, len(text), PIECE):
        yield grams(text, at, min(len(text), at + PIECE))


def packed(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys by byte planes, compressed."""
    planes = np.diff(sorted_keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    return squeezed(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(opened(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not keys:
        return np.empty(0, U), np.empty(0)
    both, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, np.int64)
    return both[first], np.add.reduceat(n[order], first) if len(first) else np.empty(0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight above x."""
    low = np.log(x)
    for i in range(1, 8):
        low += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + HALF_LOG_TAU + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z - low


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def weighted(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of a node's own estimate, its probability of a one, log weighted
    probability; `children`: sums of their log weighted probabilities, None at the leaves."""
    own = log_estimate(zeros, ones)
    chance = (ones + 0.5) / (zeros + ones + 1)
    if children is None:
        return np.ones(len(own)), chance, own
    whole = np.logaddexp(own, children) - math.log(2)
    return np.exp(own - math.log(2) - whole), chance, whole


def nodes(keys: np.ndarray, bit: int) -> np.ndarray:
    """The node of each gram at one bit: context above a one and the bits before."""
    before = keys & U(255)
    return (keys >> U(8) << U(8)) | U(1 << bit) | (before >> U(8 - bit))


def up(node: np.ndarray, levels: int = 1) -> np.ndarray:
    """The node `levels` nearer to the root: the oldest bytes of the context go."""
    return (node >> U(8 + 8 * levels) << U(8)) | (node & U(255))


def tallied(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, in order, and their zeros and ones. Grams in order have their nodes in
    order too."""
    if not len(keys):
        return np.empty(0, U), np.empty(0), np.empty(0)
    node = nodes(keys, bit)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    is_one = ((keys >> U(7 - bit)) & U(1)).astype(float)
    n, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * is_one, first)
    return node[first], n - ones, ones


class Subtrees:
    """All nodes from depth LOW to DEPTH over grams with training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.logs: dict[tuple[int, int], np.ndarray] = {}  # weighted probabilities of the upmost level
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        for depth in range(DEPTH, LOW - 1, -1):
            for bit in range(8):
                node, zeros, ones = tallied(keys, counts, bit)
                children = None
                if depth < DEPTH:
                    below = self.levels[depth + 1, bit][0]
                    children = np.bincount(np.searchsorted(node, up(below)), self.logs.pop((depth + 1, bit)), minlength=len(node))
                weight, chance, self.logs[depth, bit] = weighted(zeros, ones, children)
                self.levels[depth, bit] = (node, weight, chance)
            keys, counts = merged([up(keys)], [counts])

    def above(self, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """The nodes just above, as far as these grams know them: node, zeros, ones,
        log (sum of their children's log weighted probabilities)."""
        keys, counts = merged([up(keys, DEPTH - LOW + 1)], [counts])
        out = []
        for bit in range(8):
            node, zeros, ones = tallied(keys, counts, bit)
            sums = np.bincount(np.searchsorted(node, up(self.levels[LOW, bit][0])), self.logs[LOW, bit], minlength=len(node))
            out.append(pd.DataFrame({"node": node.astype(np.int64), "zeros": zeros, "ones": ones, "log": sums}))
        return pd.concat(out)

    def log10(self, keys: np.ndarray, top: Top, known: pd.DataFrame) -> np.ndarray:
        """Log10 probability of the byte of each gram in its context. `known`: node,
        mixed, left, stop of the nodes just above, in order of `node`."""
        out = np.zeros(len(keys))
        at_known = known.node.to_numpy().astype(U)
        for bit in range(8):
            node = nodes(keys, bit)
            # From the root: the mixture so far, the weight that is left, what a path that ends here has.
            two = up(node, DEPTH - LOW + 1)
            stop, mixed, left = top.stop(up(two)), np.zeros(len(keys)), np.zeros(len(keys))
            at, live = _find(at_known, two)
            stop[live] = known.stop.to_numpy()[at[live]]
            mixed[live], left[live] = known.mixed.to_numpy()[at[live]], known.left.to_numpy()[at[live]]
            for depth in range(LOW, DEPTH + 1):
                have, weight, chance = self.levels[depth, bit]
                at, found = _find(have, up(node, DEPTH - depth) if depth < DEPTH else node)
                live &= found
                w, p = weight[at[live]], chance[at[live]]
                stop[live] = mixed[live] + left[live] * p
                mixed[live] += left[live] * w * p
                left[live] *= 1 - w
            is_one = ((keys >> U(7 - bit)) & U(1)) == 1
            out += np.log10(np.where(is_one, stop, 1 - stop))
        return out


def _find(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(have, wanted)
    if not len(have):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(have) - 1)
    return at, have[at] == wanted


@dataclass(frozen=True)
class Top:
    """Root and depth 1 of the 255 trees, weights and chances: dense, bounded arrays."""

    w0: np.ndarray
    p0: np.ndarray
    w1: np.ndarray
    p1: np.ndarray
    has1: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log: np.ndarray) -> Top:
        """From the nodes of depth 1 and the sums of their children's logs."""
        place = node.astype(np.int64)
        w1, p1, has1 = np.zeros(1 << 16), np.full(1 << 16, 0.5), np.zeros(1 << 16, bool)
        w1[place], p1[place], whole = weighted(zeros, ones, log)
        has1[place] = True
        total = lambda x: np.bincount(place & 255, x, minlength=256)
        z, o = total(zeros), total(ones)
        w0, p0, _ = weighted(z, o, total(whole))
        return cls(np.where(z + o > 0, w0, 0.0), np.where(z + o > 0, p0, 0.5), w1, p1, has1)

    def stop(self, node: np.ndarray) -> np.ndarray:
        """What a path has that ends at depth 1, or at the root if it wasn't seen."""
        at = node.astype(np.int64)
        w0, p0 = self.w0[at & 255], self.p0[at & 255]
        return np.where(self.has1[at], w0 * p0 + (1 - w0) * self.p1[at], p0)

    def through(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixture and weight left below depth 1."""
        at = node.astype(np.int64)
        w0, p0, w1, p1 = self.w0[at & 255], self.p0[at & 255], self.w1[at], self.p1[at]
        return w0 * p0 + (1 - w0) * w1 * p1, (1 - w0) * (1 - w1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def squeezed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Distinct:
    """The different grams of texts and their training counts. Positions wait until
    there are SETTLED of them, so many texts are sorted together and few are held."""

    def __init__(self) -> None:
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.runs: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def add(self, text: bytes, held: bool) -> None:
        for part in pieces(text):
            self.waiting[held].append(part)
            if sum(map(len, self.waiting[held])) >= SETTLED:
                self.settle(held)

    def settle(self, held: bool) -> None:
        if self.waiting[held]:
            keys, n = np.unique(np.concatenate(self.waiting[held]), return_counts=True)
            self.runs[0].append(keys)
            self.runs[1].append(np.zeros(len(keys)) if held else n.astype(float))
            self.waiting[held] = []

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle(True)
        self.settle(False)
        return merged(*self.runs)


def gram_cells(keys: np.ndarray, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cell and places of its grams in order: by the last two bytes of the context and
    four bits of the third, so a subtree from depth LOW on lies in one cell."""
    pair, third = keys >> U(8 * (DEPTH - 1)), (keys >> U(8 * (DEPTH - 2))) & U(15)
    return _parted((mix64(pair << U(4) | third) % U(cells)).astype(np.int64))


def word_cells(words: list[bytes], cells: int) -> Iterator[tuple[int, list[bytes]]]:
    """Cell and words in order; the end has a cell of its own."""
    for c, places in _parted(np.array([zlib.crc32(w) % cells if w != END else cells for w in words], np.int64)):
        yield c, [words[i] for i in places]


class Table:
    """Values of 64-bit keys by open addressing; whole arrays are looked up at once,
    which is several times as fast as a binary search."""

    NONE = U(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, self.NONE)
        self.values = np.zeros(1 << self.bits, values.dtype)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == self.NONE
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            at, left = (at[~won] + 1) & self.mask, left[~won]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all there."""
        at = self._home(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            off = off[self.keys[at[off]] != keys[off]]
        return self.values[at]


class _Block:
    """Texts, grams and words that a task has read since its last block."""

    def __init__(self, cells: int):
        self.cells, self.id, self.positions = cells, uuid.uuid4().int >> 65, 0
        self.texts: list[bytes] = []
        self.rows_: list[tuple[int, int, int]] = []  # doc_id, flags (1: no id, 2: held out), bytes
        self.words: Counter = Counter()
        self.grams = Distinct()

    def add(self, doc_id: int | None, words: list[bytes], held: bool) -> None:
        text = b" ".join(words) + END
        self.texts.append(text)
        self.rows_.append((doc_id or 0, (doc_id is None) | held << 1, len(text)))
        self.positions += len(text)
        self.words[END] += not held
        if held:
            self.words.update(dict.fromkeys(words, 0))
        else:
            self.words.update(words)
        self.grams.add(text, held)

    def stored(self) -> pa.RecordBatch:
        out = [("text", 0, squeezed(b"".join(self.texts), 3), squeezed(np.array(self.rows_, np.int64).tobytes()), self.positions)]
        keys, counts = self.grams.all()
        for c, places in gram_cells(keys, self.cells):
            out.append(("gram", c, packed(keys[places]), squeezed(counts[places].astype(np.uint32).tobytes()), len(places)))
        for c, own in word_cells(sorted(self.words), self.cells):
            out.append(("word", c, squeezed(b" ".join(own)), squeezed(np.array([self.words[w] for w in own], np.int64).tobytes()), len(own)))
        kind, cell, data, extra, size = zip(*out, strict=True)
        columns = [pa.array([self.id] * len(out), pa.int64()), pa.array(kind), pa.array(cell, pa.int32()), pa.array(data, pa.binary()), pa.array(extra, pa.binary()), pa.array(size, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["block", "kind", "cell", "data", "extra", "size"])


def _parted(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each cell, in order."""
    order = np.argsort(cell, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        yield int(cell[places[0]]), places


def stored(docs: DataFrame) -> DataFrame:
    """Blocks: block, kind (text, gram, word), cell, data, extra, size. Texts lie
    together with their ids and lengths, grams and words of a cell with their counts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    cells = min(CELLS, 1 << max(4, int(total / (4 * SHARD)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(cells)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pydict()
                for doc_id, held, body in zip(part["doc_id"], part["held_out"], part["body"], strict=True):
                    if block.positions and block.positions + len(body) > BLOCK:
                        yield block.stored()
                        block = _Block(cells)
                    block.add(doc_id, tokens(body), held)
        if block.positions:
            yield block.stored()

    return written(rows.mapInArrow(run, "block bigint, kind string, cell int, data binary, extra binary, size bigint"))


def _together(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of each row; the distinct ones of all rows and their counts."""
    each = [unpacked(x) for x in rows.data]
    counts = [np.frombuffer(opened(x), np.uint32).astype(float) for x in rows.extra]
    return each, *merged(each, counts)


def gram_scores(cells: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """block, kind, data, extra: a block's distinct grams of a cell and the log10
    probabilities of their bytes, as 32-bit floats; and the stored tables that this
    reads."""
    spark = cells.sparkSession
    shards = max(1, math.ceil((cells.agg(F.sum("size")).first()[0] or 0) / SHARD))
    dealt = cells.select((F.col("cell") % shards).alias("shard"), "block", "data", "extra")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _together(rows)
        return Subtrees(keys, counts).above(keys, counts).assign(shard=rows.shard.iloc[0])[["shard", "node", "zeros", "ones", "log"]]

    asked = written(dealt.groupBy("shard").applyInPandas(train, "shard int, node bigint, zeros double, ones double, log double"))
    two = asked.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).where("zeros + ones > 0")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            w, p, log = weighted(x.zeros.to_numpy(), x.ones.to_numpy(), x.log.to_numpy())
            yield x.assign(weight=w, chance=p, log=log)

    two = written(two.mapInPandas(whole, "node bigint, zeros double, ones double, log double, weight double, chance double"))
    one = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
    # At most 65,280 nodes.
    upper = two.groupBy(one.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).orderBy("node").toPandas()
    top = spark.sparkContext.broadcast(tuple(vars(Top.of(*[upper[c].to_numpy() for c in ("node", "zeros", "ones", "log")])).values()))

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            mixed, left = Top(*top.value).through(up(x.node.to_numpy().astype(U)))
            w, p = x.weight.to_numpy(), x.chance.to_numpy()
            yield pd.DataFrame({"node": x.node, "mixed": mixed + left * w * p, "left": left * (1 - w), "stop": mixed + left * p})

    paths = two.mapInPandas(down, "node bigint, mixed double, left double, stop double")
    paths = asked.select("shard", "node").distinct().join(paths, "node")

    def answer(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        each, keys, counts = _together(rows)
        logs = Subtrees(keys, counts).log10(keys, Top(*top.value), known.sort_values("node"))
        return pd.DataFrame({"block": rows.block, "kind": "gram", "data": rows.data, "extra": [_planes(logs[np.searchsorted(keys, x)].astype(np.float32)) for x in each]})

    return dealt.groupBy("shard").cogroup(paths.groupBy("shard")).applyInPandas(answer, GIVEN), [asked, two]


def word_counts(cells: DataFrame) -> DataFrame:
    """block, kind, data, extra: a block's words of a cell and how often each occurs in
    all training texts; and in rows without a block, how many different training words
    a cell has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        each = [_words(x) for x in rows.data]
        counts: Counter = Counter()
        for words, extra in zip(each, rows.extra, strict=True):
            for w, n in zip(words, np.frombuffer(opened(extra), np.int64).tolist(), strict=True):
                counts[w] += n
        told = pd.DataFrame({"block": rows.block.astype("Int64"), "kind": "word", "data": rows.data, "extra": [squeezed(np.array([counts[w] for w in words], np.int64).tobytes()) for words in each]})
        known = np.array([sum(n > 0 for n in counts.values())], np.int64)
        return pd.concat([told, pd.DataFrame({"block": pd.array([None], "Int64"), "kind": ["known"], "data": [b""], "extra": [known.tobytes()]})])

    return written(cells.groupBy("cell").applyInPandas(run, GIVEN))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte (code length) of every row."""
    held = stored(docs)
    part = lambda kind, *columns: held.where(F.col("kind") == kind).select("block", *columns)
    words = word_counts(part("word", "cell", "data", "extra"))
    different = sum(int(np.frombuffer(r.extra, np.int64)[0]) for r in words.where("kind = 'known'").select("extra").collect())  # a row a cell
    sums = held.where("kind = 'word'").select("extra").mapInArrow(_summed, "n bigint")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = total + 0.1 * (different + 1)
    scored, used = gram_scores(part("gram", "cell", "data", "extra", "size"))
    given = scored.unionByName(words.where("kind = 'word'"))

    def run(texts: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        data, extra = texts.data.iloc[0], texts.extra.iloc[0]  # a block has one row
        whole, rows = memoryview(opened(data)), np.frombuffer(opened(extra), np.int64).reshape(-1, 3).tolist()
        some = given[given.kind == "gram"]
        table_ = Table(np.concatenate([unpacked(x) for x in some.data]), np.concatenate([_unplaned(x) for x in some.extra]))
        some, logs = given[given.kind == "word"], {}
        unknown: set[bytes] = set()
        for words_, counts in zip(some.data, some.extra, strict=True):
            counts = np.frombuffer(opened(counts), np.int64)
            words_ = _words(words_)
            logs.update(zip(words_, np.log10((counts + 0.1) / share).tolist(), strict=True))
            unknown.update(words_[i] for i in np.flatnonzero(counts == 0))
        out, at = [], 0
        for doc_id, flags, n in rows:
            text = bytes(whole[at : at + n])
            at += n
            own = Counter(text.split())
            own[END] = 1
            base = math.fsum([n * logs[w] for w, n in own.items()])
            model = math.fsum([table_.get(part).sum(dtype=float) for part in pieces(text)])
            tokens_ = own.total()
            known = tokens_ - sum(own[w] for w in own.keys() & unknown) if unknown else tokens_
            out.append((None if flags & 1 else doc_id, bool(flags & 2), tokens_, known, total, base, model, len(text), -model * math.log2(10) / len(text)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")]).astype({"doc_id": "Int64"})

    texts = part("text", "data", "extra")
    out = written(texts.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(run, SCORED))
    release(held, words, *used)
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(int(np.frombuffer(opened(x), np.int64).sum()) for x in batch.column("extra").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _words(data: bytes) -> list[bytes]:
    return opened(data).split() or [END]


def _planes(values: np.ndarray) -> bytes:
    """Floats by byte planes, compressed."""
    return squeezed(values.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(data), np.uint8).reshape(4, -1).T).view(np.float32).ravel()


GIVEN = "block bigint, kind string, data binary, extra binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"


def op12_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
