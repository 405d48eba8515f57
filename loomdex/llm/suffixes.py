"""Exact dedup of repeated byte strings with suffix arrays.

A suffix array is built by linear grouping. First the suffixes are grouped by
their longest Lyndon prefix: groups are taken in descending order; each suffix
of a group points to the previous smaller one, and the suffixes that get the
same number of pointers from a group move together to a new group right above
their old one. Then, from the smallest suffix on, each suffix emits the ones
that end where it begins into the next free place of their groups. No ranks are
renamed recursively.

At scale the array is built where it decides something. A window of WIDTH bytes
belongs to the smallest K-gram inside it (its anchor), so equal windows have
equal anchors at equal offsets and meet in one shard. Texts whose anchors occur
nowhere else drop out; in a shard the windows' hashes pick the stretches that
may repeat (equal strings have equal hashes, so none is lost); equal stretches
are one string with a count, and the suffix array over the different ones of an
anchor decides which windows occur twice. Bytes are compared, not hashes.

An anchor that lies in more than HOT places would be one large group (a common
line in many contexts). Its windows are dealt out further, by the STEP offsets of
the anchor among which theirs lies and by the bytes that all windows with such an
offset hold around it (the core). Equal windows still meet; others mostly part. Equal
stretches of a text travel once with all their places, and equal ones of several
texts are judged once with their number.

Equal documents are one text with a count: with WIDTH bytes or more all of it is
repeated. Copies are told by two 64-bit hashes of the whole text.

Defined cases: null and empty texts have 0 bytes; a text below WIDTH bytes keeps
all; repeats within a text count, overlapping ones too; rows that repeat a
doc_id are documents of their own; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import OFTEN, arrow_map, mix64, shards_for, spread_left, table, written

WIDTH, K = 200, 64
#: Places of one anchor beyond which its windows are parted, and the offsets of a part.
HOT, STEP = 10_000, 16
#: Window starts that are looked at together, and bits of a place among them.
CHUNK, _PLACE = 1 << 22, 24
_BASE = 0x9E3779B97F4A7C15 | 1


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of `symbols`, whose last one is smaller than all others."""
    n = len(symbols)
    if n == 0:
        return []
    alphabet = sorted(set(symbols))
    of = {c: g for g, c in enumerate(alphabet)}
    group = [of[c] for c in symbols]  # current group of each suffix
    members: list[list[int]] = [[] for _ in alphabet]  # in text order, may hold moved ones
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(alphabet) - 1))
    above = [*range(1, len(alphabet)), -1]
    smaller = [-2] * n  # previous smaller suffix; -2: not known yet
    g = len(alphabet) - 1
    final: list[int] = []
    while g != -1:
        final.append(g)
        mine = [i for i in members[g] if group[i] == g]
        members[g] = mine
        counts: dict[int, list[int]] = {}
        last, times = -1, 0
        for i in mine:
            p = i - 1
            while p >= 0 and smaller[p] != -2:
                p = smaller[p]
            smaller[i] = p
            if p != last:
                if last >= 0:
                    counts.setdefault(times, []).append(last)
                last, times = p, 0
            times += 1
        if last >= 0:
            counts.setdefault(times, []).append(last)
        for times in sorted(counts, reverse=True):
            moved: dict[int, int] = {}
            for p in counts[times]:
                old = group[p]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up != -1:
                        below[up] = new
                group[p] = new
                members[new].append(p)
        g = below[g]
    free, at = [0] * len(members), 0
    for g in reversed(final):
        free[g] = at
        at += len(members[g])
    order = [0] * n
    order[0] = n - 1
    free[group[n - 1]] += 1
    for rank in range(n):
        j = order[rank]
        stop, p = smaller[j], j - 1
        while p != stop and p >= 0:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            p = smaller[p]
    return order


def repeated_starts(strings: list[bytes], counts: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each of the different `strings`, which of its windows occur twice in
    all strings, where string i occurs counts[i] times."""
    flags = [np.full(max(0, len(s) - width + 1), c > 1) for s, c in zip(strings, counts, strict=True)]
    if len(strings) < 2:
        if strings and counts[0] == 1:
            flags[0] |= _within(strings[0], width)
        return flags
    if all(f.all() for f in flags):
        return flags
    whole = b"\n".join(strings)
    symbols = [c + 2 for c in whole]
    starts, at = [], 0
    for s in strings:
        starts.append(at)
        at += len(s) + 1
        if at <= len(whole):
            symbols[at - 1] = 1
    symbols.append(0)
    room = np.zeros(len(symbols), bool)
    for s, f in zip(starts, flags, strict=True):
        room[s : s + len(f)] = True
    order = [i for i in suffix_array(symbols) if room[i]]
    twice = np.zeros(len(symbols), bool)
    for a, b in zip(order, order[1:], strict=False):
        if whole[a : a + width] == whole[b : b + width]:
            twice[a] = twice[b] = True
    for s, f in zip(starts, flags, strict=True):
        f |= twice[s : s + len(f)]
    return flags


def _within(s: bytes, width: int) -> np.ndarray:
    """Windows of one string that occur twice in it."""
    seen: dict[bytes, int] = {}
    out = np.zeros(max(0, len(s) - width + 1), bool)
    for i in range(len(out)):
        j = seen.setdefault(s[i : i + width], i)
        if j != i:
            out[i] = out[j] = True
    return out


class Rolling:
    """Hashes of all windows of a byte string, through prefix sums modulo 2^64."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = 1 << (n + 1).bit_length()
            step = np.full(n, _BASE, np.uint64)
            step[0] = 1
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def windows(self, body: np.ndarray, width: int) -> np.ndarray:
        n = len(body) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(body))
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.power[: len(body)], out=sums[1:])
        return mix64((sums[width:] - sums[:-width]) * self.inverse[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` keys in a row."""
    n = len(keys) - width + 1
    pad = (-len(keys)) % width
    x = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(body: bytes, rolling: Rolling, parting: bool = False):
    """Yield, for each CHUNK of the window starts of a text: hash of each anchor,
    the first and last window start that belong to it, its place and, if `parting`,
    a function that gives the hashes of the strings of WIDTH - STEP + 1 bytes at
    given places. A window's anchor depends on its bytes alone, so the cuts only
    divide an anchor's range; memory follows CHUNK, whatever the text's length."""
    whole, place = np.frombuffer(body, np.uint8), np.uint64((1 << _PLACE) - 1)
    for start in range(0, len(body) - WIDTH + 1, CHUNK):
        own = whole[start : start + CHUNK + WIDTH - 1]
        grams = rolling.windows(own, K)
        keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(keys, WIDTH - K + 1) & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        cores = rolling.windows(own, WIDTH - STEP + 1) if parting else None
        yield grams[at[first]], first + start, last + start, at[first] + start, (lambda x, c=cores, s=start: c[x - s])


def parted(f: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, cores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window start of the parts of some anchors' windows.
    cores: hashes of the strings of WIDTH - STEP + 1 bytes at given places. A part's
    core begins at its greatest possible start, so each of its windows holds it."""
    low, high = (place - last) // STEP, (place - first) // STEP
    n = high - low + 1
    of = np.repeat(np.arange(len(f)), n)
    part = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    greatest = place[of] - STEP * part
    key = mix64(f[of] ^ mix64(cores(greatest) + part.astype(np.uint64)))
    return key, np.maximum(first[of], greatest - STEP + 1), np.minimum(last[of], greatest)


_TEXT = "doc_id bigint, a bigint, b bigint"


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(3), text).alias("b"),
        text.cast("binary").alias("body"),
    )


def _by_shard(home: np.ndarray, shards: int):
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def repeated_anchors(texts: DataFrame, shards: int) -> DataFrame:
    """_TEXT, `held` (binary: sorted anchor hashes that occur twice) and `hot`
    (those of them in more than HOT places) of one document of each text."""

    def find(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        rolling = state.setdefault("rolling", Rolling())
        none = np.zeros(0, np.uint64)
        hashes = [np.concatenate([none, *[found[0] for found in anchors(b, rolling)]]) for b in batch.column("body").to_pylist()]
        f = np.concatenate([np.zeros(0, np.uint64), *hashes])
        doc = np.repeat(np.arange(len(hashes), dtype=np.uint16), [len(h) for h in hashes])
        who = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1).astype("<i8")
        ids = np.array([-(2**63) if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8")
        out = []
        for s, i in _by_shard((f % np.uint64(shards)).astype(np.int64), shards):
            # A shard gets the texts its anchors lie in, not the batch's.
            own, at = np.unique(doc[i], return_inverse=True)
            out.append((s, f[i].tobytes(), at.astype(np.uint16).tobytes(), who[own].tobytes(), ids[own].tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["shard", "f", "doc", "who", "ids"],
        )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.f])
        doc = [np.frombuffer(x, np.uint16) for x in rows.doc]
        who = np.concatenate([np.frombuffer(w, "<i8").reshape(-1, 2)[d] for w, d in zip(rows.who, doc, strict=True)])
        ids = np.concatenate([np.frombuffer(w, "<i8")[d] for w, d in zip(rows.ids, doc, strict=True)])
        order = np.lexsort((ids, who[:, 1], who[:, 0], f))
        f, who, ids = f[order], who[order], ids[order]
        new_f = np.r_[True, f[1:] != f[:-1]]
        new_text = new_f | np.r_[True, (who[1:] != who[:-1]).any(1)]
        # A copy of the same text repeats nothing new: its smallest id stands for it,
        # once for each time the anchor lies in the text.
        keep = new_text | np.r_[False, ids[1:] == ids[:-1]]
        lead = np.maximum.accumulate(np.where(new_text, np.arange(len(f)), 0))
        keep &= ids == ids[lead]
        f, who, ids = f[keep], who[keep], ids[keep]
        edge = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        size = np.diff(np.r_[edge, len(f)])
        many, hot = np.repeat(size > 1, size), np.repeat(size > HOT, size)
        f, who, ids, hot = f[many], who[many], ids[many], hot[many]
        order = np.lexsort((f, who[:, 1], who[:, 0]))
        f, who, ids, hot = f[order], who[order], ids[order], hot[order]
        edge = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]).any(1)]) if len(f) else np.zeros(0, np.int64)
        ends = np.r_[edge[1:], len(f)] if len(f) else edge
        return pd.DataFrame({
            "doc_id": ids[edge], "a": who[edge, 0], "b": who[edge, 1],
            "held": [np.unique(f[x:y]).tobytes() for x, y in zip(edge, ends, strict=True)],
            "hot": [np.unique(f[x:y][hot[x:y]]).tobytes() for x, y in zip(edge, ends, strict=True)],
        })

    blobs = arrow_map(texts, find, "shard int, f binary, doc binary, who binary, ids binary")
    found = blobs.groupBy("shard").applyInPandas(meet, f"{_TEXT}, held binary, hot binary")
    joined = [F.unhex(F.array_join(F.collect_list(F.hex(c)), "")).alias(c) for c in ("held", "hot")]
    return found.groupBy("doc_id", "a", "b").agg(*joined)


def _stretches(texts: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """shard, f, doc_id, a, b, los, piece: the bytes of all windows of one anchor
    (or of a part of them) and the places in the text where they begin."""
    h = held.select(F.col("doc_id").alias("i"), F.col("a").alias("x"), F.col("b").alias("y"), "held", "hot")
    body = texts.join(h, texts.doc_id.eqNullSafe(F.when(h.i != -(2**63), h.i)) & (texts.a == h.x) & (texts.b == h.y))

    def cut(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        rolling = state.setdefault("rolling", Rolling())
        at, fs, los, pieces = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("body", "held", "hot"))
        for row, (body, own, hot) in enumerate(zip(*columns, strict=True)):
            held, many = np.frombuffer(own, np.uint64), np.frombuffer(hot, np.uint64)
            same: dict[tuple[int, bytes], list[int]] = {}
            for *found, cores in anchors(body, rolling, len(many) > 0):
                mine = np.isin(found[0], held)
                much = mine & np.isin(found[0], many)
                kinds = [[x[mine & ~much] for x in found[:3]]]
                if much.any():
                    kinds.append(parted(*[x[much] for x in found], cores))
                for kind in kinds:
                    for key, x, y in zip(*(column.tolist() for column in kind), strict=True):
                        same.setdefault((key, body[x : y + WIDTH]), []).append(x)
            at += [row] * len(same)
            fs += [key for key, _ in same]
            pieces += [piece for _, piece in same]
            los += [np.array(x, "<i8").tobytes() for x in same.values()]
        f = np.array(fs, np.uint64)
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array((f % np.uint64(shards)).astype(np.int32)), pa.array(f.view(np.int64)), *[batch.column(c).take(take) for c in ("doc_id", "a", "b")],
             pa.array(los, pa.binary()), pa.array(pieces, pa.binary())],
            ["shard", "f", "doc_id", "a", "b", "los", "piece"],
        )

    return arrow_map(body.select("doc_id", "a", "b", "body", "held", "hot"), cut, f"shard int, f bigint, {_TEXT}, los binary, piece binary")


def decide(pieces: list[bytes], f: np.ndarray, counts: np.ndarray, rolling: Rolling) -> list[np.ndarray]:
    """For each piece, found counts times, which of its windows occur in another place."""
    sizes = np.array([len(p) for p in pieces])
    whole = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    hashes = rolling.windows(whole, WIDTH)
    n = sizes - WIDTH + 1
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), n)
    offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    h = hashes[begin[owner] + offset] ^ mix64(f.view(np.uint64))[owner]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    maybe = counts[owner] > 1
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    flags = np.zeros(len(h), bool)
    # Runs of windows that may repeat, as strings of their anchor.
    edge = np.flatnonzero(maybe & ~np.r_[False, maybe[:-1] & (owner[1:] == owner[:-1])])
    stop = np.flatnonzero(maybe & ~np.r_[maybe[1:] & (owner[1:] == owner[:-1]), False])
    strings: dict[int, dict[bytes, list[int]]] = {}
    for k, (x, y) in enumerate(zip(edge.tolist(), stop.tolist(), strict=True)):
        piece = pieces[owner[x]]
        strings.setdefault(int(f[owner[x]]), {}).setdefault(piece[offset[x] : offset[y] + WIDTH], []).append(k)
    for of in strings.values():
        for runs, found in zip(of.values(), repeated_starts(list(of), [int(counts[owner[edge[r]]].sum()) for r in of.values()]), strict=True):
            for k in runs:
                flags[edge[k] : stop[k] + 1] = found
    return np.split(flags, np.cumsum(n)[:-1])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, a, b, runs (array of first and last start) of repeated windows, for
    one document of each text that has any."""
    texts = _identified(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    held = written(repeated_anchors(texts, shards_for(size * 0.2)))
    stretches = _stretches(texts, held, shards_for(size * 1.5, 3e6))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "a", "b", "los"]).reset_index(drop=True)
        los = [np.frombuffer(x, "<i8") for x in rows.los]
        places = np.array([len(x) for x in los], np.int64)
        number: dict[tuple[int, bytes], int] = {}
        which = np.array([number.setdefault(k, len(number)) for k in zip(rows.f.tolist(), rows.piece.tolist(), strict=True)], np.int64)
        counts = np.bincount(which, weights=places, minlength=len(number)).astype(np.int64)
        found = decide([piece for _, piece in number], np.array([f for f, _ in number], np.int64), counts, Rolling())
        runs = [np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2) for flags in found]
        n = np.array([len(r) for r in runs], np.int64)[which]
        # Every run of a piece at every place of it.
        at = np.repeat(np.arange(len(rows)), n * places)
        none = np.zeros(0, np.int64)
        first = np.concatenate([none, *[np.add.outer(lo, runs[w][:, 0]).ravel() for lo, w in zip(los, which, strict=True)]])
        last = np.concatenate([none, *[np.add.outer(lo, runs[w][:, 1] - 1).ravel() for lo, w in zip(los, which, strict=True)]])
        return pd.DataFrame({**{c: rows[c].to_numpy()[at] for c in ("doc_id", "a", "b")}, "first": first, "last": last})

    runs = stretches.groupBy("shard").applyInPandas(judge, f"{_TEXT}, first bigint, last bigint")
    return runs.groupBy("doc_id", "a", "b").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    texts = _identified(docs)
    plain = texts.select("doc_id", "a", "b", F.octet_length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    copies = plain.where(F.col("n_bytes") >= WIDTH).groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    runs = repeats(docs).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("doc_id").alias("i"), "runs")
    cut = texts.join(runs, (texts.a == runs.x) & (texts.b == runs.y) & texts.doc_id.eqNullSafe(runs.i))

    def strip(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        removed, spans, shas = [], [], []
        for body, runs in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            lo, hi = -1, -1
            for run in [*runs, None]:
                if run is not None and run["first"] <= hi:
                    hi = max(hi, run["last"] + WIDTH)
                    continue
                if hi > 0:
                    kept.append(body[at:lo])
                    at, n = hi, n + 1
                if run is not None:
                    lo, hi = run["first"], run["last"] + WIDTH
            kept.append(body[at:])
            left = b"".join(kept)
            removed.append(len(body) - len(left))
            spans.append(n)
            shas.append(hashlib.sha256(left).hexdigest())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "a", "b")], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())],
            ["i", "x", "y", "removed", "spans", "kept"],
        )

    done = arrow_map(cut.select("doc_id", "a", "b", "body", "runs"), strip, "i bigint, x bigint, y bigint, removed bigint, spans bigint, kept string")
    done = done.dropDuplicates(["i", "x", "y"])
    # Texts of very many copies fill no task.
    out = spread_left(plain, written(copies), ("a", "b"), "copies", "doc_id", OFTEN).join(done, plain.doc_id.eqNullSafe(done.i) & (plain.a == done.x) & (plain.b == done.y), "left")
    whole = F.col("copies").isNotNull()
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
