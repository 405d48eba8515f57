"""Byte-level BPE encoding and decoding.

Ranked merges are folded over the byte arrays of the distinct words of a batch,
with the rank table broadcast to the tasks (about 50,000 entries, fixed by the
vocabulary file, so its size does not follow the data). Decoding concatenates the binary piece of each id.

Defined cases: a null text counts as empty and has no ids; a null doc_id stays
null; repeated rows give repeated results; any further columns are ignored; a
word of any length is merged by a heap in O(n log n), so one very long word
costs no more than linear memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct words whose ids a task remembers between batches.
MEMO = 400_000
#: Longer words are merged through a heap and not remembered.
SHORT = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the lowest-ranked adjacent pair (the leftmost of equals)
    is merged until no adjacent pair is in the rank map."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    got = ranks.get
    pairs = [got(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == 1 << 60:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = got(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = got(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a linked list of spans with a heap of ranked pairs."""
    n = len(word)
    end = list(range(1, n + 1))  # span i is word[i:end[i]] while alive
    left = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        if not alive[j]:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            left[stop] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one rank map; made once in each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.memo = ranks, {}
        self.split = regex.compile(pattern).findall
        self.pieces = {rank: piece for piece, rank in ranks.items()}

    def encode(self, text: str) -> array:
        """Ids of `text`, each match of the pattern on its own."""
        words = self.split(text)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for word in set(words):
            if word not in memo:
                memo[word] = array("I", fold_merges(word.encode(), self.ranks)).tobytes()
        ids = array("I")
        ids.frombytes(b"".join([memo[w] for w in words]))
        return ids

    def decode(self, ids: array) -> bytes:
        """Ids outside the vocabulary raise KeyError."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


def _codec(state: dict, shared) -> Codec:
    if not state:
        state["codec"] = Codec(*shared.value)
    return state["codec"]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens and the columns of `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = "doc_id bigint, ids array<int>, n_tokens bigint" + (", " + kept if kept else "")

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        codec = _codec(state, shared)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x.tolist() for x in ids], pa.list_(pa.int32())),
                pa.array([len(x) for x in ids], pa.int64()),
                *[batch.column(c) for c in keep],
            ],
            ["doc_id", "ids", "n_tokens", *keep],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text", *keep), run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and body (binary): the concatenated pieces of `ids`."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        codec = _codec(state, shared)
        bodies = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"]
        )

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id bigint, body binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.
    The digests are taken where the ids are made, so neither ids nor texts move."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        codec = _codec(state, shared)
        counts, coded, decoded = [], [], []
        for text in batch.column("text").to_pylist():
            ids = codec.encode(text or "")
            counts.append(len(ids))
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if array("I", [1]).tobytes()[0] != 1:
                ids.byteswap()
            coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), "text"),
        run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def vocabulary(name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    """Rank map and split pattern of an installed public tokenizer."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary())
