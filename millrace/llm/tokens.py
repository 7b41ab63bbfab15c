"""Problem 7: token ids of whole texts by a public byte-level BPE vocabulary.

The text is cut into pieces by the vocabulary's public pattern. A piece that is itself a vocabulary
entry is one token. Every other piece becomes a doubly linked list of byte symbols; a priority queue
holds the merge rank of each neighbouring pair, the lowest rank is merged first (the leftmost on
ties), and queue entries whose symbols have changed since are skipped as stale. Pieces repeat a lot,
so each Python worker keeps a bounded memo of piece -> ids. Decoding concatenates vocabulary strings.

Nulls give null ids, empty texts give an empty list.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in a worker's memo; it is emptied when full.
MEMO_SIZE = 200_000
#: Pieces longer than this many bytes are not remembered.
MEMO_BYTES = 96


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank file -> {symbol bytes: id}."""
    out = {}
    for line in raw.splitlines():
        if line:
            symbol, rank = line.split()
            out[base64.b64decode(symbol)] = int(rank)
    return out


class BytePairEncoder:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.symbols = {i: s for s, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by lowest-rank-first merging."""
        ranks = self.ranks
        n = len(piece)
        # node i starts at byte i; end[i] is where it ends, 0 once it was merged into its left neighbour
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, stop = pop(queue)
            j = right[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # stale: one of the two symbols has changed
            end[i], end[j] = stop, 0
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    push(queue, (r, i, end[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    push(queue, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = right[i]
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, ranks = self.memo, self.ranks
        for p in self.pieces.findall(text):
            ids = memo.get(p)
            if ids is None:
                b = p.encode("utf-8", "surrogatepass")
                whole = ranks.get(b)
                ids = (whole,) if whole is not None else tuple(self.merge(b))
                if len(b) <= MEMO_BYTES:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.symbols[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, BytePairEncoder] = {}


def _encoder(name: str, raw) -> BytePairEncoder:
    e = _ENCODERS.get(name)
    if e is None:
        e = _ENCODERS[name] = BytePairEncoder(read_ranks(raw.value))
    return e


def _ranks_broadcast(spark: SparkSession, vocabulary: str, folder: str | None):
    """The rank file (under 1 MB, fixed by the vocabulary) as a broadcast of its bytes."""
    with open(os.path.join(folder or TOKENIZER_DIR, f"{vocabulary}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: Column | str, vocabulary: str = VOCABULARY, folder: str | None = None) -> Column:
    """Column ``array<int>`` of the token ids of ``text``; null for null, [] for the empty text."""
    raw = _ranks_broadcast(spark, vocabulary, folder)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        enc = _encoder(vocabulary, raw).encode
        offsets, values, missing = [0], [], []
        for t in texts.to_pylist():
            missing.append(t is None)
            if t:
                values.append(np.fromiter(enc(t), dtype=np.int32))
                offsets.append(offsets[-1] + len(values[-1]))
            else:
                offsets.append(offsets[-1])
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(missing, pa.bool_()))

    return encode(F.col(text) if isinstance(text, str) else text)


def token_count(spark: SparkSession, text: Column | str, vocabulary: str = VOCABULARY, folder: str | None = None) -> Column:
    """Column ``bigint``: number of token ids; 0 for null and empty texts."""
    raw = _ranks_broadcast(spark, vocabulary, folder)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        enc = _encoder(vocabulary, raw).encode
        return pa.array([len(enc(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def decoded(spark: SparkSession, ids: Column | str, vocabulary: str = VOCABULARY, folder: str | None = None) -> Column:
    """Column ``string``: the text of token ids (the inverse of ``token_ids`` for valid Unicode)."""
    raw = _ranks_broadcast(spark, vocabulary, folder)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        dec = _encoder(vocabulary, raw).decode
        return pa.array([None if r is None else dec(r) for r in rows.to_pylist()], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(id, ids) of every row of ``docs``; only the two columns are read, nothing is shuffled."""
    return docs.select(F.col(id_col), token_ids(docs.sparkSession, text_col, vocabulary, folder).alias("ids"))
