"""Byte-level BPE: encoding by ranks with a segment tree, and decoding.

A piece of text is a row of bytes, each a token at first. A segment tree over byte positions holds, for every live
position, the rank of the pair it begins; its root is the leftmost smallest rank. A merge joins the pair at the root's
position: the right token's position dies, and the pairs of the live neighbours get new ranks, each a point update of
logarithmic cost. So a piece of n bytes takes O(n log n) however long it is.

Pieces are the matches of the splitting pattern; each worker remembers the tokens of the pieces it has seen, in a cache
of bounded size. Ranks come to the driver from the file at a path and go to the workers as a broadcast of that size.

Cases: a null text is an empty one and has no tokens; repeated rows stay rows; an empty table gives no rows; other
columns are not read. Ids that have no token can't be decoded and raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a worker remembers, and the bytes of the longest one it remembers.
CACHE_PIECES, CACHE_BYTES = 600_000, 64
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file with one base64 token and its rank on a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTree:
    """Segment tree over positions; the root is the leftmost smallest rank as ``rank * size + position``."""

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        tree = [NONE] * (2 * size)
        tree[size : size + len(leaves)] = [NONE if r is None else r * size + i for i, r in enumerate(leaves)]
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        self.tree = tree

    def set(self, position: int, rank: int | None) -> None:
        tree, node = self.tree, self.size + position
        tree[node] = NONE if rank is None else rank * self.size + position
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a <= b else b
            if tree[node] == low:
                break
            tree[node] = low
            node //= 2

    def least(self) -> int | None:
        """Position of the leftmost smallest rank."""
        root = self.tree[1]
        return None if root == NONE else root % self.size


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that begins at a position
    before = list(range(-1, n - 1))  # live position to the left
    rank = ranks.get
    tree = MergeTree([rank(piece[i : i + 2]) for i in range(n - 1)] + [None])
    while (at := tree.least()) is not None:
        right = end[at]
        end[at] = stop = end[right]
        tree.set(right, None)
        if stop < n:
            before[stop] = at
            tree.set(at, rank(piece[at : end[stop]]))
        else:
            tree.set(at, None)
        if before[at] >= 0:
            tree.set(before[at], rank(piece[before[at] : stop]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Pieces(dict):
    """piece (str) -> its ids as little-endian 32-bit bytes; fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = np.array(merge(raw, self.ranks), dtype="<u4").tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(ranks)
        self.tokens = {i: token for token, i in ranks.items()}

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The codec of a worker process, by path and pattern: its cache serves all tasks that the process runs.
CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str, ranks: dict[bytes, int]) -> Codec:
    if (path, pattern) not in CODECS:
        CODECS.clear()
        CODECS[path, pattern] = Codec(ranks, pattern)
    return CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids (array<bigint>)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, shared.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                rows.append((
                    len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(),
                    *([np.frombuffer(ids, "<u4").astype("i8")] if keep_ids else []),
                ))
            columns = list(zip(*rows)) or [()] * (3 + keep_ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + ", ids array<bigint>" * keep_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: from doc_id, ids (array<bigint>); null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: token for token, i in shared.value.items()}
        for batch in batches:
            texts = [
                None if ids is None else b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id bigint, text string")
