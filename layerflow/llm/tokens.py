"""Token ids packed into matrices.

Documents are tokenized, ended by an end id, and split without loss into pieces
of at most ``width`` ids. Each task packs what it holds, a few million ids at a
time, by best-fit decreasing: pieces in order of falling length go to the fullest
row that has room, which a segment tree over the free places finds in the
logarithm of the width. A row is written with its ids, the cumulative lengths of
its segments and the places where positions begin anew.

The tokenizer's ranks are a file in tiktoken's format, named by its path on the
driver and sent to the executors.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import in_arrow, scratch_dir, stacked

WIDTH = 2048
HELD_IDS = 2 << 20  # ids that a task packs at a time
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256

# Fixed value: the pattern that the 50k byte-level vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str = PATTERN):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class FreePlaces:
    """Rows by their free places: a segment tree of counts over 0 .. width."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, free: int, change: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the fewest free places that hold ``size``, and their number."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        free = node - self.leaves
        row = self.rows[free].pop()
        self._add(free, -1)
        return row, free


def best_fit(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Pieces of each row, by best-fit decreasing; ties keep their order."""
    places, rows = FreePlaces(width), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = places.take(size)
        if found is None:
            rows.append([])
            found = len(rows) - 1, width
        row, free = found
        rows[row].append(k)
        places.put(row, free - size)
    return rows


_PACKED = pa.schema(
    [
        ("ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ]
)
PACKED = "ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"


def id_type(end_id: int) -> np.dtype:
    """Little-endian, two bytes where they hold every id."""
    return np.dtype("<u2" if end_id < 1 << 16 else "<u4")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, *, width: int = WIDTH, end_id: int = END_ID, pattern: str = PATTERN) -> DataFrame:
    """Rows of ``width`` ids: ids, n_ids, cu_seqlens, position_resets, doc_ids, pieces.

    ``end_id`` is above every id of the vocabulary; it ends each document and
    fills the row after its last segment. Segment k of a row is
    ``ids[cu_seqlens[k]:cu_seqlens[k + 1]]``, piece ``pieces[k]`` of document
    ``doc_ids[k]``; positions begin anew at its first id. Null and empty texts are
    an end id alone; repeated rows are packed for each. An empty table gives no
    rows. Columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = id_type(end_id)

    def pack(held: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        owner, piece, parts = [], [], []
        for doc, ids in held:
            for k in range(0, len(ids), width):
                owner.append(doc)
                piece.append(k // width)
                parts.append(ids[k : k + width])
        sizes = np.array([len(p) for p in parts])
        rows = best_fit(sizes, width)
        for low in range(0, len(rows), 256):
            some = rows[low : low + 256]
            matrix = np.full((len(some), width), end_id, kind)
            ends = []
            for r, members in enumerate(some):
                at = np.concatenate([[0], np.cumsum(sizes[members])])
                matrix[r, : at[-1]] = np.concatenate([parts[k] for k in members])
                ends.append(at)
            yield stacked(
                {
                    "ids": [row.tobytes() for row in matrix], "n_ids": [int(e[-1]) for e in ends], "cu_seqlens": ends,
                    "position_resets": [e[:-1] for e in ends], "doc_ids": [[owner[k] for k in m] for m in some],
                    "pieces": [[piece[k] for k in m] for m in some],
                },
                _PACKED,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern).encode_ordinary
        held, count = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], kind)
                held.append((doc, ids))
                count += len(ids)
                if count >= HELD_IDS:
                    yield from pack(held)
                    held, count = [], 0
        if held:
            yield from pack(held)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PACKED)


def segments(rows: DataFrame, end_id: int = END_ID) -> DataFrame:
    """One row per segment of ``packed`` rows: doc_id, piece, row_id, segment,
    start, length, ids_sha256 (of its ids as written). row_id is the SHA-256 of
    the row's ids, lengths, documents and pieces."""
    kind = id_type(end_id)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("row_id", pa.string()), ("segment", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("ids_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, ends, docs, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row_id = hashlib.sha256(ids + repr((ends, docs, pieces)).encode()).hexdigest()
                for k, (doc, piece) in enumerate(zip(docs, pieces, strict=True)):
                    part = ids[ends[k] * kind.itemsize : ends[k + 1] * kind.itemsize]
                    out.append((doc, piece, row_id, k, ends[k], ends[k + 1] - ends[k], hashlib.sha256(part).hexdigest()))
            yield stacked(dict(zip(schema.names, (list(c) for c in zip(*out, strict=True)), strict=True)), schema) if out else pa.RecordBatch.from_pylist([], schema)

    kinds = "doc_id long, piece int, row_id string, segment int, start int, length int, ids_sha256 string"
    return in_arrow(rows.select("ids", "cu_seqlens", "doc_ids", "pieces"), run, kinds)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position of each id of a row: from 0 in each segment, and 0 in the filling."""
    place = np.zeros(width, np.int64)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        place[a:b] = np.arange(b - a)
    return place


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write ``packed`` as Parquet into the shared folder, read it back, and return ``segments``."""
    path = f"{scratch_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    packed(docs, tokenizer).write.option("compression", "zstd").parquet(path)
    return segments(docs.sparkSession.read.parquet(path))
