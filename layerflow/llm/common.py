"""Text kernels for Arrow batches, grouped streams and intermediate tables.

Texts are handled as UTF-8 bytes, many documents at a time, in numpy arrays
whose size is bound by ``CHUNK_BYTES`` (or by one document, if that is longer).
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow import session
from layerflow.session import scratch_dir

__all__ = [
    "CHUNK_BYTES", "chunks", "in_arrow", "fold", "held_out", "joined_hash", "lower_ascii", "materialize", "mixed", "over_groups",
    "scratch_dir", "span_hashes", "split_words", "stacked", "together", "whole_groups",
]

CHUNK_BYTES = 1 << 20
BATCH_BYTES, UNSET_BATCH = 8 << 20, "67108864b"  # ours, and the one that Spark comes with
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SEED = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _SEED.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """``session.materialize``, after which Spark removes the shuffle files of that write.

    What was written is read from its own files. Shuffle files would stay until the
    driver happens to collect its garbage, and with texts in them fill the disks.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        return session.materialize(df, label)
    finally:
        if before is None:
            conf.unset(_FREED)
        else:
            conf.set(_FREED, before)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for documents that nothing is learned from; a null id is held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte bounds of the rows) for runs of rows.

    Null counts as empty. A run ends before it passes ``limit`` bytes, but has
    one row at least.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        bounds = offsets[row : end + 1] - offsets[row]
        yield row, end, data[offsets[row] : offsets[end]], bounds
        row = end


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks find this package wherever they run.

    The package is sent to the executors once per application, so that no
    other installation is needed there. Arrow batches of the session are bound
    by ``BATCH_BYTES`` where the session has no bound of its own, so that long texts don't fill a task.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == UNSET_BATCH:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    context = df.sparkSession.sparkContext
    if not getattr(context, "_layerflow_sent", False):
        top = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="layerflow-code-")) / "layerflow.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted((top / "layerflow").rglob("*.py")):
                z.write(source, source.relative_to(top))
        context.addPyFile(str(archive))
        context._layerflow_sent = True
    return df.mapInArrow(run, schema)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not white space (or in
    another table of 256 bytes that part words)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, wherever it lies."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def joined_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += items[k : k + n] * _PLACE[k]
    return mixed(total + np.uint64(width))


def stacked(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, columns.values(), strict=True)],
        schema=schema,
    )


def together(df: DataFrame, key: str, then: Iterable[str] = ()) -> DataFrame:
    """Rows of a key side by side in one partition, in order of ``then``."""
    return df.repartition(key).sortWithinPartitions(key, *then)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, enough: int = 4096) -> Iterator[pa.Table]:
    """Tables that hold each group of a sorted stream whole, many groups in one.

    What is held back is bound by ``enough`` rows, a batch and the largest group.
    """
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(waiting)
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            waiting, rows = table.slice(cut).to_batches(), table.num_rows - cut
        else:
            enough = max(enough, 2 * rows) if rows >= 2 * enough else enough
    if rows:
        yield pa.Table.from_batches(waiting)


def over_groups(
    df: DataFrame, key: str, make: Callable[[], Callable[[pa.Table], Iterator[pa.RecordBatch]]], schema: str
) -> DataFrame:
    """Apply a function to tables of whole groups; ``make`` is called in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for table in whole_groups(batches, key):
            yield from apply(table)

    return in_arrow(df, run, schema)
