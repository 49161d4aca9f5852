"""Near-duplicates by MinHash bands and odd sketches.

A document is its set of distinct five-word shingles. MinHash samples are cut
into bands; rows that share a band are compared by odd sketches: every sample
flips one bit of a bitmap, so that the population count of the XOR of two
bitmaps tells how many samples differ (Mitzenmacher, Pagh, Pham, 2014). What
passes that estimate, with a margin of about five standard errors, is confirmed
on full shingle sets.

Equal sets are one class from the start. Pairs stay inside tasks: a bucket hands
on a star per connected part, and buckets or groups above a block size are cut
into pairs of blocks, so that no task holds more than two blocks. No partner or
candidate is left out. The comparisons of one hot group of *different* texts
grow with the square of its size; its shuffle grows with size * size / block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import (
    chunks, in_arrow, joined_hash, lower_ascii, materialize, mixed, over_groups, span_hashes, split_words, stacked, together,
)
from layerflow.llm.components import connected

WIDTH = 5  # words of a shingle
ROWS = 5  # samples of a band
SAMPLES = 200  # the first of them make the bands, all make the sketch
SKETCH_BITS = 1024
BLOCK = 512  # rows of a block of sketches
TEXT_BLOCK = 256  # rows of a block of full sets

_RANDOM = np.random.Generator(np.random.PCG64(77))
_FACTOR = (_RANDOM.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SALT = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def bands_of(percent: int) -> int:
    """Bands for a threshold: a pair at 85 % misses all 24 of them with a chance
    of 8e-7, one at 80 % all 40 with 1e-7."""
    return 24 if percent >= 85 else SAMPLES // ROWS


def margin_of(percent: int) -> float:
    """How far an estimate may lie below the threshold: about five standard errors."""
    return 0.13 if percent >= 85 else 0.15


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and their bounds."""
    data = lower_ascii(data)
    starts, ends, row = split_words(data, bounds)
    word = span_hashes(data, starts, ends)
    rows = len(bounds) - 1
    counts = np.bincount(row, minlength=rows)
    shingle = joined_hash(word, width)
    inside = row[: len(shingle)] == row[width - 1 :] if len(shingle) else np.zeros(0, bool)
    values, owner = [shingle[inside]], [row[: len(shingle)][inside]]
    first = np.concatenate([[0], np.cumsum(counts)])
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(size):
                whole = mixed(whole + word[first[short] + k] * np.uint64(2 * k + 3) + np.uint64(size))
            values.append(whole)
            owner.append(short)
    value, own = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[fresh], own[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))])


def _samples(value: np.ndarray) -> np.ndarray:
    """MinHash samples of one set; the set is taken in pieces, so memory is bound."""
    low = (value ^ (value >> np.uint64(32))).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        part = low[k : k + 4096]
        np.minimum(least, (_FACTOR[:, None] * part[None, :] + _SHIFT[:, None]).min(1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of samples, as 64-bit words."""
    place = mixed(samples.astype(np.uint64) ^ _SALT[None, :]) % np.uint64(SKETCH_BITS)
    flips = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(flips, (np.arange(len(samples))[:, None], place.astype(np.int64)), 1)
    return np.packbits(flips, axis=1).view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Similarity from the bits in which two odd sketches differ."""
    share = np.minimum(1 - 2 * differing / SKETCH_BITS, 1.0)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(share, 1e-9))


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()),
    ]
)
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def _sign(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                value, cut = shingle_sets(data, bounds)
                n = end - row
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(value))])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(value ^ np.uint64(0x5851F42D4C957F2D)))])
                samples = np.stack([_samples(value[cut[k] : cut[k + 1]]) for k in range(n)])
                band = np.zeros((n, bands), np.uint64)
                for k in range(ROWS):
                    band = mixed(band + samples[:, k : bands * ROWS : ROWS] + np.arange(1, bands + 1, dtype=np.uint64))
                sketch = odd_sketch(samples)
                yield stacked(
                    {
                        "doc_id": batch.column(0).slice(row, n),
                        "n_shingles": np.diff(cut),
                        "d1": (total[cut[1:]] - total[cut[:-1]]).view(np.int64),
                        "d2": (other[cut[1:]] - other[cut[:-1]]).view(np.int64),
                        "bands": pa.ListArray.from_arrays(
                            np.arange(0, n * bands + 1, bands, dtype=np.int32), band.view(np.int64).ravel()
                        ),
                        "sketch": [s.tobytes() for s in sketch],
                    },
                    _SIGNED,
                )

    return run


def _least_label(linked: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Least name in the connected part of each vertex, for a stack of graphs."""
    linked = linked | np.eye(linked.shape[-1], dtype=bool)
    label = name
    while True:
        near = np.where(linked, label[..., None, :], np.iinfo(np.int64).max).min(-1)
        if np.array_equal(near, label):
            return label
        label = near


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(name: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    own = name != label
    return stacked({"a": name[own], "b": label[own]}, _EDGE)


def _spans(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.concatenate([first, [len(key)]]))


def _sketch_stars(threshold: float, margin: float):
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, size = table["doc_id"].to_numpy(), table["n_shingles"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(name), -1)
        first, count = _spans(table["g"].to_numpy())
        for c in np.unique(count):
            if c < 2:
                continue
            heads = first[count == c]
            step = max(1, (1 << 18) // int(c * c))
            for k in range(0, len(heads), step):
                at = heads[k : k + step, None] + np.arange(c)
                bits = np.zeros((len(at), c, c), np.int32)
                for w in range(sketch.shape[1]):
                    word = sketch[at, w]
                    bits += np.bitwise_count(word[:, :, None] ^ word[:, None, :])
                n = size[at].astype(float)
                small = np.minimum(n[:, :, None], n[:, None, :]) >= threshold * np.maximum(n[:, :, None], n[:, None, :])
                linked = small & (similarity(bits) >= threshold - margin)
                yield _stars(name[at].ravel(), _least_label(linked, name[at]).ravel())

    return lambda: apply


def shared_counts(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sizes of all intersections in a group of sets, by columns that two or
    more of them share."""
    rows = len(cut) - 1
    owner = np.repeat(np.arange(rows), np.diff(cut))
    _, column, often = np.unique(value, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    shared = np.zeros((rows, rows), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((rows, 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _exact_stars(percent: int):
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name = table["doc_id"].to_numpy()
        first, count = _spans(table["g"].to_numpy())
        text = table["text"].combine_chunks()
        for head, c in zip(first, count, strict=True):
            if c < 2:
                continue
            values, sizes = [], []
            for _, _, data, bounds in chunks(text.slice(head, c)):
                value, cut = shingle_sets(data, bounds)
                values.append(value)
                sizes.append(np.diff(cut))
            size = np.concatenate(sizes)
            shared = shared_counts(np.concatenate(values), np.concatenate([[0], np.cumsum(size)]))
            linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
            own = name[head : head + c]
            yield _stars(own, _least_label(linked, own))

    return lambda: apply


def block_pairs(df: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """Give each row a group ``g``: its key, or one for each pair of its block
    with a block of the same key, where the key has more than ``block`` rows.
    ``own`` is the row's block."""
    blocks = F.ceil(F.col(count) / block)
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    return df.withColumn("own", own).withColumn("other", other).withColumn(
        "g", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    ).drop("other")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. Documents are
    linked where ``100 * shared >= percent * union`` of their shingle sets.
    Null and empty texts have an empty set and are linked with nothing. Ids
    should be unique: rows of one id are all returned, with the least set class
    of that id. An empty table gives no rows.
    """
    signed = materialize(in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sign(bands_of(percent)), SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    # Written, so that the join reads it through an exchange that Spark can split.
    classes = materialize(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = materialize(
        full.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "rep"), "member"
    )
    reps = member.where("doc_id = rep").select("doc_id").distinct()
    banded = signed.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    often = banded.groupBy("band").count().where("count > 1")
    crowded = block_pairs(banded.join(often, "band"), "band", "count", BLOCK).select("doc_id", "g")
    compared = crowded.join(signed.select("doc_id", "n_shingles", "sketch"), "doc_id")
    maybe = over_groups(together(compared, "g"), "g", _sketch_stars(percent / 100, margin_of(percent)), "a long, b long")
    groups = materialize(connected(maybe), "groups")
    sizes = groups.groupBy("component").count()
    asked = block_pairs(
        groups.join(sizes, "component").select(F.col("id").alias("doc_id"), "component", "count"), "component", "count", TEXT_BLOCK
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    links = over_groups(
        together(asked.select("doc_id", "g").join(texts, "doc_id"), "g"), "g", _exact_stars(percent), "a long, b long"
    )
    found = connected(links)
    named = member.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id")
    )
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each document that stays when one of each group is kept.

    Of several rows of a kept id the one with the least digest of its columns
    stays, equal rows once: later stages would take them for repeats of each
    other. A row without an id is a document of its own, under a digest of its
    columns. Columns must have an order, so no maps.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    own, text = docs.toDF(*names), names[docs.columns.index("text")]
    # Digests are not negative, so that rows with small ids represent their groups first.
    digest = F.shiftrightunsigned(F.xxhash64(*names), 1)
    own = own.withColumn("_key", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), digest))
    kept = near_duplicates(own.select(F.col("_key").alias("doc_id"), F.col(text).alias("text")), percent).where("kept")
    kept = materialize(kept.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "kept")
    rows = own.join(kept, own["_key"] == kept["_id"])
    # Few ids have more rows than one; a minimum is combined before its shuffle, however many rows an id has.
    least = rows.where("_n > 1").groupBy("_id").agg(F.min(F.struct(F.xxhash64(*names).alias("_digest"), *names)).alias("least"))
    return rows.where("_n = 1").select(*names).union(least.select(*(f"least.{c}" for c in names))).toDF(*docs.columns)
