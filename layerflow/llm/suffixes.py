"""Removal of byte strings that occur more than once, by suffix arrays in shards.

Every string of ``length`` bytes belongs to the shard of its least inner gram
(a minimizer), so equal strings meet in one shard wherever they lie. What a
document sends to a shard is a run of neighbouring strings with one minimizer,
about 1.4 times ``length`` bytes for 85 strings. Runs whose minimizer is found
nowhere else are never sent, and equal runs are sent once.

A shard sorts its suffixes by Larsson and Sadakane's doubling: ranks of the
first eight bytes are refined to 16, 32, ... bytes, and only suffixes that are
not yet told apart are sorted again. Suffixes with a common prefix of ``length``
bytes are repeats. A minimizer with many different runs is cut into several
shards, whose sorted strings are merged in ranges by binary search. The runs of such
shards are written beside the results, so that texts are read once for all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from layerflow.llm.common import chunks, in_arrow, materialize, over_groups, span_hashes, stacked, together

LENGTH = 200
GRAM = 32
SHARD_RUNS = 512  # different runs of one minimizer in one shard


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, start, number of strings, minimizer, hash of the bytes, and whether
    the minimizer occurs in it twice, of each run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    at = np.arange(len(data) - gram + 1)
    value = span_hashes(data, at, at + gram)
    inner = length - gram + 1
    least = _sliding_least(value, inner)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)[: len(least)]
    whole = bounds[1:][owner] >= np.arange(len(least)) + length
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    start = np.flatnonzero(change & whole)
    stop = np.flatnonzero(whole & np.concatenate([change[1:] | ~whole[1:], [True]])) + 1
    mini = least[start]
    twice = np.zeros(len(start), bool)
    for k in range(0, len(start), 4096):
        a, b, m = start[k : k + 4096], stop[k : k + 4096], mini[k : k + 4096, None]
        first = a + (value[a[:, None] + np.arange(inner)] == m).argmax(1)
        last = b - 1 + inner - 1 - (value[(b - 1)[:, None] + np.arange(inner)[::-1]] == m).argmax(1)
        twice[k : k + 4096] = first != last
    return owner[start], start, stop - start, mini, span_hashes(data, start, stop - 1 + length), twice


_RUN = pa.schema(
    [("doc_id", pa.int64()), ("at", pa.int32()), ("strings", pa.int32()), ("mini", pa.int64()), ("body", pa.int64()), ("twice", pa.bool_())]
)


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                owner, start, strings, mini, body, twice = runs(data, bounds, length, gram)
                yield stacked(
                    {
                        "doc_id": batch.column(0).slice(row, end - row).take(pa.array(owner)),
                        "at": start - bounds[owner], "strings": strings,
                        "mini": mini.view(np.int64), "body": body.view(np.int64), "twice": twice,
                    },
                    _RUN,
                )

    return run


def _refine(rank: np.ndarray, order: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes that share a rank by their second key.

    ``order`` lists all suffixes by rank; ranks are places in it.
    """
    ranked = rank[order]
    same = ranked[1:] == ranked[:-1]
    open_ = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    place = np.flatnonzero(open_)
    if not len(place):
        return rank, order
    suffix = order[place]
    key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second[suffix].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    suffix, key = suffix[by], key[by]
    order = order.copy()
    order[place] = suffix
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank = rank.copy()
    rank[suffix] = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
    return rank, order


def suffix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``data`` to a depth of ``length`` bytes, and the ranks:
    suffixes have one rank if their first ``length`` bytes are equal.

    Common prefixes follow from the ranks, not from a walk along the bytes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    depth = min(8, length)
    for k in range(depth):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while depth < length:
        step = min(depth, length - depth)
        second = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])[:n]
        rank, order = _refine(rank, order, second)
        depth += step
    return order, rank


def _strings(bodies: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the place of each string's first byte, and the row of each string."""
    if isinstance(bodies, pa.ChunkedArray):
        bodies = bodies.combine_chunks()
    (_, _, data, bounds), = chunks(bodies, 1 << 62)
    count = np.diff(bounds) - length + 1
    owner = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return data, bounds[owner] + within, owner


def _as_runs(found: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """Per row, from and to of each run of true values, flat."""
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    count = np.bincount(owner, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    begin = np.flatnonzero(found & ~(same & np.concatenate([[False], found[:-1]])))
    after = np.concatenate([same[1:], [False]]) & np.concatenate([found[1:], [False]])
    end = np.flatnonzero(found & ~after) + 1
    pairs = np.stack([begin - first[owner[begin]], end - first[owner[begin]]], 1).ravel() if len(begin) else np.zeros(0, int)
    offsets = np.concatenate([[0], np.cumsum(2 * np.bincount(owner[begin], minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs, pa.int32()))


_SHARD = pa.schema(
    [("mini", pa.int64()), ("body", pa.int64()), ("repeats", pa.list_(pa.int32())), ("g", pa.int64()), ("slice", pa.int64()), ("strings", pa.binary())]
)
SHARD = "mini long, body long, repeats array<int>, g long, slice long, strings binary"
SHARD_BYTES = 1 << 20


def _pieces(table: pa.Table, key: np.ndarray, size: np.ndarray) -> Iterator[pa.Table]:
    """Runs of whole groups of about ``SHARD_BYTES`` bytes."""
    last = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    upto = np.cumsum(size)[last - 1]
    row = done = 0
    while row < len(key):
        k = int(np.searchsorted(upto, done + SHARD_BYTES, side="right"))
        k = max(k - 1, int(np.searchsorted(last, row, side="right")))
        k = min(k, len(last) - 1)
        yield table.slice(row, last[k] - row)
        row, done = int(last[k]), int(upto[k])


def _sort_shards(length: int):
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in table["bytes"].to_pylist()])
        for piece in _pieces(table, table["g"].to_numpy(), size):
            data, place, owner = _strings(piece["bytes"], length)
            _, rank = suffix_ranks(data, length)
            spread, copies = piece["spread"].to_numpy(), piece["copies"].to_numpy()
            mini, body, g = (piece[c].to_numpy() for c in ("mini", "body", "g"))
            own = rank[place]
            by = np.argsort(own, kind="stable")
            ranked = own[by]
            same = ranked[1:] == ranked[:-1]
            found = np.zeros(len(own), bool)
            found[by] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            found |= copies[owner] > 1
            alone = np.flatnonzero(spread == 1)
            lists = _as_runs(found, owner, len(spread)).take(pa.array(alone))
            none = [None] * len(alone)
            yield stacked(
                {"mini": mini[alone], "body": body[alone], "repeats": lists, "g": g[alone], "slice": none, "strings": none}, _SHARD
            )
            hot = spread > 1
            if not hot.any():
                continue
            split = np.flatnonzero(hot)  # read again when the shards are merged
            nothing = [None] * len(split)
            yield stacked(
                {
                    "mini": mini[split], "body": body[split], "repeats": nothing, "g": g[split], "slice": nothing,
                    "strings": piece["bytes"].combine_chunks().take(pa.array(split)).cast(pa.binary()),
                },
                _SHARD,
            )
            print_of = span_hashes(data, place, place + length)
            for shard in np.unique(g[hot]):
                mine = hot & (g == shard)
                part = mine[owner]
                value, count = np.unique(print_of[part], return_counts=True)
                often = np.isin(value, print_of[part & found])
                value, often = value, often | (count > 1)
                width = int(spread[mine][0])
                cuts = np.searchsorted(value, np.arange(1, width, dtype=np.uint64) * np.uint64((1 << 64) // width))
                for k, (some, flag) in enumerate(zip(np.split(value, cuts), np.split(often, cuts), strict=True)):
                    if len(some):
                        yield stacked(
                            {
                                "mini": [mini[mine][0]], "body": [None], "repeats": [None], "g": [shard], "slice": [k],
                                "strings": [some.tobytes() + flag.tobytes()],
                            },
                            _SHARD,
                        )

    return lambda: apply


_FOUND = pa.schema([("g", pa.int64()), ("strings", pa.binary())])


def _merge_slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of the shards of one minimizer and range: the strings that repeat."""
    key, shard, blobs = table["m"].to_numpy(), table["g"].to_numpy(), table["strings"].to_pylist()
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for a, b in zip(first[:-1], first[1:], strict=True):
        parts = []
        for blob in blobs[a:b]:
            n = len(blob) // 9
            parts.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, bool, n, 8 * n)))
        merged, often = parts[0][0], parts[0][1].copy()
        for value, flag in parts[1:]:
            at = np.minimum(np.searchsorted(merged, value), len(merged) - 1)
            known = merged[at] == value
            often[at[known]] = True
            where = np.searchsorted(merged, value[~known])
            merged, often = np.insert(merged, where, value[~known]), np.insert(often, where, flag[~known])
        repeated = merged[often]
        for k, (value, _) in enumerate(parts):
            own = value[np.isin(value, repeated, assume_unique=True)]
            if len(own):
                yield stacked({"g": [shard[a + k]], "strings": [own.tobytes()]}, _FOUND)


def _mark_hot(length: int):
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(table, table["g"].to_numpy(), np.array([len(x or b"") for x in table["bytes"].to_pylist()])):
            told = piece.filter(piece["strings"].is_valid())
            rows = piece.filter(piece["bytes"].is_valid())
            if not rows.num_rows:
                continue
            repeated = np.frombuffer(b"".join(told["strings"].to_pylist()), np.uint64)
            data, place, owner = _strings(rows["bytes"], length)
            found = np.isin(span_hashes(data, place, place + length), repeated)
            none = [None] * rows.num_rows
            yield stacked(
                {
                    "mini": rows["mini"].combine_chunks(), "body": rows["body"].combine_chunks(),
                    "repeats": _as_runs(found, owner, rows.num_rows), "g": rows["g"].combine_chunks(), "slice": none, "strings": none,
                },
                _SHARD,
            )

    return lambda: apply


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, once: DataFrame | None = None) -> DataFrame:
    """(doc_id, at, repeats): per run of strings the starts of those that occur
    elsewhere, as from and to (exclusive), counted from ``at``. ``docs`` has
    doc_id and text and unique ids, or ``once`` has one row of each of its ids,
    and rows of one id have one text. Ids are not null."""
    cut = materialize(in_arrow(docs, _cut(length, gram), "doc_id long, at int, strings int, mini long, body long, twice boolean"), "runs")
    shared = cut.groupBy("mini").agg(F.count("*").alias("n"), F.max("twice").alias("t")).where("n > 1 OR t").select("mini")
    maybe = materialize(cut.join(shared, "mini").drop("twice"), "maybe")
    one = maybe.groupBy("mini", "body").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "at", "strings")).alias("o")
    )
    spread = one.groupBy("mini").agg(F.ceil(F.count("*") / SHARD_RUNS).alias("spread")).where("spread > 1")
    one = one.join(spread, "mini", "left").select(
        "mini", "body", "copies", F.coalesce("spread", F.lit(1)).alias("spread"), "o.doc_id", "o.at", "o.strings"
    )
    raw = F.col("text").cast("binary")
    bodies = one.join(docs if once is None else once, "doc_id").select(
        "mini", "body", "copies", "spread", F.xxhash64("mini", F.pmod("body", "spread")).alias("g"),
        F.substring(raw, F.col("at") + 1, F.col("strings") + (length - 1)).alias("bytes"),
    )
    sorted_ = materialize(over_groups(together(bodies, "g"), "g", _sort_shards(length), SHARD), "shards")
    told = sorted_.where("repeats IS NOT NULL")
    slices = sorted_.where("slice IS NOT NULL").withColumn("m", F.xxhash64("mini", "slice"))
    if not slices.isEmpty():
        merged = over_groups(together(slices.select("m", "g", "strings"), "m"), "m", lambda: _merge_slices, "g long, strings binary")
        again = sorted_.where("repeats IS NULL AND slice IS NULL").select(
            "g", "mini", "body", F.col("strings").alias("bytes"), F.lit(None).cast("binary").alias("strings")
        )
        found = merged.select("g", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("binary"), "strings")
        told = told.union(over_groups(together(again.union(found), "g"), "g", _mark_hot(length), SHARD))
    return maybe.join(told.where("size(repeats) > 0").select("mini", "body", "repeats"), ["mini", "body"]).select("doc_id", "at", "repeats")


_CUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def _remove(length: int, kept: list[str], place: int):
    """``place`` is the text's column; the last one has the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(place).cast(pa.large_binary())
            total, removed, spans, digest, rest = [], [], [], [], []
            for row, mark in enumerate(marks):
                data = texts[row].as_py() or b""
                total.append(len(data))
                gone = np.zeros(len(data) + 1, np.int8)
                for m in mark or ():
                    pairs = np.array(m["repeats"]).reshape(-1, 2) + m["at"]
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 1] + length - 1, -1)
                if mark:
                    out = np.cumsum(gone[:-1], dtype=np.int64) > 0
                    edge = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
                    removed.append(int(out.sum()))
                    spans.append(int((edge == 1).sum()))
                    data = np.frombuffer(data, np.uint8)[~out].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                digest.append(hashlib.sha256(data).hexdigest())
                rest.append(data.decode("utf-8", "ignore"))
            added = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *added], names=[*kept, *_CUT])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, ...) with ``key``: rows share one only if their texts
    are equal. It is the id, or a hash of id and text where the id is null or has
    different texts, and null where the text is."""
    print_of = F.xxhash64("text")
    several = docs.where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min(print_of).alias("a"), F.max(print_of).alias("b"))
    several = materialize(several.where("a <> b").select("id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        marked, hashed = docs, F.col("id").isNull()
    else:
        marked, hashed = docs.join(several, "id", "left"), F.col("id").isNull() | F.col("several")
    key = F.when(F.col("text").isNotNull(), F.when(hashed, F.xxhash64("id", "text")).otherwise(F.col("id")))
    return marked.withColumn("key", key).drop("several")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Each byte covered by a string of ``length`` bytes that also starts anywhere
    else, in this or another document, is removed; strings are judged on the
    input. Null texts count as empty and have no repeats, as have texts below
    ``length`` bytes. kept_text drops the parts of characters that a cut left.
    Every row is a document, also where ids repeat or are null; rows of equal texts
    are each other's repeats. Columns named like the added ones are replaced. An
    empty table gives no rows.
    """
    if not 8 <= gram < length:
        raise ValueError("8 <= gram < length")
    kept = [c for c in docs.columns if c not in _CUT]
    names = [f"c{k}" for k in range(len(kept))]
    own = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)),
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
    )
    own = _keyed(own)
    texts = own.where("key IS NOT NULL").select(F.col("key").alias("doc_id"), "text")
    # Rows of one key have equal texts: one of them is enough where bytes are read.
    repeated = texts.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    once = texts
    if not repeated.isEmpty():
        several = texts.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        once = texts.join(repeated, "doc_id", "left_anti").union(several)
    found = repeated_runs(texts, length, gram, once)
    marks = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "repeats")).alias("marks")).withColumnRenamed("doc_id", "key")
    # A kept text is shuffled once, not beside a copy of itself.
    same = docs.schema["text"].dataType == StringType()
    joined = own.join(marks, "key", "left").select(*names, *([] if same else ["text"]), "marks")
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name, kind in zip(_CUT, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return in_arrow(joined, _remove(length, kept, kept.index("text") if same else len(kept)), schema)


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeats cut out of text and n_chars counted anew; documents
    of which nothing is left go."""
    cut = without_repeats(docs, length).where("n_removed = 0 OR kept_text <> ''")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("n_chars"))
    return cut.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
