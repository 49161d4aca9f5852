"""Toxicity by class-conditional Kneser-Ney models.

A word is a bigram of its stem (the first bytes) and its ending. Two models are
learned, of toxic and of ordinary labelled documents. Counts are those of Kneser
and Ney: not how often an expression occurs, but after how many different words,
so that copies of a text weigh no more than one. Both models take discounts and back off, endings to stems and stems to counts that both classes
share. A discount is a constant, in proportion to the size of the class, and twice
the count that is expected from both classes; the mass that is backed off is one
for both. A stem's endings have more contexts together than the stem has different
ones, the more so the more text there is and in the larger class most; so an ending's
count must also pass the discounts when compared with the sum over its stem's endings.
So an expression that is rare, or nearly as common in one class as in
the other, has the same probability in both and is no evidence. A document's evidence is
the difference of the two log-likelihoods per different word; a logistic curve, fitted on
labelled documents that the counts don't hold, turns it into a score.

Expressions and the words before them are counted whole, in tables that grow with
the labelled text, by 64-bit keys. Only stems and words whose count passes the
discounts in some class are evidence; what goes to the executors is their list,
sorted by key. A discount takes at least ``DISCOUNT`` contexts of the smaller
class's size, so the list has at most two thirds as many entries as the smaller
class has contexts. Beyond ``MOST_ENTRIES`` of them, the documents' words are joined
with the table instead. Labels are broadcast up to ``MOST_LABELS``, joined beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import chunks, fold, held_out, in_arrow, lower_ascii, materialize, span_hashes, split_words, stacked

MOST_LABELS = 1_000_000  # broadcast
MOST_ENTRIES = 2_000_000  # of the lists that are broadcast, 16 bytes each
MOST_POINTS = 50_000  # labelled documents for the logistic curve
STEM = 4  # bytes
STEM_BITS, WORD_BITS = 28, 36  # of a word's key: its stem's hash, then its own
DISCOUNT = 4.0  # of the smaller class; the larger one's is in proportion to its size
EXPECTED = 2.0  # times the count expected from both classes that a discount takes besides
TRUST = 20.0  # endings that each stem is taken to have besides those counted
UNSEEN = 0.05  # share of the common probability that unseen stems have
HELD = 1 << 21  # expressions that a task gathers before it hands them on

_PART = np.ones(256, bool)
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def expressions(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word, class of the word before it (0: none), and row."""
    data = lower_ascii(data)
    starts, ends, row = split_words(data, bounds, _PART)
    value = span_hashes(data, starts, ends)
    stem = span_hashes(data, starts, np.minimum(starts + STEM, ends)) >> np.uint64(64 - STEM_BITS)
    key = ((stem << np.uint64(WORD_BITS)) | (value >> np.uint64(64 - WORD_BITS))).view(np.int64)
    before = np.zeros(len(value), np.int64)
    before[1:] = np.where(row[1:] == row[:-1], 1 + (value[:-1] % np.uint64((1 << 30) - 1)).astype(np.int64), 0)
    return key, before, row


def stem_of(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(WORD_BITS)).astype(np.int64)


_SEEN = "key long, tail int"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word's key, word before and class), each once for what a task holds at a time."""
    schema = pa.schema([("key", pa.int64()), ("tail", pa.int32())])
    held: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        every = np.unique(np.concatenate(held))
        held.clear()
        return stacked({"key": every["key"], "tail": every["tail"]}, schema)

    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end, data, bounds in chunks(batch.column(0)):
            key, before, owner = expressions(data, bounds)
            seen = np.empty(len(key), [("key", np.int64), ("tail", np.int32)])
            seen["key"], seen["tail"] = key, (before << 1) | toxic[row:end][owner]
            held.append(np.unique(seen))
            if sum(map(len, held)) > HELD:
                yield told()
    if held:
        yield told()


@dataclass(frozen=True)
class Model:
    """Evidence of the stems and words that have any: the difference of the
    logarithms of both classes' probabilities, by sorted key; ``other`` is that of
    all other stems. The tables are frames where they are too large to send."""

    stems: np.ndarray
    stem_evidence: np.ndarray
    words: np.ndarray
    word_evidence: np.ndarray
    other: float
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    table: DataFrame | None = None  # of (key, is_stem, evidence), beyond MOST_ENTRIES


def features(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the logistic curve weighs: the same evidence per word says more of a longer text."""
    return np.stack([np.ones(len(value)), value, value * np.log1p(count), value * np.sqrt(count)], 1)


def _over(count: Column, size: Column, both: Column, discount: Column) -> Column:
    """What is left of a class's count: less the discount, and less what is
    expected from the count in both classes."""
    return F.greatest(count - discount - EXPECTED * size * both, F.lit(0.0))


def learn_counts(rows: DataFrame) -> Model:
    """Both models from rows of (text, toxic boolean)."""
    seen = materialize(in_arrow(rows.select("text", "toxic"), _count, _SEEN).distinct(), "contexts")
    side = [F.count_if(F.col("tail") % 2 == c).cast("double").alias(n) for c, n in ((0, "a"), (1, "b"))]
    stem = F.shiftrightunsigned("key", WORD_BITS)
    words = materialize(seen.groupBy("key").agg(*side).withColumn("stem", stem), "words")
    stems = materialize(seen.select(stem.alias("stem"), "tail").distinct().groupBy("stem").agg(*side), "stems")
    total = stems.agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    sizes = [max(1.0, x) for x in total]
    size, discount = [F.lit(s) for s in sizes], [F.lit(DISCOUNT * s / min(sizes)) for s in sizes]

    share = (F.col("a") + F.col("b")) / sum(sizes)
    above = [_over(F.col(n), size[c], share, discount[c]) for c, n in enumerate("ab")]
    kept = stems.select("stem", "a", "b", share.alias("share"), above[0].alias("over_a"), above[1].alias("over_b"))
    over, number = kept.agg(F.sum("over_a"), F.sum("over_b")).first(), max(1, stems.count())
    left = [1 - (x or 0.0) / s for x, s in zip(over, sizes, strict=True)]
    common = (1 - UNSEEN) * F.col("share") + UNSEEN / number
    chance = [F.col(f"over_{n}") / size[c] + left[c] * common for c, n in enumerate("ab")]
    marked = kept.where("over_a > 0 OR over_b > 0").select(F.col("stem").alias("key"), F.lit(True).alias("is_stem"), F.ln(chance[1] / chance[0]).alias("evidence"))

    inside = words.groupBy("stem").agg(F.sum("a").alias("inside_a"), F.sum("b").alias("inside_b"))
    number_inside = F.col("inside_a") + F.col("inside_b")
    whole = stems.join(inside, "stem").select(
        "stem", F.col("a").alias("stem_a"), F.col("b").alias("stem_b"), "inside_a", "inside_b",
        F.greatest(number_inside, F.col("a") + F.col("b"), F.lit(1.0)).alias("whole"),
    )
    of_stem = (F.col("a") + F.col("b")) / F.col("whole")
    ending = [
        F.when(
            _over(F.col(n), F.col(f"inside_{n}"), (F.col("a") + F.col("b")) / number_inside, discount[c]) > 0,
            _over(F.col(n), F.col(f"stem_{n}"), of_stem, discount[c]),
        ).otherwise(0.0)
        for c, n in enumerate("ab")
    ]
    deep = words.join(whole, "stem").withColumns({"end_a": ending[0], "end_b": ending[1]}).where("end_a > 0 OR end_b > 0")
    deep = materialize(deep, "endings")
    taken = deep.groupBy("stem").agg(F.sum(F.col("end_a") + F.col("end_b")).alias("taken"))
    every = F.col("whole") + TRUST
    shared = (1 - F.col("taken") / every) * (F.col("a") + F.col("b") + 0.1) / every
    given = [F.col(f"end_{n}") / (F.col(f"stem_{n}") + TRUST * sizes[c] / sum(sizes)) + shared for c, n in enumerate("ab")]
    told = deep.join(taken, "stem").select("key", F.lit(False).alias("is_stem"), F.ln(given[1] / given[0]).alias("evidence"))

    table = materialize(marked.union(told), "evidence")
    other = float(np.log(left[1] / left[0]))
    none = np.zeros(0, np.int64), np.zeros(0)
    if table.count() > MOST_ENTRIES:
        return Model(*none, *none, other, table=table)
    found = table.orderBy("key").toArrow()
    key, is_stem, value = (found[c].to_numpy(zero_copy_only=False) for c in ("key", "is_stem", "evidence"))
    is_stem = is_stem.astype(bool)
    return Model(key[is_stem], value[is_stem], key[~is_stem], value[~is_stem], other)


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def different_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the different words of each row."""
    key, _, row = expressions(data, bounds)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[fresh], key[fresh]


def evidence(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference of the log-likelihoods per different word, and their number, of each row."""
    row, key = different_words(data, bounds)
    value = _looked_up(model.stems, model.stem_evidence, stem_of(key), model.other)
    value = value + _looked_up(model.words, model.word_evidence, key, 0.0)
    rows = len(bounds) - 1
    count = np.bincount(row, minlength=rows)
    return np.bincount(row, weights=value, minlength=rows) / np.maximum(count, 1), count


def _summed(docs: DataFrame, model: Model) -> DataFrame:
    """(row, evidence, n_words) of (row, text) by joins with a table too large to send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("stem", pa.int64())])
        for batch in batches:
            for first, end, data, bounds in chunks(batch.column(1)):
                row, key = different_words(data, bounds)
                owner = batch.column(0).slice(first, end - first).take(pa.array(row))
                yield stacked({"row": owner, "key": key, "stem": stem_of(key)}, schema)

    asked = in_arrow(docs.select("row", "text"), run, "row long, key long, stem long")
    words = model.table.where("NOT is_stem").select("key", F.col("evidence").alias("of_word"))
    stems = model.table.where("is_stem").select(F.col("key").alias("stem"), F.col("evidence").alias("of_stem"))
    value = F.coalesce("of_word", F.lit(0.0)) + F.coalesce("of_stem", F.lit(model.other))
    valued = asked.join(words, "key", "left").join(stems, "stem", "left")
    summed = valued.groupBy("row").agg(F.avg(value).alias("evidence"), F.count("*").alias("n_words"))
    return docs.select("row").join(summed, "row", "left").select(
        "row", F.coalesce("evidence", F.lit(0.0)).alias("evidence"), F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words")
    )


def _weighed(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` of (doc_id, held_out, text) as doc_id, held_out, evidence, n_words."""
    kind = docs.select("doc_id", "held_out").schema.add("evidence", "double").add("n_words", "long")
    texts = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    if model.table is not None:
        rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
        return rows.join(_summed(rows, model), "row").select(*kind.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(2)):
                value, count = evidence(shared.value, data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(value), pa.array(count, pa.int64())],
                    names=kind.names,
                )

    return in_arrow(texts, run, kind)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` of (doc_id, held_out, text) as doc_id, held_out, score, predicted, evidence, n_words.

    n_words counts different words. Texts that are null or have no word get the
    score of no evidence.
    """
    value, n = F.col("evidence"), F.col("n_words")
    terms = (F.lit(1.0), value, value * F.log1p(n), value * F.sqrt(n))  # as in ``features``
    logit = sum((F.lit(float(w)) * x for w, x in zip(model.curve, terms, strict=True)), F.lit(0.0))
    scored = _weighed(docs, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0)))))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "n_words")


def fit_curve(value: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Weights of the logistic curve, by Newton's method with a small ridge."""
    x = features(value, count)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the labelled documents that are not held out.

    Counts come from those whose crc32 modulo 5 is 1 to 3, the curve from those
    with 4. ``labels`` has doc_id and toxic; of repeated ids the largest label
    counts, null labels don't. Where the curve's documents lack a class, evidence is
    added to the logit of their smoothed share of toxic ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.select("doc_id", (F.col("toxic") > 0).alias("toxic")), "labels")
    known = F.broadcast(known) if known.count() <= MOST_LABELS else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(known, "doc_id")
    model = learn_counts(rows.where(fold() != 4))
    asked = score(texts.where(fold() == 4).join(known, "doc_id").select(F.struct("doc_id", "toxic").alias("doc_id"), F.lit(False).alias("held_out"), "text"), model)
    points = asked.orderBy(F.xxhash64("doc_id")).limit(MOST_POINTS).select("doc_id.toxic", "evidence", "n_words").toArrow()
    toxic = np.array(points["toxic"].to_pylist(), float)
    if 0 < toxic.sum() < len(toxic):
        curve = fit_curve(points["evidence"].to_numpy(), points["n_words"].to_numpy(), toxic)
    else:
        curve = (float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))), 1.0, 0.0, 0.0)
    return replace(model, curve=curve)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...) for every row of ``docs``."""
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs, labels))
