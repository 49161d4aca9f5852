"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow trees are grown on the statistics of labelled documents. Every path of
every tree is a rule, a conjunction of bounds on statistics. A logistic
regression with an L1 penalty gives most rules the weight zero, and those left
are compiled into one Spark column over the statistics (Friedman and Popescu,
2008). Every text is read once, for its statistics.

The model is fitted on at most ``MOST_LABELS`` labelled documents, in hash order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import chunks, in_arrow, joined_hash, materialize, span_hashes, split_words

FOLDS, HELD_OUT = 3, 1
MOST_LABELS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
PENALTY = 0.001

# Shares of bytes that are in a class, per word or per byte.
_CLASSES = {
    "symbols": "#*$%&|<>", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "marks": ".,;:!?", "brackets": "(){}[]/\\=+_~^@\"'",
}
_TABLES = {name: np.isin(np.arange(256), [ord(c) for c in members]) for name, members in _CLASSES.items()}
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True

STATISTICS = (
    "words", "word_length", "long_words", "distinct_words", "top_word", "distinct_triples", *_CLASSES, "beyond_ascii", "lines", "line_length", "repeated_lines",
)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values of each row, and how often the most frequent one is there."""
    kinds, most = np.zeros(rows), np.zeros(rows)
    if len(row):
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
        kinds += np.bincount(r[first], minlength=rows)
        np.maximum.at(most, r[first], np.diff(np.concatenate([first, [len(r)]])))
    return kinds, most


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of bytes; all are zero for a row without a word."""
    rows = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    starts, ends, row = split_words(data, bounds)
    word = span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    words = np.bincount(row, minlength=rows).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    kinds, most = _distinct(row, word, rows)
    triple = joined_hash(word, 3)
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    triples, _ = _distinct(row[: len(triple)][inside], triple[inside], rows)
    out = {
        "words": np.log1p(words), "word_length": np.bincount(row, length, rows) / per_word, "long_words": np.bincount(row, length > 20, rows) / per_word,
        "distinct_words": kinds / per_word, "top_word": most / per_word, "distinct_triples": triples / np.maximum(words - 2, 1),
    }
    for name, table in _TABLES.items():
        upto = np.concatenate([[0], np.cumsum(table[data])])
        out[name] = (upto[bounds[1:]] - upto[bounds[:-1]]) / per_byte
    upto = np.concatenate([[0], np.cumsum(data >= 128)])
    out["beyond_ascii"] = (upto[bounds[1:]] - upto[bounds[:-1]]) / per_byte
    first, last, line_row = split_words(data, bounds, _LINE)
    lines = np.bincount(line_row, minlength=rows).astype(float)
    different, _ = _distinct(line_row, span_hashes(data, first, last), rows)
    out["lines"] = np.log1p(lines)
    out["line_length"] = np.log1p(size / np.maximum(lines, 1))
    out["repeated_lines"] = (lines - different) / np.maximum(lines, 1)
    return {name: np.where(words > 0, out[name], 0.0) for name in STATISTICS}


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double per name of ``STATISTICS``) of rows of (doc_id, text)."""
    kind = docs.select("doc_id").schema
    for name in STATISTICS:
        kind = kind.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                found = measure(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *map(pa.array, found.values())], names=["doc_id", *found])

    return in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, kind)


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: above the first, at most the second number of each."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        parts = []
        for name, above, upto in self.bounds:
            parts += [F.col(name) > F.lit(above)] * (above > -math.inf) + [F.col(name) <= F.lit(upto)] * (upto < math.inf)
        return reduce(and_, parts)

    def met(self, values: Mapping[str, float]) -> bool:
        return all(above < values[name] <= upto for name, above, upto in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    intercept: float

    def chance(self) -> Column:
        """Probability of a good text, as a column over the statistics."""
        terms = [F.lit(self.intercept), *(F.when(r.holds(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules)]
        while len(terms) > 1:  # pairwise, so that the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
        return 1 / (1 + F.exp(-terms[0]))


def _paths(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:
    """A rule for every node below the root of a fitted tree."""
    if bounds:
        yield Rule(tuple((name, *bounds[name]) for name in sorted(bounds)))
    if node.subtreeDepth() == 0:
        return
    name, value = STATISTICS[node.split().featureIndex()], node.split().threshold()
    above, upto = bounds.get(name, (-math.inf, math.inf))
    yield from _paths(node.leftChild(), bounds | {name: (above, min(upto, value))})
    yield from _paths(node.rightChild(), bounds | {name: (max(above, value), upto)})


def fit(sample: DataFrame) -> Ensemble:
    """Rules and their weights from rows of the statistics and ``label`` (0 or 1).

    Where the sample lacks one of the labels there are no rules, and the chance
    is its smoothed share of good ones.
    """
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        return Ensemble((), math.log((good + 0.5) / (n - good + 0.5)))
    measured = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"), *STATISTICS)
    grown = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, bootstrap=False, featureSubsetStrategy="onethird", minInstancesPerNode=5
    ).fit(measured)
    found = dict.fromkeys(rule for tree in grown.trees for rule in _paths(tree._call_java("rootNode"), {}))
    rules = sorted(found, key=lambda r: r.bounds)
    if not rules:
        return Ensemble((), math.log((good + 0.5) / (n - good + 0.5)))
    matched = measured.select("label", array_to_vector(F.array(*[r.holds().cast("double") for r in rules])).alias("met"))
    lasso = LogisticRegression(featuresCol="met", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=100).fit(matched)
    weights = lasso.coefficients.toArray()
    return Ensemble(tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    ``labels`` has doc_id and quality; documents whose fold is held out teach
    nothing, nor do those without an id, which are held out too. Of repeated
    labels of an id the least counts, null ones don't; of repeated documents each
    is a row of the result. Null and empty texts and texts without a word have
    the score of statistics that are all zero. Other columns are ignored; an
    empty table gives no rows.
    """
    ided = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(statistics(ided).withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(True))), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("label") > 0).cast("double")).alias("label"))
    taught = measured.where("NOT held_out").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(MOST_LABELS)
    model = fit(materialize(taught.select("label", *STATISTICS).coalesce(1), "taught"))
    scored = measured.select("doc_id", "held_out", model.chance().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
