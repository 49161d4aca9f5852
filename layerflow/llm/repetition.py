"""Quality rules on repetition, from suffix arrays over words.

All suffixes of a document's words are sorted by doubling, many documents in one
array: the first key holds document and word, so suffixes of different documents
never share a prefix. Common prefixes of neighbours come from the ranks of each
doubling. Neighbours with a common prefix of ``window`` words or more are the
intervals of maximal repeated substrings; their spans are united, and a document
is kept if they cover a limited share of it and none is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import chunks, in_arrow, span_hashes, split_words, stacked

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
MOST_COVERED = 0.25  # share of words in maximal repeats
LONGEST = 100  # words of the longest repeat

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def longest_repeats(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur once more in its row."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    left = np.bincount(row)[row] - (np.arange(n) - np.searchsorted(row, row))  # words to the end of the row
    order = np.lexsort((word, row))
    fresh = np.ones(n, bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        ranked = rank[order]
        same = ranked[1:] == ranked[:-1]
        place = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(place):
            break
        suffix = order[place]
        ahead = np.minimum(suffix + step, n - 1)
        second = np.where(left[suffix] > step, rank[ahead] + 1, 0)
        key = (rank[suffix] << 32) | second
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[place] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # Places of one old rank lie together, so a run's first place is its rank.
        rank = rank.copy()
        rank[suffix] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        levels.append(rank)
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        inside = (a < n) & (b < n)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        equal = inside & (row[x] == row[order[:-1]]) & (row[y] == row[order[1:]]) & (levels[k][x] == levels[k][y])
        equal &= np.minimum(left[x], left[y]) >= size
        common += size * equal
        a, b = a + size * equal, b + size * equal
    most = np.zeros(n, np.int64)
    most[order[:-1]] = common
    most[order[1:]] = np.maximum(most[order[1:]], common)
    return most


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Words inside a repeat of at least ``least`` words."""
    n = len(repeat)
    edge = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(repeat >= least)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + repeat[start], -1)
    return np.cumsum(edge[:-1]) > 0


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def measures(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The columns of ``_STATS`` for each row."""
    rows = len(bounds) - 1
    starts, ends, row = split_words(data, bounds)
    words = np.bincount(row, minlength=rows)
    letter = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = np.bincount(row, weights=letter[ends] - letter[starts], minlength=rows)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # A line that has a word: its first byte, its last, and the row.
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[:-1]
    break_at = np.flatnonzero(data == 0x0A)
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (line[starts[1:]] != line[starts[:-1]])
    at = starts[first]
    number, own = line[at], row[first]
    begin = np.maximum(bounds[own], np.where(number > 0, break_at[np.maximum(number - 1, 0)] + 1, 0) if len(break_at) else 0)
    end = np.minimum(bounds[own + 1], break_at[np.minimum(number, len(break_at) - 1)] if len(break_at) else len(data))
    if len(break_at):
        end = np.where(number < len(break_at), end, bounds[own + 1])
    value = span_hashes(data, begin, end)
    different = np.zeros(rows, np.int64)
    if len(value):
        order = np.lexsort((value, own))
        new = np.ones(len(value), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (own[order][1:] != own[order][:-1])
        different = np.bincount(own[order][new], minlength=rows)
    repeat = longest_repeats(span_hashes(data, starts, ends), row)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, repeat)
    return (
        words, size.astype(np.int64), symbol[bounds[1:]] - symbol[bounds[:-1]], np.bincount(own, minlength=rows) - different,
        np.bincount(row, weights=covered(repeat, window), minlength=rows).astype(np.int64), longest,
    )


def repetition(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat) per row.

    n_repeat_words counts the words inside maximal repeats of ``window`` words or
    more, longest_repeat is the longest repeat of any length. Null and empty
    texts have zeros. Words are compared by 64-bit hashes. Other columns are
    ignored; an empty table gives no rows.
    """
    schema = pa.schema([(n, pa.int64()) for n in _STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                found = stacked(dict(zip(_STATS, measures(data, bounds, window), strict=True)), schema)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *found.columns], names=["doc_id", *_STATS])

    kind = docs.select("doc_id").schema
    for name in _STATS:
        kind = kind.add(name, "long")
    return in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, kind)


def judged(docs: DataFrame) -> DataFrame:
    """``repetition`` with base_failed, covered_share and kept.

    base_failed: below ``LEAST_WORDS`` words, or more than ``MOST_REPEATED``
    percent of them repeated. kept: not base_failed, repeats cover at most
    ``MOST_COVERED`` of the words, and none is longer than ``LONGEST``.
    """
    found = repetition(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")).otherwise(0.0)
    return found.withColumn("base_failed", failed).withColumn("covered_share", share).withColumn(
        "kept", ~F.col("base_failed") & (F.col("covered_share") <= MOST_COVERED) & (F.col("longest_repeat") <= LONGEST)
    )
