"""Spelling variants by range searches in k-d trees over letter counts.

A word is a point: how often each letter is in it. One edit moves the point by
at most two in the L1 norm: a replaced letter takes one count down and another
one up, an inserted letter takes one count up. So the words near a word lie in a
small box around it, in the tree of its own length or of the next one, and only
these are compared letter by letter.

The upper part of a length's tree is fitted on a bounded sample of its words and
deals the words to cells. A word is a point of one cell and asks every cell that
its box meets. Inside a task a cell's points get a k-d tree of their own. Near
words are added up where they are found, so that no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import in_arrow, materialize, stacked
from layerflow.llm.sketches import _spans

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
TYPO = 31  # one run in so many loses a letter
RATIO = 10  # a form is so many times as frequent
LETTERS = 26 + 64
CELL_WORDS = 4096
SAMPLE, SAMPLE_PER_CELL = 16_384, 16  # words of a length that its cells are fitted on
LEAF = 16
PAIRS = 1 << 20  # compared at once
ASKING = 8192  # words that search at once


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a byte each: no code point is above 255."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    place = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - (0xC0 - 26))
    row = np.arange(len(codes))[:, None] * LETTERS
    return np.bincount((place + row).ravel(), minlength=len(codes) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


_LETTER = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, LETTERS, dtype=np.uint64)
_SLOT = np.uint64(64 - 20)
_STEP = [np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)]
_STEP[0][_LETTER >> _SLOT] = True  # one letter more
_STEP[1][((_LETTER[:, None] - _LETTER[None, :]) >> _SLOT)[~np.eye(LETTERS, dtype=bool)]] = True  # one more and one less


def marks(counts: np.ndarray) -> np.ndarray:
    """A sum over a word's letters: marks of words whose letter counts are one
    edit apart differ by a value whose first bits ``_STEP`` has."""
    return (counts.astype(np.uint64) * _LETTER).sum(1, dtype=np.uint64)


@dataclass
class Tree:
    """K-d tree. Node k parts its box at ``axis[k]``: counts up to ``cut[k]`` go
    to node ``left[k]``, others to ``right[k]``; leaves have -1 there and a number
    in ``leaf``. ``low`` and ``high`` are the ends of the box along that axis."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray
    leaves: list[np.ndarray]  # the rows in each leaf, as given to ``plant``

    def home(self, counts: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node = np.zeros(len(counts), np.int64)
        while (inner := np.flatnonzero(self.left[node] >= 0)).size:
            at = node[inner]
            small = counts[inner, self.axis[at]] <= self.cut[at]
            node[inner] = np.where(small, self.left[at], self.right[at])
        return self.leaf[node]

    def meets(self, counts: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold a point with one count higher
        than the row's by one and ``down`` counts (0 or 1) lower by one."""
        row, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        more, less = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
        rows, leaves = [], []
        while len(row):
            end = self.left[node] < 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node, more, less = row[~end], node[~end], more[~end], less[~end]
            value, cut, low, high = counts[row, self.axis[node]], self.cut[node], self.low[node], self.high[node]
            # What the axis has added so far gives way to what the half box adds.
            rest_more, rest_less = more - np.maximum(0, low - value), less - np.maximum(0, value - high)
            sides = [
                (self.left[node], rest_more + np.maximum(0, low - value), rest_less + np.maximum(0, value - cut)),
                (self.right[node], rest_more + np.maximum(0, cut + 1 - value), rest_less + np.maximum(0, value - high)),
            ]
            fits = [(m <= 1) & (s <= down) for _, m, s in sides]
            node, more, less = (np.concatenate([side[k][fit] for side, fit in zip(sides, fits, strict=True)]) for k in range(3))
            row = np.concatenate([row[fit] for fit in fits])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def plant(counts: np.ndarray, leaf: int) -> Tree:
    """Tree whose leaves have at most ``leaf`` rows, or rows that are all equal."""
    axis, cut, left, right, low, high, number, leaves = [], [], [], [], [], [], [], []
    waiting = [(np.arange(len(counts)), {}, None, False)]
    while waiting:
        rows, box, parent, is_right = waiting.pop()
        k = len(axis)
        if parent is not None:
            (right if is_right else left)[parent] = k
        own = counts[rows]
        varied = own.var(0) if len(rows) > leaf else None
        if varied is None or varied.max() == 0:
            for column, value in zip((axis, cut, left, right, low, high, number), (0, 0, -1, -1, 0, 0, len(leaves)), strict=True):
                column.append(value)
            leaves.append(rows)
            continue
        d = int(varied.argmax())
        values = own[:, d]
        at = int(np.partition(values, len(values) // 2)[len(values) // 2])
        # Of the two cuts beside the median the one that halves the rows better.
        at = min((c for c in (at - 1, at) if values.min() <= c < values.max()), key=lambda c: abs(2 * int((values <= c).sum()) - len(values)))
        a, b = box.get(d, (-1, 1 << 30))
        for column, value in zip((axis, cut, left, right, low, high, number), (d, at, 0, 0, a, b, -1), strict=True):
            column.append(value)
        small = values <= at
        waiting.append((rows[~small], box | {d: (at + 1, b)}, k, True))
        waiting.append((rows[small], box | {d: (a, at)}, k, False))
    return Tree(*[np.array(c, np.int64) for c in (axis, cut, left, right)], *[np.array(c, np.int32) for c in (low, high)], np.array(number, np.int64), leaves)


def near(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one edit; ``long`` has as many letters
    (one is replaced) or one more (one is inserted)."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    head = np.logical_and.accumulate(short == long[:, :n], 1).sum(1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= n


def _cells(trees: dict[int, Tree]):
    """Words as a point of their cell (kind 0) and as questions (kind 1) to the
    cells of their own length and of the next one."""
    schema = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def rows(length, leaf, kind, words, n) -> pa.RecordBatch:
        return stacked({"length": np.full(len(leaf), length, np.int32), "leaf": leaf.astype(np.int32), "kind": np.full(len(leaf), kind, np.int32), "word": words, "n": n}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nowhere = plant(np.zeros((0, LETTERS), np.int32), LEAF)  # a tree of one leaf
        for batch in batches:
            size = batch["length"].to_numpy()
            for length in np.unique(size).tolist():
                part = batch.filter(pa.array(size == length))
                word, n = part["word"], part["n"].to_numpy()
                counts = letter_counts(_codes(word.to_pylist()))
                yield rows(length, trees.get(length, nowhere).home(counts), 0, word, n)
                for target, down in ((length, 1), (length + 1, 0)):
                    row, leaf = trees.get(target, nowhere).meets(counts, down)
                    yield rows(target, leaf, 1, word.take(pa.array(row)), n[row])

    return run


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near_word", pa.string())])


def _gathered(word: np.ndarray, other: np.ndarray, n: np.ndarray, of: list[str], others: list[str]) -> pa.RecordBatch:
    """Per word: how many near ones, and the most frequent (the least of equals)."""
    name = np.array(others, object)[other]
    order = np.lexsort((name.astype(str), -n, word))
    first, count = _spans(word[order])
    best = order[first]
    return stacked({"word": [of[w] for w in word[best]], "n_near": count, "near_n": n[best], "near_word": name[best].tolist()}, _NEAR)


class Cell:
    """The points of one cell, of one length, and the questions to them."""

    def __init__(self, words: list[str], n: np.ndarray):
        counts = letter_counts(_codes(words))
        self.tree = plant(counts, LEAF)
        order = np.concatenate(self.tree.leaves)  # the points of a leaf lie together
        self.words, self.n = [words[k] for k in order.tolist()], n[order]
        self.codes, self.marks = _codes(self.words), marks(counts[order])
        self.size = np.array([len(x) for x in self.tree.leaves])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def ask(self, words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What words of one length, this one's or one less, and points are to each other."""
        codes = _codes(words)
        equal = codes.shape[1] == self.codes.shape[1]
        counts = letter_counts(codes)
        row, leaf = self.tree.meets(counts, 1 if equal else 0)
        order = np.argsort(row, kind="stable")
        row, leaf, mark = row[order], leaf[order], marks(counts)
        upto = np.cumsum(self.size[leaf])
        low = 0
        while low < len(row):
            before = upto[low - 1] if low else 0
            end = max(low + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
            size, ends = self.size[leaf[low:end]], upto[low:end] - before
            point = np.arange(ends[-1]) + np.repeat(self.start[leaf[low:end]] - (ends - size), size)
            # Letter counts first: few pairs are left for the order of letters.
            step = (self.marks[point] - np.repeat(mark[row[low:end]], size)) >> _SLOT
            likely = np.flatnonzero(_STEP[equal][step])
            a, b = row[low + np.searchsorted(ends, likely, side="right")], point[likely]
            low = end
            hit = near(codes[a], self.codes[b])
            a, b = a[hit], b[hit]
            if not len(a):
                continue
            yield _gathered(a, b, self.n[b], words, self.words)
            if not equal:
                yield _gathered(b, a, n[a], self.words, words)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (length, leaf, kind, word, n), each cell's points before its questions.

    Only the points of a cell are held; questions pass by in runs.
    """
    now, points, numbers, cell = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        length, leaf, kind = batch["length"].to_numpy(), batch["leaf"].to_numpy(), batch["kind"].to_numpy()
        size = batch["size"].to_numpy()
        step = np.ones(len(kind), bool)
        step[1:] = (np.diff(length) != 0) | (np.diff(leaf) != 0) | (np.diff(kind) != 0) | (np.diff(size) != 0)
        first = np.flatnonzero(step)
        for a, end in zip(first.tolist(), [*first[1:].tolist(), len(kind)], strict=True):
            if (length[a], leaf[a]) != now:
                now, points, numbers, cell = (length[a], leaf[a]), [], [], None
            word, n = batch["word"].slice(a, end - a).to_pylist(), batch["n"].slice(a, end - a).to_numpy()
            if kind[a] == 0:
                points += word
                numbers.append(n)
                continue
            if not points:
                continue
            if cell is None:
                cell = Cell(points, np.concatenate(numbers))
            for low in range(0, len(word), ASKING):
                yield from cell.ask(word[low : low + ASKING], n[low : low + ASKING])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, length) of the distinct words of (doc_id, text).

    Every ``TYPO``-th run, by the crc32 of ``<doc_id>:<run>``, loses a letter; a
    run of a row without an id stays whole. A null text has no words.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = runs.where(F.length("run") >= LEAST_LENGTH).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
    cut = "concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))"
    words = hashed.select(F.when(F.col("h") % TYPO == 0, F.expr(cut)).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT).withColumn("length", F.length("word"))


def fitted(words: DataFrame) -> tuple[dict[int, Tree], int]:
    """Trees that deal the words of long lists to cells, by length; and how many
    cells all lengths have. Lengths with few words are one cell.

    At most about ``SAMPLE`` words of a length, by hash, come to the driver.
    """
    sizes = {r["length"]: r["count"] for r in words.groupBy("length").count().collect()}
    trees, large = {}, {length: n for length, n in sizes.items() if n > CELL_WORDS}
    if large:
        share = F.element_at(F.create_map(*[F.lit(x) for length, n in large.items() for x in (length, int((1 << 30) * min(1.0, SAMPLE / n)))]), F.col("length"))
        picked = words.where(F.col("length").isin(list(large)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share))
        sample: dict[int, list[str]] = {}
        for row in picked.select("length", "word").collect():
            sample.setdefault(row["length"], []).append(row["word"])
        for length, some in sample.items():
            leaf = max(SAMPLE_PER_CELL, len(some) * CELL_WORDS // large[length])
            trees[length] = plant(letter_counts(_codes(sorted(some))), leaf)
            trees[length].leaves = [np.zeros(0, np.int64)] * len(trees[length].leaves)
    return trees, len(sizes) - len(trees) + sum(len(t.leaves) for t in trees.values())


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near_word) of the words that have near ones: how
    many, and the most frequent of them, the least of equals in code-point order.

    ``words`` are (word, n, length); each stands once.
    """
    trees, cells = fitted(words)
    dealt = in_arrow(words.select("word", "n", "length"), _cells(trees), "length int, leaf int, kind int, word string, n long")
    # Longer and shorter questions to a cell pass in runs of one length.
    placed = dealt.withColumn("size", F.length("word")).repartition(min(4096, max(16, cells)), "length", "leaf")
    found = in_arrow(placed.sortWithinPartitions("length", "leaf", "kind", "size"), _search, "word string, n_near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near_word").alias("near_word")
    )


def last_of(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms.

    Every round doubles how far a root lies. A form is ``RATIO`` times as
    frequent as its word, so that chains end and have fewer than 20 words.
    """
    reach = materialize(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(reach.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        reach = further.select("word", "root")
        if further.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (doc_id, text).

    See ``vocabulary`` for words. Two are near if they differ by one inserted,
    deleted or replaced letter. A word's form is its most frequent near word, the
    least of equals, if that is ``RATIO`` times as frequent; its root is the last
    of the forms that follow each other, or itself. Repeated rows count each
    time; other columns are ignored; without words there are no rows.
    """
    words = materialize(vocabulary(docs.select("doc_id", "text")), "words")
    known = materialize(words.select("word", "n").join(neighbours(words), "word", "left"), "near")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    formed = known.select(
        "word", F.when(is_form, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    roots = last_of(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
