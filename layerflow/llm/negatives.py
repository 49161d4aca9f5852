"""Hard negatives by best-first search in packed R-trees.

Rows are dealt to shards by their id, and each shard packs its rows into an
R-tree by sort-tile-recursion: first by label, then by the coordinates of the
widest spread. A node's minimum bounding box bounds the inner product of a query
with all rows below it: each coordinate adds the product with one end of its
interval. The same holds for labels, whose interval is a coordinate of the box.

Every anchor asks every shard twice: for its nearest rows of the same label, and
then for the rows of other labels in the score windows that these set. A query
opens boxes best first and closes a box that lies outside its windows, or whose
bound is strictly below the score of its kth row. The queries of a block empty
their queues side by side, in runs that double, so that queries which open the
same box are one matrix product; a query opens at most twice the boxes of a queue
that is emptied one by one.

The work is anchors times shards; a shard holds up to ``SHARD_ROWS`` rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.llm.common import in_arrow, materialize, over_groups, stacked
from layerflow.llm.sketches import _spans

ANCHORS = "vec_id % 50 = 0"
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of a positive's score
LEAST_SHARDS, SHARD_ROWS = 6, 32_768
PART_ROWS = 4_096  # anchors that ask a shard in one task
BLOCK = 256  # anchors that search side by side
LEAF, FAN = 64, 16
LIMIT = 1 << 28  # of a scaled component times the root of the length, so that 100 inner products fit in a long
EXACT = float(1 << 53)
NONE = -(1 << 63)


@dataclass
class Tree:
    """Levels from the leaves up. Node k of a level covers the nodes (of the
    lowest: the rows) from ``starts[level][k]`` to ``starts[level][k + 1]``."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]  # boxes, one row per node; the labels' interval apart
    high: list[np.ndarray]
    label_low: list[np.ndarray]
    label_high: list[np.ndarray]


def _tiles(x: np.ndarray, order: np.ndarray, axes: np.ndarray, size: int) -> np.ndarray:
    """Rows in sort-tile order: slabs along the first axis, each tiled by the others."""
    leaves = -(-len(order) // size)
    if leaves <= 1 or not len(axes):
        return order
    slabs = max(2, int(np.ceil(leaves ** (1.0 / len(axes)))))
    order = order[np.argsort(x[order, axes[0]], kind="stable")]
    width = -(-leaves // slabs) * size
    return np.concatenate([_tiles(x, order[k : k + width], axes[1:], size) for k in range(0, len(order), width)])


def pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Tree:
    """Packed tree of the rows: tiles inside a label, leaves of ``LEAF`` rows."""
    rows = np.lexsort((ids, labels))
    runs, count = _spans(labels[rows])
    order = []
    for a, c in zip(runs, count, strict=True):
        run = rows[a : a + c]
        spread = x[run].max(0) - x[run].min(0)
        order.append(_tiles(x, run, np.argsort(-spread, kind="stable"), LEAF))
    at = np.concatenate(order)
    tree = Tree(x[at], ids[at], labels[at], [], [], [], [], [])
    low = high = tree.x
    label_low = label_high = tree.labels
    fan = LEAF
    while True:
        starts = np.arange(0, len(low), fan)
        low, high = np.minimum.reduceat(low, starts, 0), np.maximum.reduceat(high, starts, 0)
        label_low, label_high = np.minimum.reduceat(label_low, starts), np.maximum.reduceat(label_high, starts)
        tree.starts.append(np.append(starts, len(tree.x) if len(tree.starts) == 0 else len(tree.low[-1])))
        tree.low.append(low)
        tree.high.append(high)
        tree.label_low.append(label_low)
        tree.label_high.append(label_high)
        if len(low) == 1:
            return tree
        fan = FAN


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all partial sums fit."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with anything in each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return _product(up, low) + _product(down, high), _product(up, high) + _product(down, low)


class Search:
    """Queries of a block against one tree: ``keep`` best rows of each window.

    ``same`` looks for rows of the query's label, else for those of other ones.
    Windows are closed intervals of scores, ``floor`` to ``ceiling``, one row of
    each per query; an empty one has its floor above its ceiling.
    """

    def __init__(self, tree: Tree, ids, labels, q, floor, ceiling, keep: int, same: bool):
        self.tree, self.ids, self.labels, self.q, self.same, self.keep = tree, ids, labels, q, same, keep
        self.floor, self.ceiling = floor, ceiling
        self.score = np.full((*floor.shape, keep), NONE, np.int64)
        self.found = np.zeros((*floor.shape, keep), np.int64)
        self.opened = 0

    def run(self) -> None:
        tree, count = self.tree, len(self.q)
        top = len(tree.starts) - 1
        # One queue per query over all nodes: the bound of a box that waits, or NONE.
        offset = np.concatenate([[0], np.cumsum([len(low) for low in tree.low])])
        queue = np.full((count, offset[-1]), NONE, np.int64)
        self._enqueue(queue, np.arange(count), top, 0, 1, offset)
        active, length = np.arange(count), 1
        while len(active):
            waiting = queue[active]
            # A box may be closed by what was found since it came into the queue.
            waiting[waiting < self._bar()[active][:, None]] = NONE
            length = min(length, waiting.shape[1])
            pick = np.argpartition(~waiting, length - 1, axis=1)[:, :length] if length < waiting.shape[1] else np.tile(
                np.arange(waiting.shape[1]), (len(active), 1)
            )
            row, column = np.nonzero(np.take_along_axis(waiting, pick, 1) > NONE)
            who, node = active[row], pick[row, column]
            queue[who, node] = NONE
            order = np.argsort(node, kind="stable")
            who, node = who[order], node[order]
            self.opened += len(who)
            rows: list[tuple] = []
            if len(node):
                for a, c in zip(*_spans(node), strict=True):
                    level = int(np.searchsorted(offset, node[a], side="right")) - 1
                    k = int(node[a] - offset[level])
                    first, end = tree.starts[level][k], tree.starts[level][k + 1]
                    if level:
                        self._enqueue(queue, who[a : a + c], level - 1, first, end, offset)
                    else:
                        rows.append(self._scan(who[a : a + c], first, end))
            if rows:
                self._merge(*[np.concatenate(part) for part in zip(*rows, strict=True)])
            active = active[(queue[active] > NONE).any(1) & (queue[active].max(1) >= self._bar()[active])]
            length *= 2

    def _bar(self) -> np.ndarray:
        """Score that a query's next row must reach in some window to count."""
        need = np.maximum(self.score[:, :, -1], self.floor)
        return np.where(self.floor <= self.ceiling, need, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)

    def _enqueue(self, queue, who, level: int, first: int, end: int, offset) -> None:
        tree = self.tree
        least, most = _bounds(self.q[who], tree.low[level][first:end], tree.high[level][first:end])
        a, b = tree.label_low[level][first:end], tree.label_high[level][first:end]
        own = self.labels[who][:, None]
        fits = (a <= own) & (own <= b) if self.same else ~((a == own) & (b == own))
        inside = np.zeros(least.shape, bool)
        for w in range(self.floor.shape[1]):
            need = np.maximum(self.floor[who, w], self.score[who, w, -1])[:, None]
            high = self.ceiling[who, w][:, None]
            inside |= (most >= need) & (least <= high) & (need <= high)
        queue[who[:, None], offset[level] + np.arange(first, end)] = np.where(fits & inside, most, NONE)

    def _scan(self, who, first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tree = self.tree
        score = _product(self.q[who], tree.x[first:end])
        equal = tree.labels[first:end] == self.labels[who][:, None]
        ok = (equal & (tree.ids[first:end] != self.ids[who][:, None])) if self.same else ~equal
        ok &= (score >= self._bar()[who][:, None]) & (score <= self.ceiling[who].max(1)[:, None])
        row, column = np.nonzero(ok)
        return who[row], score[row, column], tree.ids[first:end][column]

    def _merge(self, who, score, found) -> None:
        for w in range(self.floor.shape[1]):
            ok = (score >= np.maximum(self.floor[who, w], self.score[who, w, -1])) & (score <= self.ceiling[who, w])
            if not ok.any():
                continue
            touched = np.unique(who[ok])
            held = self.score[touched, w] > NONE
            q = np.concatenate([who[ok], np.repeat(touched, self.keep)[held.ravel()]])
            s = np.concatenate([score[ok], self.score[touched, w][held]])
            i = np.concatenate([found[ok], self.found[touched, w][held]])
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            first, count = _spans(q)
            rank = np.arange(len(q)) - np.repeat(first, count)
            best = rank < self.keep
            self.score[touched, w] = NONE
            self.score[q[best], w, rank[best]] = s[best]
            self.found[q[best], w, rank[best]] = i[best]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


_TREE = pa.schema([("key", pa.int64()), ("body", pa.binary())])


def _build():
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table["key"].to_numpy()
        for a, c in zip(*_spans(key), strict=True):
            part = table.slice(a, c).combine_chunks()
            x = _matrix(part["v"].combine_chunks() if isinstance(part["v"], pa.ChunkedArray) else part["v"], c)
            tree = pack(part["vec_id"].to_numpy(), part["label"].to_numpy(), x)
            yield stacked({"key": [key[a]], "body": [pickle.dumps(tree)]}, _TREE)

    return apply


_FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _ask(keep: int, same: bool):
    """Rows of (g, rank, body, vec_id, label, v, floors, ceilings): a shard's
    tree, then the anchors that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rank = batch["g"].to_numpy(), batch["rank"].to_numpy()
            for a, c in zip(*_spans(key), strict=True):
                if key[a] != now:
                    tree, now = None, key[a]
                if rank[a] == 0:
                    tree = pickle.loads(batch["body"][a].as_py())
                    a, c = a + 1, c - 1
                for low in range(a, a + c if tree is not None else a, BLOCK):  # a shard may have no rows of a length
                    part = batch.slice(low, min(BLOCK, a + c - low))
                    n = part.num_rows
                    ids = part["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64)
                    labels = part["label"].to_numpy(zero_copy_only=False).astype(np.int64)
                    floor, ceiling = _matrix(part["floors"], n), _matrix(part["ceilings"], n)
                    search = Search(tree, ids, labels, _matrix(part["v"], n), floor, ceiling, keep, same)
                    search.run()
                    who, window, place = np.nonzero(search.score > NONE)
                    yield stacked(
                        {
                            "anchor_id": ids[who], "window": window.astype(np.int32),
                            "id": search.found[who, window, place], "score": search.score[who, window, place],
                        },
                        _FOUND,
                    )

    return run


def scaled(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v, dim) of the rows that take part, one per id.

    A null id, label or vector, an empty vector, and a component that is null or
    not finite leave a row out, as does one so large (see ``LIMIT``) that a score
    could pass a long. Of several rows of one id the least one (by label, then
    vector) counts.
    """
    ok = "vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) * sqrt(size(v)) < {})"
    named = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE).alias("v"),
    ).where(ok.format(LIMIT))  # a component that is not a number counts as the greatest of all
    whole = named.withColumn("v", F.transform("v", lambda x: F.floor(x).cast("long")))
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def _asked(trees: DataFrame, anchors: DataFrame, keep: int, same: bool, shards: int, parts: int) -> DataFrame:
    """(anchor_id, window, id, score): the best ``keep`` rows of each shard, whose
    tree is sent once for every part of the anchors."""
    fields = {"vec_id": "long", "label": "long", "v": "array<long>", "floors": "array<long>", "ceilings": "array<long>"}
    place = F.xxhash64("key", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)))
    asked = anchors.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("key", F.xxhash64("dim", "key"))
    questions = asked.select(place.alias("g"), F.lit(1).alias("rank"), F.lit(None).cast("binary").alias("body"), *fields)
    bodies = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select(
        F.xxhash64("key", "part").alias("g"), F.lit(0).alias("rank"), "body", *[F.lit(None).cast(t).alias(n) for n, t in fields.items()]
    )
    stream = bodies.union(questions).repartition(4 * shards, "g").sortWithinPartitions("g", "rank")
    return in_arrow(stream, _ask(keep, same), "anchor_id long, `window` int, id long, score long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of each anchor and window over all shards, by rank."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _hundredth(x: Column) -> Column:
    """floor(x / 100) in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(
    rows: DataFrame, anchors: str = ANCHORS, label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id``. An anchor's positives are its first
    other rows of the same label, by inner product of the scaled vectors and then
    by id; for each of them the first rows of other labels follow whose score is
    from ``low`` to ``high`` per cent of the positive's. See ``scaled`` for rows
    that take no part and for repeated ids. Vectors of different lengths have no
    inner product and never meet. Other columns are ignored; without anchors,
    positives or rows within the window there are no rows.
    """
    clean = materialize(scaled(rows, label), "scaled")
    asking = clean.where(F.expr(anchors))
    shards, parts = max(LEAST_SHARDS, -(-clean.count() // SHARD_ROWS)), max(1, -(-asking.count() // PART_ROWS))
    own = clean.select(F.xxhash64("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).alias("key"), "vec_id", "label", "v")
    shelved = own.repartition(4 * shards, "key").sortWithinPartitions("key")
    trees = materialize(over_groups(shelved, "key", _build, "key long, body binary"), "trees")
    no_floor, no_ceiling = F.array(F.lit(NONE + 1)), F.array(F.lit((1 << 63) - 1))
    first = _asked(trees, asking.withColumns({"floors": no_floor, "ceilings": no_ceiling}), positives, True, shards, parts)
    good = materialize(
        _best(first, positives).select(
            "anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # At most ``positives`` of each anchor; windows that are missing are empty ones.
    scores = good.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p"))
    missing = F.lit(positives) - F.size("p")
    windows = scores.select(
        "vec_id",
        F.concat(F.transform("p", lambda p: -_hundredth(-(p.positive_score * low))), F.array_repeat(F.lit(1).cast("long"), missing)).alias("floors"),
        F.concat(F.transform("p", lambda p: _hundredth(p.positive_score * high)), F.array_repeat(F.lit(0).cast("long"), missing)).alias("ceilings"),
    )
    second = _asked(trees, asking.join(windows, "vec_id"), negatives, False, shards, parts)
    return _best(second, negatives).join(good, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def shifted_label() -> Column:
    """The label as the query takes it: moved on by one in every seventh row."""
    return F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
