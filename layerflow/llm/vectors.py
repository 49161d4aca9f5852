"""Near-duplicate vectors by navigable small-world graphs in shards.

Equal vectors are one class. The classes are dealt to shards; each shard builds
a hierarchical navigable small-world graph (Malkov and Yashunin, 2018), and every
vector asks every shard of its dimension. Searches run in lockstep, hundreds of
queries in one numpy step. A beam widens as long as all it holds is within the
threshold, so dense groups are found whole, and the base width doubles until an
audit against brute force finds enough of the links of probes.

What is found joins candidate groups. Inside a group cosines are verified in
double precision, block against block, which also counts the links; pairs are
never emitted. Links that pass are united into components.

Work grows with rows * shards. A shard holds up to ``SHARD_ROWS`` vectors (of 64
dimensions: about 80 MB with its graph), so that the number of shards is
``LEAST_SHARDS`` up to 1.2 million vectors and grows in proportion beyond.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import in_arrow, materialize, over_groups, stacked, together
from layerflow.llm.components import connected
from layerflow.llm.sketches import _least_label, _spans, _stars, block_pairs

LINK = 0.95
SLACK = 1e-4  # below the threshold, for single-precision candidates
LEAST_SHARDS, SHARD_ROWS = 6, 200_000
PART_ROWS = 65_536  # queries of a shard in one task
DEGREE = 16  # of the upper layers; twice as much below
BUILD_BEAM, BEAM = 48, 48
BATCH = 256
EXPAND = 4  # nodes that a query opens at a time
PROBES, RECALL = 128, 0.99
BLOCK = 512


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision of rows that have a direction."""
    schema = pa.schema([("doc_id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])
    for batch in batches:
        ids, dims, units = [], [], []
        for k, value in enumerate(batch.column(1).to_numpy(zero_copy_only=False)):
            if value is None:
                continue
            v = np.asarray(value, np.float64)
            top = np.abs(v).max() if len(v) else 0.0
            if not np.isfinite(v).all() or top == 0:
                continue
            v = v / top
            ids.append(batch.column(0)[k].as_py())
            dims.append(len(v))
            units.append((v / np.sqrt((v * v).sum())).tobytes())
        yield stacked({"doc_id": ids, "dim": dims, "unit": units}, schema)


@dataclass
class Graph:
    """Layers from the lowest up; node k of all layers is row k of ``x``."""

    x: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)  # neighbours, -1 where none
    sizes: list[int] = field(default_factory=list)  # nodes below are in the layer
    beam: int = BEAM

    def search(self, queries: np.ndarray, beam: int, floor: float = np.inf, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 where none) and cosines per query, best first, in layer ``low``."""
        start = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, low, -1):
            start, _ = self._beam(queries, start, 1, k, np.inf)
        return self._beam(queries, start, beam, low, floor)

    def _beam(self, queries: np.ndarray, start: np.ndarray, width: int, layer: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        near, n, count = self.layers[layer], self.sizes[layer], len(queries)
        node = np.full((count, width), -1, np.int64)
        cosine = np.full((count, width), -np.inf, np.float32)
        node[:, : start.shape[1]] = start
        cosine[:, : start.shape[1]] = np.einsum("qkd,qd->qk", self.x[start], queries)
        opened = node < 0
        seen = np.zeros((count, n + 1), bool)
        seen[np.arange(count)[:, None], node] = True  # -1 marks the spare column
        active = np.arange(count)
        while len(active):
            ready = np.where(opened[active], -np.inf, cosine[active])
            k = min(EXPAND, width)
            pick = np.argpartition(-ready, k - 1, axis=1)[:, :k]
            valid = np.take_along_axis(ready, pick, 1) > -np.inf
            at = active[:, None]
            opened[at, pick] |= valid
            found = near[np.where(valid, node[at, pick], 0)]
            found[~valid] = -1
            found = np.sort(found.reshape(len(active), -1), 1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[at, found]] = -1
            seen[at, found] = True
            room = max(1, int((found >= 0).sum(1).max()))
            found = -np.sort(-found, 1)[:, :room]
            value = np.einsum("qkd,qd->qk", self.x[found], queries[active])
            value[found < 0] = -np.inf
            both = np.concatenate([cosine[active], value], 1)
            best = np.argpartition(-both, width - 1, axis=1)[:, :width]
            cosine[active] = np.take_along_axis(both, best, 1)
            node[active] = np.take_along_axis(np.concatenate([node[active], found], 1), best, 1)
            shut = np.concatenate([opened[active], found < 0], 1)
            opened[active] = np.take_along_axis(shut, best, 1)
            active = active[~opened[active].all(1)]
            if not len(active) and width < n and np.isfinite(floor):
                # Widen where even the last of the beam is within the floor.
                full = np.flatnonzero(cosine.min(1) >= floor)
                if len(full):
                    more = min(n, 2 * width) - width
                    node = np.pad(node, ((0, 0), (0, more)), constant_values=-1)
                    cosine = np.pad(cosine, ((0, 0), (0, more)), constant_values=-np.inf)
                    opened = np.pad(opened, ((0, 0), (0, more)), constant_values=True)
                    width += more
                    opened[full] = node[full] < 0  # what they refused may fit now
                    again = np.zeros((len(full), n + 1), bool)
                    again[np.arange(len(full))[:, None], node[full]] = True
                    seen[full] = again
                    active = full
        order = np.argsort(-cosine, 1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(cosine, order, 1)


def _choose(x: np.ndarray, near: np.ndarray, cosine: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (best first): those that no
    chosen one is nearer to than the row itself, then the nearest others."""
    rows, width = near.shape
    v = x[near]
    among = np.einsum("rid,rjd->rij", v, v)
    blocked = np.full((rows, width), -np.inf, np.float32)
    taken = np.zeros((rows, width), bool)
    held = np.zeros(rows, int)
    valid = near >= 0
    for j in range(width):
        ok = valid[:, j] & (held < degree) & (blocked[:, j] < cosine[:, j])
        taken[ok, j] = True
        held += ok
        blocked[ok] = np.maximum(blocked[ok], among[ok, :, j])
    rank = np.where(taken, 0, 1) * width + np.arange(width)
    rank[~valid] = 3 * width
    pick = np.argsort(rank, 1)[:, :degree]
    chosen = np.take_along_axis(near, pick, 1)
    if chosen.shape[1] < degree:
        chosen = np.pad(chosen, ((0, 0), (0, degree - chosen.shape[1])), constant_values=-1)
    return chosen


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """Graph of unit vectors, inserted in batches; rows are in order of falling level.

    Rows must come in random order: the first n / DEGREE**k of them are layer k.
    """
    n = len(x)
    top = 0
    while n // DEGREE ** (top + 1) > 1:
        top += 1
    graph = Graph(x)
    graph.layers = [np.zeros((0, 2 * DEGREE if k == 0 else DEGREE), np.int64) for k in range(top + 1)]
    graph.sizes = [0] * (top + 1)
    for k in range(top, -1, -1):
        size = n // DEGREE**k
        degree = graph.layers[k].shape[1]
        graph.layers[k] = np.full((size, degree), -1, np.int64)
        done = 0
        while done < size:
            end = min(size, done + min(BATCH, max(32, done)))
            new = np.arange(done, end)
            inner = x[done:end] @ x[done:end].T
            np.fill_diagonal(inner, -np.inf)
            own = min(DEGREE, len(new) - 1)
            pick = np.argsort(-inner, 1)[:, :own]
            near, cosine = new[pick], np.take_along_axis(inner, pick, 1)
            if done:
                a, b = _insertion(graph, x[done:end], k)
                near, cosine = np.concatenate([a, near], 1), np.concatenate([b, cosine], 1)
            if near.shape[1]:
                order = np.argsort(-cosine, 1, kind="stable")
                chosen = _choose(x, np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1), DEGREE)
                graph.layers[k][new, :DEGREE] = chosen
                _link_back(graph, k, new, chosen)
            graph.sizes[k] = done = end
    return graph


def _insertion(graph: Graph, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if k + 1 < len(graph.layers) and graph.sizes[k] < graph.sizes[k + 1]:
        # The layer above leads to nodes that are not in this one yet.
        return graph._beam(queries, np.zeros((len(queries), 1), np.int64), BUILD_BEAM, k, np.inf)
    return graph.search(queries, BUILD_BEAM, low=k)


def _link_back(graph: Graph, k: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """Give the chosen neighbours a link to the new nodes; full ones choose anew."""
    layer, x = graph.layers[k], graph.x
    source = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
    target = chosen.ravel()[chosen.ravel() >= 0]
    cosine = np.einsum("kd,kd->k", x[source], x[target])
    order = np.lexsort((-cosine, target))
    source, target = source[order], target[order]
    first, count = _spans(target)
    for low in range(0, len(first), 512):
        f, c = first[low : low + 512], np.minimum(count[low : low + 512], DEGREE)
        at = target[f]
        place = f[:, None] + np.arange(c.max())
        more = np.where(np.arange(c.max()) < c[:, None], source[np.minimum(place, len(source) - 1)], -1)
        near = np.concatenate([layer[at], more], 1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        value = np.einsum("rkd,rd->rk", x[near], x[at])
        value[near < 0] = -np.inf
        by = np.argsort(-value, 1, kind="stable")
        near, value = np.take_along_axis(near, by, 1), np.take_along_axis(value, by, 1)
        degree = layer.shape[1]
        wide = (near >= 0).sum(1) > degree
        fit = near[:, :degree] if near.shape[1] >= degree else np.pad(near, ((0, 0), (0, degree - near.shape[1])), constant_values=-1)
        layer[at[~wide]] = fit[~wide]
        if wide.any():
            layer[at[wide]] = _choose(x, near[wide], value[wide], degree)


def audited(graph: Graph, floor: float, seed: int = 0) -> Graph:
    """Double the base beam until probes find ``RECALL`` of their links.

    Probes are vectors of the shard, turned to a cosine just above the floor;
    their links are counted by brute force.
    """
    x = graph.x
    rng = np.random.default_rng(seed)
    base = x[rng.choice(len(x), min(PROBES, len(x)), replace=False)]
    noise = rng.standard_normal(base.shape).astype(np.float32)
    noise -= np.einsum("kd,kd->k", noise, base)[:, None] * base
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    cosine = min(1.0, floor + 0.005)
    probe = (cosine * base + np.sqrt(1 - cosine**2) * noise).astype(np.float32)
    every = sum(int((probe[k] @ x.T >= floor).sum()) for k in range(len(probe)))
    while True:
        found = 0
        for k in range(0, len(probe), BATCH):
            found += int((graph.search(probe[k : k + BATCH], min(graph.beam, len(x)), floor)[1] >= floor).sum())
        if found >= RECALL * every or graph.beam >= len(x):
            return graph
        graph.beam *= 2


_GRAPH = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary())])


def _build_shards(floor: float):
    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids = table["key"].to_numpy(), table["doc_id"].to_numpy()
        first, count = _spans(key)
        for a, c in zip(first, count, strict=True):
            order = np.random.default_rng(int(c)).permutation(c) + a
            units = table["unit"].take(pa.array(order)).to_pylist()
            x = np.frombuffer(b"".join(units), np.float64).reshape(c, -1).astype(np.float32)
            graph = audited(build(x), floor)
            layers = [layer.astype(np.int32) for layer in graph.layers]
            yield stacked(
                {"key": [key[a]], "doc_id": [None], "body": [pickle.dumps((ids[order], x, layers, graph.sizes, graph.beam))]}, _GRAPH
            )

    return lambda: apply


class _Parts:
    """Union of nodes of one shard and of the queries that found them."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, i: int) -> int:
        top = self.top
        path = []
        while (up := top.setdefault(i, i)) != i:
            path.append(i)
            i = up
        for p in path:
            top[p] = i
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.array([self.find(i) for i in ids.tolist()], np.int64)
        pairs = np.stack([root[place[: len(a)]], root[place[len(a) :]]], 1)
        for p, q in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist():
            p, q = self.find(p), self.find(q)
            self.top[max(p, q)] = min(p, q)

    def stars(self) -> pa.RecordBatch:
        ids = np.array(list(self.top), np.int64)
        return _stars(ids, np.array([self.find(i) for i in ids.tolist()], np.int64))


def _ask(floor: float):
    """Rows of (g, rank, doc_id, body): a shard's graph, then the queries to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, parts, now = None, None, _Parts(), None
        for batch in batches:
            key = batch.column(0).to_numpy()
            rank, doc, body = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            first, count = _spans(key) if len(key) else ((), ())
            for a, c in zip(first, count, strict=True):
                if key[a] != now:
                    if parts.top:
                        yield parts.stars()
                    graph, parts, now = None, _Parts(), key[a]
                if rank[a] == 0:
                    ids, x, layers, sizes, beam = pickle.loads(body[a].as_py())
                    graph = Graph(x, [layer.astype(np.int64) for layer in layers], sizes, beam)
                    a, c = a + 1, c - 1
                for low in range(a, a + c, BATCH):
                    end = min(a + c, low + BATCH)
                    queries = np.frombuffer(b"".join(body.slice(low, end - low).to_pylist()), np.float64).reshape(end - low, -1)
                    node, cosine = graph.search(queries.astype(np.float32), min(graph.beam, len(ids)), floor)
                    row, column = np.nonzero((cosine >= floor) & (node >= 0))
                    asked = doc.slice(low, end - low).to_numpy()[row]
                    found = ids[node[row, column]]
                    other = asked != found
                    if other.any():
                        parts.join(asked[other], found[other])
        if parts.top:
            yield parts.stars()

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _verify(threshold: float):
    """Per group of one or two blocks: links of each vector, and a star per part (n null)."""

    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, block = table["doc_id"].to_numpy(), table["own"].to_numpy()
        copies = table["copies"].to_numpy()
        first, count = _spans(table["g"].to_numpy())
        for a, c in zip(first, count, strict=True):
            if c < 2:
                continue
            x = np.frombuffer(b"".join(table["unit"].slice(a, c).to_pylist()), np.float64).reshape(c, -1)
            own, part = name[a : a + c], block[a : a + c]
            linked = (x @ x.T >= threshold) & (own[:, None] != own[None, :])
            label = _least_label(linked, own)
            # Pairs inside a block are counted in the group of that block alone.
            counted = linked & (part[:, None] != part[None, :]) if part.min() != part.max() else linked
            number = counted @ copies[a : a + c]
            some = number > 0
            yield stacked({"a": own[some], "b": own[some], "n": number[some]}, _LINK)
            star = own != label
            yield stacked({"a": own[star], "b": label[star], "n": [None] * int(star.sum())}, _LINK)

    return lambda: apply


def near_vectors(rows: DataFrame, threshold: float = LINK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    Pairs that are found and whose cosine, in double precision, is at least
    ``threshold`` are linked. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, as do vectors of different
    dimensions. Of several vectors of one id the least that can be linked, by its
    components, stands for it, and each of its rows has the id's result. A row
    without an id has no links and no component, and is kept. Other columns are
    ignored; an empty table gives no rows.
    """
    floor = threshold - SLACK
    named = rows.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = "forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    usable = named.where(f"doc_id IS NOT NULL AND v IS NOT NULL AND {finite}")
    often = materialize(usable.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    valid = usable
    if not often.isEmpty():
        least = usable.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("v").alias("v"))
        valid = usable.join(often, "doc_id", "left_anti").union(least)
    clean = materialize(in_arrow(valid, _clean, "doc_id long, dim int, unit binary").withColumn("class", F.sha2("unit", 256)), "clean")
    classes = materialize(clean.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = materialize(clean.select("doc_id", "class").join(classes, "class").select("doc_id", "rep", "copies"), "member")
    reps = materialize(clean.join(member.where("doc_id = rep").select("doc_id", "copies"), "doc_id").select("doc_id", "dim", "copies", "unit"), "reps")
    dims = reps.groupBy("dim").agg(F.count("*").alias("n")).select(
        "dim", F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / SHARD_ROWS)).alias("shards"), F.ceil(F.col("n") / PART_ROWS).alias("parts")
    )
    dealt = reps.join(dims, "dim")
    own = dealt.withColumn("key", F.xxhash64("dim", F.pmod(F.xxhash64("doc_id"), "shards")))
    shards = int(reps.agg(F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.count("*") / SHARD_ROWS))).first()[0])
    built = own.select("key", "doc_id", "unit").repartition(4 * shards, "key").sortWithinPartitions("key", "doc_id")
    graphs = materialize(over_groups(built, "key", _build_shards(floor), "key long, doc_id long, body binary"), "graphs")
    keys = own.select("key", "parts").distinct()
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    sent = graphs.join(keys, "key").select(F.explode(every).alias("part"), "key", "body")
    sent = sent.select(F.xxhash64("key", "part").alias("g"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), "body")
    each = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    asked = each.withColumn("key", F.xxhash64("dim", "shard")).join(keys.select("key"), "key", "left_semi").select(
        F.xxhash64("key", F.pmod(F.xxhash64("doc_id", F.lit(1)), "parts")).alias("g"), F.lit(1).alias("rank"), "doc_id", F.col("unit").alias("body")
    )
    stream = sent.union(asked).repartition(4 * shards, "g").sortWithinPartitions("g", "rank")
    groups = materialize(connected(in_arrow(stream, _ask(floor), "a long, b long")), "groups")
    sizes = groups.groupBy("component").count()
    compared = block_pairs(
        groups.join(sizes, "component").select(F.col("id").alias("doc_id"), "component", "count"), "component", "count", BLOCK
    ).select("doc_id", "g", "own").join(reps.select("doc_id", "copies", "unit"), "doc_id")
    found = materialize(over_groups(together(compared, "g"), "g", _verify(threshold), "a long, b long, n long"), "links")
    number = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    top = connected(found.where("n IS NULL")).withColumnRenamed("id", "rep")
    linked = member.join(number, "rep", "left").join(top, "rep", "left").select(
        "doc_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    return named.select("doc_id").join(linked, "doc_id", "left").select(
        F.col("doc_id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
