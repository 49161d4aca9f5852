"""Selection of documents so that sources meet target weights.

Weights stand on a tree, domain - language - source by default. A total of
tokens is divided from the top by weight; a node that has less than its share
gives what is missing to its siblings, and only what they cannot take goes to
the siblings of its parent. Each leaf then reads its budget as a prefix of its
documents in seeded order, epoch after epoch.

Only sums per leaf reach the driver, at most ``MOST_LEAVES`` of them (more are
refused). The end of a prefix is found from sums per hash range, then inside one
range of a few thousand rows; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_LEAVES = 100_000
RANGE_ROWS = 4096
LEVELS = ("domain", "lang", "source")
ABSENT = "(none)"

Weights = Mapping[tuple[str, ...], float]


def words(text: str | Column = "text") -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(total: int, parts: Sequence[tuple[float, int]]) -> list[int]:
    """Divide ``total`` by weight among parts of (weight, capacity).

    No part gets more than its capacity; what it cannot take goes to the others
    by their weights. Parts without weight get nothing. Single tokens that are
    left by rounding go to the first parts with room.
    """
    given = [0] * len(parts)
    open_ = [k for k, (w, c) in enumerate(parts) if w > 0 and c > 0]
    total = min(total, sum(parts[k][1] for k in open_))
    rest = total
    while open_:
        whole = sum(parts[k][0] for k in open_)
        full = [k for k in open_ if parts[k][1] <= rest * parts[k][0] / whole]
        if not full:
            for k in open_:
                given[k] = int(rest * parts[k][0] / whole)
            break
        for k in full:
            given[k] = parts[k][1]
        rest -= sum(parts[k][1] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    left = total - sum(given)
    for k in open_:
        more = min(left, 1, parts[k][1] - given[k])
        given[k] += more
        left -= more
    return given


def budgets(leaves: Mapping[tuple[str, ...], int], weights: Weights, total: int) -> dict[tuple[str, ...], int]:
    """Tokens of each leaf. ``leaves`` holds capacities; a node that ``weights``
    doesn't name has weight 1. Weights count among siblings only."""

    def divide(prefix: tuple[str, ...], amount: int, below: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
        if below == [prefix]:
            return {prefix: amount}
        children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for leaf in below:
            children.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        parts = [(float(weights.get(c, 1.0)), room(c, inner)) for c, inner in children.items()]
        found: dict[tuple[str, ...], int] = {}
        for (c, inner), part in zip(children.items(), share_out(amount, parts), strict=True):
            found |= divide(c, part, inner)
        return found

    def room(node: tuple[str, ...], below: list[tuple[str, ...]]) -> int:
        """What the node can take: nothing flows below a weight of 0."""
        return sum(leaves[x] for x in below if all(weights.get(x[:k], 1.0) > 0 for k in range(len(node) + 1, len(x) + 1)))

    return divide((), total, sorted(leaves)) if leaves else {}


def select(
    docs: DataFrame,
    weights: Weights,
    *,
    share: float | None = None,
    total: int | None = None,
    levels: Sequence[str] = LEVELS,
    tokens: Column | None = None,
    epochs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with n_tokens, copies and tokens_taken.

    ``total`` tokens are asked for, or ``share`` of all tokens. ``epochs`` bounds
    how often a document is used. copies counts the epochs that use the row, the
    last of them maybe in part; tokens_taken sums to the leaf's budget. Null
    levels are the node ``(none)``. Rows without tokens are used in whole epochs
    and where the prefix passes them. Rows of one id share their place; if the
    prefix ends there, each of them counts as its end. Added columns replace
    those of the same name; an empty table gives no rows.
    """
    added = ("n_tokens", "copies", "tokens_taken")
    path = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(ABSENT)).alias(f"__l{k}") for k, c in enumerate(levels)]
    names = [f"__l{k}" for k in range(len(levels))]
    size = words() if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added), size.alias("n_tokens"), *path)
    narrow = own.select("doc_id", "n_tokens", *names)

    sums = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    held = {tuple(r[n] for n in names): (r.t, r.n) for r in sums}
    everything = sum(t for t, _ in held.values())
    wanted = total if total is not None else int(everything * (1.0 if share is None else share))
    given = budgets({leaf: t * epochs for leaf, (t, _) in held.items()}, weights, wanted)
    rows = []
    for leaf, (t, n) in held.items():
        whole, rest = divmod(given[leaf], t) if t else (0, 0)
        rows.append((*leaf, whole, rest, -(-n // RANGE_ROWS)))
    kind = ", ".join([*(f"{n} string" for n in names), "__whole long", "__rest long", "__ranges long"])
    session = docs.sparkSession
    plan = F.broadcast(session.createDataFrame(rows, kind))

    place = F.xxhash64(F.lit(seed), F.col("__whole"), F.col("doc_id"))
    range_ = F.least(F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * F.col("__ranges")), F.col("__ranges") - 1)
    ordered = narrow.join(plan, names).withColumn("__h", place).where("__rest > 0").withColumn("__range", range_)
    upto = W.partitionBy(*names).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        ordered.groupBy(*names, "__range", "__rest").agg(F.sum("n_tokens").alias("__t"))
        .withColumn("__before", F.coalesce(F.sum("__t").over(upto), F.lit(0)))
        .where("__before < __rest AND __before + __t >= __rest").select(*names, "__range", "__before")
    )
    inside = W.partitionBy(*names).orderBy("__h", "doc_id", "n_tokens")
    ends = (
        ordered.join(F.broadcast(ranges), [*names, "__range"])  # one row per leaf at most
        .withColumn("__before", F.col("__before") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .where("__before < __rest")
        .withColumn("__last", F.row_number().over(W.partitionBy(*names).orderBy(F.desc("__h"), F.desc("doc_id"), F.desc("n_tokens"))))
        .where("__last = 1").select(*names, F.col("__h").alias("__eh"), F.col("doc_id").alias("__eid"), F.col("__before").alias("__eb"))
    )
    done = own.join(plan, names).join(F.broadcast(ends), names, "left").withColumn("__h", place)
    at_end = (F.col("__h") == F.col("__eh")) & F.col("doc_id").eqNullSafe(F.col("__eid"))
    passed = at_end | (F.col("__h") < F.col("__eh")) | ((F.col("__h") == F.col("__eh")) & (F.col("doc_id") < F.col("__eid")))
    part = F.when(at_end, F.least("n_tokens", F.col("__rest") - F.col("__eb"))).when(passed, F.col("n_tokens")).otherwise(0)
    return done.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in added),
        "n_tokens",
        (F.col("__whole") + F.when(passed, 1).otherwise(0)).alias("copies"),
        (F.col("__whole") * F.col("n_tokens") + part).alias("tokens_taken"),
    )


# The tree of the given documents: a large crawl and the other sources.
DOMAINS = {"src0": "crawl"}
WEIGHTS: Weights = {
    ("crawl",): 1.0, ("curated",): 2.0,
    ("crawl", "en"): 3.0, ("crawl", "de"): 2.0, ("crawl", "fr"): 2.0,
    ("curated", "en"): 4.0, ("curated", "de"): 2.0, ("curated", "fr"): 2.0,
}


def with_domain(docs: DataFrame, domains: Mapping[str, str] = DOMAINS, other: str = "curated", name: str = "domain") -> DataFrame:
    """Add the column ``name``: the domain of the source, ``other`` if it has none."""
    named = F.lit(None).cast("string")
    for source, domain in domains.items():
        named = F.when(F.col("source") == source, domain).otherwise(named)
    return docs.withColumn(name, F.coalesce(named, F.lit(other)))


def mixed_documents(docs: DataFrame, share: float = 0.9, seed: int = 8) -> DataFrame:
    """Rows of ``docs`` that the mixture uses, each once."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "lang", "source")
    used = select(with_domain(plain), WEIGHTS, share=share, seed=seed).where("copies > 0")
    return used.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
