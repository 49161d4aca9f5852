"""Quality rules: annotate, split, and measure in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.functions.conditions import TABLE_LEVEL, Rule, rule_condition, rule_keys

ENFORCE_MODES = ("all", "critical")


def _prefix(style: str) -> str:
    return {"audit": "_dq", "meta": "_meta_dq"}[style]


def mark_repeated(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Add ``flag``: TRUE where the key tuple occurs once (NULLs form one key).

    Counting keys first (combined map-side) and joining only the repeated ones
    back avoids a window, which would hold a whole hot key in one task; the
    join is broadcast when small and split by AQE when one key is hot.
    """
    names = [f"{flag}_{i}" for i in range(len(keys))]
    repeated = (
        df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        .agg(F.count(F.lit(1)).alias("_times"))
        .filter("_times > 1")
        .select(*names, F.lit(True).alias(f"{flag}_seen"))
    )
    match = F.lit(True)
    for key, name in zip(keys, names):
        match = match & df[key].eqNullSafe(repeated[name])
    return (
        df.join(repeated, match, "left")
        .withColumn(flag, F.col(f"{flag}_seen").isNull())
        .drop(f"{flag}_seen", *names)
    )


def annotate(df: DataFrame, rules: Sequence[Rule], *, style: str = "audit", as_of: Column | None = None) -> DataFrame:
    """Add the array of failed rule ids and the passed flag."""
    prefix = _prefix(style)
    flags: dict[tuple[str, ...], str] = {}
    for rule in rules:
        if rule["type"] == "unique" and rule_keys(rule) not in flags:
            flag = f"_unique_{len(flags)}"
            flags[rule_keys(rule)] = flag
            df = mark_repeated(df, rule_keys(rule), flag)
    nothing = F.array().cast("array<string>")
    failed = [nothing]
    for rule in rules:
        unique_flag = F.col(flags[rule_keys(rule)]) if rule["type"] == "unique" else None
        fails = ~rule_condition(rule, as_of, unique_flag)
        failed.append(F.when(fails, F.array(F.lit(rule["rule_id"]))).otherwise(nothing))
    # Flattening generates code; a filter over the array would be interpreted.
    errors = F.flatten(F.array(*failed))
    return (
        df.withColumn(f"{prefix}_errors", errors)
        .withColumn(f"{prefix}_passed", F.size(f"{prefix}_errors") == 0)
        .drop(*flags.values())
    )


def enforced_condition(rules: Sequence[Rule], *, style: str = "audit", enforce: str = "all") -> Column:
    """TRUE for rows that go on: no failed rule, or no failed critical rule."""
    if enforce not in ENFORCE_MODES:
        raise ValueError(f"unknown enforce mode: {enforce}")
    prefix = _prefix(style)
    if enforce == "all":
        return F.col(f"{prefix}_passed")
    critical = [r["rule_id"] for r in rules if r.get("severity", "critical") == "critical"]
    return ~F.arrays_overlap(F.col(f"{prefix}_errors"), F.array(*map(F.lit, critical)).cast("array<string>"))


def split(annotated: DataFrame, rules: Sequence[Rule], *, style: str = "audit", enforce: str = "all"):
    """(passed, failed); together they are exactly the annotated rows."""
    good = enforced_condition(rules, style=style, enforce=enforce)
    return annotated.filter(good), annotated.filter(~good)


def metric_columns(rules: Sequence[Rule], *, style: str = "audit", enforce: str = "all") -> dict[str, Column]:
    """All counts of a quality run as aggregate columns for a single pass."""
    prefix = _prefix(style)
    good = enforced_condition(rules, style=style, enforce=enforce)
    counts = {
        "total_rows": F.count(F.lit(1)),
        "passed_rows": F.count_if(good),
        "failed_rows": F.count_if(~good),
    }
    for rule in rules:
        counts[f"failed_{rule['rule_id']}"] = F.count_if(
            F.array_contains(F.col(f"{prefix}_errors"), rule["rule_id"])
        )
    return counts


def rule_metrics(annotated: DataFrame, rules: Sequence[Rule], *, style: str = "audit", enforce: str = "all") -> DataFrame:
    """One row per rule: failures of the rule, and the passed and failed totals."""
    counts = metric_columns(rules, style=style, enforce=enforce)
    one_row = annotated.agg(*[c.alias(n) for n, c in counts.items()])
    per_rule = F.array(
        *[
            F.struct(
                F.lit(r["rule_id"]).alias("rule_id"),
                F.lit(r.get("severity", "critical")).alias("severity"),
                F.col("total_rows"),
                F.col("passed_rows"),
                F.col(f"failed_{r['rule_id']}").alias("failed_rows"),
                F.col("failed_rows").alias("total_failed_rows"),
            )
            for r in rules
        ]
    )
    return one_row.select(F.inline(per_rule))


def add_reason(failed: DataFrame, *, style: str = "audit") -> DataFrame:
    return failed.withColumn("_quarantine_reason", F.concat_ws(",", F.col(f"{_prefix(style)}_errors")))


def model_quality(df: DataFrame, rules: Sequence[Rule], *, model: str, target: str, as_of: Column | None = None) -> DataFrame:
    """Result rows of a model's rules in one pass, with success or failed."""
    flags = {}
    for rule in rules:
        if rule["type"] == "unique":
            flags[rule["rule_id"]] = f"_unique_{len(flags)}"
            df = mark_repeated(df, rule_keys(rule), flags[rule["rule_id"]])
    counts = [F.count(F.lit(1)).alias("total_rows")]
    for i, rule in enumerate(rules):
        if rule["type"] in TABLE_LEVEL:
            counts.append(F.when(F.count(F.lit(1)) > 0, 0).otherwise(1).cast("long").alias(f"failed_{i}"))
        else:
            unique_flag = F.col(flags[rule["rule_id"]]) if rule["rule_id"] in flags else None
            counts.append(F.count_if(~rule_condition(rule, as_of, unique_flag)).alias(f"failed_{i}"))
    results = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                F.lit(target).alias("target"),
                F.lit(r["rule_id"]).alias("rule_id"),
                F.lit(r.get("severity", "critical")).alias("severity"),
                F.col("total_rows"),
                F.col(f"failed_{i}").alias("failed_rows"),
                F.when(F.col(f"failed_{i}") == 0, "success").otherwise("failed").alias("status"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return df.agg(*counts).select(F.inline(results))
