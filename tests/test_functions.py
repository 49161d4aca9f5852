import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import rows
from layerflow.functions import hashing, masking
from layerflow.functions.conditions import rule_condition


def test_canonical_json_matches_sorted_compact_json(spark):
    df = spark.createDataFrame(
        [(2, 'a "quoted" é', Decimal("1.50"), None)], "b int, a string, c decimal(18,2), d string"
    )
    got = df.select(hashing.canonical_json(df).alias("j")).first().j
    want = json.dumps({"b": 2, "a": 'a "quoted" é', "c": "1.50", "d": None},
                      sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == want
    digest = df.select(hashing.content_hash(df).alias("h")).first().h
    assert digest == hashlib.sha256(want.encode()).hexdigest()


def test_joined_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    safe = df.select(hashing.joined_hash(["x", "y", "z"]).alias("h")).distinct().count()
    plain = df.select(hashing.joined_hash(["x", "y", "z"], null_safe=False).alias("h")).distinct().count()
    assert (safe, plain) == (2, 1)


def test_surrogate_key_is_repeatable_and_not_negative(spark):
    df = spark.range(5000).select(hashing.surrogate_key(["id"]).alias("k"))
    assert df.filter("k < 0").count() == 0
    assert df.distinct().count() == 5000
    assert df.collect() == df.collect()


@pytest.mark.parametrize(
    "method, value, want",
    [
        ("email_mask", "john@example.com", "j***@example.com"),
        ("email_mask", "noat", "n***@noat"),
        ("email_mask", "", "***@"),
        ("email_mask", "a@b@c.d", "a***@c.d"),
        ("phone_mask", "0912345678", "***5678"),
        ("phone_mask", "12", "***12"),
        ("last4", "4111111111111111", "****-****-****-1111"),
        ("sha256", "x", hashlib.sha256(b"x").hexdigest()),
        ("nullify", "x", None),
        (None, "x", None),
        ("keep", "x", "x"),
        ("email_mask", None, None),
        ("sha256", None, None),
        ("last4", None, None),
    ],
)
def test_masks(spark, method, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(masking.mask(method, F.col("v")).alias("m")).first().m == want


def test_unknown_mask_is_an_error():
    with pytest.raises(ValueError):
        masking.mask("rot13", F.lit("x"))


@pytest.mark.parametrize(
    "rule, values, want",
    [
        ({"type": "not_null", "column": "v"}, ["a", None], [True, False]),
        ({"type": "regex", "column": "v", "pattern": "b"}, ["abc", "x", None], [True, False, None]),
        ({"type": "positive", "column": "v"}, ["1", "0", "text", None], [True, False, None, None]),
        ({"type": "non_negative", "column": "v"}, ["0", "-1", None], [True, False, None]),
        ({"type": "in_set", "column": "v", "values": ["a"]}, ["a", "b", None], [True, False, None]),
        ({"type": "range", "column": "v", "min": 1, "max": 2}, ["1", "2", "3", "0"], [True, True, False, False]),
        ({"type": "range", "column": "v", "min": 1}, ["5"], [True]),
        ({"type": "range", "column": "v"}, ["5"], [True]),
        ({"type": "expr", "expr": "v = 'a'"}, ["a", "b"], [True, False]),
        ({"type": "always_pass"}, [None], [True]),
    ],
)
def test_rule_conditions_keep_three_values(spark, rule, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(rule_condition(rule)).collect()]
    assert got == want


def test_freshness_counts_the_future_too(spark):
    df = spark.sql(
        "SELECT id, timestamp'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS t FROM range(-30, 31, 30)"
    )
    rule = {"type": "freshness_hours", "column": "t", "threshold": 24}
    condition = rule_condition(rule, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert rows(df.filter(condition), "id") == [(0,)]


def test_unknown_rule_is_an_error():
    with pytest.raises(ValueError):
        rule_condition({"type": "magic", "column": "v"})
