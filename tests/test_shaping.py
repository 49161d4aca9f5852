import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from layerflow.operators import contract, shaping
from layerflow.operators.dedup import latest_per_key


def test_contract_casts_adds_and_keeps(spark):
    df = spark.createDataFrame([("1", "x", "kept"), ("bad", "y", "kept")], "id string, name string, extra string")
    columns = [{"name": "id", "type": "long"}, {"name": "paid", "type": "decimal(18,2)"}]
    out = contract.apply_contract(df, columns)
    assert rows(out, "id", "extra", "paid") == [(1, "kept", None), (None, "kept", None)]
    assert out.schema["paid"].dataType.simpleString() == "decimal(18,2)"


def test_strict_contract_refuses_missing_required(spark):
    df = spark.createDataFrame([(1,)], "id int")
    columns = [{"name": "must", "type": "string", "nullable": False}]
    with pytest.raises(ValueError):
        contract.apply_contract(df, columns, strict=True)
    assert contract.apply_contract(df, columns).columns == ["id", "must"]


def test_evolution_modes(spark):
    target = spark.createDataFrame([], "a int, b string").schema
    df = spark.createDataFrame([("new", 1)], "c string, a int")
    with pytest.raises(ValueError):
        contract.evolve(df, target, "fail")
    kept, _ = contract.evolve(df, target, "permissive")
    assert kept.columns == ["a", "b"] and rows(kept) == [(1, None)]
    grown, schema = contract.evolve(df, target)
    assert grown.columns == ["a", "b", "c"] == schema.fieldNames() and rows(grown) == [(1, None, "new")]


def test_standardize_in_order_and_errors(spark):
    df = spark.createDataFrame([(" Ab ", None)], "a string, b string")
    rules = [
        {"column": "a", "action": "trim"},
        {"column": "a", "action": "upper"},
        {"column": "a", "action": "regexp_replace", "pattern": "B"},
        {"name": "c", "action": "coalesce", "columns": ["b", "a"]},
        {"name": "d", "action": "expr", "expr": "concat(c, '!')"},
    ]
    assert rows(shaping.standardize(df, rules)) == [("A", None, "A", "A!")]
    for bad in ({"column": "absent", "action": "trim"}, {"column": "a", "action": "reverse"}):
        with pytest.raises(ValueError):
            shaping.standardize(df, [bad])


def test_audit_hash_scope(spark):
    df = spark.createDataFrame([(1, "t")], "a int, _t string")
    options = dict(layer="raw", batch_id="b", source_system="s")
    some = shaping.stamp_audit(df, **options).first()._row_hash
    every = shaping.stamp_audit(df, hash_all_columns=True, **options).first()._row_hash
    assert some != every
    assert shaping.drop_technical(shaping.stamp_audit(df, **options)).columns == ["a"]


def test_latest_per_key_orders_nulls_last_and_skips_without_order(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 5, "five"), (2, None, "only")], "k int, o int, v string")
    assert rows(latest_per_key(df, ["k"], ["o"]), "k", "v") == [(1, "five"), (2, "only")]
    assert latest_per_key(df, ["k"], ["absent"]).count() == 3


def test_latest_per_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    text = plan(latest_per_key(df, ["k"], ["o"]))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_final_projection_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "derived int, b int, _meta_x int, _raw int, a int")
    assert shaping.final_projection(df, ["a", "b", "absent"]).columns == ["a", "b", "derived", "_meta_x"]
