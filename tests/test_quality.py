import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from layerflow.operators import privacy, quality

RULES = [
    {"rule_id": "A", "type": "not_null", "column": "v"},
    {"rule_id": "B", "type": "positive", "column": "n", "severity": "warning"},
]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, "x", 1), (2, None, -1), (3, "y", -1), (4, None, None)], "k int, v string, n int")


def test_split_is_a_partition_of_the_input(frame):
    passed, failed = quality.split(quality.annotate(frame, RULES), RULES)
    assert rows(passed, "k") == [(1,)]
    assert rows(failed.select("k", F.concat_ws(",", "_dq_errors"))) == [(2, "A,B"), (3, "B"), (4, "A")]
    assert passed.count() + failed.count() == frame.count()


def test_only_critical_rules_can_quarantine(frame):
    passed, failed = quality.split(quality.annotate(frame, RULES), RULES, enforce="critical")
    assert rows(failed, "k") == [(2,), (4,)]
    assert rows(passed, "k") == [(1,), (3,)]


def test_no_rules_pass_everything_and_can_be_written(frame, tmp_path):
    checked = quality.annotate(frame, [], style="meta")
    passed, failed = quality.split(checked, [], style="meta")
    assert (passed.count(), failed.count()) == (4, 0)
    checked.write.parquet(str(tmp_path / "out"))


def test_unique_fails_every_copy_and_groups_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (None, "b"), (None, "b"), (None, "c")], "a int, b string")
    rule = {"rule_id": "U", "type": "unique", "columns": ["a", "b"]}
    _, failed = quality.split(quality.annotate(df, [rule]), [rule])
    assert rows(failed, "a", "b") == [(1, None), (1, None), (None, "b"), (None, "b")]
    assert "Window" not in plan(failed)


def test_unique_join_of_a_hot_key_is_split(spark):
    """One key holds most rows: the join back is cut by AQE."""
    names = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 40000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
        )
        rule = {"rule_id": "U", "type": "unique", "columns": ["k"]}
        checked = quality.annotate(df, [rule])
        checked.write.format("noop").mode("overwrite").save()
        failed = checked.filter(~F.col("_dq_passed"))
        assert failed.count() == df.filter("k = 7").count()
        collected = checked.select("k", "v", "_dq_passed")
        collected.toArrow()
        assert "skew=true" in plan(collected)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_metrics_take_one_pass(frame):
    metrics = quality.rule_metrics(quality.annotate(frame, RULES), RULES)
    assert plan(metrics).count("Exchange") == 1
    assert rows(metrics) == [("A", "critical", 4, 1, 2, 3), ("B", "warning", 4, 1, 2, 3)]


def test_checks_stay_in_generated_code(spark, frame):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        stored = spark.range(10).selectExpr("CAST(id AS STRING) AS v", "id AS n")
        text = plan(quality.annotate(stored, RULES))
        assert all("*(1)" in line for line in text.strip().split("\n"))
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_model_quality_of_an_empty_model(frame):
    rules = [{"rule_id": "N", "type": "row_count_positive"}, {"rule_id": "V", "type": "not_null", "column": "v"}]
    got = quality.model_quality(frame.filter("k > 9"), rules, model="m", target="t")
    assert rows(got, "rule_id", "total_rows", "failed_rows", "status") == [("N", 0, 1, "failed"), ("V", 0, 0, "success")]


def test_masking_checks_count_what_was_missed(spark):
    df = spark.createDataFrame([("a@b.c", "secret"), ("a***@b.c", None), (None, None)], "email string, note string")
    policy = {"email": {"method": "email_mask"}, "note": {"method": "nullify"}, "absent": {"method": "sha256"}}
    checks = privacy.masking_checks(df, policy, "t")
    assert rows(checks, "column_name", "total", "unmasked") == [("email", 2, 1), ("note", 3, 1)]
    assert privacy.masking_accuracy(checks).first().accuracy_pct == pytest.approx(60.0)
