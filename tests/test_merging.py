import random

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, plan, rows
from layerflow.operators import dedup, history, keys, neighbors, reconcile, upsert
from layerflow.operators.shaping import LOG_COLUMNS
from layerflow.queries.merging import stored_changes
from layerflow.sales.views import SalesSource
from layerflow.session import materialize

EVENT = "k int, at int, v string, op string, off long"


def events(spark, data, schema=EVENT):
    """Events (key, time in days, value, op, offset) in log order."""
    df = spark.createDataFrame(data, schema)
    return df.select(
        "k",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("at"))).alias("effective_from"),
        "v",
        F.col("op").alias("_meta_source_operation"),
        F.col("off").alias("_meta_kafka_offset"),
        F.sha2("v", 256).alias("_meta_record_hash"),
        F.concat(F.lit("e"), F.col("off").cast("string")).alias("_meta_event_id"),
    )


def brute_history(data):
    """Version rows by a plain loop over each key's events."""
    out = []
    for key in {d[0] for d in data}:
        newest = {}
        for _, at, v, op, off in sorted((d for d in data if d[0] == key), key=lambda d: d[4]):
            newest[at] = (v, op)
        open_row = None
        for at in sorted(newest):
            v, op = newest[at]
            if op == "d":
                if open_row:
                    out.append((key, open_row[0], open_row[1], at, False, True))
                open_row = None
            elif not open_row or open_row[1] != v:
                if open_row:
                    out.append((key, open_row[0], open_row[1], at, False, False))
                open_row = (at, v)
        if open_row:
            out.append((key, open_row[0], open_row[1], None, True, False))
    return sorted(out, key=repr)


def shown(df):
    day = "CAST(datediff(CAST({0} AS DATE), DATE'2024-01-01') AS INT) AS {0}"
    picked = df.selectExpr(
        "k", day.format("effective_from"), "v", day.format("effective_to"), "is_current", "_meta_is_deleted"
    )
    return rows(picked)


def random_events(seed, n, keys=4, days=12):
    rng = random.Random(seed)
    return [
        (rng.choice([0, 0, 0, rng.randrange(keys)]), rng.randrange(days), rng.choice("abc"), rng.choice("cuuud"), i)
        for i in range(n)
    ]


ORDINARY = history.history_columns(["k"])


@pytest.fixture(params=[1, 7], ids=["one range", "seven ranges"])
def ranges(request, spark):
    """Runs with all rows in one range, and with keys cut into several."""
    changed = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("seed", range(2))
def test_history_equals_a_loop_over_the_events(spark, seed, ranges):
    data = random_events(seed, 60)
    assert shown(history.build_history(events(spark, data), ORDINARY)) == brute_history(data)


def test_history_of_one_key_alone(spark, ranges):
    """A single key, here the NULL one, holds every row."""
    data = [(None, at, v, op, off) for _, at, v, op, off in random_events(7, 80, days=70)]
    assert shown(history.build_history(events(spark, data), ORDINARY)) == brute_history(data)


def merged_in(spark, batches, columns):
    table = history.build_history(events(spark, batches[0]), columns)
    for batch in batches[1:]:
        rebuilt, untouched = history.merge_history(materialize(table), events(spark, batch), columns)
        table = rebuilt.unionByName(untouched)
    return table


def test_history_does_not_depend_on_batches(spark, ranges):
    """Batches in time order, the last one twice, give the history of all events."""
    data = sorted(random_events(100, 45, days=60), key=lambda d: d[1])
    data = [(*d[:4], i) for i, d in enumerate(data)]
    table = merged_in(spark, [data[:15], data[15:30], data[30:], data[30:]], ORDINARY)
    assert shown(table) == brute_history(data)


@pytest.mark.parametrize("seed", range(2))
def test_out_of_order_batches_keep_a_valid_history(spark, seed):
    data = random_events(seed + 200, 40, days=60)
    table = shown(merged_in(spark, [data[20:], data[:20]], ORDINARY))
    for key in {r[0] for r in table}:
        spans = sorted((r[1], r[3]) for r in table if r[0] == key)
        assert all(end is not None and end <= start for (_, end), (start, _) in zip(spans, spans[1:]))
        assert sum(r[4] for r in table if r[0] == key) <= 1


def test_replay_changes_nothing_at_all(spark):
    data = [(1, 0, "a", "c", 0), (1, 5, "b", "u", 1), (2, 0, "x", "c", 2), (2, 9, "x", "d", 3), (3, 1, "z", "d", 4)]
    batch = events(spark, data)
    table = materialize(history.build_history(batch, ORDINARY))
    rebuilt, untouched = history.merge_history(table, batch, ORDINARY)
    assert rows(rebuilt.unionByName(untouched), *table.columns) == rows(table)
    assert shown(table) == [
        (1, 0, "a", 5, False, False), (1, 5, "b", None, True, False), (2, 0, "x", 9, False, True),
    ]


def test_late_change_takes_its_place_and_reinsert_reopens(spark):
    table = materialize(history.build_history(events(spark, [(1, 0, "a", "c", 0), (1, 10, "c", "u", 1)]), ORDINARY))
    rebuilt, untouched = history.merge_history(
        table, events(spark, [(1, 5, "b", "u", 2), (1, 20, "c", "d", 3), (1, 30, "c", "c", 4)]), ORDINARY
    )
    assert shown(rebuilt.unionByName(untouched)) == [
        (1, 0, "a", 5, False, False), (1, 10, "c", 20, False, True), (1, 30, "c", None, True, False),
        (1, 5, "b", 10, False, False),
    ]


def test_untouched_keys_are_not_rebuilt(spark):
    table = materialize(history.build_history(events(spark, [(1, 0, "a", "c", 0), (2, 0, "b", "c", 1)]), ORDINARY))
    rebuilt, untouched = history.merge_history(table, events(spark, [(2, 3, "c", "u", 2)]), ORDINARY)
    assert {r.k for r in rebuilt.collect()} == {2} and {r.k for r in untouched.collect()} == {1}


def test_a_key_with_most_rows_is_spread_over_ranges(spark, ranges):
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 > 0, F.lit(None).cast("int")).otherwise(F.col("id").cast("int")).alias("k"),
        F.timestamp_seconds("id").alias("t"),
    )
    ranged = neighbors.in_ranges(df, ["k", "t"])
    sizes = [r[0] for r in ranged.filter("k IS NULL").groupBy(neighbors.RANGE).count().select("count").collect()]
    assert sum(sizes) == 900 and len(sizes) >= ranges - 1 and max(sizes) < 1.5 * 1000 / ranges
    near = neighbors.add_neighbors(ranged, ["k"], "t", previous={"p": "t"}, following={"n": "t"})
    null_key = near.filter("k IS NULL")
    assert null_key.filter("p IS NULL").count() == 1 and null_key.filter("n IS NULL").count() == 1
    want = sorted(k for k in range(1000) if k % 10)
    assert rows(null_key.filter("p IS NOT NULL").select(F.unix_seconds("p"), F.unix_seconds("t"))) == sorted(zip(want, want[1:]), key=repr)
    assert near.filter("k IS NOT NULL AND (p IS NOT NULL OR n IS NOT NULL)").count() == 0
    few = ranged.filter("k IS NOT NULL OR unix_seconds(t) % 400 = 1")  # whole ranges are left empty
    again = neighbors.add_neighbors(few, ["k"], "t", previous={"p": "t"}, following={"n": "t"}).filter("k IS NULL")
    assert rows(again.select(F.unix_seconds("p"), F.unix_seconds("t"), F.unix_seconds("n"))) == [
        (1, 401, 801), (401, 801, None), (None, 1, 401)
    ]


STATE = "k int, at int, v string, op string, off long"


def state_rows(spark, data):
    df = spark.createDataFrame(data, STATE)
    return df.select(
        "k", "at", "v", F.col("op").alias("_meta_source_operation"), F.col("off").alias("_meta_kafka_offset"),
        (F.col("op") == "d").alias("_meta_is_deleted"), F.lit(None).cast("timestamp").alias("_meta_deleted_at"),
    )


def brute_state(data, hard):
    live, gone = {}, set()
    for k, at, v, op, off in sorted(data, key=lambda d: (d[1], d[4])):
        if op == "d":
            if k in live:
                gone.add(k)
        else:
            live[k] = v
            gone.discard(k)
    return sorted(
        [(k, v, k in gone) for k, v in live.items() if not (hard and k in gone)], key=repr
    )


@pytest.mark.parametrize("hard", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_upsert_outcome_does_not_depend_on_batches(spark, seed, hard):
    rng = random.Random(seed)
    data = [(rng.randrange(5), i // 3, f"v{i}", rng.choice("ccuuud"), i) for i in range(40)]
    mode = {"delete_mode": "hard_delete" if hard else "soft_delete", "sequence": ["at"]}
    target = upsert.initial_rows(state_rows(spark, data[:15]), ["k"], **mode)
    for part in (data[15:25], data[25:]):
        target = upsert.upsert(materialize(target), state_rows(spark, part), ["k"], **mode)
    assert rows(target, "k", "v", "_meta_is_deleted") == brute_state(data, hard)


def test_upsert_ignores_stale_changes_with_a_guard(spark):
    target = state_rows(spark, [(1, 10, "new", "c", 0)])
    late = state_rows(spark, [(1, 5, "old", "u", 9), (2, 1, "two", "c", 10)])
    guarded = upsert.upsert(target, late, ["k"], sequence=["at"], guard="at")
    assert rows(guarded, "k", "v") == [(1, "new"), (2, "two")]
    assert rows(upsert.upsert(target, late, ["k"], sequence=["at"]), "k", "v") == [(1, "old"), (2, "two")]


def test_null_operation_is_an_upsert_and_null_keys(spark):
    target = state_rows(spark, [(None, 1, "a", "c", 0)])
    change = state_rows(spark, [(None, 2, "b", None, 1)])
    assert rows(upsert.upsert(target, change, ["k"]), "k", "v") == [(None, "b")]
    loose = upsert.upsert(target, change, ["k"], null_safe=False)
    assert rows(loose, "k", "v") == [(None, "a"), (None, "b")]


def test_upsert_adds_new_columns_and_keeps_the_target_unshuffled(spark):
    target = spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"))
    changes = spark.createDataFrame([(5, "new", 1), (500, "add", 2)], "k int, v string, extra int")
    merged = upsert.upsert(target, changes, ["k"])
    assert rows(merged.filter("k IN (4, 5, 500)")) == [(4, "old", None), (5, "new", 1), (500, "add", 2)]
    update_side = plan(merged).split("Union")[1]
    first = update_side[: update_side.index("Range")]
    assert "BroadcastHashJoin" in first and "hashpartitioning" not in first


def test_lookup_uses_one_current_row_per_key(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, ck int")
    dimension = spark.createDataFrame(
        [(10, 100, False), (10, 101, True), (10, 102, True), (None, 7, True)], "ck int, sk long, is_current boolean"
    )
    out = keys.lookup_key(facts, dimension, name="sk", value="sk", lookup=["ck"], current="is_current")
    assert out.columns == ["id", "ck", "sk"]
    assert rows(out, "id", "sk") == [(1, 102), (2, -1), (3, -1)]
    assert rows(keys.unknown_rate(out, "sk"), "total_rows", "unknown_rows") == [(3, 2)]


def test_reconcile_updates_only_unknown_rows_with_a_match(spark):
    facts = spark.createDataFrame([(1, 10, -1), (2, 20, -1), (3, 10, 5), (4, None, -1)], "id int, ck int, sk long")
    dimension = spark.createDataFrame([(10, 100, True), (20, 200, False), (None, 9, True)], "ck int, dsk long, cur boolean")
    job = {
        "name": "late", "unknown_fk_column": "sk", "lookup_keys": [{"fact_column": "ck", "lookup_column": "ck"}],
        "lookup_value": "dsk", "current_filter": "cur", "update_columns": ["sk"], "fact_key": ["id"],
    }
    updates = reconcile.late_matches(facts, dimension, job)
    assert rows(updates, "id", "sk", "_meta_reconciled_by") == [(1, 100, "late"), (4, 9, "late")]
    fixed = upsert.update_columns(facts, updates, ["id"], reconcile.updated_columns(job))
    assert rows(fixed, "id", "sk") == [(1, 100), (2, -1), (3, 5), (4, 9)]


def test_changes_with_keys_of_their_own_are_not_ranked(spark):
    data = [(k, k % 7, f"v{k}", "d" if k % 5 == 0 else "u", k) for k in range(40)]
    for extra in ([], [(3, 9, "w", "u", 90), (4, 9, "x", "d", 91)], [(k, 9, "z", "d" if k % 2 else "u", 90 + k) for k in range(30)]):
        stored = materialize(events(spark, data + extra), "given")
        options = {"sequence": ["effective_from"], "guard": "effective_from"}
        quick, ranked = (upsert.change_images(stored, ["k"], stored=s, **options) for s in (True, False))
        order = ["_s_0", "_row", "_gone", "_row_guard", "_gone_guard"]
        assert rows(quick, *order) == rows(ranked, *order)
        if not extra:
            assert "Window" not in plan(quick) and "Exchange" not in plan(quick)


def test_a_merge_settles_starts_where_the_ranges_put_them(spark, monkeypatch):
    columns = history.history_columns(["k"], sequence=("_meta_kafka_offset",))
    data = random_events(3, 60)
    table = materialize(history.build_history(events(spark, data[:40]), columns), "versions")
    plans = []
    kept = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, label: (plans.append(plan(df)), kept(df, label))[1])
    rebuilt, untouched = history.merge_history(table, events(spark, data[20:]), columns)
    assert shown(rebuilt.unionByName(untouched)) == brute_history(data)
    last = plans[-1].index("Exchange rangepartitioning")
    assert "Exchange" not in plans[-1][:last] and "Window" in plans[-1][:last]


def test_the_queries_merge_no_text_of_the_log(spark):
    assert not set(LOG_COLUMNS) & set(stored_changes(SalesSource(spark, SMALL)).columns)


def test_a_first_load_ranks_inside_its_ranges(spark, monkeypatch):
    columns = history.history_columns(["k"], sequence=("_meta_kafka_offset",))
    data = random_events(5, 80)
    plans = []
    kept = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, label: (plans.append(plan(df)), kept(df, label))[1])
    for many in (history.MANY, 1):
        monkeypatch.setattr(history, "MANY", many)
        assert shown(history.build_history(events(spark, data), columns)) == brute_history(data)
    assert "hashpartitioning" not in plans[0] and "hashpartitioning" in plans[1]


def test_stored_rows_with_keys_of_their_own_are_not_shuffled(spark):
    stored = materialize(events(spark, [(k, 1, f"v{k}", "u", k) for k in range(20)]), "given")
    assert "Exchange" not in plan(dedup.latest_of_stored(stored, ["k"], ["effective_from"]))
    twice = stored.unionByName(events(spark, [(3, 5, "w", "u", 50)]))
    assert rows(dedup.latest_of_stored(twice, ["k"], ["effective_from"])) == rows(dedup.latest_per_key(twice, ["k"], ["effective_from"]))
