from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
import pytest

from helpers import plan, rows
from layerflow.sources import readers, sizes
from layerflow.sources.tables import DAY, VERSIONS, TableStore
from layerflow.config import ConfigError, registry_from

ROW = "k int, t string, v string"


def frame(spark, data, schema=ROW):
    return spark.createDataFrame(data, schema).withColumn("t", F.col("t").cast("timestamp"))


def days(store, name):
    return sorted(r[0] for r in store.spark.sql(f"SHOW PARTITIONS {name}").collect())


def test_append_creates_a_day_partitioned_table_and_evolves(spark, store, space):
    name = f"{space}_raw.items"
    store.append(frame(spark, [(1, "2024-01-01 05:00:00", "a")]), name, partition_by="t")
    assert store.partition_columns(name) == [DAY] and days(store, name) == ["p_date=2024-01-01"]
    later = frame(spark, [("x", 2, "2024-01-02 00:00:00", "b")], "extra string, k int, t string, v string")
    store.append(later, name, partition_by="t")
    assert rows(store.read(name), "k", "v", "extra") == [(1, "a", None), (2, "b", "x")]
    with pytest.raises(ValueError):
        store.append(later.withColumn("more", F.lit(1)), name, partition_by="t", on_schema_change="fail")


def test_repeated_batch_replaces_itself(spark, store, space):
    name = f"{space}_raw.events"
    batch = lambda i, v: spark.createDataFrame([(v, i)], "v string, b long")
    store.append(batch(0, "a"), name, batch_column="b")
    store.append(batch(1, "b"), name, batch_column="b")
    store.append(batch(1, "b2"), name, batch_column="b")
    assert rows(store.read(name), "b", "v") == [(0, "a"), (1, "b2")]


@pytest.mark.parametrize("partition_by", [None, "t"])
def test_merge_rewrites_moves_and_empties_days(spark, store, space, partition_by):
    name = f"{space}_silver.items"
    first = frame(spark, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-02 00:00:00", "b"), (3, "2024-01-03 00:00:00", "c")])
    store.merge_rows(first, name, ["k"], partition_by=partition_by)
    change = frame(spark, [(2, "2024-01-05 00:00:00", "moved"), (4, "2024-01-03 00:00:00", "new")])
    store.merge_rows(change, name, ["k"], partition_by=partition_by)
    store.merge_rows(change, name, ["k"], partition_by=partition_by)
    assert rows(store.read(name), "k", "v") == [(1, "a"), (2, "moved"), (3, "c"), (4, "new")]
    if partition_by:
        assert days(store, name) == ["p_date=2024-01-01", "p_date=2024-01-03", "p_date=2024-01-05"]


def test_write_modes(spark, store, space):
    name = f"{space}_gold.kpi"
    a, b = frame(spark, [(1, "2024-01-01 00:00:00", "a")]), frame(spark, [(1, "2024-02-01 00:00:00", "b")])
    store.write(a, name, write_mode="overwrite", partition_by="t")
    store.write(b, name, write_mode="overwrite", partition_by="t")
    assert rows(store.read(name), "k", "v") == [(1, "b")]
    store.write(a, name, write_mode="merge", primary_key=["k"], partition_by="t")
    assert rows(store.read(name), "k", "v") == [(1, "a")]
    nullable = frame(spark, [(None, "2024-01-01 00:00:00", "n")])
    store.write(nullable, name, write_mode="merge", primary_key=["k"], partition_by="t")
    store.write(nullable, name, write_mode="merge", primary_key=["k"], partition_by="t")
    assert rows(store.read(name), "k", "v") == [(1, "a"), (None, "n")]  # a repeated batch adds nothing
    store.write(nullable.withColumn("v", F.lit("m")), name, write_mode="merge", primary_key=["k"], partition_by="t")
    assert rows(store.read(name), "k", "v") == [(1, "a"), (None, "m"), (None, "n")]
    store.replace(spark.range(2), name)
    assert store.read(name).columns == ["id"] and store.read(name).count() == 2
    with pytest.raises(ValueError):
        store.write(a, name, write_mode="upside_down")


def test_time_window_prunes_days(spark, store, space):
    name = f"{space}_silver.orders"
    data = [(i, f"2024-01-{i:02d} 12:00:00", "v") for i in range(1, 11)]
    store.append(frame(spark, data), name, partition_by="t")
    window = store.read_days(name, "t", "2024-01-03 00:00:00", "2024-01-05 13:00:00")
    assert rows(window, "k") == [(3,), (4,), (5,)]
    assert "PartitionFilters: [isnotnull(p_date" in plan(window)
    assert sizes.table_bytes(window).first().files == 3


def test_layer_window_is_half_open_and_pushed_down(spark, store, space):
    name = f"{space}_raw.win"
    df = frame(spark, [(i, f"2024-01-01 00:0{i}:00", "v") for i in range(5)]).withColumnRenamed("t", "_meta_ingest_ts")
    store.append(df, name)
    window = readers.layer_window(store.read(name), "2024-01-01 00:01:00", "2024-01-01 00:03:00")
    assert rows(window, "k") == [(1,), (2,)]
    assert "GreaterThanOrEqual(_meta_ingest_ts" in plan(window)
    assert readers.layer_window(store.read(name), limit=2).count() == 2
    work = df.withColumn("_meta_work_ts", F.lit("2030-01-01").cast("timestamp"))
    assert readers.layer_window(work, "2029-01-01", prefer=readers.WORK_WINDOW).count() == 5


def test_sources(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "k int, w string").write.option("header", True).csv(path)
    registry = registry_from(
        {
            "connections": {"db": {"type": "jdbc", "url": "jdbc:x", "user": "u", "password": "p"}},
            "tables": [
                {
                    "name": "t", "watermark_column": "w",
                    "source": {"type": "file", "format": "csv", "path": path, "options": {"header": True},
                               "load_strategy": "incremental"},
                },
                {"name": "bad", "source": {"type": "carrier_pigeon"}},
            ],
        }
    )
    table = registry.tables["t"]
    assert readers.read_source(spark, registry, table).count() == 2
    assert rows(readers.read_source(spark, registry, table, "2024-01-01"), "k") == [("2",)]
    with pytest.raises(ConfigError):
        readers.read_source(spark, registry, registry.tables["bad"])


def test_jdbc_options():
    connection = {"url": "jdbc:x", "user": "u", "password": "p"}
    plain = readers.jdbc_options({"table": "s.t"}, connection)
    assert plain["dbtable"] == "s.t" and plain["driver"] == "org.postgresql.Driver"
    assert readers.jdbc_options({"query": "SELECT 1"}, connection)["query"] == "SELECT 1"
    ranged = readers.jdbc_options(
        {"query": "SELECT 1", "partition_column": "id", "lower_bound": 0, "upper_bound": 9}, connection
    )
    assert ranged["dbtable"] == "(SELECT 1) q" and ranged["numPartitions"] == "32" and "query" not in ranged


def test_snapshot_query():
    assert readers.snapshot_query({"table": "t"}) == "SELECT * FROM public.t"
    template = {"query_template": "SELECT * FROM t WHERE u >= %(from_ts)s AND u < %(to_ts)s"}
    with pytest.raises(ConfigError):
        readers.snapshot_query(template, "2024-01-01")
    text = readers.snapshot_query(template, "2024-01-01", "2024-02-01'; DROP")
    assert text == "SELECT * FROM t WHERE u >= TIMESTAMP '2024-01-01' AND u < TIMESTAMP '2024-02-01''; DROP'"


def test_partitioned_directory_is_registered(spark, tmp_path, space):
    path = str(tmp_path / "plain")
    df = frame(spark, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-02 00:00:00", "b")])
    sizes.write_day_partitioned(df, path, "t")
    sizes.write_day_partitioned(df.filter("k = 2"), path, "t")
    sizes.register_partitioned(spark, f"{space}_plain", path)
    assert rows(spark.table(f"{space}_plain"), "k") == [(2,)]


def test_layer_sizes_add_up(spark, tmp_path):
    for layer, n in (("raw", 10), ("silver", 5)):
        spark.range(n).write.parquet(str(tmp_path / layer / "t"))
    got = {r.layer: r.bytes for r in sizes.layer_sizes(spark, {n: str(tmp_path / n) for n in ("raw", "silver")}).collect()}
    assert got["total"] == got["raw"] + got["silver"] > 0


def test_emptied_table_and_empty_changes(spark, store, space):
    """Deleting every row of a day drops it; merging nothing changes nothing."""
    name = f"{space}_silver.gone"
    schema = "k int, t string, _meta_source_operation string"
    store.merge_rows(frame(spark, [(1, "2024-01-01 00:00:00", "c"), (2, "2024-01-02 00:00:00", "c")], schema), name, ["k"], partition_by="t")
    store.merge_rows(frame(spark, [], schema), name, ["k"], partition_by="t")
    assert store.read(name).count() == 2
    gone = frame(spark, [(1, "2024-01-01 00:00:00", "d"), (2, "2024-01-02 00:00:00", "d"), (9, "2024-01-01 00:00:00", "d")], schema)
    store.merge_rows(gone, name, ["k"], partition_by="t", delete_mode="hard_delete")
    assert store.read(name).count() == 0 and days(store, name) == []


def test_old_versions_of_a_table_are_dropped(spark, space, tmp_path):
    name = f"{space}_silver.versions"
    patient = TableStore(spark, str(tmp_path / "tables"))
    folder = tmp_path / "tables" / f"{space}_silver" / "versions" / VERSIONS
    for i in range(4):
        patient.merge_rows(spark.createDataFrame([(1, i)], "k int, v int"), name, ["k"], sequence=["v"])
    assert len(list(folder.iterdir())) == 4  # within a day, readers may hold any of them
    hasty = TableStore(spark, str(tmp_path / "tables"), keep_hours=0)
    hasty.merge_rows(spark.createDataFrame([(1, 9)], "k int, v int"), name, ["k"], sequence=["v"])
    assert rows(hasty.read(name)) == [(1, 9)] and len(list(folder.iterdir())) == 1


def test_versions_of_one_table_leave_other_tables_alone(spark, space, tmp_path):
    """A table and a namespace of one name share no directory."""
    store = TableStore(spark, str(tmp_path / "tables"), keep_hours=0)
    fact = f"{space}.fact"
    store.overwrite(spark.range(10), fact)
    for i in range(4):
        store.merge_rows(spark.createDataFrame([(1, i)], "k int, v int"), space, ["k"], sequence=["v"])
    assert store.read(fact).count() == 10 and rows(store.read(space)) == [(1, 3)]


def test_replace_keeps_the_name_and_retires_the_old_files(spark, space, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"), keep_hours=0)
    name = f"{space}_gold.again"
    store.replace(frame(spark, [(1, "2024-01-01 00:00:00", "a")]), name, partition_by="t")
    store.replace(spark.range(3), name)
    assert rows(store.read(name)) == [(0,), (1,), (2,)]
    assert len(list((tmp_path / "tables" / f"{space}_gold" / "again" / VERSIONS).iterdir())) == 1
    assert [t.name for t in spark.catalog.listTables(f"{space}_gold")] == ["again"]


def test_create_lost_to_another_writer_appends(spark, store, space, monkeypatch):
    name = f"{space}_audit.metrics"
    store.append(spark.range(2), name)
    answers = iter([False])
    monkeypatch.setattr(TableStore, "exists", lambda self, n: next(answers, True))
    store.append(spark.range(1), name)
    assert store.read(name).count() == 3


def test_updates_of_a_repeated_key_multiply_no_rows(spark, store, space):
    name = f"{space}_silver.facts"
    store.overwrite(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), name)
    updates = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x")], "k int, v string")
    store.update_rows(updates, name, ["k"], ["v"])
    assert rows(store.read(name)) == [(1, "x"), (2, "b"), (3, "c")]


def test_history_moves_between_days(spark, store, space):
    from layerflow.operators.history import history_columns

    name = f"{space}_silver.history"
    schema = "k int, t string, _meta_record_hash string, _meta_source_operation string"
    columns = history_columns(["k"], start="t", sequence=())
    load = lambda data: store.merge_history(frame(spark, data, schema), name, columns, partition_by="t")
    load([(1, "2024-01-01 00:00:00", "a", "c"), (2, "2024-01-01 00:00:00", "x", "c")])
    load([(1, "2024-01-03 00:00:00", "b", "u"), (3, "2024-01-02 00:00:00", "n", "c")])
    load([(1, "2024-01-02 00:00:00", "late", "u"), (2, "2024-01-05 00:00:00", "x", "d")])
    got = rows(store.read(name).selectExpr("k", "day(t) d", "day(effective_to) e", "is_current", "_meta_is_deleted"))
    assert got == [
        (1, 1, 2, False, False), (1, 2, 3, False, False), (1, 3, None, True, False),
        (2, 1, 5, False, True), (3, 2, None, True, False),
    ]


def test_writers_side_by_side_lose_nothing(spark, store, space):
    """Three threads record batches at once, the first of them before there is a table."""
    name = f"{space}_audit"
    schema = "flow string, batch long, value double"

    def keep(flow):
        for batch in range(6):
            store.record([{"flow": flow, "batch": batch, "value": batch}], name, schema, f"{flow}.{batch}")
            if batch % 2:  # tried again
                store.record([{"flow": flow, "batch": batch, "value": batch + 0.5}], name, schema, f"{flow}.{batch}")

    with ThreadPoolExecutor(3) as pool:
        for done in [pool.submit(keep, flow) for flow in ("a", "b", "c")]:
            done.result()
    want = [(f, b, b + 0.5 * (b % 2)) for f in "abc" for b in range(6)]
    assert rows(store.read(name), "flow", "batch", "value") == sorted(want, key=repr)


def test_writers_side_by_side_add_columns(spark, store, space):
    name = f"{space}_wide"
    store.record([{"k": 0}], name, "k long", "first")

    def keep(letter):
        store.record([{"k": 1, letter: 2.0, "shared": 3.0}], name, f"k long, {letter} double, shared double", letter)

    with ThreadPoolExecutor(3) as pool:
        for done in [pool.submit(keep, letter) for letter in ("x", "y", "z")]:
            done.result()
    assert rows(store.read(name), "x", "y", "z", "shared") == sorted(
        [(None, None, None, None), (2.0, None, None, 3.0), (None, 2.0, None, 3.0), (None, None, 2.0, 3.0)], key=repr
    )


@pytest.mark.parametrize("session_mode", ["static", "dynamic"])
def test_overwrite_mode_is_the_write_s_own(spark, store, space, session_mode):
    """Whatever the session says, a batch replaces its own partition and an overwrite all."""
    name, key = f"{space}_mode", "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, session_mode)
    try:
        for batch in ("a", "b", "a"):
            store.append(spark.range(2).withColumn("batch", F.lit(batch)), name, batch_column="batch")
        assert store.read(name).count() == 4
        store.overwrite(spark.range(3).withColumn("batch", F.lit("c")), name)
        assert rows(store.read(name).select("batch").distinct()) == [("c",)]
    finally:
        spark.conf.set(key, before)


def test_merges_look_up_days_instead_of_scanning_keys(spark, store, space):
    """The index names the days of changed keys, follows rows that move, and is
    made anew where rows changed otherwise."""
    name = f"{space}_facts"
    data = [(k, f"2024-01-{1 + k % 9:02d}", f"v{k}") for k in range(60)]
    store.merge_rows(frame(spark, data), name, ["k"], partition_by="t")
    moved = frame(spark, [(7, "2024-02-01", "moved"), (100, "2024-01-02", "new")])
    for _ in range(2):
        store.merge_rows(moved, name, ["k"], partition_by="t")
    index = store.day_index(name)
    keys = spark.createDataFrame([(7,), (8,), (100,)], "k long")  # of another type than the table's
    looked_up = index.days_of(keys, ["k"])
    assert "PartitionFilters: [_bucket" in plan(looked_up).replace("PartitionFilters: [isnotnull(_bucket#", "PartitionFilters: [_bucket")
    # Day 8 of key 7 is an entry too many: it was there before it moved.
    assert {str(r[0]) for r in looked_up.collect()} == {"2024-01-08", "2024-01-09", "2024-01-02", "2024-02-01"}
    expected = {k: v for k, _, v in data} | {7: "moved", 100: "new"}
    assert rows(store.read(name), "k", "v") == sorted(expected.items(), key=repr)
    store.append(frame(spark, [(200, "2024-03-01", "appended")]), name, partition_by="t")
    assert not store.day_index(name).known
    store.merge_rows(frame(spark, [(200, "2024-03-02", "later")]), name, ["k"], partition_by="t")
    assert rows(store.read(name).filter("k = 200"), "v") == [("later",)]


def test_index_is_folded(spark, store, space, monkeypatch):
    monkeypatch.setattr("layerflow.sources.day_index.FOLD_AFTER", 2)
    name = f"{space}_folded"
    for day in range(1, 7):
        store.merge_rows(frame(spark, [(1, f"2024-01-{day:02d}", f"v{day}"), (day, "2024-02-01", "other")][: 1 + (day > 1)]), name, ["k"], partition_by="t")
    known = store.day_index(name).known["k"]
    assert known["runs"] <= 2
    assert rows(store.read(name).filter("k = 1"), "v") == [("v6",)] and store.read(name).count() == 6


def test_windows_of_layers_prune_days(spark, store, space):
    name = f"{space}_layer"
    df = spark.createDataFrame([(k, f"2024-01-{1 + k % 9:02d} 12:00:00", k % 3) for k in range(90)], "k int, t string, b long")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    for batch in range(3):
        store.append(df.filter(F.col("b") == batch), name, partition_by="t", batch_column="b", batch=batch)
    window = store.read_days(name, "t", "2024-01-03 12:00:00", "2024-01-05 00:00:00")
    text = plan(window)
    assert "PartitionFilters: [isnotnull(p_date" in text and ">= 2024-01-03" in text and "<= 2024-01-05" in text
    assert DAY not in window.columns and window.count() == 20
    # A batch that is tried again on another day leaves nothing behind.
    again = df.filter("b = 1").withColumn("t", F.col("t") + F.make_dt_interval(F.lit(30)))
    store.append(again, name, partition_by="t", batch_column="b", batch=1)
    assert store.read(name).count() == 90 and store.read(name).filter("b = 1 AND t < '2024-01-20'").count() == 0
    store.drop_batch(name, "b", 2)
    assert store.read(name).count() == 60


def test_kafka_options_limit_a_trigger():
    flow = registry_from({"connections": {"l": {}}, "flows": [{
        "name": "f", "source": {"connection": "l", "topics": ["a", "b"]},
        "target": {"raw_table": "r", "work_table": "w", "silver_table": "s"}}]}).flows["f"]
    plain = readers.kafka_options(flow, {"bootstrap_servers": "h:1"})
    assert plain["subscribe"] == "a,b" and "maxOffsetsPerTrigger" not in plain
    assert readers.kafka_options(flow, {"bootstrap_servers": "h:1", "max_offsets_per_trigger": 500})["maxOffsetsPerTrigger"] == "500"
