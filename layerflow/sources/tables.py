"""Tables of the session catalog: create, append, overwrite, merge, evolve."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.operators.contract import align_to, evolve, new_columns
from layerflow.operators.history import HistoryColumns, build_history, merge_history
from layerflow.operators.upsert import apply_images, change_images, initial_rows, update_columns
from layerflow.session import CODEC, materialize, observed
from layerflow.sources.day_index import DayIndex

DAY = "p_date"
VERSIONS = "table-versions"  # holds the directories of one table and nothing else
RETIRED = "layerflow.retired"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
AUDIT_KEY = "_audit_key"  # partition of audit tables
WRITERS = 8  # at once, that may add columns to one table
WRITE_MODES = ("append", "overwrite", "merge")


def with_day(df: DataFrame, column: str | None) -> DataFrame:
    """Add the day partition of ``column`` where the frame has that column."""
    return df.withColumn(DAY, F.to_date(F.col(column))) if column and column in df.columns else df


def typed_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: str) -> DataFrame:
    """Rows given by name as a frame of ``schema``; names that a row lacks are null."""
    kind = T.StructType.fromDDL(schema)
    doubles = {f.name for f in kind if isinstance(f.dataType, T.DoubleType)}
    data = [{n: float(v) if n in doubles and v is not None else v for n, v in row.items() if n in kind.names} for row in rows]
    return spark.createDataFrame(data, kind).coalesce(1)


class TableStore:
    """Parquet tables of the session catalog with keyed merges.

    A merge rewrites only the day partitions it touches, by dynamic partition
    overwrite. A table without partitions is written to a new directory and its
    location is switched, so a running reader keeps the files it opened. The
    table's properties record which directories it left and when; these go at a
    later write, ``keep_hours`` after they were left, and no other ever does.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, keep_hours: float = 24.0):
        self.spark, self.keep_hours = spark, keep_hours
        self.location = location.rstrip("/") if location else None

    # -- reading -------------------------------------------------------------
    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def read(self, name: str) -> DataFrame:
        # Another session may have switched the location since the last read.
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def read_optional(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    def read_days(
        self, name: str, column: str, from_ts: str | None = None, to_ts: str | None = None, limit: int | None = None
    ) -> DataFrame:
        """Half-open time window on the column whose date is the table's day.

        The day bounds follow and prune partitions before any file is opened.
        The day itself is left out; a table without days is filtered row by row.
        """
        df = self.read(name)
        for bound, is_from in ((from_ts, True), (to_ts, False)):
            if bound and column in df.columns:
                at = F.lit(bound).cast("timestamp")
                df = df.filter(F.col(column) >= at if is_from else F.col(column) < at)
                if DAY in df.columns:
                    df = df.filter(F.col(DAY) >= F.to_date(at) if is_from else F.col(DAY) <= F.to_date(at))
        df = df.drop(DAY)
        return df.limit(limit) if limit else df

    def partition_columns(self, name: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(name) if c.isPartition]

    # -- writing -------------------------------------------------------------
    def _ensure_namespace(self, name: str) -> None:
        if "." in name:
            self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name.rsplit('.', 1)[0]}")

    def _version_path(self, name: str) -> str:
        root = self.location or self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        return f"{root}/{name.replace('.', '/')}/{VERSIONS}/{uuid.uuid4().hex}"

    def create(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        self._ensure_namespace(name)
        writer = df.write.format("parquet").option("compression", CODEC).option("path", self._version_path(name))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(name)

    def _spread(self, df: DataFrame, partitions: Sequence[str]) -> DataFrame:
        """Cluster rows by partition before a partitioned write.

        The rebalance lets AQE split a huge day and join tiny ones, so neither
        one writer per day nor a file per task and day comes out.
        """
        return df.hint("rebalance", *partitions) if partitions else df

    def _evolve(self, df: DataFrame, name: str, mode: str) -> DataFrame:
        known = self.read(name).schema
        aligned, _ = evolve(df, known, mode)
        added = new_columns(df, known) if mode == "add_columns" else []
        # Another writer may add some of them at the same time.
        while added:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            try:
                self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
                break
            except AnalysisException:
                left = new_columns(df, self.read(name).schema)
                if len(left) == len(added):
                    raise
                added = left
        return align_to(aligned, self.read(name).schema)

    def append(
        self,
        df: DataFrame,
        name: str,
        *,
        partition_by: str | None = None,
        on_schema_change: str = "add_columns",
        batch_column: str | None = None,
        batch: int | str | None = None,
    ) -> None:
        """Append rows by column name.

        With ``batch_column`` the table is partitioned by it, inside the day if
        there is one, and the frame replaces the partitions it brings, so a
        repeated batch adds nothing; with its value in ``batch``, what an earlier
        try left on other days goes as well. Each such write has a staging folder
        of its own, so writers of different batches may run at the same time.
        Without it, run one writer per table.
        """
        df = with_day(df, partition_by)
        if not self.exists(name):
            dated = DAY in df.columns and (partition_by or not batch_column)
            partitions = [*([DAY] if dated else []), *([batch_column] if batch_column else [])]
            try:
                self.create(self._spread(df, [DAY] if dated and not batch_column else []), name, partitions)
                return
            except AnalysisException as error:
                if error.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                    raise  # else another flow was first
        # Another writer may add a column between the look at the schema and the
        # analysis of the insert, which then refuses the frame as it is.
        for left in range(WRITERS, -1, -1):
            try:
                self._insert(self._evolve(df, name, on_schema_change), name, batch_column, batch)
                return
            except AnalysisException as error:
                if not left or not (error.getCondition() or "").startswith("INSERT_COLUMN_ARITY_MISMATCH"):
                    raise

    def _insert(self, df: DataFrame, name: str, batch_column: str | None, batch: int | str | None) -> None:
        partitions = self.partition_columns(name)
        if not batch_column:
            self._forget_days(name, partitions)
            self._spread(df, partitions).write.insertInto(name, overwrite=False)
            return
        left = self._batch_days(name, batch_column, batch) if DAY in partitions and batch is not None else []
        if left:
            watch = Observation()
            on_day = [F.count_if(F.col(DAY).eqNullSafe(F.lit(None if d == NO_DAY else d).cast("date"))) for d in left]
            df = df.observe(watch, *[n.alias(f"d{i}") for i, n in enumerate(on_day)])
        self._insert_over(df, name)
        if left:
            found = observed(watch, [f"d{i}" for i in range(len(left))])
            self._drop_partitions(name, [{DAY: d, batch_column: batch} for i, d in enumerate(left) if not found[f"d{i}"]])

    def _batch_days(self, name: str, column: str, batch: int | str) -> list[str]:
        """Days on which the table has rows of a batch, from the catalog."""
        value = str(batch).replace("'", "''")
        found = self.spark.sql(f"SHOW PARTITIONS {name} PARTITION (`{column}`='{value}')").collect()
        return [part.split("=", 1)[1] for row in found for part in row[0].split("/") if part.startswith(f"{DAY}=")]

    def _drop_partitions(self, name: str, specs: Iterable[Mapping[str, Any]]) -> None:
        for spec in specs:
            values = ", ".join("`{}`='{}'".format(c, str(v).replace("'", "''")) for c, v in spec.items())
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({values})")

    def record(self, rows: Sequence[Mapping[str, Any]], name: str, schema: str, key: str) -> None:
        """Keep audit rows, given by column name, under a key of what they tell of.

        The table is partitioned by the key: rows of one key replace each other,
        so a retried batch adds nothing, and writers of different keys don't meet.
        """
        if rows:
            kept = typed_rows(self.spark, rows, schema).withColumn("created_at", F.current_timestamp())
            self.append(kept.withColumn(AUDIT_KEY, F.lit(key)), name, batch_column=AUDIT_KEY)

    def drop_batch(self, name: str, column: str, batch: int | str) -> None:
        """Remove the partitions of a batch, where the table has any."""
        partitions = self.partition_columns(name) if self.exists(name) else []
        if column in partitions:
            days = [{DAY: d} for d in self._batch_days(name, column, batch)] if DAY in partitions else [{}]
            self._drop_partitions(name, [{**day, column: batch} for day in days])

    def _insert_over(self, df: DataFrame, name: str) -> None:
        """Replace the partitions the frame brings.

        The session's overwrite mode is made dynamic and stays so: other threads
        may share the session, and no write of the store relies on another mode."""
        conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        if conf.get(key).lower() != "dynamic":
            conf.set(key, "dynamic")
        df.write.insertInto(name, overwrite=True)

    def overwrite(self, df: DataFrame, name: str, *, partition_by: str | None = None) -> None:
        """Replace all rows; the table, its grants and its name stay. A frame
        that reads a partitioned table cannot overwrite that same table."""
        df = with_day(df, partition_by)
        if not self.exists(name):
            self.create(self._spread(df, [DAY] if DAY in df.columns else []), name, [DAY] if DAY in df.columns else [])
            return
        self._replace_all(df, name)

    def replace(self, df: DataFrame, name: str, *, partition_by: str | None = None) -> None:
        """Create or replace: columns may change too.

        The new table is complete under a name of its own before the old one
        gives up the name; its files are recorded and go later.
        """
        df = with_day(df, partition_by)
        partitions = [DAY] if DAY in df.columns else []
        self._ensure_namespace(name)
        path, fresh = self._version_path(name), f"{name}__{uuid.uuid4().hex}"
        writer = self._spread(df, partitions).write.format("parquet").option("compression", CODEC)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        self.spark.catalog.createTable(fresh, path=path, source="parquet")
        if partitions:
            self.spark.catalog.recoverPartitions(fresh)
        if self.exists(name):
            self._record_retired(fresh, self._retired(name), self.location_of(name))
            self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")

    def _replace_all(self, df: DataFrame, name: str) -> None:
        df = self._evolve(df, name, "add_columns")
        partitions = self.partition_columns(name)
        self._forget_days(name, partitions)
        if partitions:
            writer = self._spread(df, partitions).write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "static")
            writer.partitionBy(*partitions).parquet(self.location_of(name))
            self.spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        else:
            path, left = self._version_path(name), self.location_of(name)
            df.write.option("compression", CODEC).parquet(path)
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            self._record_retired(name, self._retired(name), left)
        self.spark.catalog.refreshTable(name)

    def location_of(self, name: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"] if rows else ""

    def _retired(self, name: str) -> list[tuple[str, float]]:
        """Directories that the table has left, and when."""
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return [(path, float(at)) for path, at in json.loads(found.get(RETIRED, "[]"))]

    def _record_retired(self, name: str, before: list[tuple[str, float]], left: str) -> None:
        """Note the directory left just now; delete those left long ago.

        Only directories of this table's own versions are deleted.
        """
        now = time.time()
        every = [*before, (left, now)] if f"/{VERSIONS}/" in left else before
        old = [path for path, at in every if now - at >= 3600 * self.keep_hours]
        kept = json.dumps([x for x in every if x[0] not in old]).replace("'", "\\'")
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{RETIRED}'='{kept}')")
        for place in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(
        self,
        df: DataFrame,
        name: str,
        *,
        write_mode: str = "append",
        partition_by: str | None = None,
        primary_key: Sequence[str] = (),
        on_schema_change: str = "add_columns",
    ) -> None:
        """Dispatch on the declared mode; the first write creates the table."""
        mode = (write_mode or "append").lower()
        if mode not in WRITE_MODES:
            raise ValueError(f"unknown write mode: {write_mode}")
        if mode == "overwrite":
            self.overwrite(df, name, partition_by=partition_by)
        elif mode == "merge" and primary_key and self.exists(name):
            self.merge_rows(
                df, name, primary_key, partition_by=partition_by, null_safe=False, on_schema_change=on_schema_change
            )
        else:
            self.append(df, name, partition_by=partition_by, on_schema_change=on_schema_change)

    # -- merging -------------------------------------------------------------
    def day_index(self, name: str) -> DayIndex:
        return DayIndex(self.spark, name, f"{self._version_path(name).rsplit('/', 2)[0]}/day-index", DAY)

    def _forget_days(self, name: str, partitions: Sequence[str], columns: Sequence[str] | None = None) -> None:
        """Rows change other than by a merge: what is known of their days goes."""
        if DAY in partitions:
            self.day_index(name).forget(columns)

    def _touched_days(self, name: str, changed: DataFrame, keys: Sequence[str], own: DataFrame | None) -> list:
        """Days of the stored rows with a changed key, and of the ``own`` rows,
        those to be written.

        The days come from the table's index, which then learns the own rows.
        Only partition values reach the driver: one per day, whatever the rows.
        """
        index = self.day_index(name)
        days = index.days_of(changed, keys)
        if own is not None:
            days = days.union(own.select(DAY).distinct())
        found = [row[0] for row in days.distinct().collect()]
        if own is not None:
            index.add(own)
        return found

    def _of_days(self, df: DataFrame, days: Sequence) -> DataFrame:
        dated = [d for d in days if d is not None]
        condition = F.col(DAY).isin(dated)
        return df.filter(condition | F.col(DAY).isNull() if None in days else condition)

    def _rewrite(self, name: str, result: DataFrame, days: Sequence | None) -> None:
        """Store a merge result: only the given days, or the whole table."""
        if days is None:
            self._replace_all(result, name)
            return
        if not days:
            return
        # Files are replaced when the job commits, so it may read this table. A
        # day that lost all its rows is not among those written: drop it. The
        # days left are found before, reading only keys and days.
        result = align_to(result, self.read(name).schema)
        left = {row[0] for row in result.select(DAY).distinct().collect()}
        self._insert_over(self._spread(result, [DAY]), name)
        self._drop_partitions(name, [{DAY: NO_DAY if day is None else day} for day in set(days) - left])
        self.spark.catalog.refreshTable(name)

    def _merge_scope(self, name: str, changes: DataFrame, keys: Sequence[str], own: DataFrame | None):
        if DAY not in self.partition_columns(name):
            return self.read(name), None
        days = self._touched_days(name, changes, keys, own)
        return self._of_days(self.read(name), days), days

    def merge_rows(
        self,
        changes: DataFrame,
        name: str,
        keys: Sequence[str],
        *,
        partition_by: str | None = None,
        sequence: Sequence[str] = (),
        guard: str | None = None,
        delete_mode: str = "soft_delete",
        null_safe: bool = True,
        on_schema_change: str = "add_columns",
        stored: bool = False,
    ) -> None:
        """Upsert with deletes. One image per changed key is written to the
        scratch folder: it is read several times, and its file size tells
        Catalyst whether it may be broadcast. ``stored`` tells that the changes
        come straight from files, so that reading their keys first is cheap."""
        changes = with_day(changes, partition_by)
        if not self.exists(name):
            rows = initial_rows(changes, keys, sequence=sequence, delete_mode=delete_mode, stored=stored)
            self.create(self._spread(rows, [DAY] if DAY in rows.columns else []), name, [DAY] if DAY in rows.columns else [])
            return
        changes = self._evolve(changes, name, on_schema_change)
        keyless = None
        if not null_safe:
            changes = materialize(changes, "changes")
            has_key = reduce(and_, [F.col(k).isNotNull() for k in keys])
            keyless, changes = changes.filter(~has_key), changes.filter(has_key)
        images = materialize(change_images(changes, keys, sequence=sequence, guard=guard, stored=stored), "images")
        if keyless is not None:
            # Rows without a key are told apart by all columns, so that a
            # repeated batch adds none of them again.
            stored = self.read(name).filter(~has_key)
            keyless = materialize(keyless.exceptAll(stored.select(*keyless.columns)), "keyless")
            if not keyless.isEmpty():
                partitions = self.partition_columns(name)
                if DAY in partitions:
                    self.day_index(name).add(keyless)
                self._spread(align_to(keyless, self.read(name).schema), partitions).write.insertInto(name)
        slots = [f"_s_{i}" for i in range(len(keys))]
        days = None
        if DAY in self.partition_columns(name):
            changed = images.select(*[F.col(s).alias(k) for s, k in zip(slots, keys)])
            days = self._touched_days(name, changed, keys, images.filter(F.col("_row").isNotNull()).select("_row.*"))
        target = self.read(name) if days is None else self._of_days(self.read(name), days)
        self._rewrite(name, apply_images(target, images, keys, guard=guard, delete_mode=delete_mode), days)

    def merge_history(
        self,
        events: DataFrame,
        name: str,
        columns: HistoryColumns,
        *,
        partition_by: str | None = None,
        on_schema_change: str = "add_columns",
    ) -> None:
        """Type-2 merge: the chains of the changed keys are rebuilt."""
        events = materialize(with_day(events, partition_by), "changes")
        if not self.exists(name):
            rows = build_history(events, columns)
            self.create(self._spread(rows, [DAY] if DAY in rows.columns else []), name, [DAY] if DAY in rows.columns else [])
            return
        events = self._evolve(events, name, on_schema_change)
        target, days = self._merge_scope(name, events, columns.keys, events)
        rebuilt, untouched = merge_history(target, events, columns)
        self._rewrite(name, rebuilt.unionByName(untouched), days)

    def update_rows(self, updates: DataFrame, name: str, keys: Sequence[str], columns: Sequence[str]) -> int:
        """Set some columns of the matched rows; returns how many were given."""
        updates = materialize(updates, "updates")
        count = updates.count()
        if count == 0:
            return 0
        known = self.read(name).schema
        added = [f for f in new_columns(updates, known) if f.name in columns]
        if added:
            spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({spec})")
        self._forget_days(name, self.partition_columns(name), columns)
        target, days = self._merge_scope(name, updates, keys, None)
        self._rewrite(name, update_columns(target, updates, keys, columns), days)
        return count
