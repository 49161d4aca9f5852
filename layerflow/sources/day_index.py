"""Which days of a table hold a key: a side table that merges look up.

A merge into a table with days rewrites the days of the stored rows whose keys
changed. To find these days without scanning the keys of the whole table, a
Parquet folder beside it holds (hash of the key, day), partitioned by a bucket
of the hash. A lookup opens the buckets of the changed keys only.

Entries are added before the rows they stand for are written, and none is taken
away when a row leaves a day: an entry too many costs a look at that day, and one
too few is not possible as long as the table is written through its store. After
``FOLD_AFTER`` additions the entries are written anew, each once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROPERTY = "layerflow.day_index"
FOLD_AFTER = 16
BUCKET_ROWS, MOST_BUCKETS, LEAST_BUCKETS = 1_000_000, 4096, 8
SCHEMA = "_hash long, _day date, _run int, _bucket int"


class DayIndex:
    """The indexes of one table, one per set of key columns it was merged by."""

    def __init__(self, spark: SparkSession, name: str, folder: str, day: str):
        self.spark, self.name, self.folder, self.day = spark, name, folder, day
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        self.known: dict[str, dict] = json.loads(found.get(PROPERTY, "{}"))

    def _record(self) -> None:
        text = json.dumps(self.known).replace("'", "\\'")
        self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('{PROPERTY}'='{text}')")

    def _hash(self, df: DataFrame, keys: Sequence[str]) -> Column:
        """Equal for keys that are equal null-safely, whatever type the frame has."""
        types = self.spark.table(self.name).schema
        return F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in keys])

    def _entries(self, df: DataFrame, keys: Sequence[str], buckets: int, run: int) -> DataFrame:
        entry = df.select(self._hash(df, keys).alias("_hash"), F.col(self.day).alias("_day")).distinct()
        return entry.withColumns({"_run": F.lit(run), "_bucket": F.pmod("_hash", F.lit(buckets)).cast("int")})

    def _write(self, entries: DataFrame, path: str) -> None:
        entries.hint("rebalance", "_bucket").write.mode("append").partitionBy("_run", "_bucket").parquet(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(path)

    def _built(self, keys: Sequence[str]) -> dict:
        """The index of these keys; made by one scan of the keys where there is none."""
        label = ",".join(keys)
        if label not in self.known:
            table = self.spark.table(self.name)
            buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, table.count() // BUCKET_ROWS))
            path = f"{self.folder}/{uuid.uuid4().hex}"
            self._write(self._entries(table, keys, buckets, 0), path)
            self.known[label] = {"keys": list(keys), "path": path, "buckets": buckets, "runs": 1}
            self._record()
        return self.known[label]

    def lookup(self, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Entries of the keys of a frame, which has the key columns."""
        index = self._built(keys)
        hashes = changed.select(self._hash(changed, keys).alias("_hash")).distinct()
        bucket = F.pmod("_hash", F.lit(index["buckets"])).cast("int")
        wanted = [r[0] for r in hashes.select(bucket.alias("b")).distinct().collect()]  # at most MOST_BUCKETS numbers
        entries = self._read(index["path"]).filter(F.col("_bucket").isin(wanted))
        return entries.join(hashes, "_hash", "left_semi")

    def days_of(self, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self.lookup(changed, keys).select(F.col("_day").alias(self.day)).distinct()

    def add(self, rows: DataFrame) -> None:
        """Enter rows that are about to be written: all key columns and the day."""
        for label, index in list(self.known.items()):
            entries = self._entries(rows, index["keys"], index["buckets"], index["runs"])
            held = self.lookup(rows, index["keys"]).select("_hash", F.col("_day").alias("_held"))
            same = (entries["_hash"] == held["_hash"]) & entries["_day"].eqNullSafe(held["_held"])
            self._write(entries.join(held, same, "left_anti"), index["path"])
            index["runs"] += 1
            if index["runs"] > FOLD_AFTER:
                fresh = f"{self.folder}/{uuid.uuid4().hex}"
                once = self._read(index["path"]).select("_hash", "_day", "_bucket").distinct()
                self._write(once.withColumn("_run", F.lit(0)), fresh)
                self.known[label] = {**index, "path": fresh, "runs": 1}
        if self.known:
            self._record()

    def forget(self, columns: Iterable[str] | None = None) -> None:
        """Drop the indexes that hold one of the columns, or all: the next merge makes them anew."""
        left = {} if columns is None else {k: v for k, v in self.known.items() if not set(v["keys"]) & set(columns)}
        if left != self.known:
            self.known = left
            self._record()
