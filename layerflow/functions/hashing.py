"""Canonical JSON, content hashes and deterministic keys as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}

# Stands for NULL inside a hashed text, so (a, NULL, b) and (a, b, NULL) differ.
NULL_MARK = "\u0000"


def _plain(name: str, dtype: T.DataType) -> Column:
    """Decimals keep their digits as text; other types are printed by Spark."""
    col = F.col(name)
    return (col.cast("string") if isinstance(dtype, T.DecimalType) else col).alias(name)


def row_struct(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """The row as a struct with fields in name order."""
    names = sorted(columns if columns is not None else df.columns)
    return F.struct(*[_plain(n, df.schema[n].dataType) for n in names])


def canonical_json(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Compact JSON, names sorted, NULL fields kept."""
    return F.to_json(row_struct(df, columns), JSON_OPTIONS)


def json_of(fields: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), JSON_OPTIONS)


def content_hash(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def event_id(batch_run_id: Column, topic: Column, key: Column, row_hash: Column) -> Column:
    """Equal run, topic, key and content always give the equal id."""
    return F.sha2(
        json_of({"batch_run_id": batch_run_id, "topic": topic, "key": key, "row_hash": row_hash}), 256
    )


def joined_hash(columns: Iterable[str], null_safe: bool = True) -> Column:
    """sha256 of the column texts joined by ``||``.

    ``null_safe=False`` skips NULLs, the way plain ``concat_ws`` does.
    """
    texts = [F.col(c).cast("string") for c in columns]
    if null_safe:
        texts = [F.coalesce(t, F.lit(NULL_MARK)) for t in texts]
    return F.sha2(F.concat_ws("||", *texts), 256)


def surrogate_key(columns: Iterable[str]) -> Column:
    """Repeatable non-negative 64-bit key of the column texts; a NULL part counts
    as a text of its own, so that its place is told."""
    hashed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns])
    # The lowest long has no positive counterpart.
    return F.when(hashed == F.lit(-(2**63)), F.lit(0)).otherwise(F.abs(hashed)).cast("long")
