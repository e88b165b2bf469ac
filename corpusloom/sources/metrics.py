"""Counters taken while rows are written, appended to a table that takes no texts; JSON reports.

The counters are observed by the write itself, without a second pass over the rows. A metrics table holds numbers, truth
values, times and a few labels; any other column is refused before anything runs, so that no content can reach it.

Defined cases: an empty table is written with counters of zero rows (sums null); columns of df may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: String columns that a metrics table may have, each of at most LABEL_CHARS characters.
LABELS = ("mode", "strategy", "error_code", "model", "model_profile", "client_id", "version", "phase", "stage", "status")
LABEL_CHARS = 64


def _allowed(name: str, kind: DataType) -> bool:
    if isinstance(kind, StringType):
        return name in LABELS
    return isinstance(kind, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType))


def metadata_only(df: DataFrame) -> DataFrame:
    """df, if its columns are metadata, with labels that are too long failing the job that reads it; raises for others."""
    refused = [f.name for f in df.schema if not _allowed(f.name, f.dataType)]
    if refused:
        raise ValueError(f"no columns of a metrics table: {', '.join(refused)}")
    long = lambda c: F.when(F.length(c) > LABEL_CHARS, F.raise_error(F.lit(f"{c}: label too long"))).otherwise(F.col(c))
    return df.select(*(long(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema))


def append_metrics(df: DataFrame, path: str) -> None:
    metadata_only(df).write.mode("append").parquet(path)


def write_counted(df: DataFrame, path: str, counters: dict[str, Column], metrics_path: str, stage: str) -> dict:
    """Write df as Parquet and append (stage, at, the counters) to the metrics table; counters are aggregates over df."""
    spark = df.sparkSession
    # What may be kept is settled on an empty copy, before the rows are written.
    empty = df.limit(0).agg(*(c.alias(n) for n, c in counters.items()))
    metadata_only(empty)
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in counters.items())).write.parquet(path)
    found = seen.get
    row = spark.createDataFrame([tuple(found.get(n) for n in empty.columns)], empty.schema)
    append_metrics(row.select(F.lit(stage).alias("stage"), F.current_timestamp().alias("at"), "*"), metrics_path)
    return found


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are written, so that every row has every key."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
