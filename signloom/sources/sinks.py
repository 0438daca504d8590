"""Sinks: JSON lines, append logs, one-object files, summaries by key, and review sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """Overwrite; nulls are written, non-ASCII text stays as it is."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str, every: int = 0) -> None:
    """Append to a log; with ``every``, each file holds as many rows at most, and a task that is lost repeats only its own."""
    df.write.mode("append").option("maxRecordsPerFile", every).parquet(path)


def object_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``json``: an object of all keys and values, sorted by key; for small tables such as manifests."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.agg(F.to_json(F.map_from_entries(entries), {"pretty": "true"}).alias("json"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def review_sheet(df: DataFrame, columns: list[str], blanks: list[str]) -> DataFrame:
    """The columns of a review sheet, with blank ones for people to fill."""
    return df.select(*columns, *[F.lit("").alias(b) for b in blanks])
