"""Sources: JSON lines strict and tolerant, JSON objects, optional files, landed sheets, and paged services."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict: a malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_unbroken(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict, and a blank line fails the read as well."""
    lines = spark.read.text(path)
    checked = lines.select(F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line"))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_log(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Tolerant, for resume logs: malformed lines and lines without the key are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(key).isNotNull())


def json_object_keys(spark: SparkSession, path: str, field: str, value: str = "array<string>") -> DataFrame:
    """Rows ``key, value`` of one map in a file that is one JSON object."""
    whole = spark.read.option("multiLine", True).schema(f"`{field}` map<string,{value}>").json(path)
    return whole.select(F.explode(field))


def optional(spark: SparkSession, path: str, schema: T.StructType | str, read: Callable[[SparkSession, str, T.StructType | str], DataFrame] = json_lines) -> DataFrame:
    """The file's rows, or none of the declared schema where there is no file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return read(spark, path, schema) if there else spark.createDataFrame([], schema)


def without_locks(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The CSV sheets of a folder, but for the lock files that editors leave."""
    return spark.read.schema(schema).option("header", True).option("pathGlobFilter", "[!~]*").csv(folder)


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short table written in the code."""
    return spark.createDataFrame(rows, schema)


def landed_sheet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A sheet landed as CSV with a header and ``_ord``; no rows where a required column is missing."""
    sheet = spark.read.option("header", True).option("multiLine", True).csv(path)
    return sheet if {*required, "_ord"} <= {*sheet.columns} else sheet.limit(0)


def sheet_from_row(spark: SparkSession, path: str, columns: list[str], first: int) -> DataFrame:
    """A sheet landed as CSV without names, ``_ord`` first: its rows from number ``first`` on (``_ord`` from 1), its columns named by place.

    Rows of fewer columns have nulls, those of more lose them; blank cells are null.
    """
    schema = T.StructType([T.StructField("_ord", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])
    return spark.read.schema(schema).option("multiLine", True).option("emptyValue", "").option("nullValue", "").csv(path).filter(F.col("_ord") >= first)


def sheet_with_header_row(spark: SparkSession, path: str, header: int, width: int) -> DataFrame:
    """A sheet whose names stand in row ``header``: the rows after it, under these names. ``width`` is the number of columns landed, ``_ord`` left out."""
    rows = sheet_from_row(spark, path, [f"c{n}" for n in range(width)], header)
    names = rows.filter(F.col("_ord") == header).first()
    named = {f"c{n}": names[f"c{n}"] for n in range(width) if names is not None and names[f"c{n}"]}
    return rows.filter(F.col("_ord") > header).select("_ord", *[F.col(c).alias(name) for c, name in named.items()])


def file_pages(start: str, page: int, size: int) -> tuple[list, int]:
    """A service's page from a landed file of JSON lines, for replay and where there is no network."""
    with open(start, encoding="utf-8") as f:
        rows = [json.loads(line) for line in f if line.strip()]
    return rows[(page - 1) * size : page * size], len(rows)


class _Page(InputPartition):
    def __init__(self, start: str) -> None:
        self.start = start


class PagedReader(DataSourceReader):
    """Reads pages until one is empty or the total is reached, with retries and a limit on the rate.

    A start that fails to the last raises, or is skipped with ``onfailure=skip``.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher = options.get("fetcher", f"{__name__}:file_pages")
        self.starts = json.loads(options.get("starts", '[""]'))
        self.size = int(options.get("pagesize", "200"))
        self.tries = int(options.get("tries", "4"))
        self.wait = float(options.get("backoff", "2"))
        self.pause = float(options.get("pause", "0.12"))
        self.skip = options.get("onfailure", "raise") == "skip"

    def partitions(self) -> list[InputPartition]:
        return [_Page(s) for s in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.rpartition(":")
        fetch = getattr(__import__(module, fromlist=[name]), name)
        page = 1
        while True:
            for k in range(self.tries):
                try:
                    rows, total = fetch(partition.start, page, self.size)
                    break
                except OSError:
                    if k == self.tries - 1:
                        if self.skip:
                            return
                        raise
                    time.sleep(self.wait * (k + 1))
            for row in rows:
                yield partition.start, page, json.dumps(row, ensure_ascii=False)
            if not rows or page * self.size >= total:
                return
            page += 1
            time.sleep(self.pause)


class PagedService(DataSource):
    """``format("paged")``: rows ``start, page, record`` of a paged service, by a function ``module:name`` of (start, page, size)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "start string, page int, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedService)
