"""Lineage cuts and table loading shared by the operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, tuple[SparkSession, str]] = {}
_private: dict[str, str] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder inside ``spark.checkpoint.dir``.

    Where that is unset, a private folder serves a local master, whose executors are this very process;
    any other master raises, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _private:
            _private[name] = tempfile.mkdtemp(prefix="signloom-")
            atexit.register(shutil.rmtree, _private[name], ignore_errors=True)
        base = "file://" + _private[name]
    path = f"{base.rstrip('/')}/signloom-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders[path] = (spark, path)
        atexit.register(_clear, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _clear(path: str) -> None:
    spark, _ = _folders.pop(path)
    try:
        _delete(spark, path)
    except Exception:  # the session is gone; the folder belongs to its cluster
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps survive lost executors and read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.signloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table of a ``cut`` that nothing reads any more, itself or what was made from it and not cut."""
    _delete(df.sparkSession, df.signloom_path)


def sweep(spark: SparkSession) -> None:
    """Remove the shuffle files that nothing can read any more, now rather than when the driver next happens to collect garbage."""
    for _ in range(2):  # the last query's events refer to it until they are handled
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, which need not have it installed; once per application."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    _shipped.add(name)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="signloom-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{package.name}-{name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the test data's layout."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
