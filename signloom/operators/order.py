"""Operators on explicit row order: blocks, sequential ids, keep-first, greedy holdout, samples.

Running values over a whole table never go through one task. Rows get a bucket of their order; totals
per bucket, a small table, are summed along the buckets; each bucket then continues from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_ORDERS = 1 << 16


def _start(totals: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__start", F.coalesce(F.sum(value).over(before), F.lit(0)))


def running_sum(df: DataFrame, value: Column, order: str, out: str, by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` along the unique ``order``, per ``by``; the row itself included.

    ``bucket`` must grow with ``order``; by default rows of ``BUCKET_ORDERS`` whole numbers share one.
    Null values count nothing.
    """
    by = by or []
    rows = df.withColumn("__bucket", F.floor(F.col(order) / BUCKET_ORDERS) if bucket is None else bucket).withColumn("__value", F.coalesce(value.cast("long"), F.lit(0)))
    keys = [*by, "__bucket"]
    starts = _start(rows.groupBy(*keys).agg(F.sum("__value").alias("__total")), by, "__bucket", "__total").drop("__total")
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn(out, F.sum("__value").over(inside)).alias("r").join(
        starts.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    )
    return joined.select("r.*", "s.__start").withColumn(out, F.col(out) + F.col("__start")).drop("__bucket", "__value", "__start")


def blocks(df: DataFrame, opens: Column, order: str, out: str = "block") -> DataFrame:
    """Rows with the number of their block, which starts where ``opens`` holds; rows before the first block are dropped."""
    return running_sum(df, F.coalesce(opens, F.lit(False)).cast("int"), order, out).filter(F.col(out) > 0)


def sequential_ids(df: DataFrame, order: str, out: str, prefix: str, width: int, first: int = 1) -> DataFrame:
    """Rows numbered along ``order``, as ``prefix`` and padded number."""
    numbered = running_sum(df, F.lit(1), order, "__n")
    return numbered.withColumn(out, F.format_string(f"{prefix}%0{width}d", F.col("__n") + (first - 1))).drop("__n")


def keep_first(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row along ``order`` of each key; null keys are keys. Aggregates before it shuffles.

    A key that holds most rows costs no more than others: each task sends one row for it.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(row, F.col(order)).alias("__row")).select("__row.*")


def hashed_order(seed: int, *columns: str) -> Column:
    """An order by hash, the same wherever the rows are."""
    return F.md5(F.concat_ws("", F.lit(f"{seed}:"), *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def greedy_holdout(df: DataFrame, group: str, ratio: float, seed: int, stratum: str | None = None, least_rows: int = 0) -> DataFrame:
    """Rows ``stratum, group, size`` of the groups held out: whole groups, in hashed order, until the target is reached.

    The group that crosses the target is taken. The target is ``ratio`` of the stratum's rows, rounded
    half to even, and 0 for strata of fewer than ``least_rows`` rows, from which nothing is taken. A
    null group is a group; groups are counted with all their rows.
    """
    own = df.withColumn("stratum", F.col(stratum) if stratum else F.lit("")).withColumn("group", F.col(group))
    sizes = own.groupBy("stratum", "group").agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.groupBy("stratum").agg(F.sum("size").alias("n"))
    targets = totals.select("stratum", F.when(F.col("n") >= least_rows, F.bround(F.col("n") * F.lit(float(ratio)))).otherwise(0).cast("long").alias("target"))
    order = sizes.withColumn("__order", F.concat(hashed_order(seed, "stratum", "group"), F.lit("/"), F.coalesce("group", F.lit(""))))
    reached = running_sum(order, F.col("size"), "__order", "reached", by=["stratum"], bucket=F.substring("__order", 1, 3))
    taken = reached.alias("r").join(targets.alias("t"), F.col("r.stratum").eqNullSafe(F.col("t.stratum"))).filter(F.col("reached") - F.col("size") < F.col("target"))
    return taken.select("r.stratum", "r.group", "r.size")


def hashed_sample(df: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """``n`` rows by hashed order."""
    return df.orderBy(hashed_order(seed, *columns), *columns).limit(n)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)
