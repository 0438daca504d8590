"""Occurrences and records of every distinct term, by heavy-light aggregation.

Terms that a bounded sketch finds heavy are broadcast and counted exactly into one array per task;
only the remaining terms are shuffled, already summed by batch. Both tables are then united. Which
terms count as heavy changes the route of the counts, never the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_TERMS = 256
TRACKED_TERMS = 4096
#: White space, in a way that both dialects of regular expressions read.
BLANK = r"^[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"


def _is_term(t: Column) -> Column:
    return t.isNotNull() & ~t.rlike(BLANK)


def heavy_terms(df: DataFrame, terms: str, most: int = HEAVY_TERMS, tracked: int = TRACKED_TERMS) -> list[str]:
    """At most ``most`` candidates for the frequent terms, from a sketch of ``tracked`` items a task."""
    found = df.select(F.explode(terms).alias("t")).filter(_is_term(F.col("t"))).agg(F.expr(f"approx_top_k(t, {most}, {tracked})").alias("top")).first()
    return [r["item"] for r in found["top"]] if found and found["top"] else []


def count_terms(df: DataFrame, terms: str, heavy: list[str] | None = None) -> DataFrame:
    """Rows ``term, occurrences, records`` of each distinct term of the array column ``terms``.

    Null arrays, null terms and blank terms (only white space) count nothing; an empty table gives no
    rows. A term twice in a record is two occurrences in one record. Repeated rows are records of
    their own. Other columns are not read.
    """
    heavy = sorted(set(heavy_terms(df, terms) if heavy is None else heavy))
    known = pa.array(heavy, pa.string())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences = np.zeros(len(heavy), np.int64)
        records = np.zeros(len(heavy), np.int64)
        for batch in batches:
            lists = batch.column(0)
            row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
            real = pc.and_(pc.is_valid(term), pc.invert(pc.fill_null(pc.match_substring_regex(term, BLANK), True)))
            row, term = row.filter(real), term.filter(real)
            at = pc.index_in(term, value_set=known)
            is_heavy = pc.is_valid(at)
            n, r = at.filter(is_heavy).to_numpy(zero_copy_only=False).astype(np.int64), row.filter(is_heavy).to_numpy(zero_copy_only=False).astype(np.int64)
            occurrences += np.bincount(n, minlength=len(heavy))[: len(heavy)]
            records += np.bincount(np.unique(r * max(1, len(heavy)) + n) % max(1, len(heavy)), minlength=len(heavy))[: len(heavy)]
            light = pa.table({"row": row.filter(pc.invert(is_heavy)), "term": term.filter(pc.invert(is_heavy))})
            if light.num_rows:
                once = light.group_by(["row", "term"]).aggregate([([], "count_all")]).group_by("term").aggregate([("count_all", "sum"), ([], "count_all")])
                yield pa.RecordBatch.from_arrays([once["term"].combine_chunks(), once["count_all_sum"].combine_chunks(), once["count_all"].combine_chunks(), pa.nulls(once.num_rows, pa.list_(pa.int64())), pa.nulls(once.num_rows, pa.list_(pa.int64()))], names=["term", "occurrences", "records", "heavy_occurrences", "heavy_records"])
        if occurrences.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([occurrences.tolist()], pa.list_(pa.int64())), pa.array([records.tolist()], pa.list_(pa.int64()))], names=["term", "occurrences", "records", "heavy_occurrences", "heavy_records"])

    schema = "term string, occurrences long, records long, heavy_occurrences array<long>, heavy_records array<long>"
    parts = df.select(terms).mapInArrow(local, schema)
    # one shuffle serves both: an array is opened to (term, count) rows of its own task, at most HEAVY_TERMS of them
    names = F.array(*map(F.lit, heavy)) if heavy else F.array().cast("array<string>")
    one = F.array(F.struct("term", "occurrences", "records"))
    opened = F.when(F.col("term").isNotNull(), one).otherwise(F.arrays_zip(names.alias("term"), F.col("heavy_occurrences").alias("occurrences"), F.col("heavy_records").alias("records")))
    rows = parts.select(F.explode(opened).alias("x")).select("x.term", "x.occurrences", "x.records").filter("occurrences > 0")
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(df: DataFrame, terms: str, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """``count_terms`` with ``mark``: ``rare`` below ``rare_below`` records, ``common`` above that share of all rows, else null."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__rows")))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("__rows"), "common")
    return count_terms(df, terms).crossJoin(total).select("term", "occurrences", "records", mark.alias("mark"))
