"""Joins and set operations in the shapes a corpus pipeline needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KEYWORDS = 1000


def not_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``other``; null keys are in nothing."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def not_in_any(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share none of ``keys`` with ``other``: one anti-join per key, where a disjunction would be a nested loop."""
    for key in keys:
        df = not_in(df, other, [key])
    return df


def resume(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What of ``todo`` the log doesn't hold yet."""
    return not_in(todo, log, [key])


def updated(df: DataFrame, news: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the values of ``news`` where it has a row and a value; ``news`` has one row per key."""
    fresh = news.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(fresh, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in df.columns])


def expanded(df: DataFrame, **lists: str) -> DataFrame:
    """Each row with every combination of its lists, in order; a null or empty list behaves as one null."""
    for out, column in lists.items():
        df = df.select("*", F.posexplode_outer(column).alias(f"{out}_at", out))
    return df


def flagged_membership(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One row per key of any part, with a flag for each: union and one aggregation instead of full outer joins."""
    whole = None
    for tag, part in parts:
        rows = part.select(F.col(key).alias(key), F.lit(tag).alias("__tag"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy(key).agg(*[F.max(F.col("__tag") == tag).alias(f"in_{tag}") for tag, _ in parts])


def shared_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups that stand in both."""
    return a.select(group).intersect(b.select(group))


def unexpected_tokens(df: DataFrame, key: str, tokens: str, names: DataFrame, name: str) -> DataFrame:
    """Rows ``key, pos, token`` of the tokens that are no name, with place, repeated ones included."""
    spread = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    return spread.join(names.select(F.col(name).alias("token")).distinct(), "token", "left_anti").select(key, "pos", "token")


def first_keyword(df: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Rows with the first keyword, by its ``ord``, that their text holds; rows without one are dropped.

    ``keywords`` (``ord, theme, keyword``) is a short list in the code, of ``KEYWORDS`` at most, and becomes one
    expression, so there is no cross join.
    """
    listed = sorted((r["ord"], r["theme"], r["keyword"]) for r in keywords.limit(KEYWORDS + 1).collect())
    if len(listed) > KEYWORDS:
        raise ValueError(f"more than {KEYWORDS} keywords")
    chain = F.coalesce(*[F.when(F.col(text).contains(k), F.struct(F.lit(t).alias("theme"), F.lit(k).alias("keyword"))) for _, t, k in listed])
    return df.withColumn("__hit", chain).filter("__hit is not null").select(*df.columns, F.col("__hit.theme").alias("hit_theme"), F.col("__hit.keyword").alias("keyword"))


def drop_counts(df: DataFrame, other: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rows ``by, rows, dropped, kept`` of ``not_in_any``, before anything is made distinct: a flag per key, one aggregation."""
    flagged = df
    for key in keys:
        flagged = flagged.join(other.select(key).distinct().withColumn(f"__in_{key}", F.lit(True)), key, "left")
    hit = F.greatest(*[F.coalesce(f"__in_{k}", F.lit(False)) for k in keys], F.lit(False))
    return flagged.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("dropped"), F.count_if(~hit).alias("kept"))


def not_containing(df: DataFrame, text: str, key: str, others: DataFrame, other: str, gram: int = 8) -> DataFrame:
    """Rows whose ``text`` holds no text of ``others`` anywhere inside; null and empty texts hold and are held by nothing.

    A text inside another begins with the same characters there: the first ``gram`` of it (all, if it has
    fewer) meet the runs of as many characters by equality of their hashes, and what meets is looked at whole.
    Texts decide, so a ``key`` may repeat or be null. The runs are many times the file whose size Spark takes
    them to have: they travel as two hashes without their text, and merge joins keep them out of the driver.
    """
    sized = others.select(F.col(other).alias("__o")).filter("__o <> ''").withColumn("__n", F.least(F.length("__o"), F.lit(gram)))
    lengths = [r["__n"] for r in sized.select("__n").distinct().collect()]  # at most ``gram`` numbers
    if not lengths:
        return df
    held = sized.select("__o", F.xxhash64(F.expr("substring(__o, 1, __n)")).alias("__g")).distinct()
    texts = df.select(F.col(text).alias("__t")).filter("__t <> ''").distinct()
    runs = F.flatten(F.array(*[F.when(F.length("__t") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__t") - n + 1), _run_of(n)))).otherwise(F.array().cast("array<bigint>")) for n in sorted(lengths)]))
    spread = texts.select(F.xxhash64("__t").alias("__h"), F.explode(runs).alias("__g"))
    met = spread.join(held.select("__g").distinct().hint("merge"), "__g", "left_semi")
    near = met.join(texts.withColumn("__h", F.xxhash64("__t")).hint("merge"), "__h").select("__t", "__g").alias("near")
    same = F.expr("near.__g = held.__g and contains(near.__t, held.__o)")
    hit = near.join(held.alias("held").hint("merge"), same, "left_semi").select("__t").distinct()
    return df.join(hit, F.col(text) == F.col("__t"), "left_anti")


def _run_of(n: int):
    return lambda i: F.xxhash64(F.substring(F.col("__t"), i, F.lit(n)))


def in_groups(df: DataFrame, groups: DataFrame, group: str, how: str) -> DataFrame:
    """``df`` in (``left_semi``) or not in (``left_anti``) the groups; a null group is a group."""
    names = groups.select(F.col(group).alias("__group"))
    return df.join(names, F.col(group).eqNullSafe(F.col("__group")), how)


def first_record(df: DataFrame, records: str, out: str) -> DataFrame:
    """Rows with the first of their ``records`` as ``out``; rows whose list is null or empty are dropped."""
    return df.filter(F.size(records) > 0).withColumn(out, F.get(records, 0)).drop(records)


def nested_rows(df: DataFrame, nested: str, out: str, place: str) -> DataFrame:
    """A row for each element of a nested list (a path, null-safe) with its ``place`` from 0; null and empty lists give none."""
    return df.select("*", F.posexplode(nested).alias(place, out))


def in_order(parts: Sequence[DataFrame], order: str) -> DataFrame:
    """All rows of ``parts`` with ``part``, the number of the part they come from: ``part, order`` is the order of the whole."""
    whole = None
    for n, part in enumerate(parts):
        rows = part.select(F.lit(n).alias("part"), "*")
        whole = rows if whole is None else whole.unionByName(rows)
    return whole
