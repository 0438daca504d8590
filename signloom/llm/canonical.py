"""Freely typed values are mapped to the closest entry of a reference list.

SQL only. Values that equal an entry once white space, marks, case and variant suffixes are set
aside come from an equality join. For the others, a pigeonhole join: a reference text within ``k``
edits of a value holds, among its ``k + 1`` segments, one that stands unchanged in the value, at most
``k`` places off. The segments join by equality on length, place and substring; the built-in
``levenshtein`` verifies; an anti-join reports what matched nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signloom.plans.durable import cut

VARIANT = r"^(.+?)_[A-Za-z]{1,2}\d?$"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def token_key(token: Column) -> Column:
    """What of a token counts: no final ``++``, no variant suffix, no white space, marks, hyphens or case."""
    bare = F.regexp_replace(token, r"(?U)[\s\p{Cf}]+|[\p{P}&&[^_]]+", "")
    bare = F.regexp_replace(bare, r"\++$", "")
    bare = F.regexp_replace(bare, VARIANT, "$1")
    return F.lower(F.regexp_replace(bare, NOT_WORD, ""))


def names_of(master: DataFrame, entry: str, surface: str, aliases: str) -> DataFrame:
    """Rows ``name_key, entry``: every way to write an entry; where two entries share one, the smaller entry has it."""
    names = master.select(F.col(entry).alias("entry"), F.explode(F.concat(F.array(surface), F.coalesce(aliases, F.array().cast("array<string>")))).alias("name"))
    return names.select("entry", token_key(F.col("name")).alias("name_key")).filter("name_key <> ''").groupBy("name_key").agg(F.min("entry").alias("entry"))


def _allowed(a: Column, b: Column) -> Column:
    """Edits that are at most a third of the longer text."""
    return F.floor(F.greatest(a, b) / 3).cast("int")


def nearest(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Rows ``key, entry, distance`` for the distinct ``key`` column of ``keys`` that come near a name; ties go to the smallest entry.

    Each (name, length of value) pair has its own ``k``, so its segments are cut for that ``k``. A
    value of ``n`` characters only meets names of ``ceil(2n/3)`` to ``floor(3n/2)``.
    """
    sized = names.withColumn("m", F.length("name_key"))
    lengths = sized.select("*", F.explode(F.sequence(F.ceil(F.col("m") * 2 / 3).cast("int"), F.floor(F.col("m") * 3 / 2).cast("int"))).alias("n"))
    cut = lengths.withColumn("k", _allowed(F.col("m"), F.col("n"))).filter("abs(m - n) <= k and k >= 1")
    # segment i of k + 1 starts at floor(i * m / (k + 1))
    piece = cut.select("name_key", "entry", "m", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    piece = piece.withColumn("start", F.expr("cast(floor(i * m / (k + 1)) as int)")).withColumn("len", F.expr("cast(floor((i + 1) * m / (k + 1)) as int) - start"))
    # before segment i at most i edits count, after it at most k - i: the shift lies within both
    piece = piece.select(
        "name_key", "entry", "n", "len", F.expr("substring(name_key, start + 1, len)").alias("seg"),
        F.explode(F.expr("sequence(greatest(start - i, start + (n - m) - (k - i), 0), least(start + i, start + (n - m) + (k - i), n - len))")).alias("at"),
    ).filter("at >= 0 and at <= n - len")
    # which (length of value, length of segment, place) to look at follows from the reference list alone
    places = piece.select("n", "len", "at").distinct()
    probe = keys.select("key", F.length("key").alias("n")).join(F.broadcast(places) if _bounded(places) else places, "n").withColumn("seg", F.expr("substring(key, at + 1, len)"))
    near = probe.join(piece, ["n", "len", "at", "seg"]).select("key", "name_key", "entry", "n").distinct()
    limit = _allowed(F.col("n"), F.length("name_key"))
    scored = near.withColumn("distance", F.levenshtein("key", "name_key")).filter(F.col("distance") <= limit)
    best = scored.groupBy("key").agg(F.min(F.struct("distance", "entry")).alias("b"))
    return best.select("key", F.col("b.entry").alias("entry"), F.col("b.distance").alias("distance"))


def map_values(values: DataFrame, value: str, master: DataFrame, entry: str, surface: str, aliases: str, unmatched: int = -1) -> DataFrame:
    """Rows ``value, entry`` for the distinct values that equal no surface exactly; ``unmatched`` where no entry comes near.

    Null values are left out; a value without any letter or digit is unmatched. An empty list leaves
    every value unmatched. Repeated values come out once.
    """
    odd = values.select(F.col(value).alias("value")).filter("value is not null").distinct()
    odd = odd.join(master.select(F.col(surface).alias("value")).distinct(), "value", "left_anti").withColumn("key", token_key(F.col("value")))
    names = names_of(master, entry, surface, aliases)
    keys = odd.select("key").distinct()
    equal = keys.join(names.withColumnRenamed("name_key", "key"), "key").select("key", "entry")
    rest = keys.join(names.withColumnRenamed("name_key", "key"), "key", "left_anti").filter("key <> ''")
    close = nearest(rest, names).select("key", "entry")
    found = equal.unionByName(close)
    matched = odd.join(found, "key").select("value", "entry")
    missing = odd.join(found, "key", "left_anti").select("value", F.lit(unmatched).cast("long").alias("entry"))
    return matched.unionByName(missing)


def map_tokens(df: DataFrame, key: str, tokens: str, master: DataFrame) -> DataFrame:
    """Rows ``id, pos, gloss_id`` for the tokens that equal no surface exactly.

    Null and blank tokens and those with ``＿`` are left out, as are null arrays. Rows that repeat an
    id come out as often as they differ.
    """
    spread = df.select(F.col(key).alias("id"), F.posexplode(tokens).alias("pos", "token"))
    typed = spread.filter(F.col("token").isNotNull() & F.col("token").rlike(r"(?U)\S") & ~F.col("token").contains("＿"))
    surfaces = master.select(F.col("surface").alias("token")).distinct()
    odd = cut(typed.join(F.broadcast(surfaces) if _bounded(master) else surfaces, "token", "left_anti"))
    mapped = map_values(odd, "token", master, "gloss_id", "surface", "aliases")
    return odd.join(mapped.select(F.col("value").alias("token"), F.col("entry").alias("gloss_id")), "token").select("id", F.col("pos").cast("int").alias("pos"), "gloss_id").distinct()


def _bounded(table: DataFrame, most: int = 500_000) -> bool:
    """Whether a table that follows from the reference list is short enough to broadcast; counted, not assumed."""
    return table.limit(most + 1).count() <= most
