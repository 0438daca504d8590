"""Vocabularies: frequencies, postings, the master list and its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signloom.functions.text import PLACEHOLDER, VARIANT, base_name, norm_variants, strip


def frequencies(df: DataFrame, glosses: str) -> DataFrame:
    """Rows ``gloss, freq``; null tokens are none."""
    return df.select(F.explode(glosses).alias("gloss")).filter("gloss is not null").groupBy("gloss").agg(F.count(F.lit(1)).alias("freq"))


def postings(df: DataFrame, key: str, glosses: str, order: str) -> DataFrame:
    """The inverted index in long form, rows ``gloss, id, first``: each gloss without placeholder with each of its sources.

    A gloss of a third of all sources is so many rows, not one list.
    """
    spread = df.select(F.explode(glosses).alias("gloss"), F.col(key).alias("id"), F.col(order).alias("first"))
    return spread.filter(F.col("gloss").isNotNull() & ~F.col("gloss").contains(PLACEHOLDER)).groupBy("gloss", "id").agg(F.min("first").alias("first"))


def master(own: DataFrame, entries: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per surface of ``own`` (``gloss``), ``entries`` (``surface, aliases, ids``) and ``corpus`` (``gloss, freq``).

    ``sources`` has own, twtsl else twtsl-alias, and corpus, in this order. ``norm_has_dict_entry`` also
    counts what equals an entry or own gloss once variant characters are one.
    """
    no_ids = F.array().cast("array<bigint>")
    tagged = (
        own.select("gloss").distinct().select(F.col("gloss").alias("surface"), F.lit("own").alias("tag"), F.lit(0).cast("bigint").alias("freq"), no_ids.alias("ids"))
        .unionByName(entries.select("surface", F.lit("twtsl").alias("tag"), F.lit(0).cast("bigint").alias("freq"), F.coalesce("ids", no_ids).alias("ids")))
        .unionByName(entries.select(F.explode("aliases").alias("surface")).distinct().select("surface", F.lit("twtsl-alias").alias("tag"), F.lit(0).cast("bigint").alias("freq"), no_ids.alias("ids")))
        .unionByName(corpus.select(F.col("gloss").alias("surface"), F.lit("corpus").alias("tag"), F.col("freq").cast("bigint").alias("freq"), no_ids.alias("ids")))
    )
    has = {t: F.max(F.col("tag") == t).alias(t.replace("-", "_")) for t in ("own", "twtsl", "twtsl-alias", "corpus")}
    rows = tagged.groupBy("surface").agg(*has.values(), F.sum("freq").alias("corpus_freq"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("twtsl_ids"))
    sources = F.array_compact(F.array(F.when(F.col("own"), "own"), F.when(F.col("twtsl"), "twtsl").when(F.col("twtsl_alias"), "twtsl-alias"), F.when(F.col("corpus"), "corpus")))
    entry = F.col("own") | F.col("twtsl") | F.col("twtsl_alias")
    flagged = rows.select("surface", sources.alias("sources"), "corpus_freq", entry.alias("has_dict_entry"), "twtsl_ids", norm_variants("surface").alias("norm"))
    known = flagged.groupBy("norm").agg(F.max("has_dict_entry").alias("norm_has_dict_entry"))
    return flagged.join(known, "norm").select("surface", "sources", "corpus_freq", "has_dict_entry", "norm_has_dict_entry", "twtsl_ids")


def coverage(listed: DataFrame) -> DataFrame:
    """One row of counts over a master list: types and tokens of the corpus that the dictionary has, as written and normalised."""
    corpus, raw, norm = F.array_contains("sources", "corpus"), F.col("has_dict_entry"), F.col("norm_has_dict_entry")
    count = lambda c, name: F.count_if(c).alias(name)
    one = listed.agg(
        count(F.array_contains("sources", "own"), "own_gloss"), count(F.array_contains("sources", "twtsl"), "twtsl_canonical"),
        count(corpus, "corpus_unique_gloss"), F.coalesce(F.sum("corpus_freq"), F.lit(0)).alias("corpus_token_total"), F.count(F.lit(1)).alias("master_total_surface"),
        count(corpus & raw, "corpus_type_in_dict_raw"), count(corpus & norm, "corpus_type_in_dict_norm"),
        F.coalesce(F.sum(F.when(norm, F.col("corpus_freq"))), F.lit(0)).alias("corpus_token_in_dict_norm"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 1)).otherwise(0.0)
    return one.select(
        "*", share("corpus_type_in_dict_raw", "corpus_unique_gloss").alias("corpus_type_in_dict_raw_pct"), share("corpus_type_in_dict_norm", "corpus_unique_gloss").alias("corpus_type_in_dict_norm_pct"),
        share("corpus_token_in_dict_norm", "corpus_token_total").alias("corpus_token_in_dict_norm_pct"),
    )


def alias_names(entries: DataFrame, key: str, canonical: str, aliases: str) -> DataFrame:
    """Rows ``key, aliases``: normalised alias names other than the canonical one, distinct and sorted; entries without any keep an empty list."""
    names = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: norm_variants(F.regexp_replace(a, VARIANT, "$1")))
    return entries.select(key, F.array_sort(F.array_distinct(F.filter(names, lambda a: a != F.col(canonical)))).alias("aliases"))


def flag_rollup(df: DataFrame, flags: str) -> DataFrame:
    """Rows ``flag, n`` over an array column; rows without flags are counted as ``none``."""
    empty = F.col(flags).isNull() | (F.size(flags) <= 0)
    return df.select(F.explode(F.when(empty, F.array(F.lit("none"))).otherwise(F.col(flags))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def ordered_names(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Rows ``key, names``: the distinct names of each key in the order of their first row; for keys of few names."""
    first = df.groupBy(key, name).agg(F.min(order).alias("__at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", name))), lambda x: x[name]).alias("names"))


def alias_lists(entries: DataFrame, key: str, canonical: str, names: DataFrame, name: str) -> DataFrame:
    """Rows ``key, canonical, aliases``: the names that ``names`` has for an entry's key, without variant suffix, other than the canonical one, distinct and sorted.

    Entries without any keep an empty list (a left outer join, one to many, collected before it joins).
    """
    bare = names.select(key, base_name(strip(F.col(name))).alias("__alias")).filter("__alias is not null")
    lists = bare.groupBy(key).agg(F.array_sort(F.collect_set("__alias")).alias("__all"))
    own = base_name(strip(F.col(canonical)))
    return entries.join(lists, key, "left").select(key, canonical, F.filter(F.coalesce("__all", F.array().cast("array<string>")), lambda a: a != own).alias("aliases"))


def source_counts(listed: DataFrame) -> DataFrame:
    """Rows ``source, n``: the surfaces of a master list that have each source, ``twtsl-alias`` included."""
    return listed.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows ``status, n``; a null status is one."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
