"""From landed rows to clean sentence pairs: blocks of a sheet, segments of a corpus, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signloom.functions.text import clean_token, filled, gloss_text, id_number, numbered, prefixed_url
from signloom.operators.joins import expanded, not_in
from signloom.operators.order import keep_first, running_sum, sequential_ids
from signloom.plans.durable import cut


def consolidate(df: DataFrame, host: str, prefix: str = "TC", width: int = 9) -> DataFrame:
    """Corpus rows cleaned: marks out of glosses, rows without text or gloss dropped, first of each corpus id kept, numbered anew."""
    own = df.select("_ord", "corpus_id", "chinese", F.filter(F.transform("gloss", clean_token), lambda t: t != "").alias("gloss"), prefixed_url("film_url", host).alias("film_url"))
    some = own.filter((F.col("chinese") != "") & (F.size("gloss") > 0))
    first = cut(keep_first(some, ["corpus_id"], "_ord"))  # numbering reads it twice
    return sequential_ids(first, "_ord", "id", prefix, width).select("id", "corpus_id", "chinese", gloss_text("gloss").alias("gloss_text"), "film_url")


def block_tokens(rows: DataFrame, block: str, place: str, order: str, token: str, *first: str) -> DataFrame:
    """Rows ``block, glosses`` and ``first``: the tokens of each block in the order of ``place``, then ``order``; null tokens are none.

    ``first`` are columns of the block's first row along ``order``. A block is a sheet's sentence, of few rows.
    """
    item = F.struct(F.col(place), F.col(order), F.col(token).alias("token"))
    tokens = F.transform(F.array_sort(F.collect_list(F.when(F.col(token).isNotNull(), item))), lambda x: x["token"])
    return rows.groupBy(block).agg(tokens.alias("glosses"), F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in first])


def merge_blocks(rows: DataFrame, block: str, sentence: str, order: str, text: str, glosses: str, marks: str) -> DataFrame:
    """One row per sentence id of its blocks: first text and gloss, number of blocks, sorted distinct marks."""
    return rows.groupBy(sentence).agg(
        F.min_by(text, order).alias(text), F.min_by(glosses, order).alias(glosses), F.countDistinct(block).alias("n_videos"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(marks)))).alias(marks)
    )


def inconsistent(rows: DataFrame, sentence: str, glosses: str) -> DataFrame:
    """Sentences whose blocks don't all have one gloss."""
    return rows.groupBy(sentence).agg(F.countDistinct(glosses).alias("glosses")).filter("glosses > 1")


def expand_templates(templates: DataFrame, real: DataFrame) -> DataFrame:
    """Rows ``tid, chinese, gloss_text``: every phrasing of every combination of slots, without sentences that are real.

    ``templates`` has ``ord, tid, phrasings, gloss, slots, times`` and, if it likes, ``v_slots``; a null list of slots
    is one empty slot. The order is that of templates, slots, ``v_slots``, times, phrasings.
    """
    lists = {"P": "slots"} | ({"V": "v_slots"} if "v_slots" in templates.columns else {}) | {"T": "times"}
    every = expanded(templates, **lists, phrase="phrasings")
    slots = {n: n for n in lists}
    text = every.select("ord", "tid", *[f"{n}_at" for n in (*lists, "phrase")], filled("phrase", **slots).alias("chinese"), gloss_text(F.filter(F.transform("gloss", lambda g: filled(g, **slots)), lambda g: g != "")).alias("gloss_text"))
    fresh = not_in(text, real, ["chinese"])
    order = F.format_string("%06d" * (len(lists) + 2), F.col("ord"), *[F.coalesce(f"{n}_at", F.lit(0)) for n in (*lists, "phrase")])
    return keep_first(fresh.withColumn("place", order), ["chinese", "gloss_text"], "place").select("place", "tid", "chinese", "gloss_text")


def merge_synthetic(old: DataFrame, new: DataFrame, batch: str, prefix: str = "SYN", width: int = 4) -> DataFrame:
    """``old`` (``id, chinese, gloss_text, batch``) as it is, and what of ``new`` it lacks, numbered from its greatest number on."""
    fresh = not_in(new, old, ["chinese", "gloss_text"])
    last = old.agg(F.coalesce(F.max(id_number("id", len(prefix))), F.lit(0)).alias("last"))
    ranked = running_sum(fresh.select("place", "chinese", "gloss_text"), F.lit(1), "place", "n", bucket=F.substring("place", 1, 6))
    numbered_rows = ranked.crossJoin(F.broadcast(last)).select(numbered(prefix, width, F.col("n") + F.col("last")).alias("id"), "chinese", "gloss_text", F.lit(batch).alias("batch"))
    return old.select("id", "chinese", "gloss_text", "batch").unionByName(numbered_rows)


def batch_label(sheets: DataFrame, sheet: str, prefix: str = "batch") -> DataFrame:
    """One row ``label``: the number of the sheets there are, and one, after ``prefix``."""
    return sheets.agg(F.concat(F.lit(prefix), F.countDistinct(sheet) + 1).alias("label"))
