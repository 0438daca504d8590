"""A split of paired text that leaks neither texts nor groups from one side to another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signloom.functions.text import PLACEHOLDER
from signloom.operators.joins import drop_counts, in_groups, not_in_any, shared_groups
from signloom.operators.order import greedy_holdout, keep_first
from signloom.plans.durable import cut

RECORD = ("_ord", "id", "chinese", "gloss_text", "source", "group", "confidence", "review_status")


@dataclass(frozen=True)
class SplitPlan:
    dev_ratio: float = 0.08
    corpus_test_ratio: float = 0.12
    seed: int = 42
    least_tokens: int = 2
    include_rule_derived: bool = False
    least_stratum: int = 10


def record(df: DataFrame, group: Column) -> DataFrame:
    """The unified record of any source; a missing review status is ``n/a``."""
    return df.select("_ord", "id", "chinese", "gloss_text", "source", group.alias("group"), F.col("confidence"), F.coalesce("review_status", F.lit("n/a")).alias("review_status"))


def usable(df: DataFrame) -> DataFrame:
    """Rows with both texts and without placeholders."""
    return df.filter((F.col("chinese") != "") & (F.col("gloss_text") != "") & ~F.col("gloss_text").contains(PLACEHOLDER))


def without_class(df: DataFrame, column: str, value: str, keep: bool = False) -> DataFrame:
    """Rows of other classes and of none, or all if they are to be kept."""
    return df if keep else df.filter(~F.col(column).eqNullSafe(value))


def split(records: DataFrame, test: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Rows of ``records`` with ``split`` (train, dev, test_corpus), and those of ``test``.

    Corpus groups are held out first; what of them repeats a text of ``test`` or of another held-out row
    vanishes, and no row of these groups returns to the pool. Pool rows that share either text with
    a test row go, repeated pairs keep their first row, and dev takes whole groups per source.
    """
    pool = without_class(usable(records), "confidence", "rule-derived", plan.include_rule_derived)
    long_enough = (F.col("source") != "tslcorpus") | (F.size(F.split("gloss_text", "/")) >= plan.least_tokens)
    pool = pool.filter(long_enough)
    texts = ["chinese", "gloss_text"]
    corpus = pool.filter("source = 'tslcorpus'")
    held = cut(greedy_holdout(corpus, "group", plan.corpus_test_ratio, plan.seed).select("group"))
    candidates = in_groups(corpus, held, "group", "left_semi")
    test_corpus = cut(keep_first(not_in_any(candidates, test, texts), texts, "_ord"))
    rest = in_groups(pool, held, "group", "left_anti")
    seen = test.select(*texts).unionByName(test_corpus.select(*texts))
    rest = cut(keep_first(not_in_any(rest, seen, texts), texts, "_ord"))
    dev = greedy_holdout(rest, "group", plan.dev_ratio, plan.seed, "source", plan.least_stratum).select("stratum", F.col("group").alias("held"), F.lit("dev").alias("split"))
    placed = rest.join(dev, F.col("source").eqNullSafe(F.col("stratum")) & F.col("group").eqNullSafe(F.col("held")), "left").select(*pool.columns, F.coalesce("split", F.lit("train")).alias("split"))
    return placed.unionByName(test_corpus.withColumn("split", F.lit("test_corpus"))).unionByName(test.select(*pool.columns).withColumn("split", F.lit("test")))


def holdout_counts(records: DataFrame, test: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Rows ``source, rows, dropped, kept``: how many usable records share a text with ``test``, before repeated pairs are dropped."""
    pool = without_class(usable(records), "confidence", "rule-derived", plan.include_rule_derived)
    return drop_counts(pool, test, ["chinese", "gloss_text"], "source")


def leaks(placed: DataFrame) -> DataFrame:
    """Rows ``pair, shared``: groups on both sides; 0 for a sound split."""
    of = lambda *s: placed.filter(F.col("split").isin(*s))
    pairs = {"train/dev": (of("train"), of("dev")), "test_corpus/pool": (of("test_corpus"), of("train", "dev"))}
    whole = None
    for name, (a, b) in pairs.items():
        one = shared_groups(a, b, "group").agg(F.count(F.lit(1)).alias("shared")).select(F.lit(name).alias("pair"), "shared")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def manifest(placed: DataFrame) -> DataFrame:
    """Rows ``split, source, rows, groups, four_grams``."""
    size = F.size(F.split("gloss_text", "/"))
    return placed.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("group").alias("groups"), F.sum(F.greatest(size - 3, F.lit(0))).alias("four_grams"))
