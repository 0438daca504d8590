"""Metrics of predictions against references, and of marker positions.

A row holds its reference and its hypothesis, so pairing needs no join. The metrics of pairs come from
one pass that counts Arrow batches; nothing is exploded or shuffled by n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signloom.functions.arrays import clipped, common_length, last_match, longest_common
from signloom.functions.text import tokens

ORDERS = (1, 2, 3, 4)


def pairs(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Rows ``ref, hyp`` of token arrays; null texts have no tokens."""
    none = F.array().cast("array<string>")
    return df.select(F.coalesce(tokens(ref), none).alias("ref"), F.coalesce(tokens(hyp), none).alias("hyp"))


COUNTS = (*(f"matches_{n}" for n in ORDERS), *(f"total_{n}" for n in ORDERS), "ref_len", "hyp_len", "n", "exact")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a batch of pairs, in one row."""
    for batch in batches:
        counts, f1 = dict.fromkeys(COUNTS, 0), 0.0
        for ref, hyp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            same = ref == hyp
            for n, m in zip(ORDERS, [max(len(hyp) - n + 1, 0) for n in ORDERS] if same else clipped(ref, hyp, len(ORDERS)), strict=True):
                counts[f"matches_{n}"] += m
                counts[f"total_{n}"] += max(len(hyp) - n + 1, 0)
            counts["ref_len"] += len(ref)
            counts["hyp_len"] += len(hyp)
            counts["n"] += 1
            counts["exact"] += same
            if ref and hyp:
                f1 += 2 * (len(hyp) if same else common_length(ref, hyp)) / (len(ref) + len(hyp))
        yield pa.RecordBatch.from_arrays([*(pa.array([counts[c]], pa.int64()) for c in COUNTS), pa.array([f1])], names=[*COUNTS, "f1"])


def sums(paired: DataFrame) -> DataFrame:
    """One row of all that the metrics need, from one pass over the pairs: batches are counted where they are, and only their sums travel."""
    parts = paired.select("ref", "hyp").mapInArrow(_counted, ", ".join(f"{c} long" for c in COUNTS) + ", f1 double")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "f1")])


def bleu_counts(paired: DataFrame) -> DataFrame:
    """Rows ``n, matches, total`` for n of 1 to 4, those without any n-gram included."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"matches_{n}").alias("matches"), F.col(f"total_{n}").alias("total")) for n in ORDERS])
    return sums(paired).select(F.explode(each).alias("x")).select("x.*")


def _bleu() -> Column:
    """Corpus BLEU of the sums: one added to both counts above unigrams, 0 if any is 0, brevity penalty below the reference's length."""
    top = [F.col(f"matches_{n}") + (n > 1) * 1 for n in ORDERS]
    low = [F.col(f"total_{n}") + (n > 1) * 1 for n in ORDERS]
    some = F.least(*top, *low, F.col("hyp_len")) > 0
    mean = sum((F.log(a / b) for a, b in zip(top, low, strict=True)), F.lit(0.0)) / len(ORDERS)
    brief = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    return F.when(some, brief * F.exp(mean) * 100).otherwise(0.0)


def bleu(paired: DataFrame) -> DataFrame:
    return sums(paired).select(_bleu().alias("bleu"))


def rouge_l_of(ref: Column, hyp: Column) -> Column:
    """F1 of the longest common subsequence; 0 where either is empty."""
    common = longest_common(ref, hyp)
    return F.when(common > 0, 2 * common / (F.size(ref) + F.size(hyp))).otherwise(0.0)


def _mean(value: str) -> Column:
    return F.when(F.col("n") > 0, F.col(value) / F.col("n") * 100).otherwise(0.0)


def rouge_l(paired: DataFrame) -> DataFrame:
    return sums(paired).select(_mean("f1").alias("rouge_l"))


def exact_match(paired: DataFrame) -> DataFrame:
    return sums(paired).select(_mean("exact").alias("exact_match"))


def in_vocab(paired: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Rows ``known, total, in_vocab``: tokens of the hypotheses that are names, pooled. Tokens are counted before they join."""
    counts = paired.select(F.explode("hyp").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    flagged = counts.join(names.select(F.col(name).alias("token"), F.lit(True).alias("known")).distinct(), "token", "left")
    both = flagged.agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return both.withColumn("in_vocab", F.when(F.col("total") > 0, F.col("known") / F.col("total") * 100).otherwise(0.0))


def evaluate(df: DataFrame, ref: str, hyp: str, names: DataFrame, name: str) -> DataFrame:
    """Rows ``metric, value``: n, BLEU-4, ROUGE-L, exact match and in-vocabulary rate, to two places. An empty table scores 0."""
    paired = pairs(df, ref, hyp)
    one = sums(paired).select("n", _bleu().alias("bleu"), _mean("f1").alias("rouge_l"), _mean("exact").alias("exact_match")).crossJoin(in_vocab(paired, names, name).select("in_vocab"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(c).cast("double"), 2).alias("value")) for m, c in (("n", "n"), ("BLEU-4", "bleu"), ("ROUGE-L", "rouge_l"), ("ExactMatch%", "exact_match"), ("InVocab%", "in_vocab"))])
    return one.select(F.explode(each).alias("x")).select("x.*")


def marker_positions(df: DataFrame, glosses: str, groups: dict[str, list[str]]) -> DataFrame:
    """Rows ``group, n, early, mid, late``: where the last token that holds a marker stands, in rows of two tokens or more."""
    rows = df.select(F.col(glosses).alias("g")).filter(F.size("g") >= 2)
    each = F.array(*[F.struct(F.lit(name).alias("group"), last_match(F.col("g"), markers).alias("at")) for name, markers in groups.items()])
    places = rows.select(F.size("g").alias("size"), F.explode(each).alias("x")).select("x.group", (F.col("x.at") / (F.col("size") - 1)).alias("place")).filter("place is not null")
    early, late = F.col("place") <= 0.34, F.col("place") >= 0.67
    return places.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(early).alias("early"), F.count_if(~early & ~late).alias("mid"), F.count_if(late).alias("late"))
