"""Functions on token arrays, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\x01"))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def clipped(ref: list, hyp: list, orders: int) -> list[int]:
    """For runs of 1 to ``orders`` tokens: over the distinct runs of ``hyp``, the lesser of its counts in both lists, summed."""
    found = [0] * orders
    for n in range(1, orders + 1):
        have: dict = {}
        for run in zip(*(ref[i:] for i in range(n)), strict=False):
            have[run] = have.get(run, 0) + 1
        for run in zip(*(hyp[i:] for i in range(n)), strict=False):
            if have.get(run):
                have[run] -= 1
                found[n - 1] += 1
        if not found[n - 1]:  # longer runs hold shorter ones
            break
    return found


@F.arrow_udf(IntegerType())
def clipped_matches(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Over the distinct items of ``hyp``: the lesser of its counts in both arrays, summed."""
    return pa.array([clipped(a or [], b or [], 1)[0] for a, b in zip(ref.to_pylist(), hyp.to_pylist(), strict=True)], pa.int32())


def common_length(ref: list, hyp: list) -> int:
    """Length of the longest common subsequence: the tokens of ``hyp`` are the bits of one number, each of ``ref`` is an addition."""
    masks: dict = {}
    for place, token in enumerate(hyp):
        masks[token] = masks.get(token, 0) | 1 << place
    full = (1 << len(hyp)) - 1
    left = full
    for token in ref:
        hit = left & masks.get(token, 0)
        left = (left + hit | left - hit) & full
    return len(hyp) - left.bit_count()


@F.arrow_udf(IntegerType())
def longest_common(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Length of the longest common subsequence; 0 for null and empty arrays."""
    return pa.array([common_length(a or [], b or []) for a, b in zip(ref.to_pylist(), hyp.to_pylist(), strict=True)], pa.int32())


def last_match(tokens: Column, markers: list[str]) -> Column:
    """Zero-based place of the last token that holds one of ``markers``; null if none does."""
    hit = lambda t: F.exists(F.array(*map(F.lit, markers)), lambda m: t.contains(m))
    return F.array_max(F.filter(F.transform(tokens, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull()))


def masked_labels(prompt: Column, whole: Column, most: int, mask: int = -100) -> Column:
    """Labels of a training row: the prompt masked, the rest as it is, cut at ``most``."""
    rest = F.when(F.size(whole) > F.size(prompt), F.slice(whole, F.size(prompt) + 1, F.size(whole))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.concat(F.array_repeat(F.lit(mask), F.size(prompt)), rest), 1, most)


def padded(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def without(tokens: Column, text: str) -> Column:
    """Tokens that don't hold ``text``."""
    return F.filter(tokens, lambda t: ~t.contains(text))


def non_empty(*values: Column) -> Column:
    """Values that are neither null nor empty, as an array."""
    return F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))


def values_of_keys(fields: Column, starts: str, holds: str) -> Column:
    """Values of a map whose keys start and hold so, in the order of their keys, null and empty ones dropped."""
    some = F.map_filter(fields, lambda k, v: k.startswith(starts) & k.contains(holds) & v.isNotNull() & (v != ""))
    return F.transform(F.array_sort(F.map_entries(some)), lambda e: e["value"])
