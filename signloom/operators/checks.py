"""Checks that stop a job, and labels by rules given as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """What a table should hold, it doesn't."""


def expect_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    if (found := df.count()) != n:
        raise CheckFailed(f"{what}: {found} rows where {n} are due")
    return df


def expect_none(df: DataFrame, what: str) -> None:
    """No row may be there, as of tokens outside a vocabulary or groups on two sides; an example is told."""
    if row := df.first():
        raise CheckFailed(f"{what}: {row.asDict()}")


def expect_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise CheckFailed(f"{what}: no column {', '.join(missing)}")
    return df


def verdict(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The text of the first rule that holds; a null condition doesn't."""
    return F.coalesce(*[F.when(condition, F.lit(said)) for condition, said in rules], F.lit(otherwise))


def notes(rules: Sequence[tuple[Column, str]], stamp: str | None = None, mark: str = "；") -> Column:
    """The texts of all rules that hold, in order, after a stamp; the stamp alone if none does."""
    said = F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in rules]))
    parts = F.concat(F.array(F.lit(stamp)), said) if stamp else said
    return F.array_join(parts, mark)


def bucket(text: Column, whole: Sequence[tuple[str, str]], head: Sequence[tuple[str, str]], otherwise: str, mark: str = "；") -> Column:
    """A bucket by phrase: first phrases sought in the whole text, then others in what stands before the first mark."""
    start = F.split_part(text, F.lit(mark), F.lit(1))
    return verdict([*[(text.contains(p), b) for p, b in whole], *[(start.contains(p), b) for p, b in head]], otherwise)
