"""Prompts, chat messages and inference with a pluggable client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt(task: str, text: Column, rules: str | None = None, examples: Column | None = None) -> Column:
    """Task, rules and examples, blank lines between, then the sentence."""
    parts = [F.lit(task), *([F.lit(rules)] if rules else []), *([examples] if examples is not None else []), F.concat(F.lit("中文："), text, F.lit("\nGloss："))]
    return F.concat_ws("\n\n", *parts)


def exemplars(pool: list[tuple[str, str, str]], key: Column) -> Column:
    """The pool of (id, text, gloss) as one text, without the row's own."""
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"中文：{t}\nGloss：{g}").alias("s")) for i, t, g in pool])
    return F.array_join(F.transform(F.filter(items, lambda x: x["i"] != key), lambda x: x["s"]), "\n")


def messages(user: Column, answer: Column | None = None) -> Column:
    """Chat messages: the user's, and the assistant's where there is an answer."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.array(turn("user", user))
    return asked if answer is None else F.when(answer.isNull(), asked).otherwise(F.concat(asked, F.array(turn("assistant", answer))))


def infer(df: DataFrame, key: str, text: str, client: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Rows ``key, raw``: answers of a model. ``client`` makes, once per task, a function from prompts to answers."""
    schema = df.select(key).schema.simpleString()[7:-1].replace(":", " ") + ", raw string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = client()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "raw": answer(batch[text].fillna("").tolist())})

    return df.select(key, text).mapInPandas(run, schema)


def encode(df: DataFrame, key: str, text: str, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """Rows ``key, ids`` by any tokenizer; ``tokenizer`` makes, once per task, a function from texts to ids. Null texts have none."""
    schema = df.select(key).schema.simpleString()[7:-1].replace(":", " ") + ", ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = tokenizer()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "ids": ids(batch[text].fillna("").tolist())})

    return df.select(key, text).mapInPandas(run, schema)
