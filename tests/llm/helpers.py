"""Frames that every operator has to bear: nulls, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _md5 string, key string, start int, spans string, node long, y double, word string, k1 long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(40_000))


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "a", "b", 1, "c", 2, 0.5, "d", 3) for i, t in rows], SCHEMA)


def odd_rows() -> list[tuple[int | None, str | None]]:
    return [(1, "plain words in a plain row of text, no more than that."), (1, "plain words in a plain row of text, no more than that."), (1, "another text with the key of the first one"),
            (None, "a row without a key but with some words in it"), (2, None), (3, ""), (4, " \n\t "), (None, None), (5, LONG), (6, "\x00\x1c é́ 😀 ﬁ İ"), (7, "a" * 5000)]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
