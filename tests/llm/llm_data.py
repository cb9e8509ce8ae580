"""Rows that every operator must handle."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "xx", "a", 3),
    (4, "word " * 30_000, "en", "b", 150_000),
    (5, "The cat sat on the mat and looked at the dog that was in the garden of the house.", "en", "a", 82),
    (5, "The cat sat on the mat and looked at the dog that was in the garden of the house.", "en", "a", 82),
    (None, "No id here, yet there are some words in it for all that, as the rules ask for ten.", None, None, 1),
    (6, "emoji 😀 ß é 漢字 mixed <|endoftext|> #*$%&|<> x y z", "de", "b", 40),
    (7, "x" * 70_000, "fr", None, 70_000),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame(list(rows), SCHEMA)
