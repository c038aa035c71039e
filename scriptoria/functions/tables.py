"""Table functions for SQL: what divides a text, callable by a lateral join. register() makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.splitting import paragraphs, split
from ..operators.windows import windows


class Paragraphs:
    def eval(self, text: str, target: int) -> Iterator[tuple]:
        for i, x in enumerate(paragraphs(text, target)):
            yield i, *x


class Pieces:
    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
        for i, x in enumerate(split(text, most, overlap)):
            yield i, *x


class Windows:
    def eval(self, text: str, least: int, most: int, overlap: int) -> Iterator[tuple]:
        for i, x in enumerate(windows(text, least, most, overlap)):
            yield i, *x


PIECE = "idx: int, text: string, char_start: int, char_end: int"
FUNCTIONS = {
    "pseudo_paragraphs": udtf(Paragraphs, returnType=PIECE, useArrow=False),
    "split_semantic": udtf(Pieces, returnType=PIECE, useArrow=False),
    "ner_windows": udtf(Windows, returnType="idx: int, section: int, heading: string, start: int, end: int, text: string", useArrow=False),
}


def register(spark: SparkSession) -> None:
    """pseudo_paragraphs(text, target), split_semantic(text, most, overlap) and ner_windows(text, least, most, overlap)."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
