"""Splitting of long texts at natural places, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textrows import text_rows

PIECE = {"text": "string", "char_start": "integer", "char_end": "integer"}
NEAR, SHIFT = 150, 0.4  # characters before the end that count as its surroundings; Jaccard similarity below which topics shift
STOPS = ".!?"


def _last(text: str, signs: str, low: int, high: int) -> int:
    """The last place of any of the signs in [low, high); -1 without one."""
    return max(text.rfind(s, low, high) for s in signs)


def _cut(text: str, start: int, end: int, least: int, places: list[int], keys: list[str]) -> int:
    """Where to cut text[start:end]: at a shift of entities, a blank line, a sentence's end, a space, or at its end."""
    low = start + least
    if keys:
        a, b, c = (bisect_left(places, p) for p in (low, end - NEAR, end))
        before, after = set(keys[a:b]), set(keys[b:c])
        if before and after and len(before & after) / len(before | after) < SHIFT:
            blank = text.rfind("\n\n", low, end - NEAR + 300)
            at = blank + 2 if blank >= 0 else _last(text, STOPS, low + 1, end - NEAR + 1) + 1
            if at > 0:
                return at
    blank = text.rfind("\n\n", low, end)
    if blank >= 0:
        return blank + 2
    stop = _last(text, STOPS, low + 1, end + 1)  # the sign right behind the piece counts too
    if stop >= 0:
        return stop + 1
    space = text.rfind(" ", low, end)
    return space + 1 if space >= 0 else end


def split(text: str | None, most: int = 2000, overlap: int = 300, entities: list[tuple[int, str]] | None = None) -> list[tuple[str, int, int]]:
    """(text, start, end) of pieces of at most most characters, besides what a late blank line adds; each starts up to overlap before the end of the one before.

    entities: (start, key) in order. Pieces are stripped, offsets are not. Null texts have no pieces."""
    if most // 3 <= overlap:
        raise ValueError("a third of the size must be more than the overlap")
    text = text or ""
    places, keys = [e[0] for e in entities or ()], [e[1] for e in entities or ()]
    out, start = [], 0
    while start < len(text):
        if len(text) - start <= most:
            if tail := text[start:].strip():
                out.append((tail, start, start + len(tail)))
            break
        cut = _cut(text, start, start + most, most // 3, places, keys)
        if piece := text[start:cut].strip():
            out.append((piece, start, cut))
        back = max(start, cut - overlap)
        after = [p + 1 for p in (text.find(s, back, cut) for s in ".!?\n") if p >= 0]
        start = min(min(after, default=back), cut) if min(after, default=back) > start else cut
    return out


def size_split(docs: DataFrame, key: str | list[str] = "doc_id", most: int = 2000, overlap: int = 300) -> DataFrame:
    """key, idx, text, char_start, char_end. docs: key, text and, if there are any, entities (array of structs start, key)."""
    if "entities" not in docs.columns:
        docs = docs.withColumn("entities", F.lit(None).cast("array<struct<start:int,key:string>>"))

    def pieces(text: str | None, entities: list[dict] | None) -> list[tuple[str, int, int]]:
        return split(text, most, overlap, [(e["start"], e["key"]) for e in entities or ()])

    return text_rows(docs, [key] if isinstance(key, str) else key, ["text", "entities"], pieces, PIECE)


_AFTER_STOP = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: str | None, target: int = 500) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of pseudo-paragraphs: sentences joined by one space until they reach target characters.

    A paragraph is looked for by its first 50 characters from the end of the one before; where they are not found, as they
    span white space that the joining changed, it is taken to begin right there. Its end is its start and its length."""
    text, begin, held, size = text or "", 0, [], 0

    def placed() -> tuple[str, int, int]:
        joined = " ".join(held)
        at = text.find(joined[:50], begin)
        at = at if at >= 0 else begin
        return joined, at, at + len(joined)

    for sentence in filter(None, map(str.strip, _AFTER_STOP.split(text))):
        held.append(sentence)
        size += len(sentence) + (size > 0)
        if size >= target:
            yield (done := placed())
            begin, held, size = done[2], [], 0
    if held:
        yield placed()


def anchored(text: str, pieces: Iterable[str], begin: int, back: int = 400) -> Iterator[tuple[str, int, int]]:
    """(piece, start, end): pieces found again in the text that they come from, by a cursor that stays at most back characters behind the
    end of the piece before. A piece is looked for by its first 50 characters; one that is not found begins at the cursor."""
    for piece in pieces:
        at = text.find(piece[:50], begin)
        at = at if at >= 0 else begin
        yield piece, at, at + len(piece)
        begin = max(at, at + len(piece) - back)
