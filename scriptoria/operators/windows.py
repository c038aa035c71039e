"""Overlapping windows for entity extraction: headings, paragraphs and sentences decide where they begin and end."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .textrows import text_rows

WINDOW = {"section": "integer", "heading": "string", "start": "integer", "end": "integer", "text": "string"}
#: Lines that open a section, and what ends a sentence.
HEADING = re.compile(
    r"^(?:capitolo|canto|atto|scena|libro|parte|sezione|sonetto|ode|canzo?ne)\b\s*[\w\-–—\.]*(?:\s*[ivxlcdm0-9]+)?\s*$",
    re.IGNORECASE | re.MULTILINE,
)
SENTENCE = re.compile(r"[.!?][\"'”’)\]\s]*")
Span = tuple[int, int]


def heading_sections(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, heading); what stands before the first heading has none."""
    begins = [m.start() for m in HEADING.finditer(text)]
    named = [text[b : e if (e := text.find("\n", b)) >= 0 else len(text)].strip() for b in begins]
    if not begins or begins[0] > 0:
        begins, named = [0, *begins], [None, *named]
    return list(zip(begins, [*begins[1:], len(text)], named, strict=True))


def paragraphs(text: str, low: int, high: int) -> list[Span]:
    """Stretches between blank lines, blank ones left out."""
    gaps = [m.span() for m in re.compile(r"\n{2,}").finditer(text, low, high)]
    spans = zip([low, *(e for _, e in gaps)], [*(b for b, _ in gaps), high], strict=True)
    return [(b, e) for b, e in spans if text[b:e].strip()]


def sentence_spans(text: str, low: int, high: int, least: int, most: int) -> list[Span]:
    """Stretches that end with a sentence: the last one that ends within most, or else within half as much again, or a hard cut."""
    ends = [m.end() for m in SENTENCE.finditer(text, low, high)]

    def last(floor: int, ceiling: int) -> int:
        i = bisect_right(ends, ceiling)
        return ends[i - 1] if i and ends[i - 1] > floor else 0

    out, at = [], low
    while at < high:
        end = last(at + least, min(at + most, high)) or last(at + least, min(at + most * 3 // 2, high)) or min(at + most, high)
        out.append((at, end))
        at = end
    return out


def runs(units: list[Span], least: int, most: int, overlap: int) -> list[Span]:
    """First and last unit of each window: it grows while it is short or the next unit fits; the next begins with the first unit that ends in its last overlap characters."""
    out, first, ends = [], 0, [e for _, e in units]
    while first < len(units):
        begin, last = units[first][0], first
        while last + 1 < len(units) and (ends[last] - begin < least or ends[last + 1] - begin <= most):
            last += 1
        out.append((first, last))
        first = max(first + 1, bisect_right(ends, ends[last] - overlap))
    return out


def windows(text: str | None, least: int = 500, most: int = 2000, overlap: int = 300) -> list[tuple[int, str | None, int, int, str]]:
    """(section, heading, start, end, stripped text). Null and blank texts have no windows."""
    text, out = text or "", []

    def by_sentence(low: int, high: int) -> list[Span]:
        units = sentence_spans(text, low, high, least, most)
        return [(units[a][0], units[b][1]) for a, b in runs(units, least, most, overlap)]

    for number, (low, high, heading) in enumerate(heading_sections(text)):
        blocks = paragraphs(text, low, high)
        if not blocks or (len(blocks) == 1 and blocks[0][1] - blocks[0][0] > most):
            spans = by_sentence(low, high)
            if overlap > 0 and len(spans) > 1 and spans[0][1] <= spans[1][0]:
                stride = max(1, most - overlap)
                spans = [(b, min(b + most, high)) for b in range(low, max(low + 1, high - overlap), stride)]
        else:
            spans = []
            for a, b in runs(blocks, least, most, overlap):
                begin, end = blocks[a][0], blocks[b][1]
                parted = end - begin > most or (overlap > 0 and end - begin > least and len(sentence_spans(text, begin, end, least, most)) > 1)
                spans += by_sentence(begin, end) if parted else [(begin, end)]
        out += [(number, heading, b, e, piece) for b, e in spans if (piece := text[b:e].strip())]
    return out


def entity_windows(docs: DataFrame, key: str = "doc_id", least: int = 500, most: int = 2000, overlap: int = 300) -> DataFrame:
    """key, idx, section, heading, start, end, text of every window. docs: key, text."""
    return text_rows(docs, [key], ["text"], lambda text: windows(text, least, most, overlap), WINDOW)
