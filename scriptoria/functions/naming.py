"""Names, labels and small rules over columns: book titles, safe file names, badges, positions, step counts, JSON in noisy replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD, FAIR = 60.0, 35.0


def title_case(text: Column) -> Column:
    """The first letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def book_name(file_name: Column) -> Column:
    """A title from a file's name: no hash before it, no extensions, spaces for underscores."""
    name = F.translate(F.regexp_replace(file_name, r"^[0-9a-f]{6,}_", ""), "_", " ")
    return title_case(F.trim(F.regexp_replace(name, r"\.txt|\.json", "")))


def file_safe(name: Column) -> Column:
    """name with _ for all but word characters and dashes."""
    return F.regexp_replace(name, r"(?U)[^\w\-]", "_")


def retention_badge(percent: Column) -> Column:
    return F.when(percent >= GOOD, "good").when(percent >= FAIR, "fair").when(percent.isNotNull(), "poor")


def position(part: Column, parts: Column) -> Column:
    """Where the part-th (from 1) of parts stands; an only part is the first."""
    return F.when(part == 1, "INIZIALE").when(part == parts, "FINALE").otherwise("CENTRALE")


def summary_steps(sections: Column, threshold: int = 10, macro: int = 10, partial: int = 4) -> Column:
    """Model calls that a book of so many sections takes."""
    macros = F.when(sections > threshold, F.ceil(sections / macro)).otherwise(0)
    return sections + macros + F.when(macros > partial, F.ceil(macros / partial)).otherwise(1)


def target_chars(text_chars: Column, share: int, least: int) -> Column:
    """The length that a summary is asked for: a share-th of its text, at least least."""
    return F.greatest(F.floor(text_chars / share), F.lit(least))


def embedded_json(reply: Column) -> Column:
    """From the first bracket or brace to the last closing one; null without both."""
    return F.nullif(F.regexp_extract(reply, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def numbered(parts: Column, label: str) -> Column:
    """The parts of an array as one text, each under its number from 1."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), p)), "\n\n")
