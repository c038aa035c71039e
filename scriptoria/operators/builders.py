"""Chunks of a book built from its text, paragraphs and entities: base chunks, chunks by section, and sections joined to chapters."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import once
from .splitting import PIECE, anchored, split
from .textrows import text_lists

ENTITIES = "array<struct<start:int,end:int,word:string,label:string>>"


def entity_key(label: Column, word: Column) -> Column:
    """By which entities of different chunks are the same."""
    return F.concat(label, F.lit(":"), F.lower(F.trim(word)))


def _keys(entities: Column | str) -> Column:
    return F.transform(entities, lambda e: entity_key(e["label"], e["word"]))


def books_with(docs: DataFrame, spans: DataFrame | None) -> DataFrame:
    """doc_id, text, entities (by place) of docs: what is made of a text is made where it is, and moves no more.

    spans: doc_id, word, label, start, end; without it docs bring their entities along."""
    if spans is None:
        return docs.select("doc_id", "text", "entities")
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "label"))).cast(ENTITIES).alias("entities"))
    return docs.select("doc_id", "text").join(held, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


def _marks() -> Column:
    """Of a book's entities what the helpers below read."""
    return F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), entity_key(e["label"], e["word"]).alias("key")))


def _inside(marks: list[dict], places: list[int], begin: int, end: int) -> list[int]:
    """Which of the marks, of these places, lie inside [begin, end]."""
    return [i for i in range(bisect_left(places, begin), bisect_right(places, end)) if marks[i]["end"] <= end]


def _pairs(marks: list[dict]) -> list[tuple[int, str]]:
    return [(m["start"], m["key"]) for m in marks]


def _listed(held: Column) -> Column:
    """The entities at these places of a book's list."""
    return F.transform(held, lambda i: F.get("entities", i))


def base_chunks(docs: DataFrame, spans: DataFrame | None = None, most: int = 2000, overlap: int = 300) -> DataFrame:
    """doc_id, chunk_id (from 1), text, char_start, char_end, topic_hint, entities, num_entities, keys (of its entities, each once), total_chunks.

    docs, spans: as of books_with; spans also move the places at which texts are divided."""

    def pieces(text: str | None, marks: list[dict]) -> Iterator[tuple]:
        places = [m["start"] for m in marks]
        for piece, start, end in split(text, most, overlap, _pairs(marks)):
            yield piece, start, end, _inside(marks, places, start, end)

    rows = text_lists(books_with(docs, spans), ["doc_id", "entities"], ["text", _marks()], pieces, {**PIECE, "held": "array<int>"}, "pieces")
    held = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in PIECE], _listed(p["held"]).alias("entities")))
    rows = rows.select("doc_id", F.size("pieces").cast("long").alias("total_chunks"), F.posexplode_outer(held).alias("idx", "p")).where("idx IS NOT NULL").select("doc_id", "idx", "p.*", "total_chunks")
    number = F.col("idx") + 1
    return rows.select(
        "doc_id", number.alias("chunk_id"), "text", "char_start", "char_end", F.concat(F.lit("Chunk NER "), number.cast("string")).alias("topic_hint"),
        "entities", F.size("entities").cast("long").alias("num_entities"), F.array_sort(F.array_distinct(_keys("entities"))).alias("keys"), "total_chunks",
    )


CHUNK = ("doc_id", "chunk_id", "section", "text", "char_start", "char_end", "topic_hint", "entities", "num_entities", "total_chunks")


PART = {"section": "integer", "part": "integer", "divided": "integer", **PIECE, "held": "array<int>"}


def _numbered(parts: Column, hint: str) -> Column:
    """parts (structs of PART, in order) of a book, numbered from 1 and with their hints: CHUNK's columns but doc_id and total_chunks, with held in place of entities."""

    def chunk(p: Column, i: Column) -> Column:
        named = F.concat(F.lit(hint), p["section"].cast("string"), F.when(p["divided"] == 1, " (parte)").otherwise(""))
        return F.struct((i + 1).alias("chunk_id"), *[p[c].alias(c) for c in ("section", "text", "char_start", "char_end")], named.alias("topic_hint"), p["held"].alias("held"))

    return F.transform(parts, chunk)


def _chunk_rows(books: DataFrame, *more: str) -> DataFrame:
    """CHUNK's columns, and more of them, of books (doc_id, entities, chunks). From a plain explode a filter on the list would be inferred, which makes each list twice."""
    with_entities = F.transform("chunks", lambda c: c.withField("entities", _listed(c["held"])))
    rows = books.select("doc_id", F.size("chunks").cast("long").alias("total_chunks"), F.explode_outer(with_entities).alias("c")).where("c IS NOT NULL").select("doc_id", "c.*", "total_chunks")
    return rows.withColumn("num_entities", F.size("held").cast("long")).select(*CHUNK, *more)


def _with_sections(books: DataFrame, paragraphs: DataFrame, boundaries: DataFrame | None, search: int) -> DataFrame:
    """books with sections: structs of section, char_start, char_end and text, as book_sections has them."""
    rows = paragraphs
    if boundaries is not None:
        cuts = boundaries.select("doc_id", F.col("boundary").cast("int").alias("idx"), F.lit(True).alias("cut")).distinct()
        rows = paragraphs.select("doc_id", "idx", "char_start", "char_end").join(cuts, ["doc_id", "idx"], "left")
    number = 1 + F.sum((F.coalesce("cut", F.lit(False)) & (F.col("idx") > 0)).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx"))
    rows = rows.select("doc_id", "idx", "char_start", "char_end", number.alias("section"))
    rows = rows.groupBy("doc_id", "section").agg(F.min_by("char_start", "idx").alias("char_start"), F.max_by("char_end", "idx").alias("char_end"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "char_start", "char_end"))).alias("sections"))

    def section(s: Column, i: Column) -> Column:
        ends = F.substring("text", s["char_end"], F.lit(1)).rlike("[.!?\"'»\n]")
        more = F.length(F.regexp_extract(F.substring("text", s["char_end"] + 1, F.lit(search)), r"^[^.!?]*[.!?]", 0))
        end = s["char_end"] + F.when((i == F.size("sections") - 1) | ends, 0).otherwise(more)
        return F.struct(s["section"].alias("section"), s["char_start"].alias("char_start"), end.alias("char_end"))

    # one side of the join is whole texts: the other, a short list for each, is held instead of sorting both
    joined = books.join(rows.hint("shuffle_hash"), "doc_id").withColumn("sections", F.transform("sections", section))
    text = lambda s: F.substring("text", s["char_start"] + 1, s["char_end"] - s["char_start"])
    return joined.withColumn("sections", F.transform("sections", lambda s: s.withField("text", text(s))))


def book_sections(docs: DataFrame, paragraphs: DataFrame, boundaries: DataFrame | None = None, search: int = 300) -> DataFrame:
    """doc_id, section (from 1), char_start, char_end, text: what lies between two boundaries.

    paragraphs: doc_id, idx, char_start, char_end. boundaries: doc_id, boundary, the idx before which a section begins; repeats do no harm. Without them paragraphs have cut, which tells that.
    A section but the last whose end falls into a sentence goes on to the sentence's end, if there is one within search characters; the next begins where it would."""
    return _with_sections(docs.select("doc_id", "text"), paragraphs, boundaries, search).select("doc_id", F.inline("sections"))


def section_books(docs: DataFrame, paragraphs: DataFrame, boundaries: DataFrame | None = None, spans: DataFrame | None = None, most: int = 2000, overlap: int = 300) -> DataFrame:
    """doc_id, entities, chunks: section_chunks' rows as one list for each book; held are the places of a chunk's entities in its book's."""

    def parts(sections: list[dict], marks: list[dict]) -> Iterator[tuple]:
        places = [m["start"] for m in marks]
        for s in sections:
            text, begin, end = s["text"], s["char_start"], s["char_end"]
            if text is None:
                continue
            if len(text) <= most:
                yield s["section"], 0, 0, text, begin, end, _inside(marks, places, begin, end)
                continue
            inside = [marks[i] for i in _inside(marks, places, begin, end)]
            for part, (piece, a, z) in enumerate(split(text, most, overlap, _pairs(inside))):
                yield s["section"], part, 1, piece, begin + a, begin + z, _inside(marks, places, begin + a, begin + z)

    books = _with_sections(books_with(docs, spans), paragraphs, boundaries, 300)
    books = text_lists(books, ["doc_id", "entities"], ["sections", _marks()], parts, PART, "_parts").where(F.size("_parts") > 0)
    return books.select("doc_id", "entities", _numbered(F.col("_parts"), "Capitolo Semantico ").alias("chunks"))


def section_chunks(docs: DataFrame, paragraphs: DataFrame, boundaries: DataFrame | None = None, spans: DataFrame | None = None, most: int = 2000, overlap: int = 300) -> DataFrame:
    """CHUNK's columns: sections of a book, those over most characters divided; chunks are numbered through the book.

    paragraphs, boundaries: as of book_sections; docs, spans: as of books_with.
    Where a section is divided, entities move the places as in a text of its own, with their places in the book (not in the section)."""
    return _chunk_rows(section_books(docs, paragraphs, boundaries, spans, most, overlap))


def _begins(keys: Column, frame: int, least: int) -> Column:
    """frame_boundaries of a book's lists of keys, as a list."""

    def flags(keys: Column) -> Column:
        before = lambda i: F.array_distinct(F.flatten(F.slice(keys, F.greatest(i - frame + 1, F.lit(1)), F.least(i, F.lit(frame)))))
        return F.transform(keys, lambda k, i: (i > 0) & (F.size(F.array_intersect(before(i), k)) < least))

    return once(keys, flags)


def _running(begins: Column) -> Column:
    """1, and one more from each true entry on."""
    return F.aggregate(begins, F.array().cast("array<bigint>"), lambda done, b: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(1)) + b.cast("bigint"))))


def ner_section_books(docs: DataFrame, spans: DataFrame | None = None, most: int = 2000, overlap: int = 300) -> DataFrame:
    """doc_id, entities, chunks: ner_section_chunks' rows as one list for each book; held are the places of a chunk's entities in its book's."""

    def pieces(book: str | None, marks: list[dict]) -> Iterator[tuple]:
        places = [m["start"] for m in marks]
        return ((_inside(marks, places, start, end),) for _, start, end in split(book, most, overlap, _pairs(marks)))

    def parts(book: str | None, marks: list[dict], held: list[dict], begins: list[bool]) -> Iterator[tuple]:
        base = zip(accumulate(begins, initial=1), held, split(book, most, overlap, _pairs(marks)), strict=False)
        for section, of in groupby(base, lambda x: x[0]):
            of = list(of)
            first: dict[str, int] = {}
            for i in chain.from_iterable(h["held"] for _, h, _ in of):
                first.setdefault(marks[i]["key"], i)
            text, begin, end, mine = " ".join(p[0] for _, _, p in of), of[0][2][1], of[-1][2][2], list(first.values())
            if len(text) <= most:
                yield section, 0, 0, text, begin, end, mine, mine
                continue
            found = list(anchored(book, (x[0] for x in split(text, most, overlap)), begin, overlap + 100))
            lists = [[i for i in mine if marks[i]["start"] >= a and marks[i]["end"] <= z] for _, a, z in found]
            every = list(set(chain.from_iterable(lists)))
            for part, (piece, mine) in enumerate(zip(found, lists, strict=True)):
                yield section, part, 1, *piece, mine, None if part else every

    keys = lambda lists, name: F.transform(lists, lambda x: F.array_distinct(_keys(_listed(x[name]))))
    books = books_with(docs, spans).withColumn("_marks", _marks())
    books = text_lists(books, ["doc_id", "text", "entities", "_marks"], ["text", "_marks"], pieces, {"held": "array<int>"}, "_pieces")
    begins = F.slice(_begins(keys("_pieces", "held"), 4, 1), 2, F.greatest(F.size("_pieces") - 1, F.lit(0)))
    books = text_lists(books, ["doc_id", "entities"], ["text", "_marks", "_pieces", begins], parts, {**PART, "all": "array<int>"}, "_parts").where(F.size("_parts") > 0)
    # a section's keys stand in its first part
    chapters = _running(_begins(keys(F.filter("_parts", lambda p: p["part"] == 0), "all"), 3, 2))
    chunks = _numbered(F.col("_parts"), "Sezione NER ")
    chunks = once(chapters, lambda chapters: F.transform(chunks, lambda c: c.withField("chapter_id", F.get(chapters, c["section"] - 1))))
    return books.select("doc_id", "entities", chunks.alias("chunks"))


def ner_section_chunks(docs: DataFrame, spans: DataFrame | None = None, most: int = 2000, overlap: int = 300) -> DataFrame:
    """CHUNK's columns, chapter_id and chapter_hint: base_chunks joined to sections while a key of the four before recurs, those over most characters divided again and found again in the book.

    docs, spans: as of books_with. A section's chunk holds the first entity of each key, a divided section's chunks those of them that lie inside. Chapters end where a section shares fewer than two keys with the three before it."""
    rows = _chunk_rows(ner_section_books(docs, spans, most, overlap), "chapter_id")
    return rows.withColumn("chapter_hint", F.concat(F.lit("Capitolo NER "), F.col("chapter_id").cast("string")))


def chapter_metadata(chunks: DataFrame) -> DataFrame:
    """doc_id, chapter_id, chapter_hint, section_ids, num_sections, char_start, char_end; chunks: doc_id, chapter_id, section, char_start, char_end."""
    some = chunks.groupBy("doc_id", "chapter_id").agg(F.array_sort(F.collect_set("section")).alias("section_ids"), F.coalesce(F.min("char_start"), F.lit(0)).alias("char_start"), F.coalesce(F.max("char_end"), F.lit(0)).alias("char_end"))
    return some.withColumn("num_sections", F.size("section_ids").cast("long")).withColumn("chapter_hint", F.concat(F.lit("Capitolo NER "), F.col("chapter_id").cast("string")))
