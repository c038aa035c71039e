"""Entities stitched from windows, and reports that compare two ways of dividing a book."""

import json

from pyspark.sql import functions as F

from scriptoria.operators import comparison as C
from scriptoria.operators import stitching as T
from scriptoria.operators.windows import entity_windows

SPANS = "doc_id long, idx int, n int, label string, start int, end int, score double"


def test_entities_of_overlapping_windows(spark):
    windows = spark.createDataFrame([(1, 0, 100, "Anna Rossi vede Roma."), (1, 1, 105, "Rossi vede Roma."), (2, 0, 0, None), (3, 0, 0, "x" * 2000 + " Pisa")], "doc_id long, idx int, start int, text string")
    spans = [
        (1, 0, 0, "B-PER", 0, 3, 0.7), (1, 0, 1, "I-PER", 5, 10, 0.90004), (1, 0, 2, "B-LOC", 11, 15, 0.5), (1, 0, 3, "B-LOC", 16, 21, 0.8), (1, 0, 4, "MISC", 0, 4, 0.9), (1, 0, 5, None, 0, 4, 0.9),
        (1, 1, 0, "PER", 0, 5, 0.75), (1, 1, 1, "LOC", 11, 15, 0.95), (1, 1, 2, "LOC", 5, 5, 0.95), (2, 0, 0, "PER", 0, 3, 0.9), (3, 0, 0, "LOC", 2001, 2005, 0.9), (9, 0, 0, "PER", 0, 3, 0.9),
    ]
    found = T.window_entities(windows, spark.createDataFrame(spans, SPANS))
    # snapped to the word and joined to its neighbour; trimmed; the later window's finding of one place stays
    assert sorted(tuple(r) for r in found.collect()) == [(1, "LOC", "Roma", 116, 120, 0.95), (1, "PER", "Anna Rossi", 100, 110, 0.9), (1, "PER", "Rossi", 105, 110, 0.75)]
    said = json.loads(T.entities_json(found, "doc_id", F.lit("b")).first().json)
    assert said["book_name"] == "b" and said["total_entities"] == 3 and [e["word"] for e in said["entities"]] == ["Anna Rossi", "Rossi", "Roma"]
    assert T.window_entities(windows.limit(0), spark.createDataFrame([], SPANS)).count() == 0


def test_entities_from_natural_windows(spark):
    """Names of a text with headings and paragraphs; one that only overlapping windows hold twice comes once."""
    text = "Prologo.\n\nCAPITOLO IV\n" + "Una frase corta di Marco. " * 200 + "\n\nFine a Lucca."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Pisa e Siena")], "doc_id long, text string")
    windows = entity_windows(docs)
    found = T.window_entities(windows.select("doc_id", "idx", "start", "text"), T.recognise(windows.select("doc_id", "idx", "text"), ["doc_id", "idx"])).collect()
    assert len({(r.doc_id, r.label, r.start, r.end) for r in found}) == len(found) > 100
    assert {"Marco", "Lucca", "Siena"} <= {r.word for r in found} and all(docs.where(f"doc_id = {r.doc_id}").first().text[r.start : r.end] == r.word for r in found[:5])


CHUNKS = "doc_id long, chunk_id int, section int, topic_hint string, char_start int, text string"


def test_boundaries_and_their_nearest(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "S 1", 0, "a"), (1, 2, 2, "S 2 (parte)", 1000, "b"), (1, 3, 2, "S 2 (parte)", 2000, "c"), (1, 4, 3, "S 3", 9000, "d"), (2, 1, 1, "S 1", 0, "e")], CHUNKS)
    books = C.books_of(chunks)
    assert [tuple(b) for b in books.where("doc_id = 1").select(C.section_boundaries(F.col("chunks")).alias("b")).first().b] == [(0, 1, "S 1"), (1000, 2, "S 2"), (9000, 4, "S 3")]
    chapters = spark.createDataFrame([(1, 1, "C 1", 500), (1, 2, "C 2", 1500)], "doc_id long, chapter_id int, chapter_hint string, char_start int")
    others = {r.doc_id: r.boundaries for r in C.chapter_boundaries(chapters, books).collect()}
    assert [tuple(b) for b in others[1]] == [(500, 1, "C 1"), (1500, 2, "C 2")] and [tuple(b) for b in others[2]] == [(0, 1, "S 1")]  # no chapters: sections
    said = books.join(C.chapter_boundaries(chapters, books), "doc_id").where("doc_id = 1").select(C.compared(C.section_boundaries(F.col("chunks")), F.col("boundaries")).alias("c")).first().c
    assert [(c.id, c.other_id, c.dist, c.is_match) for c in said] == [(1, 1, 500, True), (2, 1, 500, True), (4, 2, 7500, False)]


def test_two_method_report(spark):
    text = {1: "mare vento barca", 2: "mare vento porto", 3: "monte neve lupo", 4: "monte neve capra", 5: "sole"}
    first = spark.createDataFrame([(1, i, 1 if i < 3 else 2, f"Capitolo Semantico {1 if i < 3 else 2}", 100 * i, t) for i, t in text.items()] + [(2, 1, 1, "Capitolo Semantico 1", 0, "solo")], CHUNKS)
    second = spark.createDataFrame([(1, 1, 1, "Sezione NER 1", 0, "mare vento"), (1, 2, 2, "Sezione NER 2", 400, "monte neve"), (3, 1, 1, "Sezione NER 1", 0, None)], CHUNKS)
    chapters = spark.createDataFrame([(1, 1, "Capitolo NER 1", 0), (3, 1, "Capitolo NER 1", 0)], "doc_id long, chapter_id int, chapter_hint string, char_start int")
    rows = {r.doc_id: r for r in C.two_method_report(first, second, chapters, tolerance=150).collect()}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one.embed_total_chunks, one.embed_total_sections, one.ner_total_chunks, one.ner_total_sections) == (5, 2, 2, 2)
    assert one.avg_jaccard_score == 0.5 and [(c.char, c.other_char, c.is_match) for c in one.comparison] == [(100, 0, True), (300, 0, False)]
    assert (one.embed_similarity.n_intra, one.embed_similarity.n_boundary, one.embed_similarity.n_cross) == (3, 1, 0) and one.ner_similarity is None
    assert one.embed_similarity.avg_intra > one.embed_similarity.avg_boundary == 0 and one.embed_similarity.intra[0].same_section and not one.embed_similarity.boundary[0].same_section
    assert two.avg_jaccard_score is None and two.ner_total_chunks is None and three.embed_total_chunks is None and three.comparison is None


def test_windows_texts_end_at_the_join(spark, capsys):
    """No sort, window or aggregation after the join holds a window's text; what touching spans add up to is cut from their own words."""
    text = "Anna,Maria e Anna Maria-Rosa d'Este"
    windows = spark.createDataFrame([(1, 0, 0, text)], "doc_id long, idx int, start int, text string")
    spans = [(1, 0, n, "PER", s, e, 0.9) for n, (s, e) in enumerate([(0, 4), (2, 10), (5, 8), (13, 17), (13, 28), (18, 23), (29, 35)])]
    found = T.window_entities(windows, spark.createDataFrame(spans, SPANS))
    assert sorted((r.start, r.end, r.word) for r in found.collect()) == [(0, 10, text[:10]), (13, 35, text[13:])]
    found.explain("formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    after = [x for x in nodes if ") Window" in x]
    assert len(after) >= 3 and not any("_text" in x for x in after)
