"""Paragraphs with offsets, divided texts, sections and chapters, on cases made by hand."""

from pyspark.sql import functions as F

from scriptoria.operators import builders as B
from scriptoria.operators import chunks as H
from scriptoria.operators.splitting import anchored, paragraphs, split


def test_paragraphs_and_their_offsets():
    text = "Uno due.  Tre! Quattro?\n\nCinque sei. Fine"
    assert list(paragraphs(text, 10)) == [("Uno due. Tre!", 0, 13), ("Quattro? Cinque sei.", 13, 33), ("Fine", 37, 41)]
    assert list(paragraphs(text, 8)) == [("Uno due.", 0, 8), ("Tre! Quattro?", 10, 23), ("Cinque sei.", 25, 36), ("Fine", 37, 41)]
    assert list(paragraphs(None)) == list(paragraphs("")) == list(paragraphs(" \n ")) == []
    assert list(paragraphs("no stop at all " * 100))[0][1:] == (0, 1499)


def test_a_piece_ends_behind_the_sign_right_after_it():
    text = "a" * 2000 + "." + "b" * 100
    assert split(text)[0] == ("a" * 2000 + ".", 0, 2001)
    # a space before a third of the size does not count
    assert split("a" * 300 + " " + "b" * 3000)[0][2] == 2000
    assert split("a" * 700 + " " + "b" * 3000)[0][2] == 701


def test_anchors_move_on_and_back_off():
    text = "abcabcabc" * 3
    assert [x[1:] for x in anchored(text, ["abc", "abc", "zz", "cab"], 4, 2)] == [(6, 9), (9, 12), (10, 12), (11, 14)]
    assert list(anchored("", ["a"], 0)) == [("a", 0, 1)]


def book(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_sections_are_cut_at_boundaries_and_end_with_their_sentence(spark):
    text = "Uno due tre\n\nquattro cinque. Sei sette. Otto"
    docs = book(spark, [(1, text), (2, "Solo."), (3, None)])
    paras = spark.createDataFrame([(1, 0, 0, 11), (1, 1, 13, 28), (1, 2, 29, 39), (1, 3, 40, 44), (2, 0, 0, 5)], "doc_id long, idx int, char_start int, char_end int")
    cuts = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (1, 0), (2, 0), (9, 1)], "doc_id long, boundary int")
    got = sorted(tuple(r) for r in B.book_sections(docs, paras, cuts).collect())
    # the first goes on to the stop behind "cinque"; the second begins where it would have
    assert got == [(1, 1, 0, 28, text[:28]), (1, 2, 13, 39, text[13:39]), (1, 3, 40, 44, "Otto"), (2, 1, 0, 5, "Solo.")]
    assert [r.text for r in B.book_sections(docs, paras, cuts, search=3).where("doc_id = 1 AND section = 1").collect()] == [text[:11]]


def test_section_chunks_are_numbered_through_the_book(spark):
    long = "Anna va. " * 40
    docs = book(spark, [(1, "Marco sta. " + long + "Fine. Roma")])
    paras = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 370), (1, 2, 371, 381)], "doc_id long, idx int, char_start int, char_end int")
    cuts = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, boundary int")
    spans = spark.createDataFrame([(1, "Marco", "PER", 0, 5), (1, "Anna", "PER", 11, 15), (1, "Roma", "LOC", 377, 381)], "doc_id long, word string, label string, start int, end int")
    rows = B.section_chunks(docs, paras, cuts, spans, 200, 20).orderBy("chunk_id").collect()
    assert [r.topic_hint for r in rows] == ["Capitolo Semantico 1", "Capitolo Semantico 2 (parte)", "Capitolo Semantico 2 (parte)", "Capitolo Semantico 3"]
    assert [r.chunk_id for r in rows] == [1, 2, 3, 4] and {r.total_chunks for r in rows} == {4}
    assert [[e.word for e in r.entities] for r in rows] == [["Marco"], ["Anna"], [], ["Roma"]] and [r.num_entities for r in rows] == [1, 1, 0, 1]
    assert all(docs.first().text[r.char_start : r.char_end].strip().startswith(r.text[:50]) for r in rows)
    assert B.section_chunks(docs.limit(0), paras.limit(0), cuts.limit(0), spans.limit(0)).count() == 0


def test_ner_sections_and_chapters(spark):
    """Sections go on while a name of the four chunks before recurs; a long one is divided and found again in the text."""
    text = "Anna vede Marco oggi. " * 20 + "Pioggia e vento, niente altro qui. " * 20 + "Roma dorme. " * 30
    from scriptoria.operators import entities as E

    docs = book(spark, [(1, text), (2, None), (3, "Breve")])
    spans = E.extract_spans(docs).where("word IN ('Anna', 'Marco', 'Roma')")
    rows = B.ner_section_chunks(docs, spans, 300, 40).orderBy("doc_id", "chunk_id").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.chunk_id for r in mine] == list(range(1, len(mine) + 1)) and {r.total_chunks for r in mine} == {len(mine)}
    assert len({r.section for r in mine}) > 2 and all(b.char_start >= a.char_start for a, b in zip(mine, mine[1:], strict=False))
    divided = [r for r in mine if r.topic_hint.endswith("(parte)")]
    assert divided and all(text[r.char_start :].startswith(r.text[:50]) and len(r.text) <= 300 for r in divided)
    assert all(len({(e.label, e.word.lower()) for e in r.entities}) == len(r.entities) == r.num_entities for r in mine)
    assert [tuple(r)[2:5] for r in rows if r.doc_id == 3] == [(1, "Breve", 0)]
    chapters = B.chapter_metadata(spark.createDataFrame(rows)).orderBy("doc_id", "chapter_id").collect()
    assert sorted(s for c in chapters if c.doc_id == 1 for s in c.section_ids) == sorted({r.section for r in mine})
    assert chapters[0].char_start == 0 and all(c.num_sections == len(c.section_ids) and c.chapter_hint == f"Capitolo NER {c.chapter_id}" for c in chapters)


def test_pseudo_paragraphs_of_odd_rows(spark):
    docs = book(spark, [(1, None), (2, ""), (3, "A. " * 400), (None, "Solo")]).withColumn("idx", F.lit("mine"))
    got = sorted(((r.doc_id or 0), r.idx, r.char_start, r.char_end) for r in H.pseudo_paragraphs(docs).collect())
    assert got == [(0, 0, 0, 4), (3, 0, 0, 500), (3, 1, 501, 1001), (3, 2, 1002, 1199)]
    assert H.pseudo_paragraphs(docs.limit(0)).count() == 0


def test_embeddings_match_brute_force(spark):
    """Vectors against a loop over trigrams; like texts are alike; sections begin where texts change."""
    import math
    from collections import Counter

    import numpy as np

    from scriptoria.operators import embedding as M

    texts = ["Il mare e il vento", "Il vento e il mare", "ZZ qq 99", "", None, "à", "x" * 5000]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts * 20)], "doc_id long, idx int, text string").repartition(3)
    got = {r.idx: r.embedding for r in M.with_embeddings(rows).collect()}
    signs = np.random.default_rng(M.SEED).integers(0, 2, (M.BUCKETS, M.SIZE)) * 2 - 1
    for i, t in enumerate(texts):
        low = f" {(t or '').lower()} "
        counts = Counter((ord(a) * 961 + ord(b) * 31 + ord(c)) % M.BUCKETS for a, b, c in zip(low, low[1:], low[2:], strict=False))
        want = [sum(round(math.sqrt(n) * 1024) / 1024 * signs[b][k] for b, n in counts.items()) for k in range(M.SIZE)]
        assert np.allclose(got[i], want, atol=1e-4) and all(got[i] == got[j] for j in range(i, len(texts) * 20, len(texts)))

    def cosine(a, b):
        return np.dot(got[a], got[b]) / np.linalg.norm(got[a]) / np.linalg.norm(got[b])

    assert cosine(0, 1) > 0.7 > cosine(0, 2) and not any(got[3])
    book = spark.createDataFrame([(1, i, t) for i, t in enumerate([texts[0], texts[1], texts[2], texts[2], texts[0]])], "doc_id long, idx int, text string")
    found = H.embedding_boundaries(M.with_embeddings(book), ["doc_id"], "idx").orderBy("idx").collect()
    assert [r.boundary for r in found] == [False, False, True, False, True]
    assert M.with_embeddings(book.limit(0)).count() == 0
