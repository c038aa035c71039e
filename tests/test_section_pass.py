"""Sections of books whose paragraphs are read once."""

from test_one_pass import books, steps

from scriptoria.operators import builders as B
from scriptoria.operators import comparison as C
from scriptoria.operators import entities as E
from scriptoria.plans import section_queries as Q


def test_paragraphs_are_made_once(spark, capsys):
    docs = books(spark)
    pairs = C.similarity_pairs(C.books_of(B.section_books(E.with_spans(docs), Q._cut_paragraphs(docs))))
    assert steps(pairs, capsys, "MapInArrow") == 4  # paragraphs, entities, parts, pairs
    rows = Q._cut_paragraphs(docs)
    cuts = rows.where("cut").select("doc_id", rows.idx.alias("boundary"))
    want = B.section_chunks(docs, rows.drop("cut"), cuts, E.extract_spans(docs))
    assert sorted(map(str, B.section_chunks(E.with_spans(docs), rows).collect())) == sorted(map(str, want.collect())) and pairs.count() > 0
