"""The two-method report of chunks that came as a list for each book."""

from test_one_pass import books, steps

from scriptoria.operators import builders as B
from scriptoria.operators import comparison as C
from scriptoria.operators import entities as E
from scriptoria.plans import section_queries as Q


def test_listed_chunks_give_the_same_report(spark, capsys):
    docs = books(spark)
    paragraphs = Q._cut_paragraphs(docs)
    first = B.section_chunks(E.with_spans(docs), paragraphs)
    second = B.ner_section_chunks(E.with_spans(docs))
    want = C.two_method_report(first, second, B.chapter_metadata(second))
    got = C.two_method_report(B.section_books(E.with_spans(docs), paragraphs), B.ner_section_books(E.with_spans(docs)))
    assert steps(got, capsys, "MapInArrow") == 8  # entities, parts and pairs of both, paragraphs, pieces
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.where("embed_similarity IS NOT NULL AND ner_similarity IS NOT NULL").count() > 0
