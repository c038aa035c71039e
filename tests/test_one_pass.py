"""Books divided where their texts lie: as with a table of spans, but without shuffles of texts."""

from scriptoria.operators import builders as B
from scriptoria.operators import entities as E

TEXT = "Anna vede Marco oggi. " * 150 + "pioggia e vento, niente altro qui.\n\n" * 90 + "Roma dorme. Anna no! " * 200


def books(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "Breve"), (4, ""), (5, "Luca e Pia. " * 40)], "doc_id long, text string")


def steps(df, capsys, name):
    """How often a step occurs in the plan."""
    capsys.readouterr()
    df.explain("formatted")
    return sum(f") {name}" in x.splitlines()[0] for x in capsys.readouterr().out.split("\n\n") if x.startswith("("))


def test_names_divide_books_in_one_pass(spark, capsys):
    docs = books(spark)
    one = B.ner_section_chunks(E.with_spans(docs))
    assert sorted(map(str, one.collect())) == sorted(map(str, B.ner_section_chunks(docs, E.extract_spans(docs)).collect()))
    assert {r.doc_id for r in one.collect()} == {1, 3, 5} and one.where("section > 1").count() > 0
    assert steps(one, capsys, "Exchange") == steps(one, capsys, "Window") == 0


def test_chapters_of_divided_books_in_one_shuffle(spark, capsys):
    one = B.chapter_metadata(B.ner_section_chunks(E.with_spans(books(spark))))
    assert one.count() > 3 and steps(one, capsys, "Exchange") == 1 and steps(one, capsys, "Window") == 0
