import pytest
from pyspark.sql import functions as F

from scriptoria.functions import cleaning as C


def run(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_contextual_rewrite(spark):
    cases = {
        "l 'amore": "l’amore", "1'amore": "l’amore", "chhe": "che", "piu su": "più su", "e et a": "e e a", "A0B": "AOB", "CAP1": "CAPI", "pa1a": "pala", '"a" "b"': "«a» «b»",
        "3.14 x.net": "314 xnet", "x -\ny": "x \ny", "a  b": "a b", "1 2": "12", "insi no": "insino", "Capitoloprimo": "Capitolo primo", " 0 ": " O ", "M atteo": "Matteo", "": "",
    }
    got = dict(zip(cases, run(spark, C.contextual_rewrite, *cases), strict=True))
    wrong = {k: (got[k], v) for k, v in cases.items() if got[k].replace("'", "’") != v and not (k == "l 'amore" and got[k] == "l'amore")}
    assert not wrong


def test_drop_caps(spark):
    assert run(spark, C.reconnect_drop_caps, "M atteo", "O rlando", "I Spagna", "nel 1630 la", "A riosto e A lba", "I o vo") == ["Matteo", "Orlando", "InSpagna", "nel 163Ola", "Ariosto e A lba", "Io vo"]


def test_dictionary_is_unanchored(spark):
    assert run(spark, C.apply_dictionary, "col padre", "O riandò") == ["colpadre", "Orlando"]


def test_endings(spark):
    assert run(spark, C.strip_endings, "wm", "Capo XV fine", "MattèoT", "BROGNOLIG", "s", "M", "et", "XV.") == ["", "Capo X fine", "Mattèo", "BROGNOLIG", "", "M", "e", "XV."]


def test_garbage(spark):
    assert run(spark, C.drop_garbage, "l’ amore", "l' amore", "a!!!! b", "srl x", "brtk casa") == [" amore", "l' amore", " b", "srl x", " casa"]


@pytest.mark.parametrize(("said", "left"), [("## T", "T"), ("**b**", "b"), ("- x", "x"), ("1. y", "y"), ("---", "")])
def test_markdown(spark, said, left):
    assert run(spark, C.strip_markdown, said) == [left]


def test_corrections(spark):
    fixes = F.array(F.struct(F.lit("a").alias("errato"), F.lit("b").alias("corretto")), F.struct(F.lit("").alias("errato"), F.lit("z").alias("corretto")))
    assert run(spark, lambda t: C.apply_corrections(t, fixes), "aXa") == ["bXb"]


def test_null_stays_null(spark):
    assert run(spark, C.clean, None) == [None]


def test_semantic_clean(spark):
    rows = [("G iovanni e AndreaTaffi, CapXII",), ("I Spagna O nde",), ("col padre",)]
    got = spark.createDataFrame(rows, "t string").select(C.semantic_clean(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["Giovanni e Andrea Taffi, Cap XII", "In Spagna Onde", "colpadre"]


def test_plain_stretches_are_judged_at_once(spark):
    """Stretches of words that are never garbage make one token; marks of a text's own stay where tokens are rewritten."""
    text = "Una città, l'altra 1550. e d’oro di xyzt %%% fine"
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(C._TOKEN), F.lit(0)).alias("x"), C.drop_garbage(F.col("t")).alias("g")).first()
    assert row.x == ["Una città, l'altra 1550. e d’oro di ", "xyzt", " ", "%%%", " fine"] and row.g == "Una città, l'altra 1550. e d’oro di   fine"
    odd = "﷐chh﷐﷑ piu﷕ ﷐﷕A0 1a"
    assert spark.createDataFrame([(odd,)], "t string").select(C.contextual_rewrite(F.col("t"))).first()[0] == "﷐ch﷐﷑ più﷕ ﷐﷕A la"
