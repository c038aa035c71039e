import io
import json
import random
import textwrap
import zipfile

from pyspark.sql import functions as F

from scriptoria.functions import naming as G
from scriptoria.operators import entities as E
from scriptoria.operators import packing as L
from scriptoria.sources import archive as A


def slow_packs(text, most):
    """The stated rule on one growing string."""
    out, now = [], ""
    for line in text.split("\n"):
        if len(now) + len(line) < most:
            now += line + "\n"
            continue
        out += [now.strip()] if now else []
        wrapped = textwrap.wrap(line, width=most, break_long_words=False) if len(line) >= most else [line]
        out += wrapped[:-1]
        now = wrapped[-1] + "\n" if wrapped else ""
    return out + ([now.strip()] if now else [])


def test_packs_match_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "\n\n", " " * 70, "x" * 100, *("".join(rng.choices(["word ", "\n", "a" * 45, " " * 30, "é. "], [6, 2, 1, 1, 2], k=rng.randrange(80))) for _ in range(300))]
    rows = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("idx", F.lit("mine"))
    got = {}
    for r in L.pack_lines(rows, most=40).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: p for i, t in enumerate(texts) if (p := slow_packs(t, 40))}
    assert L.pack_lines(rows.limit(0)).count() == 0


def test_passages_are_whole_words_of_the_middle(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (10, 160, 400, 5000)] + ["x" * 900, None]
    got = {r.doc_id: r for r in L.sample_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4].passage == texts[4]
    for i in (1, 2, 3):
        assert f" {got[i].passage} " in texts[i][got[i].start : got[i].start + 1200] and len(got[i].passage) < 1200
    assert 0.2 * len(texts[3]) - 1 <= got[3].start <= 0.8 * len(texts[3]) - 1200


def test_naming(spark):
    row = spark.createDataFrame([("0a1b2c_i_promessi_sposi.txt", "l'amore_d'altri.json", "qwen3.5:9b/à")], "a string, b string, c string")
    assert tuple(row.select(G.book_name(F.col("a")), G.book_name(F.col("b")), G.file_safe(F.col("c"))).first()) == ("I Promessi Sposi", "L'Amore D'Altri", "qwen3_5_9b_à")
    rows = spark.createDataFrame([(4, 70.0), (10, 60.0), (11, 35.0), (41, 1.0), (100, None)], "n int, p double").select(G.summary_steps(F.col("n")).alias("s"), G.retention_badge(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(5, "good"), (11, "good"), (14, "fair"), (48, "poor"), (113, None)]
    texts = spark.createDataFrame([('x [{"a": 1}]\n y',), ("none",), (None,)], "r string").select(G.embedded_json(F.col("r")).alias("j")).collect()
    assert [r.j for r in texts] == ['[{"a": 1}]', None, None]
    assert spark.range(1).select(G.numbered(F.array(F.lit("a"), F.lit("b")), "Parte").alias("t")).first().t == "Parte 1:\na\n\nParte 2:\nb"


def test_wordpieces(spark):
    tokens = [(1, 0, "Man", "PER"), (1, 1, "##zoni,", "PER"), (1, 2, "x", "MISC"), (1, 3, "##y!z", "LOC"), (1, 4, "Roma", "LOC"), (1, 5, "roma", "LOC"), (1, 6, "a", "PER"), (2, 0, "##om", "LOC")]
    got = E.join_wordpieces(spark.createDataFrame(tokens, "d int, at int, word string, label string"), "d", "at").collect()
    assert sorted(map(tuple, got)) == [(1, "manzoni", "PER"), (1, "roma", "LOC"), (1, "yz", "PER"), (2, "om", "")]


def test_archives_round_trip(spark):
    books = spark.createDataFrame([(1, "T", "té\nx", [1, 2]), (2, "U", None, []), (None, "V", "", None)], "id long, root string, text string, list array<int>")
    rows = {r.id: r for r in A.zip_books(A.book_entries(books, "id", "root", **{"a/t.txt": "text", "l.json": "list"}), "id").collect()}
    read = {k: {n: z.read(n).decode() for n in z.namelist()} for k, r in rows.items() for z in [zipfile.ZipFile(io.BytesIO(r.archive))]}
    assert read == {1: {"T/a/t.txt": "té\nx", "T/l.json": json.dumps([1, 2], separators=(",", ":"))}, 2: {"U/l.json": "[]"}, None: {"V/a/t.txt": ""}}
    assert {k: r.n_entries for k, r in rows.items()} == {1: 2, 2: 1, None: 1}
    assert A.zip_books(spark.createDataFrame([], "id long, path string, content string"), "id").count() == 0
