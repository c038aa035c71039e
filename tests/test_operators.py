import json

from pyspark.sql import functions as F

from scriptoria.operators import chunks as H
from scriptoria.operators import entities as E
from scriptoria.operators import report as R
from scriptoria.operators import summaries as M
from scriptoria.plans import more_queries, queries, registry, section_queries  # noqa: F401
from scriptoria.sources import books as B
from scriptoria.sources import sinks
from scriptoria.streaming import events as S


def test_section_hints(spark):
    rows = spark.createDataFrame([("Sezione NER 12 (parte)",), ("x",)], "h string").select(H.section_number(F.col("h")).alias("n"), H.base_topic(F.col("h")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(12, "Sezione NER 12"), (0, "x")]


def test_headings(spark):
    texts = ["CAPITOLO IV", "CAP. 3", "CANTO I", "la parte di noi", "la parte interna", "libro della vita", "capo delle guardie", "parte dei", "parte diè"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(H.is_heading(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [True, True, False, True, False, False, False, False, False]


def test_merge_spans_needs_neighbours_of_one_label(spark):
    rows = spark.createDataFrame([(1, "PER", 0, 4, 0.7), (1, "PER", 5, 8, 0.9), (1, "LOC", 9, 11, 0.8), (1, "PER", 12, 14, 0.8), (1, "PER", 20, 22, 0.8)], "d int, label string, start int, end int, score double")
    got = sorted((r.label, r.start, r.end, r.score) for r in E.merge_spans(rows, "d").collect())
    assert got == [("LOC", 9, 11, 0.8), ("PER", 0, 8, 0.9), ("PER", 12, 14, 0.8), ("PER", 20, 22, 0.8)]


def test_validity(spark):
    rows = [("PER", "Anna", 0.7), ("PER", "anna", 0.7), ("DATE", "1630", 0.7), ("DATE", "boh", 0.7), ("LOC", "il", 0.9), ("FANT", "Drago", 0.7), ("MISC", "Anna", 0.9)]
    got = spark.createDataFrame(rows, "l string, w string, s double").select(E.is_valid(F.col("l"), F.col("w"), F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, True, False, False, False, False]


def test_nearest_takes_the_earlier_of_two(spark):
    left, right = spark.createDataFrame([(1, 10), (1, 50), (2, 5)], "g int, a long"), spark.createDataFrame([(1, 8), (1, 12), (1, 45)], "g int, b long")
    got = sorted((r.g, r.a, r.b, r.is_match) for r in R.nearest(left, right, "g", "a", "b", 4).collect())
    assert got == [(1, 10, 8, True), (1, 50, 45, False), (2, 5, None, False)]


def test_budget_batches(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([5, 6, 3, 20, 1])], "g int, i int, t string")
    assert H.budget_batches(rows, ["g"], "i", "t", 10).first()["batches"] == [5, 9, 20, 1]
    empty = spark.createDataFrame([(1, 0, ""), (1, 1, "x" * 12), (1, 2, "xxx"), (2, 0, None), (2, 1, "")], "g int, i int, t string")  # a batch of one empty row is a batch
    assert {r.g: r.batches for r in H.budget_batches(empty, ["g"], "i", "t", 10).collect()} == {1: [0, 12, 3], 2: [0]}


def test_strip_think_takes_white_space_of_any_kind(spark):
    from scriptoria.functions import cleaning as C

    texts = ["<think>a</think>\n\nciao\n", "\u00a0 x\t<THINK>\n</think>\u2003\x1c", "<think>open", "a<think>1</think> b <think>2</think>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.strip_think(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["ciao", "x", "<think>open", "a b"]


def test_marks_of_the_rewriter_may_stand_in_texts(spark):
    from scriptoria.functions import cleaning as C

    texts = ["\ue000x 10\ue000y", "\ufdd0\ufdd1a\ufdd5", "0 rsino e B ello", "0\ufdd0\ufdd1 C 0 x", "\ufdd0 0\ufdd1\ufdd5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.reconnect_drop_caps(F.col("t")).alias("d"), C.contextual_rewrite(F.col("t")).alias("c")).collect()
    assert [r.d for r in rows] == ["\ue000x 10\ue000y", "\ufdd0\ufdd1a\ufdd5", "Orsino e Bello", "0\ufdd0\ufdd1 COx", "\ufdd0 0\ufdd1\ufdd5"]
    assert [r.c for r in rows[:2]] == texts[:2]


def test_retention_of_books_without_names(spark):
    words = spark.createDataFrame([("a", "Anna", "PER"), ("a", "Ro##ma", "LOC"), ("a", "Lo", "LOC"), ("b", "x", "ORG")], "book string, word string, label string")
    summaries = spark.createDataFrame([("a", "ANNA va"), ("b", "niente"), ("c", None)], "book string, summary string")
    got = {r.book: tuple(r)[1:] for r in E.retention_global(words, summaries, ["book"]).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (0, 0, 0.0), "c": (0, 0, 0.0)}


#: Boundaries of two reference texts, as judged and as found, and the tolerance.
GOLDEN = {
    "embed": ((0, 4, 13, 72, 115, 166, 218), (0, 2, 12, 13, 17, 20, 21, 72, 115, 124, 162, 166, 199, 200, 218, 237), 2),
    "ner": ((0, 5, 8, 10, 19, 27, 32, 33, 39, 44, 46, 48), (0, 2, 3, 4, 5, 7, 8, 9, 10, 11, 16, 17, 19, 20, 21, 22, 23, 24, 25, 40, 41, 42, 46), 1),
}


def test_golden_scores(spark):
    said = {}
    for name, (gold, found, tolerance) in GOLDEN.items():
        rows = [spark.createDataFrame([(name, x) for x in xs], f"book string, {c} int") for xs, c in ((gold, "g"), (found, "l"))]
        r = R.boundary_scores(*rows, tolerance, ["book"]).first()
        said[name] = (round(r.precision, 2), round(r.recall, 2), round(r.f1, 2))
    assert said == {"embed": (0.50, 1.00, 0.67), "ner": (0.52, 0.58, 0.55)}
    one = spark.createDataFrame([("a", 3)], "book string, g int"), spark.createDataFrame([("b", 3)], "book string, l int")
    assert sorted(tuple(r) for r in R.boundary_scores(*one, 0, ["book"]).collect()) == [("a", 0, 0, 0, 1, 0.0, 0.0, 0.0), ("b", 0, 1, 0, 0, 0.0, 0.0, 0.0)]


def test_books_json_and_plain_text(spark, tmp_path):
    (tmp_path / "a_one.json").write_text(json.dumps({"title": "T", "contenuto": "ciao", "author": {"name": "N"}}))
    (tmp_path / "b_two.json").write_text("not json")
    got = sorted((r.file_name, r.title, r.text) for r in B.read_books(spark, str(tmp_path)).collect())
    assert got == [("a_one.json", "T", "ciao"), ("b_two.json", None, "not json")]


def test_books_by_pattern_and_in_order(spark, tmp_path):
    for name in ("b.json", "a.jsonl", "c.txt", "A.json"):
        (tmp_path / name).write_text('{"text": "x"}')
    assert [r.file_name for r in B.read_books(spark, str(tmp_path), "*.json*", ordered=True).collect()] == ["A.json", "a.jsonl", "b.json"]
    assert B.read_books(spark, str(tmp_path)).count() == 4


def test_entity_strings(spark):
    rows = [(1, [("PER", "An##na"), ("LOC", " Roma "), ("PER", "Anna"), ("ORG", "Fiat"), ("LOC", "Po"), ("LOC", None)]), (2, [("DATE", "1630")]), (3, [])]
    found = spark.createDataFrame(rows, "k int, e array<struct<label:string,word:string>>").select("k", M.entity_string(F.col("e")).alias("s")).collect()
    assert {r.k: r.s for r in found} == {1: "Anna, Roma", 2: "Nessuna entità specifica", 3: "Nessuna entità specifica"}


def test_first_last_and_latest_rows(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, None, "z"), (2, None, "y"), (None, 5, "n")], "k int, o int, v string")
    assert {(r.k, r.o, r.v) for r in B.latest(rows, ["k"], "o").collect()} == {(1, 2, "b"), (2, None, "y"), (None, 5, "n")} == {(r.k, r.o, r.v) for r in E.last_wins(rows, ["k"], "o").collect()}
    assert {(r.k, r.v) for r in E.first_wins(rows, ["k"], "o").collect()} == {(1, "z"), (2, "y"), (None, "n")}


def test_numbers_and_neighbours_over_buckets(spark):
    """Against windows over whole groups: a hot group, null groups and orders, gaps, one row, no rows."""
    from pyspark.sql import Window

    from scriptoria.operators import ordering as O

    rows = spark.createDataFrame([("a" if i % 3 else None if i % 2 else "b", i * i - 50, f"v{i}") for i in range(200)] + [("c", 7, None), ("d", None, "x"), ("d", 3, "y")], "g string, o long, v string")
    w = Window.partitionBy("g").orderBy("o")
    for buckets in (1, 7, 4096):
        want = {tuple(r) for r in rows.select("g", "o", "v", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p")).collect()}
        got = O.with_previous(O.numbered(rows, ["g"], "o", "n", buckets), ["g"], "o", "v", "p", buckets)
        assert {(r.g, r.o, r.v, r.n, r.p) for r in got.collect()} == want and got.count() == 203
    assert O.numbered(rows.limit(0), ["g"], "o").count() == O.with_previous(rows.limit(0), ["g"], "o", "v", "p").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/e"))
    S.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == events.count() and back.exceptAll(events).count() == 0


def test_stream_windows_equal_batch(spark, tmp_path):
    """Windows over a file stream hold the rows of the same functions over the table."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", S.tumbling), ("sliding", S.sliding)):
        stream = f(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="90 days")
        stream.writeStream.format("memory").queryName(f"s_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        got, want = spark.table(f"s_{name}").drop("total"), f(events.withColumn("ts", F.col("ts").cast("timestamp"))).drop("total")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0


def test_streamed_sessions_equal_batch(spark, tmp_path):
    """All events, then one of the far future whose watermark closes their sessions, then one more that lets them out."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    for years in (50, 51):
        late = events.limit(1).withColumn("ts", F.col("ts") + F.make_interval(F.lit(years))).withColumn("user_id", F.lit(-years).cast(events.schema["user_id"].dataType))
        late.coalesce(1).write.mode("append").parquet(folder)
    stream = S.sessions(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder), late="1 hour")
    stream.writeStream.format("memory").queryName("s_sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got, want = spark.table("s_sessions").where("user_id > -50"), S.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_chunks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("embed", "b", i, f"h{i}", 0, 3, "abc") for i in range(3)], "method string, book_name string, chunk_id int, topic_hint string, char_start int, char_end int, text string")
    sinks.write_chunks(rows, str(tmp_path / "c"))
    assert sinks.manifest(spark.read.parquet(str(tmp_path / "c"))).first()["total_chunks"] == 3


def test_every_query_runs_small(spark):
    for q in registry.queries().values():
        q(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()


def test_split_covers_the_text():
    from scriptoria.operators.splitting import split

    text = "Una frase. " * 700 + "x" * 5000 + "\n\n" + "Fine! " * 300
    pieces = split(text)
    assert all(len(p) <= 2001 for p, _, _ in pieces) and pieces[0][1] == 0  # a stop right behind a piece goes with it
    assert all(b <= e and b > a for (_, a, e), (_, b, _) in zip(pieces, pieces[1:], strict=False)) and text.strip().endswith(pieces[-1][0])
    assert split(None) == [] and split(" ") == [] and split("ab") == [("ab", 0, 2)]
    shift = split("a. " * 1000, entities=[(i, "x" if i < 1850 else "y") for i in range(0, 3000, 50)])
    assert shift[0][2] <= 1852


def test_fuzzy(spark):
    rows = spark.createDataFrame([("anna", "annalisa"), ("la spezia", "laspezia"), ("ab", "cabo"), ("roma", "pisa")], "a string, b string").select(E.fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in rows] == [True, True, False, False]


def test_entity_windows_cover_sections():
    from scriptoria.operators.windows import heading_sections, paragraphs, runs, sentence_spans, windows

    text = "Prologo.\n\nCAPITOLO IV\n" + "Una frase corta. " * 300 + "\n\n" + "y" * 2600 + "\n\nCanto 2\nFine."
    assert [h for _, _, h in heading_sections(text)] == [None, "CAPITOLO IV", "Canto 2"]
    assert heading_sections("x") == [(0, 1, None)] and windows(None) == [] and windows(" \n\n ") == []
    assert paragraphs("a\n\n\nb\n \n\n", 0, 9) == [(0, 1), (4, 7)]
    spans = sentence_spans(text, 0, len(text), 500, 2000)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert runs([(0, 600), (600, 1200), (1200, 2300)], 500, 2000, 0) == [(0, 1), (2, 2)]
    got = windows(text)
    assert all(text[s:e].strip() == t and t for _, _, s, e, t in got) and got[0][1] is None and got[-1][1] == "Canto 2"
    covered = set().union(*(range(s, e) for _, _, s, e, _ in got))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    sliding = windows("z" * 5000)
    assert [(s, e) for _, _, s, e, _ in sliding] == [(0, 2000), (1700, 3700), (3400, 5000)]


def _snap(text, start, end):
    parts, s, e = set(" \n'\"()[]{}.,;:!?-–—/\\"), start, end
    while s > 0 and start - s < 2 and text[s - 1] not in parts:
        s -= 1
    while s < e and s - start < 2 and text[s] in parts:
        s += 1
    while e < len(text) and e - end < 2 and text[e] not in parts:
        e += 1
    while e > s and end - e < 2 and text[e - 1] in parts:
        e -= 1
    return s, e


def test_snap_matches_a_loop(spark):
    from scriptoria.operators import reading as D

    text = "Ecco, (Anna)  e Marco-Polo... à Roma/Pisa"
    rows = [(text, s, e) for s in range(len(text)) for e in range(s, min(len(text), s + 7) + 1)]
    got = spark.createDataFrame(rows, "t string, s int, e int").withColumn("x", D.snap(F.col("t"), F.col("s"), F.col("e"))).collect()
    assert [tuple(r.x) for r in got] == [_snap(r.t, r.s, r.e) for r in got]
    trimmed = spark.createDataFrame([(" (Anna). ", 0, 9), ("...", 0, 3)], "t string, s int, e int").select(D.trim_span(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()
    assert [tuple(r.x) for r in trimmed] == [(2, 6), (3, 3)]


def test_highlight(spark):
    from scriptoria.operators import reading as D

    rows = [("a <Roma> di Roma Nuova\nx", [("LOC", "Roma"), ("LOC", "Roma Nuova"), ("PER", "Roma")]), ("a&b", []), ("c++ (x)", [("ORG", "c++"), ("ORG", "(x)")])]
    got = spark.createDataFrame(rows, "t string, e array<struct<label:string,word:string>>").select(D.highlight(F.col("t"), F.col("e")).alias("h")).collect()
    mark = lambda label, w: f'<span class="hl-{label.lower()}" title="{label}">{w}</span>'
    assert [r.h for r in got] == [f"a &lt;{mark('LOC', 'Roma')}&gt; di {mark('LOC', 'Roma Nuova')}<br>x", "a&amp;b", f"{mark('ORG', 'c++')} {mark('ORG', '(x)')}"]


def test_one_to_one(spark):
    from scriptoria.operators import reading as D

    rows = [(["anna", "anna", "roma", "ab"], ["annalisa", "roma", "anna"]), ([], ["x"]), (["x"], [])]
    got = spark.createDataFrame(rows, "g array<string>, f array<string>").select(D.match_one_to_one(F.col("g"), F.col("f")).alias("m")).collect()
    assert [[tuple(p) for p in r.m] for r in got] == [[("anna", "annalisa"), ("anna", "anna"), ("roma", "roma")], [], []]


def test_exports(spark):
    rows = spark.createDataFrame([("b", 2, "Due", " fine "), ("b", 1, None, "inizio"), ("b", 3, "Tre", " ")], "book string, i int, topic_hint string, summary string")
    assert sinks.joined_summaries(rows, "book", "i").first()["text"] == "=== Sezione 1 ===\n\ninizio\n\n" + "=" * 60 + "\n\n=== Due ===\n\nfine"
    book = spark.createDataFrame([("T", None, "m", "ner", "2026-01-02T03:04", "parola " * 30 + "\n\nfine")], "title string, author string, model string, method string, created_at string, summary string")
    got = sinks.synopsis(book).first()
    known = json.loads(got.json)
    assert (known["autore"], known["data_generazione"], known["num_parole"]) == ("N/D", "2026-01-02", 31)
    assert all(len(x) <= 100 for x in got.text.split("\n")) and got.text.endswith("\n\nfine")


def test_clean_span(spark):
    got = spark.createDataFrame([(" .Anna  Bolena. ",), ("-",), ("«x»",)], "w string").select(E.clean_span(F.col("w")).alias("w")).collect()
    assert [r.w for r in got] == ["Anna Bolena", "", "«x»"]


def test_fuzzy_pairs_take_all_words(spark, tmp_path):
    """A pair of words beyond the five most frequent ones is found."""
    from scriptoria.plans import queries as Q

    spark.createDataFrame([(1, "Uno Uno Due Due Tre Tre Nove Nove Otto Otto Anna Annalisa Lisa"), (2, "Anna"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in Q.fuzzy_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, "anna", "annalisa"), (1, "annalisa", "lisa")}


def test_cross_pairs_go_by_number(spark):
    rows = spark.createDataFrame([("b", s, i) for i, s in enumerate([1, 2, 50, 51, 100])], "g string, s long, o long")
    assert sorted((r.a, r.b) for r in R.cross_pairs(rows, "g", "s", "o").collect()) == [(1, 50), (2, 50), (50, 100), (51, 100)]


def test_first_seen_label_and_counts(spark):
    spans = spark.createDataFrame([(2, 0, "Anna ", "LOC"), (1, 5, "Anna", "PER"), (1, 9, "Anna", "ORG")], "doc_id long, pos int, word string, label string")
    assert [tuple(r) for r in E.word_counts(spans).collect()] == [("Anna", 3, "PER")]
    firsts = E.first_wins(spans.withColumn("k", F.lit(1)), ["k"], "pos").collect()
    assert [r.pos for r in firsts] == [0]


def test_spans_have_real_offsets(spark):
    docs = spark.createDataFrame([(1, "è Anna e Marco"), (2, None), (3, "")], "doc_id long, text string")
    spans = E.extract_spans(docs)
    assert [(r.word, r.start, r.end) for r in spans.orderBy("pos").collect()] == [("Anna", 2, 6), ("Marco", 9, 14)]
    chunks = spark.createDataFrame([(1, 0, 7), (1, 7, 14), (1, 14, 20), (2, 0, 1)], "doc_id long, char_start int, char_end int")
    got = sorted(tuple(r) for r in E.entity_counts(chunks, spans, "doc_id").collect())
    assert got == [(1, 0, 1), (1, 7, 1), (1, 14, 0), (2, 0, 0)]


def test_retention_report(spark):
    rows = spark.createDataFrame([([("PER", "An##na"), ("LOC", "Roma"), ("ORG", "Fiat"), ("PER", "Al")], "ROMA e altro"), ([], "x")], "e array<struct<label:string,word:string>>, s string")
    got = [tuple(r.r) for r in rows.select(E.retention_report(F.col("e"), F.col("s")).alias("r")).collect()]
    assert got == [(50.0, 2, ["roma"], ["anna"]), (100.0, 0, [], [])]


def test_text_key_by_presence(spark, tmp_path):
    for name, said in (("a", {"contenuto": None, "text": "no"}), ("b", {"text": "t"}), ("c", {"content": "c"}), ("d", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(said))
    assert [r.text for r in B.read_books(spark, str(tmp_path)).orderBy("file_name").collect()] == [None, "t", "c", ""]
    assert [r.t for r in spark.createDataFrame([("ab12_la-mia-vita.json",)], "f string").select(B.title_of(F.col("f")).alias("t")).collect()] == ["La Mia Vita"]


def test_validity_cleans_first(spark):
    got = spark.createDataFrame([("PER", "«Anna»", 0.9), ("PER", " (Anna). ", 0.9), ("LOC", ".il.", 0.9)], "l string, w string, s double").select(E.is_valid(F.col("l"), F.col("w"), F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [True, True, False]


def test_base_chunks_match_a_loop(spark):
    from scriptoria.operators import builders
    from scriptoria.operators.splitting import split

    texts = {1: "Anna vede Marco. " * 150 + "Poi Roma e Pisa. " * 150, 2: "Breve.", 3: None, 4: "Lucca e Siena"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    spans = E.extract_spans(docs)
    held = {}
    for r in spans.orderBy("doc_id", "start").collect():
        held.setdefault(r.doc_id, []).append((r.start, r.end, f"{r.label}:{r.word.lower()}"))
    want = []
    for d, text in texts.items():
        pieces = split(text, entities=[(s, k) for s, _, k in held.get(d, [])])
        for i, (t, a, b) in enumerate(pieces, 1):
            keys = [k for s, e, k in held.get(d, []) if s >= a and e <= b]
            want.append((d, i, t, a, b, f"Chunk NER {i}", len(keys), sorted(set(keys)), len(pieces)))
    got = sorted((r.doc_id, r.chunk_id, r.text, r.char_start, r.char_end, r.topic_hint, r.num_entities, r.keys, r.total_chunks) for r in builders.base_chunks(docs, spans).collect())
    assert got == sorted(want) and len(got) > 4
    rows = spark.createDataFrame([(1, 1, 1, 0, 5), (1, 1, 2, 5, 9), (1, 2, 3, 9, 12)], "doc_id long, chapter_id int, section int, char_start int, char_end int")
    assert sorted(tuple(r) for r in builders.chapter_metadata(rows).collect()) == [(1, 1, [1, 2], 0, 9, 2, "Capitolo NER 1"), (1, 2, [3], 9, 12, 1, "Capitolo NER 2")]


def test_batched_sections(spark):
    rows = [(1, 1, "a" * 6), (1, 2, "b" * 7), (1, 3, None), (2, 1, None), (3, 1, "x" * 30), (3, 2, "y"), (4, 1, "ab"), (4, 2, "abc")]
    said = M.batched_sections(spark.createDataFrame(rows, "g long, o long, text string"), "g", "o", 10, lambda t: F.concat(F.lit("<"), F.replace(t, F.lit("\n\n"), F.lit("|")), F.lit(">")))
    assert dict(map(tuple, said.collect())) == {1: "<<aaaaaa>|<" + "b" * 7 + "|>>", 2: "<>", 3: "<<" + "x" * 30 + ">|<y>>", 4: "<ab|abc>"}


def test_chunks_by_book_and_manifest(spark, tmp_path):
    rows = [("m", b, i, f"hint {i}", f"{b}{i}", 0, 2) for b in "ab" for i in (2, 1)]
    chunks = spark.createDataFrame(rows, "method string, book_name string, chunk_id int, topic_hint string, text string, char_start int, char_end int")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    read = B.read_chunks(spark, str(tmp_path / "chunks"), "m", "b")
    assert [r.text for r in read.collect()] == ["b1", "b2"]
    listed = B.listed_chunks(sinks.manifest(chunks), chunks.where("text <> 'a1'"))
    assert sorted(r.text for r in listed.collect()) == ["a2", "b1", "b2"]


def test_snap_every_looks_at_no_whole_text(spark, capsys):
    """Stretches against spans cut from whole texts, with their borders and signs beyond 16 bits; spans are looked up in stretches."""
    from scriptoria.operators import reading as D

    texts = [("ab, c'😀à-" * 300)[i : i + n] for i, n in enumerate((0, 1, 5, 6, 19, 20, 21, 199, 200, 201, 203, 205, 207, 2000, 2003))]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    found = D.snap_every(docs, 2, 5)
    want = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(2))).alias("at"))
    want = want.withColumn("s", D.snap(F.col("text"), F.col("at"), F.least(F.col("at") + 5, F.length("text")))).select("doc_id", "at", "s.start", "s.end")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_cross_pairs_sort_no_group_as_a_whole(spark):
    """Against a loop, with groups and sections without a name or number; a window sees only rows that a limit lets through."""
    rows = [(g, (i * i) // 7, i) for g, n in (("a", 200), ("b", 5), ("c", 3), (None, 40)) for i in range(n) for _ in range(2)] + [("a", None, 999)]
    table = spark.createDataFrame(rows, "g string, s long, o int")
    found = R.cross_pairs(table, "g", "s", "o", 7)
    want = []
    for g in ("a", "b", "c", None):
        named = sorted({s for h, s, _ in rows if h == g and s is not None})
        gap = max(3, (len(named) + (g == "a")) // 3)
        want += [(g, s, min(t for t in named if t - s >= gap)) for s in named if named[-1] - s >= gap][:7]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == plan.count("WindowGroupLimit") == 1
