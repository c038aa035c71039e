"""Tables that are rewritten, table functions and progress: what comes again changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import tables as U
from scriptoria.operators import windows as N
from scriptoria.operators.textrows import rows_or_error
from scriptoria.sources import tables as T
from scriptoria.streaming import progress as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def section(book, idx, summary, kept=50.0, model="m:1"):
    return (book, "embed", model, idx, f"Sezione {idx}", summary, kept)


def test_partial_saves_come_again_without_change(spark, tmp_path):
    path = str(tmp_path / "summaries")
    assert T.read_partial(spark, path).count() == 0
    batches = [[section("a", 1, "uno"), section("a", 2, " \n"), section("b", 1, "bi")], [section("a", 2, "due", 100.0), section("a", 1, "uno nuovo", 0.0)]]
    for rows_ in (batches[0], batches[0], batches[1], batches[1], batches[1][:1]):  # whole and part of a batch again
        T.save_partial(spark.createDataFrame(rows_, T.SECTION), path)
    saved = T.read_partial(spark, path)
    assert sorted((r.book_name, r.model, r.section_idx, r.summary) for r in saved.collect()) == [("a", "m_1", 1, "uno nuovo"), ("a", "m_1", 2, "due"), ("b", "m_1", 1, "bi")]
    every = spark.createDataFrame([(b, "embed", "m_1", i) for b in "ab" for i in (1, 2, 3)], "book_name string, method string, model string, section_idx int")
    assert sorted((r.book_name, r.section_idx) for r in T.pending_sections(every, saved).collect()) == [("a", 3), ("b", 2), ("b", 3)]
    out = T.partial_outputs(saved, spark.createDataFrame([("a", "embed", 3)], "book_name string, method string, total_sections int")).orderBy("book_name").collect()
    assert [(r.total_sections, r.completed_sections, r.avg_ner_retention, r.global_summary, [s.section_idx for s in r.sections]) for r in out] == [(3, 2, 50.0, "", [1, 2]), (None, 1, 50.0, "", [1])]


def test_a_replayed_stream_of_sections_leaves_the_same_table(spark, tmp_path):
    for i, rows_ in enumerate(([section("a", 1, "uno")], [section("a", 2, "due"), section("a", 1, "")])):
        spark.createDataFrame(rows_, T.SECTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    said = []
    for checkpoint in ("c1", "c2"):  # the second run starts from nothing: every batch comes again
        stream = spark.readStream.schema(T.SECTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        T.stream_partials(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
        said.append(rows(T.read_partial(spark, str(tmp_path / "out"))))
    assert said[0] == said[1] and len(said[0]) == 2


BOOK = "book_id long, title string, status string"


def test_upserts_of_a_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert T.read_catalog(spark, path, BOOK).count() == 0
    first = spark.createDataFrame([(i, f"t{i}", "new") for i in range(200)], BOOK)
    assert T.upsert(first, path, "book_id", BOOK, "c1") and not T.upsert(first, path, "book_id", BOOK, "c1")
    files = {f.name for f in (tmp_path / "catalog/data/commit=c1").iterdir()}
    more = spark.createDataFrame([(3, "t3", "done"), (500, "t500", "new")], BOOK)
    assert T.upsert(more, path, "book_id", BOOK, "c2")
    assert len([f for f in (tmp_path / "catalog/data/commit=c2").iterdir() if f.name.startswith("bucket")]) <= 2 < len(files)  # only what is touched
    # a write that breaks off before its marker is not seen, and may come again
    more.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/commit=c3")
    want = sorted([(i, f"t{i}", "done" if i == 3 else "new") for i in range(200)] + [(500, "t500", "new")])
    assert sorted(map(tuple, T.read_catalog(spark, path, BOOK).collect())) == want
    assert T.upsert(more, path, "book_id", BOOK, "c3") and sorted(map(tuple, T.read_catalog(spark, path, BOOK).collect())) == want


def test_json_keeps_its_other_keys(spark):
    values = ['{"z":[1,{"q":null}],"contenuto":"aXb","n":1.5}', '{"contenuto":"ab","k":true}', '{"text":"aX"}', '{"contenuto":null}', '{"contenuto":"X\\"\\n","contenuti":2}']
    files = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "file_name string, value string")
    got = {r.file_name: json.loads(r.value) for r in T.rewritten(files, "contenuto", lambda t: F.replace(t, F.lit("X"), F.lit("é"))).collect()}
    assert got == {"0": {"z": [1, {"q": None}], "contenuto": "aéb", "n": 1.5}, "4": {"contenuto": 'é"\n', "contenuti": 2}}
    added = files.where("file_name = '2'").select(T.with_key(F.col("value"), "contenuto", F.lit("n")).alias("v")).first().v
    assert json.loads(added) == {"text": "aX", "contenuto": "n"}
    kept = files.where("file_name = '0'").select(T.with_key(F.col("value"), "contenuto", F.lit("n")).alias("v")).first().v
    assert sorted(json.loads(kept)) == ["contenuto", "n", "z"]


def test_faults_are_rows_and_are_divided(spark, tmp_path):
    def halves(n):
        yield (n // 2,)
        yield (10 // n,)

    found = rows_or_error(spark.createDataFrame([(1, 4), (2, 0), (3, None), (4, 5)], "k long, n long"), ["k"], ["n"], halves, {"half": "long"})
    said = {(r.k, r.idx): (r.half, (r.error or "").split(":")[0]) for r in found.collect()}
    assert said == {(1, 0): (2, ""), (1, 1): (2, ""), (2, 0): (None, "ZeroDivisionError"), (3, 0): (None, "TypeError"), (4, 0): (2, ""), (4, 1): (2, "")}
    T.write_divided(found, str(tmp_path / "out"))
    assert T.read_outcome(spark, str(tmp_path / "out"), "good").count() == 4 and {r.k for r in T.read_outcome(spark, str(tmp_path / "out"), "bad").collect()} == {2, 3}


def test_table_functions(spark):
    U.register(spark)
    text = "Uno due. Tre!\n\nCapitolo IV\n" + "Una frase corta. " * 200
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, w.* FROM {d} d, LATERAL ner_windows(d.text, 500, 2000, 300) w", d=docs)
    assert rows(got) == rows(N.entity_windows(docs)) and got.count() > 2
    assert spark.sql("SELECT * FROM pseudo_paragraphs('Uno due. Tre! Fine', 8)").collect()[1].text == "Tre! Fine"
    assert spark.sql("SELECT count(*) AS n FROM split_semantic(repeat('a b. ', 1000), 2000, 300)").first().n == 3


@pytest.mark.parametrize("lines", [2, 20])
def test_streamed_progress_equals_batch(spark, tmp_path, lines):
    schema = "key string, seq long, status string, detail string"
    events = [(f"k{i % 3}", i, f"s{i}", None if i % 4 == 0 else f"line {i}") for i in range(40)] + [("late", 9, "end", "b"), ("late", 2, "begin", "a"), ("quiet", 1, None, None)]
    folder = str(tmp_path / "in")
    for part in (events[1::2], events[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = P.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), lines)
        stream.writeStream.format("memory").queryName(f"progress_{lines}").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in spark.table(f"progress_{lines}").collect():  # a key's rows grow: the last has seen most
        if r.key not in last or (r.seq, len(r.log), r.log) >= (last[r.key][1], len(last[r.key][3]), last[r.key][3]):
            last[r.key] = tuple(r)
    want = {r.key: tuple(r) for r in P.progress(spark.createDataFrame(events, schema), lines).collect()}
    assert last.keys() == want.keys() and {k: v[:3] for k, v in last.items()} == {k: v[:3] for k, v in want.items()}
    assert last["late"][3] == want["late"][3] == ["a", "b"] and all(len(v[3]) <= lines for v in last.values())
