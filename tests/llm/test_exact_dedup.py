import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import exact_dedup
from scriptoria.llm.common import LOWER, UPPER

CASES = [
    (1, "Ab"), (2, "aB"), (3, "ab "), (4, None), (5, ""), (None, "ab"), (None, "only null"), (None, "ONLY NULL"), (7, "twice"), (7, "twice"), (7, "Twice"), (6, "twice"), (8, "ÀB"), (9, "àb"), (10, "X" * 300_000), (11, "x" * 300_000),
    *[(100 + i, "hot") for i in range(200)],
]


def norm(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def expected(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows each (text, doc_id) keeps."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    best = {t: max(ids, key=lambda x: (x is not None, x or 0)) for t, ids in groups.items()}
    said = Counter((i, best[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    return said, Counter((i, hashlib.sha256(t.encode()).hexdigest()) for t, i in best.items())


def check(found, rows):
    found = found.collect()
    said, kept = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == said
    assert Counter((r.doc_id, r.text_sha256) for r in found if r.kept) == kept


@pytest.mark.parametrize("shares", [1000, 2])
@pytest.mark.parametrize("weak", [False, True])
def test_marks_match_brute_force(spark, shares, weak):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").repartition(7).withColumns({n: F.lit("mine") for n in ("digest", "row", "Kept", "keep_id", "salt", "at")})
    digest = (lambda t: F.pmod(F.length(t), F.lit(3))) if weak else exact_dedup.sha256
    check(exact_dedup.mark_duplicates(docs, digest=digest, shares=shares, salts=3), CASES)


def test_documents_and_rows_that_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(exact_dedup.mark_duplicates(docs), rows)
    stay = exact_dedup.keep_last(docs.withColumn("row", F.lit(1)))
    assert stay.columns == [*docs.columns, "row"] and Counter((r.doc_id,) for r in stay.collect()) == Counter((i,) for (i, _), n in expected(rows)[1].items() for _ in range(n))
    assert exact_dedup.mark_duplicates(docs.limit(0)).collect() == [] and exact_dedup.keep_last(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.mark_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
