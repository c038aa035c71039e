import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts.get(form))
    for w in list(out):
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] += (root,)
    return out


def rows(found):
    got = [(r.word, (r.form, r.n, r.n_near, r.form_n, r.root)) for r in found.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("hot", [1, 7, 20_000])
def test_near_words_match_brute_force(spark, hot):
    rng = random.Random(hot)
    known = {"".join(rng.choice("aab" if i % 3 else "abà") for _ in range(rng.randint(1, 9))): rng.choice([5, 5, 6, 30, 30, 200, 5000]) for i in range(700)}
    known |= {"x" * 3000 + c: n for c, n in zip(["", "a", "b", "xa"], [5, 30, 30, 900], strict=True)}
    table = spark.createDataFrame(list(known.items()), "word string, n long")
    assert rows(spelling.variants(table, hot=hot)) == brute(known)


def test_wavelet_matrix_reports_what_lies_in_a_box():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 300):
        values = rng.permutation(size)
        boxes = rng.integers(0, size + 1, (50, 4))
        query, value = spelling.WaveletMatrix(values).report(*(boxes[:, i].astype(np.int64) for i in range(4)))
        got = sorted(zip(query.tolist(), value.tolist(), strict=True))
        assert got == sorted((q, int(v)) for q, (a, b, c, d) in enumerate(boxes) for v in values[a:b] if c <= v < d)


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows(spelling.spelling_variants(docs)) == brute(known)


def test_odd_rows(spark):
    texts = [None, "", "Straße ÀÉÎÕÜ÷× STRASSE", "letter " * 40, "lettet " * 6, "letter-letter_letterĀletter1", "l" * 50_000, "日本語 letters"]
    docs = [(i % 3 or None, t) for i, t in enumerate(texts)] * 6
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "N", "key", "base", "form")})
    assert rows(spelling.spelling_variants(table)) == brute(counted(docs))
    assert spelling.spelling_variants(table.limit(0)).collect() == []
    # typos occur: of many documents some run loses a letter
    assert any(w not in ("letter",) for d in range(4000) for w in spelling.with_typos(d, ["letter"]))
