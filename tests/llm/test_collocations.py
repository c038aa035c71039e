import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import collocations as co
from scriptoria.llm.common import LOWER, UPPER


def grams(rows, depth=4):
    """Counter of (lang, phrase as a tuple), and words by lang."""
    out, n = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").translate(str.maketrans(UPPER, LOWER))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, depth + 1):
                out.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return out, n


def brute(rows, least=30, top=2000, depth=4):
    f, n = grams(rows, depth)
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {lang: [(i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])] for lang, found in out.items()}


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return out


@pytest.mark.parametrize("size", [40, 400, 8_000_000])
def test_counts_of_shards_are_those_of_texts(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["a ", "b ", "a\t", "é  ", ". ", "c,", "dd ", "\x00 "]) for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["", "   ", "x" * 500, "y " * 100, ". . .", "a " + "z" * 100 + " b c d e f"]
    want = grams([("en", t) for t in texts])[0]
    got, tokens = Counter(), [p for t in texts for p in co.pieces(t.encode().translate(co._TABLE), size)]
    for i in range(0, len(tokens), 7):
        automaton = co.Automaton(co.Tokens(tokens[i : i + 7]), 4)
        for k in range(1, 5):
            phrases, counts = automaton.phrases(k)
            for p, c in zip(phrases.to_pylist(), counts.tolist(), strict=True):
                got["en", tuple(p.split(" "))] += c
            level = automaton.levels[k - 1]
            if k > 1:  # a suffix link leads to what ends at least as often
                assert (level.count <= automaton.levels[k - 2].count[level.link]).all()
    assert got == want


@pytest.mark.parametrize("shares", [1, 1000])
def test_collocations_match_brute_force(spark, monkeypatch, shares):
    monkeypatch.setattr(co, "SHARES", shares)
    rng = random.Random(5)
    vocabulary = ["the", "Of", "in", "ça", "日本", "x"] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(vocabulary[: rng.choice([4, 36])]) + rng.choice([" "] * 9 + ["\t", ". ", "\n", " New York City "]) for _ in range(rng.randint(0, 200)))) for _ in range(120)]
    rows += [("de", None), (None, None), ("de", ""), ("en", "New York City; " * 500), ("one", "word " * 29), ("two", "aa bb " * 30), ("two", "aa bb")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("mine") for c in ("phrase", "f", "k", "Rank", "score")})
    assert lists(co.collocations(docs)) == brute(rows)
    assert lists(co.collocations(docs, least=3, top=15)) == brute(rows, 3, 15)
    assert lists(co.collocations(docs, depth=2)) == brute(rows, depth=2)
    assert co.collocations(docs.limit(0)).collect() == []


def test_small_shards_and_full_bitmaps_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows)
    assert lists(co.collocations(docs)) == want
    monkeypatch.setattr(co, "MOST_BITS", 64)
    monkeypatch.setattr(co, "_BLOCK_BITS", 8)
    counts = co.frequent_phrases(docs, size=3000)
    f, n = grams(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.where("k > 0").collect()} == {g: a for g, a in f.items() if a >= 30}
    assert {r.lang: r.f for r in counts.where("k = 0").collect()} == n
