"""Large buckets of near copies lose no pair."""

import numpy as np

from scriptoria.llm import near_copies as N


def _sets(n, seed):
    """Texts that keep different parts of one: many pairs about as similar as the threshold, few that agree in two bands."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(60)]
    return [" ".join(base[:k] + [f"x{seed}_{t}_{i}" for i in range(60 - k)]) for t, k in enumerate(rng.integers(38, 46, n))]


def test_texts_of_large_buckets_that_agree_in_one_band_are_linked(spark, monkeypatch):
    """Groups by brute force over pairs that share a band; the steps that find pairs earlier are switched off."""
    from pyspark.sql import functions as F

    texts = [t for seed in range(12) for t in _sets(6, seed * 100)]
    sets = [N.shingle_set(t) for t in texts]
    held = [set(enumerate(N.bands(s).tolist())) for s in sets]
    alone = 0
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if held[a] & held[b] and N.similar(sets[a], sets[b], 0.5):
                alone += len(held[a] & held[b]) == 1
                root = [root[b] if r == root[a] else r for r in root]
    assert alone > 20
    monkeypatch.setattr(N, "MANY", -1)
    monkeypatch.setattr(N, "NEAREST", 0)
    monkeypatch.setattr(N, "ROUNDS", 0)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("text_hash", F.xxhash64("text"))
    found = rows.join(N.linked_texts(rows.select("text_hash", "text"), 0.5), F.col("text_hash") == F.col("u"), "left").select("i", F.coalesce("v", "text_hash").alias("g")).collect()
    groups = lambda pairs: {frozenset(i for i, h in pairs if h == g) for _, g in pairs}
    assert groups([(r.i, r.g) for r in found]) == groups(list(enumerate(root)))


def test_rarest_shingles_leave_no_similar_pair_apart(spark):
    rng = np.random.default_rng(3)
    sets = {i: sorted(set(rng.choice(60, rng.integers(5, 30), replace=False).tolist() + list(range(100, 140)))) for i in range(150)}
    rows = spark.createDataFrame([(i, s) for i, s in sets.items()], "key long, s array<long>")
    held: dict[int, set] = {i: set() for i in sets}
    for r in N._rarest(rows, rows.select("key"), 0.8).collect():
        held[r.key].add(r.h)
    pairs = [(a, b) for a in sets for b in range(a) if N.similar(np.array(sets[a]), np.array(sets[b]), 0.8)]
    assert pairs and all(held[a] & held[b] for a, b in pairs)
    assert N._rarest(rows.limit(0), rows.select("key").limit(0), 0.8).count() == 0
