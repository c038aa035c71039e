"""LM scoring by a class bigram model: p(word | word before) = p(class | class before) * p(word | class).

All counts are gathered from every training document. Words seen LEAST times or more that make up at least 1/FREQUENT of all
training tokens (so at most FREQUENT words, a bound on what is broadcast) are assigned to classes by exchange clustering: the TOP
most frequent ones one by one on their counts, until none moves or SEED_SWEEPS times; then all of them in parallel sweeps over the corpus, in which each word
moves to the class that raises the class bigram likelihood most. The first sweep inserts the words beyond TOP; later ones move
half of the words each, and end when the likelihood grows by less than GROWTH of itself or falls (the last moves are then taken
back), or after SWEEPS. The number of classes is the cube root of the training tokens, from 8 to CLASSES. Rarer and unseen words belong
to classes of their form (length, signs, script), known from the word alone, and meet their own counts in a join. All probabilities are
smoothed by added counts.

Texts are coded once, in pieces of some SLICE_BYTES, as class-model types in a table of the shared folder; everything after the word
counts reads that table. A very long text is several pieces, of which each knows the type before it: the score is the same.

Words are told apart by XXH64: c, V and n_known are exact as long as no two words of the corpus collide (by chance one in 10^7 at 2 million words).

Defined cases: null text is empty: one token, its end; null doc_ids are never held out; rows are scored one by one, repeated or not; with no
training documents all counts are zero and scores finite; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TOP, CLASSES, FORMS = 512, 128, 32
FREQUENT, LEAST = 1 << 20, 2
SEED_SWEEPS, SWEEPS, GROWTH = 5, 4, 0.001
ADD_WORD, ADD_CLASS = 0.5, 0.1
SLICE_BYTES = 2_000_000
#: Words or cells that a task holds before it hands them on; buckets of words that are summed together.
HELD, BUCKETS = 1 << 20, 64


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


_GAP = re.compile(rb"[\x09-\x0D\x20]")


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Rows, whether the row's text ends with it, and pieces of their texts (strings), of some SLICE_BYTES in all. Texts are divided at gaps between words."""
    rows: list[int] = []
    last: list[bool] = []
    held: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        data, start = memoryview(text.as_buffer()) if text.is_valid else memoryview(b""), 0
        while True:
            end = min(len(data), start + SLICE_BYTES)
            if end < len(data):
                gap = _GAP.search(data, end)
                end = gap.start() if gap else len(data)
            rows.append(row)
            last.append(end == len(data))
            held.append(bytes(data[start:end]))
            size += end - start
            if size >= SLICE_BYTES:
                yield np.array(rows), np.array(last), pa.array(held, pa.large_binary()).view(pa.large_string())
                rows, last, held, size = [], [], [], 0
            if end == len(data):
                break
            start = end
    if rows:
        yield np.array(rows), np.array(last), pa.array(held, pa.large_binary()).view(pa.large_string())


def _form(word: bytes) -> int:
    return min(len(word) // 3, 7) + 8 * (max(word) > 127) + 16 * (not (97 <= word[-1] <= 122 or word[-1] > 127))


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the row and the code of each word, and the codes' hashes and forms."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, rows = lists.flatten(), np.asarray(pc.list_parent_indices(lists), dtype=np.int32)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    coded = words.dictionary_encode()
    del words, lists
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype="u8", count=len(distinct)).view("i8")
    forms = np.fromiter((_form(w) if w else 0 for w in distinct), dtype=np.int64, count=len(distinct))
    return rows[full], np.asarray(coded.indices)[full], h, forms


class _Summed:
    """Counts by key, handed on as sorted keys and sums whenever more than HELD are held."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return keys, counts

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is time to take."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD:
            keys, counts = self.taken()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size > HELD // 2


def word_counts(train: DataFrame) -> DataFrame:
    """h (the word's hash), form, n; one row for each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Summed()

        def out() -> pa.RecordBatch:
            keys, counts = held.taken()
            return pa.RecordBatch.from_arrays([pa.array(keys["h"]), pa.array(keys["form"]), pa.array(counts)], names=["h", "form", "n"])

        for batch in batches:
            for _, _, texts in _pieces(batch.column(0)):
                _, codes, h, forms = encode(texts)
                n = np.bincount(codes, minlength=len(h))
                at = np.flatnonzero(n)
                keys = np.zeros(len(at), dtype=[("h", "i8"), ("form", "i8")])
                keys["h"], keys["form"] = h[at], forms[at]
                if held.add(keys, n[at]):
                    yield out()
        if held.size:
            yield out()

    return train.select("text").mapInArrow(run, "h long, form long, n long").groupBy("h").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
    """values[i] where keys[i] (sorted) is wanted, else other."""
    if not len(keys):
        return np.asarray(other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


CODED = "_row long, doc_id long, held_out boolean, before int, last boolean, types binary, tail array<struct<h:bigint,form:int,tf:int>>"


def coded_texts(docs: DataFrame, keys: np.ndarray, types: np.ndarray, words: int) -> DataFrame:
    """Pieces of docs (_row, doc_id, held_out, text) as types (little-endian int32): below words the word's, then one for each form;
    before: the type before the piece, -1 at a text's start; tail: words of no type of their own."""
    held = docs.sparkSession.sparkContext.broadcast((keys, types.astype(np.int32)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = held.value
        for batch in batches:
            open_row, before = -1, -1
            for rows, last, texts in _pieces(batch.column(3)):
                m = len(rows)
                at, codes, h, forms = encode(texts)
                kind = _look_up(keys, own, h, (words + forms).astype(np.int32)).astype("<i4")[codes]
                ends = np.searchsorted(at, np.arange(1, m + 1))
                starts = np.concatenate([[0], ends[:-1]])
                ahead = np.full(m, -1, dtype=np.int32)
                if rows[0] == open_row:
                    ahead[0] = before
                open_row, before = (-1, -1) if last[-1] else (rows[-1], kind[-1] if ends[-1] > starts[-1] else ahead[-1])
                rare = kind >= words
                cells, tf = np.unique(at[rare].astype(np.int64) * max(1, len(h)) + codes[rare], return_counts=True)
                of, code = cells // max(1, len(h)), cells % max(1, len(h))
                tail = pa.StructArray.from_arrays([pa.array(h[code]), pa.array(forms[code].astype(np.int32)), pa.array(tf.astype(np.int32))], names=["h", "form", "tf"])
                offsets = pa.array(np.searchsorted(of, np.arange(m + 1)).astype(np.int32))
                listed = pa.ListArray.from_arrays(offsets, tail)
                data = pa.array([kind[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
                some = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), batch.column(2).take(some), pa.array(ahead), pa.array(last), data, listed], names=["_row", "doc_id", "held_out", "before", "last", "types", "tail"])

    return docs.select("_row", "doc_id", "held_out", "text").mapInArrow(run, CODED)


def _transitions(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches (before, last, types first) with, for each transition in them, its piece and the types before and after; end stands at both ends of a text."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(2)), dtype=np.int64).cumsum()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES)))
            part = batch.slice(start, stop - start)
            start = stop
            data = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column(2)]
            lens = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
            kind = np.concatenate(data)
            ahead, last = np.asarray(part.column(0)), np.asarray(part.column(1).to_pylist(), dtype=bool)
            ahead = np.where(ahead < 0, end, ahead)
            ends = lens.cumsum()
            full = lens > 0
            prev = np.empty_like(kind)
            prev[1:] = kind[:-1]
            prev[(ends - lens)[full]] = ahead[full]
            final = ahead.copy()
            final[full] = kind[ends[full] - 1]
            rows = np.arange(len(data))
            yield part, np.concatenate([np.repeat(rows, lens), rows[last]]), np.concatenate([prev, final[last]]), np.concatenate([kind, np.full(int(last.sum()), end, dtype=kind.dtype)])


def class_bigrams(coded: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """Counts of neighbouring classes (k by k) over all training texts. of: each type's class; the last type is a text's end."""
    held = coded.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = held.value, np.zeros(k * k, dtype=np.int64)
        for _, _, p, q in _transitions(batches, len(of) - 1):
            total += np.bincount(of[p] * k + of[q], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(k * k, dtype=np.int64)
    found = coded.where("NOT held_out").select("before", "last", "types").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(found.column("cell"), dtype=np.int64)] = np.asarray(found.column("n"), dtype=np.int64)
    return out.reshape(k, k)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(pairs: np.ndarray) -> float:
    """The class bigram log-likelihood, but for what no exchange changes."""
    return float(_f(pairs).sum() - _f(pairs.sum(0)).sum() - _f(pairs.sum(1)).sum())


def exchange_clusters(bigrams: np.ndarray, top: int = TOP, classes: int = CLASSES, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """The class of each type: those from top on stay alone (classes, classes + 1, ...); the first top types are exchanged
    among classes 0 to classes - 1 as long as the class bigram likelihood grows, until none moves, or sweeps times."""
    types = bigrams.shape[0]
    n = bigrams.astype(np.float64)
    of = np.concatenate([np.arange(top) % classes, classes + np.arange(types - top)])
    k = classes + types - top
    member = np.zeros((types, k))
    member[np.arange(types), of] = 1
    cc = member.T @ n @ member
    out, into = cc.sum(1), cc.sum(0)
    some = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(top):
            after, before, own = np.bincount(of, n[w], k), np.bincount(of, n[:, w], k), n[w, w]
            if not after.any() and not before.any():
                continue
            c = of[w]
            after[c] -= own
            before[c] -= own
            cc[c] -= after
            cc[:, c] -= before
            cc[c, c] -= own
            leaves, comes = after.sum() + own, before.sum() + own
            out -= before
            into -= after
            out[c] -= leaves
            into[c] -= comes
            right, left = np.flatnonzero(after), np.flatnonzero(before)
            row, col = cc[:classes, right], cc[left, :classes].T
            gain = (_f(row + after[right]) - _f(row)).sum(1) + (_f(col + before[left]) - _f(col)).sum(1)
            diagonal = cc[some, some]
            gain += _f(diagonal + after[some] + before[some] + own) - _f(diagonal + after[some]) - _f(diagonal + before[some]) + _f(diagonal)
            o, t = out[:classes], into[:classes]
            gain -= _f(o + leaves) - _f(o) + _f(t + comes) - _f(t)
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[c] + 1e-6 else c
            moved += best != c
            of[w] = best
            cc[best] += after
            cc[:, best] += before
            cc[best, best] += own
            out += before
            into += after
            out[best] += leaves
            into[best] += comes
        if not moved:
            break
    return of


def best_classes(after: np.ndarray, before: np.ndarray, current: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words, each by itself: the class whose transitions make its neighbours likeliest, and how much more so than those of its current one.

    after, before: counts of the classes next to a word; pairs: the class bigrams, the words' own counts included, which are taken
    from the word's current class."""
    k, n = len(pairs), pairs.astype(np.float64)
    out, into = n.sum(1), n.sum(0)
    right = np.log((n[:classes] + ADD_CLASS) / (out[:classes, None] + ADD_CLASS * k)).T
    left = np.log((n[:, :classes] + ADD_CLASS) / (into[:classes] + ADD_CLASS * k))
    best, gain = np.zeros(len(after), dtype=np.int64), np.zeros(len(after))
    for i in range(0, len(after), 1024):
        x, y, c = after[i : i + 1024].astype(np.float64), before[i : i + 1024].astype(np.float64), current[i : i + 1024]
        value = x @ right + y @ left
        held, own = c < classes, np.minimum(c, classes - 1)
        row, col = np.maximum(n[own] - x, 0), np.maximum(n[:, own].T - y, 0)
        stay = (x * np.log((row + ADD_CLASS) / (row.sum(1, keepdims=True) + ADD_CLASS * k))).sum(1) + (y * np.log((col + ADD_CLASS) / (col.sum(1, keepdims=True) + ADD_CLASS * k))).sum(1)
        at = np.arange(len(x))
        value[at[held], own[held]] = stay[held]
        best[i : i + 1024] = np.argmax(value, axis=1)
        gain[i : i + 1024] = np.where(held, value[at, best[i : i + 1024]] - stay, np.inf)
    return best, gain


def best_moves(coded: DataFrame, of: np.ndarray, pairs: np.ndarray, words: int, classes: int, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, class, gain of the words w (below words) with w % part[0] == part[1], or from part[1] on if part[0] is 0: the class that
    suits each best given all others'. Counts of (word, side, class) are summed in tasks, then by bucket of words, as packed arrays."""
    k = pairs.shape[0]
    buckets = max(1, min(BUCKETS, words // 64))
    held = coded.sparkSession.sparkContext.broadcast((of.astype(np.int32), pairs))
    wide = np.int64(2 * k)

    def chosen(w: np.ndarray) -> np.ndarray:
        return (w < words) & ((w % part[0] == part[1]) if part[0] else (w >= part[1]))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held_cells = held.value[0], _Summed()

        def out() -> pa.RecordBatch:
            keys, counts = held_cells.taken()  # by bucket, then word, side, class
            cuts = np.searchsorted(keys >> 40, np.arange(buckets + 1))
            some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            cells = [(keys[cuts[b] : cuts[b + 1]] & ((1 << 40) - 1)) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.diff(c, prepend=0).astype("<u4").tobytes() for c in cells], pa.binary()), pa.array([counts[cuts[b] : cuts[b + 1]].astype("<u4").tobytes() for b in some], pa.binary())], names=["bucket", "cells", "counts"])

        for _, _, p, q in _transitions(batches, len(of) - 1):
            for w, other, side in ((p, q, 0), (q, p, 1)):
                mine = chosen(w)
                w = w[mine].astype(np.int64)
                keys, counts = np.unique((w % buckets) << 40 | (w // buckets * wide + side * k + of[other[mine]]), return_counts=True)
                if held_cells.add(keys, counts):
                    yield out()
        if held_cells.size:
            yield out()

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = held.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, cells, counts in zip(*batch.columns, strict=True):
                b = bucket.as_py()
                if b not in sums:
                    sums[b] = np.zeros(((words - b + buckets - 1) // buckets) * int(wide), dtype=np.int64)
                np.add.at(sums[b], np.frombuffer(cells.as_buffer(), "<u4").astype(np.int64).cumsum(), np.frombuffer(counts.as_buffer(), "<u4"))
        for b, flat in sums.items():
            table = flat.reshape(-1, 2, k)
            local = np.flatnonzero(table.any(axis=(1, 2)))
            w = local * buckets + b
            best, gain = best_classes(table[local, 0], table[local, 1], of[w], pairs, classes)
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(best.astype(np.int32)), pa.array(gain)], names=["w", "best", "gain"])

    cells = coded.where("NOT held_out").select("before", "last", "types").mapInArrow(gather, "bucket int, cells binary, counts binary")
    found = cells.repartition("bucket").mapInArrow(choose, "w int, best int, gain double").toArrow()
    return tuple(np.asarray(found.column(c)) for c in ("w", "best", "gain"))


@dataclass
class ClassModel:
    """keys: the hashes of words that have types of their own, by type; counts and of: of types, their counts and classes; pairs: counts of neighbouring classes."""

    keys: np.ndarray
    counts: np.ndarray
    of: np.ndarray
    pairs: np.ndarray
    classes: int
    grown: list[float]


def learn_classes(coded: DataFrame, keys: np.ndarray, counts: np.ndarray, tokens: int, sweeps: int = SWEEPS) -> ClassModel:
    """Exchange clustering of the words whose hashes are keys, most frequent first."""
    words = len(keys)
    classes = max(8, min(CLASSES, math.ceil(max(tokens, 1) ** (1 / 3))))
    top = min(TOP, words)
    k = classes + FORMS + 1
    forms = np.concatenate([classes + np.arange(FORMS), [k - 1]])
    # the most frequent words one by one; the others count as one more type meanwhile
    small = np.concatenate([np.arange(top), np.full(words - top, top), top + 1 + np.arange(FORMS + 1)])
    seeds = exchange_clusters(class_bigrams(coded, small, top + FORMS + 2), top, classes)[:top]
    of = np.concatenate([seeds, np.full(words - top, classes), forms]).astype(np.int64)
    pairs = class_bigrams(coded, of, k)
    grown = [likelihood(pairs)]
    for sweep in range(sweeps if words else 0):
        if sweep or words > top:
            w, best, gain = best_moves(coded, of, pairs, words, classes, (2, sweep % 2) if sweep else (0, top))
            moved = of.copy()
            moved[w[gain > 1e-6]] = best[gain > 1e-6]
            after = class_bigrams(coded, moved, k)
            if sweep and likelihood(after) <= grown[-1]:
                break
            of, pairs = moved, after
            grown.append(likelihood(pairs))
            if sweep and grown[-1] - grown[-2] < GROWTH * abs(grown[-2]):
                break
    return ClassModel(keys, counts, of, pairs, classes, grown)


SCORED = "_row long, doc_id long, held_out boolean, n_tokens long, known long, b double, s double"


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("_row"))
    train = docs.where("NOT held_out")
    vocabulary = cut(word_counts(train))
    n_docs = train.count()
    n_words, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, size = n_words + n_docs, distinct + (n_docs > 0)
    own = (F.col("n") * FREQUENT >= total) & (F.col("n") >= LEAST)
    frequent = vocabulary.where(own).toArrow()  # at most FREQUENT rows
    h, form, n = (np.asarray(frequent.column(c).combine_chunks() if frequent.num_rows else [], dtype=np.int64) for c in ("h", "form", "n"))
    by_count = np.lexsort((h, -n))
    h, form, n = h[by_count], form[by_count], n[by_count]
    words = len(h)
    order = np.argsort(h)
    coded = cut(coded_texts(docs, h[order], order, words))
    model = learn_classes(coded, h, n, total)
    pairs, of, k = model.pairs, model.of, model.pairs.shape[0]

    move = np.log10((pairs + ADD_CLASS) / (pairs.sum(1, keepdims=True) + ADD_CLASS * k))
    of_class, sizes = np.bincount(of[:words], n, k), np.bincount(of[:words], minlength=k).astype(float)
    for f, tokens, some in vocabulary.where(~own).groupBy("form").agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most FORMS rows
        of_class[model.classes + f] += tokens
        sizes[model.classes + f] += some
    room = np.log10(of_class + ADD_WORD * (sizes + 1))  # an unseen word has its share of each class
    base_of = float(np.log10(total + size + 1))
    emit = np.zeros(words + FORMS + 1)
    emit[:words] = np.log10(n + ADD_WORD) - room[of[:words]]
    base = np.zeros(words + FORMS + 1)
    base[:words] = np.log10(n + 1.0) - base_of
    base[-1] = np.log10(n_docs + 1) - base_of
    held = docs.sparkSession.sparkContext.broadcast((of.astype(np.int32), move, emit, base))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, move, emit, base = held.value
        for part, at, p, q in _transitions(batches, words + FORMS):
            m = part.num_rows
            known = (q < words) | ((q == words + FORMS) & (n_docs > 0))
            cols = [part.column(3), part.column(4), part.column(5), pa.array(np.bincount(at, minlength=m)), pa.array(np.bincount(at[known], minlength=m))]
            cols += [pa.array(np.bincount(at, weights=base[q], minlength=m)), pa.array(np.bincount(at, weights=move[of[p], of[q]] + emit[q], minlength=m))]
            yield pa.RecordBatch.from_arrays(cols, names=["_row", "doc_id", "held_out", "n_tokens", "known", "b", "s"])

    scored = coded.select("before", "last", "types", "_row", "doc_id", "held_out").mapInArrow(run, SCORED)
    rare = coded.select("_row", F.explode("tail").alias("t")).select("_row", "t.h", "t.form", "t.tf")
    rest = vocabulary.where(~own).select("h", "n")
    joined = rare.join(rest, "h", "left").select("_row", "form", "tf", F.coalesce("n", F.lit(0)).alias("n"))
    room_of = F.element_at(F.array(*[F.lit(float(room[model.classes + f])) for f in range(FORMS)]), F.col("form") + 1)
    tails = joined.select(
        "_row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("n") > 0, F.col("tf")).otherwise(0).cast("long").alias("known"),
        (F.col("tf") * (F.log10(F.col("n") + 1.0) - F.lit(base_of))).alias("b"), (F.col("tf") * (F.log10(F.col("n") + F.lit(ADD_WORD)) - room_of)).alias("s"),
    )
    sums = scored.unionByName(tails).groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "known", "b", "s")])
    return sums.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("s").alias("score"),
        F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"),
    )
