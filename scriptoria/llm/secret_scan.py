"""Secret scans on DataFrame functions alone: a trigram inverted index chooses candidates, regexes verify them.

From each rule's regex a Boolean trigram query is derived (an OR of ANDs of trigrams of the lower-cased text).
Postings (trigram, document) are built for the trigrams that some query names, intersected per document, and
only candidates of a rule are searched for it. A rule without mandatory trigrams searches every text in full.

Defined cases: null text is empty; rows with one doc_id share their postings (a superset of candidates, so results
stay exact); null doc_ids too; texts without secrets, and empty tables, give zero counts or no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The regex has one meaning in Java, RE2 and Python. A match counts if it has min_chars code
    points, or its group has, if one is named; failing matches are consumed and dropped."""

    kind: str
    regex: str
    min_chars: int = 1
    group: int = 0


#: The first three are the base kinds, in their order.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # the runs of [0-9a-f]+ that are long enough
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z]{3,8}://[A-Za-z0-9._-]+:[A-Za-z0-9._~!-]+@"),
)
RULES = BASE + MORE
#: An exact set of more strings than this is given up, and what it has shown so far is kept.
MAX_STRINGS = 64


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match holds; an empty list if nothing is mandatory."""
    runs: list[set[str]] = []  # sets of strings, one of each of which every match holds
    known = {""}

    def end() -> None:
        nonlocal known
        runs.append(known)
        known = {""}

    def strings(op, arg) -> set[str] | None:
        """All strings that a node matches, if they are few."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            if any(kind not in (C.LITERAL, C.RANGE) for kind, _ in arg):
                return None
            out = {chr(x).lower() for kind, v in arg for x in ([v] if kind is C.LITERAL else range(v[0], v[1] + 1))}
            return out if len(out) <= 4 else None
        if op is C.SUBPATTERN:
            return joined(arg[3])
        if op is C.BRANCH:
            each = [joined(x) for x in arg[1]]
            return None if None in each else set().union(*each)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
            once = joined(arg[2])
            if once is None:
                return None
            out = {""} if arg[0] == 0 else set()
            power = {""}
            for n in range(1, int(arg[1]) + 1):
                power = {a + b for a in power for b in once}
                out |= power if n >= arg[0] else set()
            return out if len(out) <= MAX_STRINGS else None
        return None

    def joined(nodes) -> set[str] | None:
        out = {""}
        for op, arg in nodes:
            one = strings(op, arg)
            if one is None or len(out) * len(one) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in one}
        return out

    def walk(nodes) -> None:
        nonlocal known
        for op, arg in nodes:
            one = strings(op, arg)
            if one is not None and len(known) * len(one) <= MAX_STRINGS:
                known = {a + b for a in known for b in one}
            elif op is C.SUBPATTERN:
                walk(arg[3])
            else:
                end()
                if one is not None:
                    known = one

    walk(_parser.parse(regex))
    end()
    # the run whose shortest string is longest selects best; strings without a trigram make a run useless
    usable = [{_grams(s) for s in run} for run in runs if min(map(len, run)) >= 3]
    if not usable:
        return []
    best = max(usable, key=lambda clauses: min(map(len, clauses)))
    always = [next(iter(x)) for x in usable if len(x) == 1]
    clauses = {frozenset().union(c, *always) for c in best}
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id") -> DataFrame:
    """The inverted index: gram (its place in grams), key; one row for each trigram that a text holds."""
    low = docs.select(key, F.lower(text_of()).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.col("_low").contains(g), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select(key, F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """key, rules: a bit for each rule whose Boolean query the key's postings satisfy. Postings of a key are
    intersected as bit sets, before the shuffle as far as they lie together."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    place = {g: i for i, g in enumerate(grams)}
    words = range(len(grams) // 60 + 1)
    bit = lambda w: F.when(F.floor(F.col("gram") / 60) == w, F.expr(f"shiftleft(1L, gram - {60 * w})")).otherwise(F.lit(0).cast("long"))
    sets = postings(docs, grams, key).groupBy(key).agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
    mask = F.lit(0).cast("long")
    for i, query in queries.items():
        hit = F.lit(False)
        for clause in query:
            all_of = F.lit(True)
            for w in words:
                if need := sum(1 << place[g] - 60 * w for g in clause if place[g] // 60 == w):
                    all_of = all_of & (F.col(f"w{w}").bitwiseAND(F.lit(need).cast("long")) == need)
            hit = hit | all_of
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return sets.select(key, mask.alias("rules")).where("rules <> 0")


_SPANS = "array<struct<start:int,end:int>>"
_BLOCK = 256


def _spans(pairs: Column, rule: Rule) -> Column:
    """Spans of the hits that pass. pairs: array of (gap before the hit, hit). Folded in blocks, since each append copies."""

    def passes(hit: Column) -> Column:
        return F.coalesce(F.length(F.regexp_extract(hit, rule.regex, rule.group) if rule.group else hit) >= rule.min_chars, F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(passes(x["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def begin(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)), begin(acc["at"]), step)
        both = F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))
        return both[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
    return F.aggregate(blocks, begin(F.lit(0)), block)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """docs' columns key and text, with spans_<kind>: array of (start, end), in code points, end exclusive."""
    found = candidates(docs, rules, key).withColumnRenamed(key, "_key")
    both = docs.select(key, text_of().alias("text")).join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    cols = []
    for i, r in enumerate(rules):
        pairs = F.arrays_zip(F.transform(F.split("text", r.regex, -1), F.length).alias("gap"), F.regexp_extract_all("text", F.lit(r.regex), F.lit(0)).alias("hit")).cast("array<struct<gap:int,hit:string>>")
        if trigram_query(r.regex):
            pairs = F.when(F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0, pairs)
        else:
            pairs = F.when(F.col("text").rlike(r.regex), pairs)
        cols.append(pairs.alias(f"_p{i}"))
    both = both.select(key, "text", *cols)
    empty = F.array().cast(_SPANS)
    return both.select(key, "text", *[F.when(F.col(f"_p{i}").isNull(), empty).otherwise(_spans(F.col(f"_p{i}"), r)).alias(f"spans_{r.kind}") for i, r in enumerate(rules)])


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), key: str = "doc_id") -> DataFrame:
    """Counts and digests of scan()'s result."""

    def listed(some: tuple[Rule, ...]) -> Column:
        def named(i: int, kind: str) -> Column:
            return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))

        each = [named(i, r.kind) for i, r in enumerate(some)]
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules[:base]]
    return found.select(key, *counts, F.sha2(listed(rules[:base]), 256).alias("base_sha256"), listed(rules).alias("spans"))
