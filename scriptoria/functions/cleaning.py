"""Text cleaning for OCR-digitised books, as column expressions that stay inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that are removed, and the ordered dictionary of unanchored corrections.
SYMBOLS = "■•►♦_^|<>\\*=~±✓¬"
CORRECTIONS = (
    ("peri tipi", "per i tipi"), ("ma gnanimità", "magnanimità"), ("incli nazione", "inclinazione"), ("col pa", "colpa"), ("Beliosi", "Bellosi"),
    ("Fra’ iovanni", "Fra' Giovanni"), ("Fra' iovanni", "Fra' Giovanni"), ("Antonio EePiero Poliamoli", "Antonio e Piero Pollaiolo"), ("G uglielmo da M ardila", "Guglielmo da Marcillat"),
    ("M arco Caiavrese", "Marco Calavrese"), ("iulio Ili", "Giulio III"), ("PTassitele", "Prassitele"), ("Cap. Ili", "Cap. III"), ("Cap. IMI", "Cap. VIII"), ("Cap. X II II", "Cap. XIV"),
    ("Cap. XVII II", "Cap. XVIII"), ("Cap. XXVII1110I", "Cap. XXVII"), ("Cap 93", "Cap. XCIII"), ("Cap 104", "Cap. CIV"), ("Cap 117", "Cap. CXVII"),
    ("ALLO ILLUSTRISSIMO E ECCELLENTISSIMO SIGNORE", "ALLO ILLUSTRISSIMO E ECCELLENTISSIMO SIGNORE"), ("O riandò", "Orlando"), ("Oriandò", "Orlando"),
)
W = "0-9A-Za-z'’À-ÿ"
K = "BCFGJKMPQSTVWXYZ"
ABBREVIATIONS = ("srl", "snc", "cfr", "sms")


def strip_symbols(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r" +(?= )", "")


def join_hyphenated(text: Column) -> Column:
    """A hyphen before a line's end goes; the line's end stays."""
    return F.regexp_replace(text, r"-(?=\n)", "")


def curly_apostrophes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("’"))


def toggle_quotes(text: Column) -> Column:
    """Straight double quotes become « and » in turn."""
    parts = F.split(text, '"')
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(i % 2 == 1, F.concat(F.lit("«"), p)).otherwise(F.concat(F.lit("»"), p))), "")


#: What any of the cases below begins with: letters are passed over without a look behind.
_MAY = rf"(?![ABDF-Zabdf-hj-oq-z][A-Za-z])(?=[{W}][.,;:!]|[cdlmnstvCDLMNSTV] ['’]|[01'\-]|[0-9] | (?: )|M at|et|chh|piu|insi|Cap|Ediz)"
#: The contextual rewriter's cases; earlier ones win. What the groups of "keep" cases hold stays; of the others all that they match becomes O, I, l or its token's reading.
_CASES = (
    ("keep", rf"(?<![{W}])([cdlmnstvCDLMNSTV]) (['’])"),
    ("keep", rf"([{W}])[.,;:!](?=[{W}])|(?<![A-Za-z.])(M) (?=at)|(?<![{W}])(e)t(?![{W}])"),
    ("token", r"(1'(?=[aeiouAEIOU])|chh|'|(?<![A-Za-z])piu(?![A-Za-z])|insi no|Capitoloprimo|Edizionedi)"),
    ("O", rf"((?<![{W}])0(?![{W}])|(?<=[A-Z])0(?=[A-Z]))"),
    ("keep", r"-(?=\n)|(?<=[A-Za-z])0(?![A-Za-z])| (?= )"),
    ("keep", r"([0-9]) (?=[0-9])"),
    ("I", r"((?<=[A-Z])1(?=[A-Z])|(?<![A-Za-z])1(?= [A-Z])|(?<=[A-Z])1(?![A-Za-z]))"),
    ("l", r"((?<=[A-Za-z])1(?=[A-Za-z])|(?<![A-Za-z])1(?=[a-z]))"),
)
#: What each case begins with, where that is told faster than by the case itself.
_FIRST = ("[cdlmnstvCDLMNSTV] ", "", "[1c'piCE]", "0", "", "", "1", "1")
#: Tokens that are rewritten.
_TOKENS = {"1'": "l'", "chh": "ch", "'": "’", "piu": "più", "insi no": "insino", "Capitoloprimo": "Capitolo primo", "Edizionedi": "Edizione di"}
#: Noncharacters: they part the places of a token, an O, an I and an l. A text's own ones are followed by _OWN meanwhile, which no mark is.
_MARKS, _OWN = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4", "\ufdd5"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _guarded(text: Column) -> Column:
    return F.regexp_replace(text, f"([{_MARKS}])", "$1" + _OWN)


def _unguarded(text: Column) -> Column:
    return F.regexp_replace(text, f"([{_MARKS}]){_OWN}", "$1")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def contextual_rewrite(text: Column) -> Column:
    """One left-to-right pass in which the first fitting case wins and context is looked up in the input.

    The pass leaves, for each match, what it keeps and the five marks, with what is to be rewritten in its kind's place between them."""
    kinds = [kind for kind, regex in _CASES for _ in range(re.compile(regex).groups)]
    of = {kind: "".join(f"${i}" for i, k in enumerate(kinds, 1) if k == kind) for kind in ("keep", "token", "O", "I", "l")}

    def left(token: str = "", o: str = "", i: str = "", l: str = "") -> str:  # noqa: E741
        return "".join(m + part for m, part in zip(_MARKS, (token, o, i, l, ""), strict=True))

    cases = "|".join(f"(?={first})(?:{regex})" if first else regex for first, (_, regex) in zip(_FIRST, _CASES, strict=True))
    out = F.regexp_replace(_guarded(text), f"{_MAY}(?:{cases})", of["keep"] + left(of["token"], of["O"], of["I"], of["l"]))
    said = {left(): "", left(o="0"): "O", left(i="1"): "I", left(l="1"): "l"} | {left(token): to for token, to in _TOKENS.items()}
    known = F.create_map(*[F.lit(x) for mark, to in said.items() for x in (mark[1:-1], to)])

    def reading(part: Column, i: Column) -> Column:
        """A part behind the first mark, with its reading; one behind a mark of the text's own keeps that."""
        head = F.substring_index(part, _MARKS[-1], 1)
        to = F.concat(F.element_at(known, head), F.substring(part, F.length(head) + 2, F.length(part)))
        return F.when(i == 0, part).otherwise(F.coalesce(to, F.concat(F.lit(_MARKS[0]), part)))

    return toggle_quotes(_unguarded(F.array_join(F.transform(F.split(out, _MARKS[0], -1), reading), "")))


def reconnect_drop_caps(text: Column) -> Column:
    """A capital that stands apart is joined to its word: consonants and 0 always, vowels before known words."""
    lone, end = r"(?<![A-Za-z'])", r"(?![A-Za-z])"
    vowels = [("A", f"riosto{end}"), ("O", f"rlando{end}"), ("O", "riand"), ("I", f"nghilterra{end}"), ("O", f"nde{end}"), ("U", f"rbino{end}"), ("I", "o ")]
    out = F.regexp_replace(text, f"(?=I Sp){lone}I (?=Spagna{end})", "In")
    out = F.regexp_replace(out, "(?=[AOIU] [rndobi])" + lone + "(?:" + "|".join(f"({v}) (?={w})" for v, w in vowels) + ")", "".join(f"${i + 1}" for i in range(len(vowels))))
    out = F.regexp_replace(_guarded(out), "(?=[B-DF-HJ-NP-TV-Z0] )" + lone + r"(?:([B-DF-HJ-NP-TV-Z])|(0)) ", "$1" + _MARKS[0] + "$2" + _MARKS[1])
    for joined, to in (("0", "O"), ("", "")):
        out = F.replace(out, F.lit(_MARKS[0] + joined + _MARKS[1]), F.lit(to))
    return _unguarded(out)


_KNOWN = "|".join(re.escape(a) for a, _ in CORRECTIONS)


def apply_dictionary(text: Column) -> Column:
    def all_of(t: Column) -> Column:
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), CORRECTIONS, t)

    return _once(text, lambda t: F.when(t.rlike(f"(?=[pmicBFAGMPCO])(?:{_KNOWN})"), all_of(t)).otherwise(t))


def strip_endings(text: Column) -> Column:
    """Consonants that no Italian word ends in are taken off the ends of words, unless a full stop follows. Three passes:
    capitals after a word that has small letters; words of nothing but one or two such consonants; the second of two characters."""
    small, begin, end = K.lower(), f"(?<![{W}])", f"(?![{W}.])"
    out = F.regexp_replace(text, f"{begin}(?=[{W}]*+(?<=[{K}]){end})(?=[{W}]*[a-z])([{W}]*?)[{K}]+{end}", "$1")
    out = F.regexp_replace(out, f"(?=[{K}{small}][{K}{small}]?{end}){begin}(?:[{small}][{K}{small}]?|[{K}][{small}]){end}", "")
    return F.regexp_replace(out, f"(?=[0-9A-Za-z'][{K}{small}]{end}){begin}([0-9A-Za-z'])[{K}{small}]{end}", "$1")


_SPACE = r" \t\n\r\f\x0B"
#: What is never garbage: words with a vowel, numbers, both with a sign after them or without, and two letters or signs.
_PLAIN = (
    rf"(?:(?=[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z0-9'’]*+[AEIOUaeiouÀ-ÿ])[{W}]++[.,;:!?]?|[0-9]++[.,;:!?]?|(?=[.,;:!?\"]?[0-9A-Za-z'])[0-9A-Za-z'.,;:!?\"]{{1,2}}|[0-9A-Za-z']{{2}}[.,;:!?])"
)
#: Up to 64 of those and of stretches of white space at once, or one other token.
_TOKEN = rf"(?:[{_SPACE}]++|{_PLAIN}(?=[{_SPACE}]|\z)){{1,64}}+|[^{_SPACE}]++"


def drop_garbage(text: Column) -> Column:
    """Tokens that are mostly no letters, or have no vowel, go; white space stays. Lengths are in bytes."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def count(t: Column, keep: str) -> Column:
        return F.octet_length(F.regexp_replace(t, f"[^{keep}]", ""))

    def judged(t: Column, alpha: Column) -> Column:
        short = (F.octet_length(t) <= 2) & (alpha >= 1)

        def fits(letters: Column) -> Column:
            vowels = count(t, "aeiouAEIOU") + F.length(F.regexp_replace(t, r"[^À-ÿ]", ""))
            mute = (letters >= 3) & (count(t, "A-Z") < letters) & (vowels == 0)
            return ~mute | F.lower(F.regexp_replace(t, f"[^{W}]", "")).isin(*ABBREVIATIONS)

        return F.when(short, ~t.rlike(rf"[\x00-\x7F&&[^{W}.,;:!?\"]]")).otherwise(alpha * 2 > F.octet_length(t)) & _once(alpha - count(t, "0-9"), fits)

    def cut(t: Column) -> Column:
        alpha = count(t, W) + F.length(F.regexp_replace(t, r"[^\u2000-\u2018\u201A-\u203F]", ""))
        keep = _once(alpha, lambda n: judged(t, n))
        return F.when(t.rlike(rf"[{_SPACE}]|^{_PLAIN}\z") | keep, t).otherwise("")

    return F.array_join(F.transform(tokens, cut), "")


def clean(text: Column) -> Column:
    """The whole cleaner."""
    for step in (strip_symbols, contextual_rewrite, reconnect_drop_caps, apply_dictionary, strip_endings, drop_garbage):
        text = step(text)
    return text


#: The second cleaner's patterns, in order; its dictionary differs in the last entries.
SEMANTIC = (
    (r"\b([B-DF-HJ-NP-TV-Z]) ([a-zàèéìòù]+)\b", "$1$2"), (r"\bO nde\b", "Onde"), (r"\bI nghilterra\b", "Inghilterra"), (r"\bI Spagna\b", "In Spagna"), (r"\bI o\b", "Io"),
    (r"\bU rbino\b", "Urbino"), (r"\bM essina\b", "Messina"), (r"([a-zàèéìòù])([A-Z])", "$1 $2"), (r"\bCap([IVXLCDM]+)\b", "Cap $1"),
)
SEMANTIC_CORRECTIONS = (*CORRECTIONS[:20], ("ALLO ILLUSTRI S 1 O E ECCELLENTISSIMOSIGNORE", "ALLO ILLUSTRISSIMO E ECCELLENTISSIMO SIGNORE"))


def semantic_clean(text: Column) -> Column:
    """The second, lighter cleaner: detached capitals, run-together words, chapter numerals, dictionary."""
    for regex, to in SEMANTIC:
        text = F.regexp_replace(text, f"(?U){regex}", to)
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SEMANTIC_CORRECTIONS, text)


def apply_corrections(text: Column, corrections: Column) -> Column:
    """All occurrences of each correction's errato become its corretto, in order; empty sides are passed over."""
    return F.aggregate(corrections, text, lambda t, c: F.when((c["errato"] != "") & (c["corretto"] != ""), F.replace(t, c["errato"], c["corretto"])).otherwise(t))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


#: Markdown's marks, in the order in which they go.
MARKDOWN = (
    (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"_{1,3}([^_]+)_{1,3}", "$1"), (r"(?m)^\s*[-*•►]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"),
)


def strip_markdown(text: Column) -> Column:
    for regex, to in MARKDOWN:
        text = F.regexp_replace(text, regex, to)
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def fallback(cleaned: Column, raw: Column) -> Column:
    """The cleaned text, or the raw one where cleaning failed."""
    return F.coalesce(cleaned, raw)
