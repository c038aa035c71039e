"""Chat formatting: a compiler for a small sandboxed template language, run over conversations.

Templates are parsed to a syntax tree, constants are folded, and the tree becomes nested Python
closures. A compiled template takes an *iterator* of messages and yields (text, under loss mask)
segments, so that a conversation of any length streams through a task in bounded memory.

Language: ``{{ expr }}``; ``{% for x in messages %}``, ``{% if %}``/``elif``/``else``, ``{% set x = e %}``,
``{% generation %}``..``{% endgeneration %}`` (what it holds is under the loss mask). Expressions know
strings, integers, names, ``.key`` and ``['key']`` on mappings only (nothing reaches Python attributes),
``== != < > in``, ``and or not``, ``+ ~`` and filters; a string holds no closing braces. ``loop`` has index, first and last.

Defined cases: null text or role is empty; turns are ordered by (turn, role, text), null first; rows with
a null conv_id form one conversation of their own; repeated rows are turns like any other; a conversation
of no rows does not exist; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SAY]", "[/SAY]")
TEMPLATE = (
    "{% set open = '<' ~ 's>' %}{% for m in messages %}{{ open }}{{ m.role | escape }}"
    "{% if m.role == 'assistant' %}[SAY]{% generation %}{{ m.text | escape }}{% endgeneration %}[/SAY]"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)


def escape(text: str) -> str:
    """Breaks control strings: a backslash after the first character of each; backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "default": lambda v, d="": v or d, "length": len}


class TemplateError(ValueError):
    pass


# ---- syntax tree: tuples, their first item names the kind -------------------------------------------
_LEX = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|[<>+~|().,\[\]]))")


def _lex(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        number, one, two, name, sign = m.groups()
        if number is not None:
            out.append(("lit", int(number)))
        elif one is not None or two is not None:
            quoted = one if one is not None else two
            out.append(("lit", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), quoted)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.rest = [*_lex(source), ("end", None)]

    def eat(self, kind: str, *values) -> object | None:
        if self.rest[0][0] == kind and (not values or self.rest[0][1] in values):
            return self.rest.pop(0)[1]
        return None

    def need(self, kind: str, *values) -> object:
        got = self.eat(kind, *values)
        if got is None:
            raise TemplateError(f"expected {values or kind}, found {self.rest[0][1]!r}")
        return got

    def whole(self):
        tree = self.either()
        self.need_end()
        return tree

    def need_end(self):
        if self.rest[0][0] != "end":
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")

    def either(self):
        left = self.both()
        while self.eat("name", "or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.eat("name", "and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.eat("name", "not") else self.compared()

    def compared(self):
        left = self.joined()
        sign = self.eat("sign", "==", "!=", "<", ">") or self.eat("name", "in")
        return (sign, left, self.joined()) if sign else left

    def joined(self):
        left = self.filtered()
        while sign := self.eat("sign", "+", "~"):
            left = (sign, left, self.filtered())
        return left

    def filtered(self):
        tree = self.keyed()
        while self.eat("sign", "|"):
            name, args = self.need("name"), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.eat("sign", "("):
                while not self.eat("sign", ")"):
                    args.append(self.either())
                    self.eat("sign", ",")
            tree = ("filter", name, tree, args)
        return tree

    def keyed(self):
        if self.eat("sign", "("):
            tree = self.either()
            self.need("sign", ")")
        elif self.rest[0][0] == "lit":
            tree = ("lit", self.rest.pop(0)[1])
        else:
            tree = ("name", self.need("name"))
        while True:
            if self.eat("sign", "."):
                tree = ("key", tree, ("lit", self.need("name")))
            elif self.eat("sign", "["):
                tree = ("key", tree, self.either())
                self.need("sign", "]")
            else:
                return tree


def parse(template: str) -> list[tuple]:
    """The template's syntax tree: a list of statements."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)

    def block(*ends: str) -> tuple[list[tuple], str, str]:
        out: list[tuple] = []
        while parts:
            part = parts.pop(0)
            whole = part.startswith("{{") and part.endswith("}}") or part.startswith("{%") and part.endswith("%}")
            if not whole and ("{{" in part or "{%" in part):
                raise TemplateError(f"unclosed tag in {part[:20]!r}")
            if part.startswith("{{"):
                out.append(("print", _Expr(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, more = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, more
                if word == "for":
                    m = re.fullmatch(r"\s*(\w+)\s+in\s+(.+)", more, re.S)
                    if not m:
                        raise TemplateError(f"for {more}")
                    out.append(("for", m[1], _Expr(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    arms, test = [], _Expr(more).whole()
                    while True:
                        body, end, more = block("elif", "else", "endif")
                        arms.append((test, body))
                        if end == "endif":
                            break
                        test = _Expr(more).whole() if end == "elif" else ("lit", True)
                    out.append(("if", arms))
                elif word == "set":
                    name, sign, value = more.partition("=")
                    if not sign or not name.strip().isidentifier():
                        raise TemplateError(f"set {more}")
                    out.append(("set", name.strip(), _Expr(value).whole()))
                elif word == "generation":
                    out.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"no tag {word!r} here")
            elif part:
                out.append(("print", ("lit", part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, "", ""

    return block()[0]


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b)}


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _fold_expr(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("lit", "name"):
        return e
    if kind == "filter":
        value, args = _fold_expr(e[2]), [_fold_expr(a) for a in e[3]]
        if all(x[0] == "lit" for x in (value, *args)):
            return ("lit", FILTERS[e[1]](value[1], *(a[1] for a in args)))
        return ("filter", e[1], value, args)
    below = tuple(_fold_expr(x) for x in e[1:])
    if kind in ("and", "or") and below[0][0] == "lit":
        return below[1] if bool(below[0][1]) == (kind == "and") else below[0]
    if all(x[0] == "lit" for x in below) and kind != "key":
        try:
            return ("lit", not below[0][1] if kind == "not" else _BINARY[kind](below[0][1], below[1][1]))
        except TypeError as e:
            raise TemplateError(f"{kind} of {below[0][1]!r} and {below[1][1]!r}") from e
    return (kind, *below)


def fold(statements: list[tuple]) -> list[tuple]:
    """Constant expressions become literals, dead arms go, neighbouring literals are joined."""
    out: list[tuple] = []
    for s in statements:
        if s[0] == "print":
            e = _fold_expr(s[1])
            if e[0] == "lit" and out and out[-1][0] == "print" and out[-1][1][0] == "lit":
                out[-1] = ("print", ("lit", _shown(out[-1][1][1]) + _shown(e[1])))
            elif e != ("lit", ""):
                out.append(("print", e))
        elif s[0] == "set":
            out.append(("set", s[1], _fold_expr(s[2])))
        elif s[0] == "for":
            out.append(("for", s[1], _fold_expr(s[2]), fold(s[3])))
        elif s[0] == "generation":
            out.append(("generation", fold(s[1])))
        else:
            arms = []
            for test, body in s[1]:
                test = _fold_expr(test)
                if test[0] != "lit" or test[1]:
                    arms.append((test, fold(body)))
                if test[0] == "lit" and test[1]:
                    break
            if arms and arms[0][0][0] == "lit":
                out.extend(arms[0][1])
            elif arms:
                out.append(("if", arms))
    return out


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "lit":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "key":
        of, key = _value(e[1]), _value(e[2])
        return lambda scope: v.get(key(scope)) if isinstance(v := of(scope), dict) else None
    if kind == "filter":
        f, of, args = FILTERS[e[1]], _value(e[2]), [_value(a) for a in e[3]]
        return lambda scope: f(of(scope), *(a(scope) for a in args))
    if kind == "not":
        of = _value(e[1])
        return lambda scope: not of(scope)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    op = _BINARY[kind]
    return lambda scope: op(a(scope), b(scope))


Segments = Iterator[tuple[str, bool]]


def _run(statements: list[tuple], masked: bool) -> Callable[[dict], Segments]:
    steps = [_step(s, masked) for s in statements]

    def run(scope: dict) -> Segments:
        for step in steps:
            yield from step(scope)

    return run


def _step(s: tuple, masked: bool) -> Callable[[dict], Segments]:
    if s[0] == "print":
        value = _value(s[1])

        def show(scope: dict) -> Segments:
            yield _shown(value(scope)), masked

        return show
    if s[0] == "set":
        value = _value(s[2])

        def put(scope: dict) -> Segments:
            scope[s[1]] = value(scope)
            return iter(())

        return put
    if s[0] == "generation":
        return _run(s[1], True)
    if s[0] == "if":
        arms = [(_value(test), _run(body, masked)) for test, body in s[1]]

        def choose(scope: dict) -> Segments:
            return next((body(scope) for test, body in arms if test(scope)), iter(()))

        return choose
    items, body = _value(s[2]), _run(s[3], masked)

    def loop(scope: dict) -> Segments:
        rest = iter(items(scope) or ())
        item, index = next(rest, None), 0
        while item is not None:
            following, index = next(rest, None), index + 1
            yield from body({**scope, s[1]: item, "loop": {"index": index, "first": index == 1, "last": following is None}})
            item = following

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Segments]:
    """The template as a closure: messages in, (text, under loss mask) segments out, both as streams."""
    run = _run(fold(parse(template)), False)
    return lambda messages: run({"messages": messages})


# ---- over Spark --------------------------------------------------------------------------------------
PIECES = "conv_id long, piece long, text string, loss array<struct<start:int,end:int>>"
PIECE_CHARS = 65536


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: Callable[[tuple], int], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 100 + chars(row)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def format_conversations(convs: DataFrame, template: str = TEMPLATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rendered conversations in pieces: conv_id, piece (0, 1, ...), text, loss (code-point intervals of the
    piece that are under the mask). The pieces of a conversation, joined in order, are its rendered text; they
    stand in order in one partition. One shuffle, by conv_id; a task streams its sorted turns and holds one
    piece (at least piece_chars characters, at most one more segment)."""
    compile_template(template)  # errors show on the driver

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)

        def pieces() -> Iterator[tuple]:
            for conv_id, turns in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                held, loss, size, n = [], [], 0, 0
                for text, masked in run({"role": r[2], "text": r[3], "turn": r[1]} for r in turns):
                    if masked and text:
                        loss.append({"start": size, "end": size + len(text)})
                    held.append(text)
                    size += len(text)
                    if size >= piece_chars:
                        yield conv_id, n, "".join(held), loss
                        held, loss, size, n = [], [], 0, n + 1
                if size or not n:
                    yield conv_id, n, "".join(held), loss

        return _batches(pieces(), _PIECE_SCHEMA, lambda r: len(r[2]))

    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame) -> DataFrame:
    """Parses rendered pieces of the default template's format (as format_conversations() leaves them, in order)
    back into turns, and digests turns and the text under the loss mask."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for conv_id, held in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, loss_chars, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
                for _, _, text, masks in held:
                    chars += len(text)
                    for mask in masks:
                        plain = unescape(text[mask["start"] : mask["end"]])
                        loss_chars += len(plain)
                        loss.update(plain.encode("utf-8", "surrogatepass"))
                    rest += text
                    start = 0
                    while (end := rest.find("</s>", start)) >= 0:
                        opened, role, mark, said = re.fullmatch(r"(<s>)(.*?)(\[INST\]|\[SAY\])(.*)\[/(?:INST|SAY)\]", rest[start:end], re.S).groups()
                        turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
                        n, start = n + 1, end + 4
                    rest = rest[start:]
                if rest:
                    raise ValueError(f"conversation {conv_id}: {len(rest)} characters after its last turn")
                yield conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return _batches(conversations(), _DIGEST_SCHEMA, lambda r: 300)

    return pieces.mapInArrow(digest, DIGESTS)
