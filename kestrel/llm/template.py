"""Chat formatting: a compiler for a small sandboxed template language.

Source text is lexed, parsed into a syntax tree, folded (operators and filters over constants, branches on constants, adjacent
text) and turned into Python closures that yield (string, is it under a generation marker).  Templates see only strings,
numbers, truth values, lists and mappings: names look up variables, a dot or brackets a mapping's key, and there are no calls.

    {{ expression }}   {# comment #}   {% set name = expression %}   a dash inside a tag strips white space on that side
    {% for m in messages %} ... {% endfor %}            with loop.index, loop.index0, loop.first and loop.last
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}            what the model is to learn
    operators: or and not == != < > <= >= in + ~ x if c else y    filters: escape line upper lower trim title length default(x)

``escape`` puts a backslash before every backslash and every control string; ``line`` also writes line feeds as ``\\n``.
:class:`Reader` undoes both, so a text that holds control strings comes back as it was.

Defined results.  Rows of a conversation are ordered by turn, then role, then text, nulls first; equal rows are all kept.
Null roles and texts count as empty.  Rows with a null conv_id form one conversation.  No rows in, no rows out.  Messages are
rendered as they stream past, and a formatted text longer than ``part_chars`` continues in further rows, so memory is bounded
by the longest message, not by the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

Segment = tuple[str, bool]


class TemplateError(ValueError):
    """The source is not a template of this language; ``at`` is the character position."""

    def __init__(self, what: str, at: int):
        super().__init__(f"{what} at character {at}")
        self.at = at


# ---- syntax tree ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- lexer and parser -------------------------------------------------------------------------------------------------

TAG = re.compile(r"\{\{-?|\{%-?|\{#")
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>.\[\]()|,=]))""", re.S)
KEYWORDS = {"or", "and", "not", "in", "if", "else", "true", "false", "none"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def pieces(source: str) -> list[tuple[str, str, int]]:
    """(kind, content, position): text, print or tag, with white space stripped where dashes ask for it."""
    out, at, strip = [], 0, False
    while at <= len(source):
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        strip = False
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text, at))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = _close(source, m.end(), close)
        body = source[m.end() : end]
        if close != "#}":
            if body.endswith("-"):
                body, strip = body[:-1], True
            out.append(("print" if close == "}}" else "tag", body, m.end()))
        at = end + 2
    return out


def _close(source: str, at: int, close: str) -> int:
    """Where the tag ends; quoted strings may hold the closing mark."""
    quote, i = "", at
    while i < len(source):
        c = source[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif close != "#}" and c in "'\"":
            quote = c
        elif source.startswith(close, i):
            return i
        i += 1
    raise TemplateError(f"missing {close}", at)


class Expression:
    """Recursive-descent parser of one tag's expression."""

    def __init__(self, source: str, at: int):
        self.tokens, i = [], 0
        while i < len(source.rstrip()):
            m = TOKEN.match(source, i)
            if not m:
                raise TemplateError("unexpected character", at + i)
            self.tokens.append((m.lastgroup, m[m.lastgroup], at + m.start(m.lastgroup)))
            i = m.end()
        self.at, self.end = 0, at + len(source)

    def peek(self) -> str:
        kind, text, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("", "", 0)
        return text if kind in ("op", "name") else ""

    def next(self) -> tuple[str, str, int]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early", self.end)
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *texts: str) -> str:
        if self.peek() in texts and self.peek():
            return self.next()[1]
        return ""

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text}", self.tokens[self.at][2] if self.at < len(self.tokens) else self.end)

    def name(self) -> str:
        kind, text, at = self.next()
        if kind != "name" or text in KEYWORDS:
            raise TemplateError("expected a name", at)
        return text

    def whole(self):
        out = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError("unexpected " + self.tokens[self.at][1], self.tokens[self.at][2])
        return out

    def ternary(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("?", (test, value, self.ternary()))
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", (left, self.negation()))
        return left

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            left = Op(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self):
        out = self.postfix()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS and name not in ("escape", "line"):
                raise TemplateError(f"no filter {name}", self.tokens[self.at - 1][2])
            if self.take("("):
                while not self.take(")"):
                    args.append(self.ternary())
                    if self.peek() != ")":
                        self.need(",")
            out = Filter(name, out, tuple(args))
        return out

    def postfix(self):
        out = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                out = Item(out, Const(self.name()))
            else:
                out = Item(out, self.ternary())
                self.need("]")
        return out

    def atom(self):
        kind, text, at = self.next()
        if kind == "num":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if text in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[text])
        if kind == "name" and text not in KEYWORDS:
            return Name(text)
        if text == "(":
            out = self.ternary()
            self.need(")")
            return out
        raise TemplateError(f"unexpected {text}", at)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = pieces(source)
    body, at = _body(parts, 0, ())
    if at < len(parts):
        raise TemplateError("unexpected {% " + parts[at][1].strip() + " %}", parts[at][2])
    return body


def _body(parts, at: int, ends: tuple) -> tuple[tuple, int]:
    out = []
    while at < len(parts):
        kind, content, pos = parts[at]
        if kind == "text":
            out.append(Text(content))
            at += 1
            continue
        if kind == "print":
            out.append(Print(Expression(content, pos).whole()))
            at += 1
            continue
        word = (content.split(None, 1) or [""])[0]
        if word in ends:
            return tuple(out), at
        e = Expression(content, pos)
        e.next()
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.whole()
            body, at = _block(parts, at + 1, ("endfor",), pos)
            out.append(For(name, over, body))
            at += 1
        elif word == "set":
            name = e.name()
            e.need("=")
            out.append(Set(name, e.whole()))
            at += 1
        elif word == "generation":
            body, at = _block(parts, at + 1, ("endgeneration",), pos)
            out.append(Generation(body))
            at += 1
        elif word == "if":
            node, at = _if(parts, at, e, pos)
            out.append(node)
        else:
            raise TemplateError(f"unknown tag {word}", pos)
    if ends:
        raise TemplateError(f"missing {ends[0]}", parts[-1][2] if parts else 0)
    return tuple(out), at


def _block(parts, at: int, ends: tuple, pos: int):
    body, at = _body(parts, at, ends)
    return body, at


def _if(parts, at: int, e: Expression, pos: int):
    test = e.whole()
    body, at = _body(parts, at + 1, ("endif", "else", "elif"))
    word = parts[at][1].split(None, 1)[0]
    if word == "elif":
        e = Expression(parts[at][1], parts[at][2])
        e.next()
        node, at = _if(parts, at, e, parts[at][2])
        return If(test, body, (node,)), at
    other: tuple = ()
    if word == "else":
        other, at = _body(parts, at + 1, ("endif",))
    return If(test, body, other), at + 1


# ---- folding ----------------------------------------------------------------------------------------------------------


def show(x: object) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


FILTERS: dict[str, Callable] = {
    "upper": lambda x: show(x).upper(),
    "lower": lambda x: show(x).lower(),
    "trim": lambda x: show(x).strip(),
    "title": lambda x: show(x).title(),
    "length": lambda x: len(x) if hasattr(x, "__len__") else 0,
    "default": lambda x, y="": y if x is None else x,
}


def _order(test: Callable) -> Callable:
    def run(a, b):
        same = (isinstance(a, str) and isinstance(b, str)) or (isinstance(a, int) and isinstance(b, int))
        return same and test(a, b)

    return run


def _plus(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else show(a) + show(b)


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _order(lambda a, b: a < b),
    ">": _order(lambda a, b: a > b),
    "<=": _order(lambda a, b: a <= b),
    ">=": _order(lambda a, b: a >= b),
    "in": lambda a, b: (show(a) in b) if isinstance(b, str) else (a in b if isinstance(b, (list, tuple, dict)) else False),
    "+": _plus,
    "~": lambda a, b: show(a) + show(b),
}


def fold_expr(e, filters: dict[str, Callable]):
    if isinstance(e, Item):
        return Item(fold_expr(e.of, filters), fold_expr(e.key, filters))
    if isinstance(e, Filter):
        of, args = fold_expr(e.of, filters), tuple(fold_expr(a, filters) for a in e.args)
        if isinstance(of, Const) and all(isinstance(a, Const) for a in args):
            return Const(filters[e.name](of.value, *[a.value for a in args]))
        return Filter(e.name, of, args)
    if not isinstance(e, Op):
        return e
    args = tuple(fold_expr(a, filters) for a in e.args)
    first = args[0]
    if isinstance(first, Const):
        if e.op == "not":
            return Const(not first.value)
        if e.op == "and":
            return args[1] if first.value else first
        if e.op == "or":
            return first if first.value else args[1]
        if e.op == "?":
            return args[1] if first.value else args[2]
        if isinstance(args[1], Const):
            return Const(BINARY[e.op](first.value, args[1].value))
    return Op(e.op, args)


def fold(body: Iterable, filters: dict[str, Callable]) -> tuple:
    """Constant expressions become text, constant branches disappear, neighbouring text is joined."""
    out: list = []
    for n in body:
        if isinstance(n, Print):
            e = fold_expr(n.expr, filters)
            new = [Text(show(e.value))] if isinstance(e, Const) else [Print(e)]
        elif isinstance(n, If):
            test, yes, no = fold_expr(n.test, filters), fold(n.body, filters), fold(n.other, filters)
            new = list(yes if test.value else no) if isinstance(test, Const) else [If(test, yes, no)]
        elif isinstance(n, For):
            new = [For(n.name, fold_expr(n.over, filters), fold(n.body, filters))]
        elif isinstance(n, Set):
            new = [Set(n.name, fold_expr(n.expr, filters))]
        elif isinstance(n, Generation):
            new = [Generation(fold(n.body, filters))]
        else:
            new = [n]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


# ---- closures ---------------------------------------------------------------------------------------------------------


def compile_expr(e, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Item):
        of, key = compile_expr(e.of, filters), compile_expr(e.key, filters)

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple)) and isinstance(k, int) and 0 <= k < len(x) else None

        return item
    if isinstance(e, Filter):
        run, of, args = filters[e.name], compile_expr(e.of, filters), [compile_expr(a, filters) for a in e.args]
        if not args:
            return lambda env: run(of(env))
        return lambda env: run(of(env), *[a(env) for a in args])
    a = [compile_expr(x, filters) for x in e.args]
    if e.op == "not":
        return lambda env: not a[0](env)
    if e.op == "and":
        return lambda env: a[0](env) and a[1](env)
    if e.op == "or":
        return lambda env: a[0](env) or a[1](env)
    if e.op == "?":
        return lambda env: a[1](env) if a[0](env) else a[2](env)
    run2 = BINARY[e.op]
    return lambda env: run2(a[0](env), a[1](env))


def compile_body(body: tuple, filters: dict[str, Callable], marked: bool = False) -> Callable[[dict], Iterator[Segment]]:
    steps = [_compile(n, filters, marked) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def _compile(n, filters, marked: bool) -> Callable[[dict], Iterator[Segment]]:
    if isinstance(n, Text):
        fixed = ((n.text, marked),)
        return lambda env: fixed
    if isinstance(n, Print):
        value = compile_expr(n.expr, filters)
        return lambda env: ((show(value(env)), marked),)
    if isinstance(n, Set):
        name, value = n.name, compile_expr(n.expr, filters)

        def assign(env):
            env[name] = value(env)
            return ()

        return assign
    if isinstance(n, Generation):
        return compile_body(n.body, filters, True)
    if isinstance(n, If):
        test, yes, no = compile_expr(n.test, filters), compile_body(n.body, filters, marked), compile_body(n.other, filters, marked)
        return lambda env: yes(env) if test(env) else no(env)
    name, over, body = n.name, compile_expr(n.over, filters), compile_body(n.body, filters, marked)

    def loop(env):
        items = iter(over(env) or ())
        missing = object()
        now, i = next(items, missing), 0
        while now is not missing:
            after = next(items, missing)
            inner = dict(env)
            inner[name] = now
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": after is missing}
            yield from body(inner)
            now, i = after, i + 1

    return loop


# ---- escapes, templates, reading back ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Marks:
    """Control strings: what opens a turn, ends its header and ends its text."""

    opening: str = "### "
    header_end: str = "\n"
    closing: str = "</turn>\n"

    def escape(self, text: object) -> str:
        out = show(text).replace("\\", "\\\\")
        for c in (self.opening, self.closing.strip()):
            out = out.replace(c, "\\" + c)
        return out

    def line(self, text: object) -> str:
        return self.escape(text).replace("\n", "\\n")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S) if "\\" in text else text

    def unline(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


TURNS = (
    "{% for m in messages %}{{ opening }}{{ m.role | line }}{{ header_end }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ closing }}{% endfor %}"
)


class Template:
    """A compiled template.  ``constants`` are names with fixed values; they are folded in."""

    def __init__(self, source: str = TURNS, marks: Marks = Marks(), constants: dict[str, object] | None = None):
        self.source, self.marks = source, marks
        filters = FILTERS | {"escape": marks.escape, "line": marks.line}
        fixed = {"opening": marks.opening, "header_end": marks.header_end, "closing": marks.closing} | (constants or {})
        self.tree = fold(_bind(parse(source), fixed), filters)
        self._run = compile_body(self.tree, filters)

    def __reduce__(self):
        return (Template, (self.source, self.marks))

    def render(self, messages: Iterable[dict], **variables) -> Iterator[Segment]:
        """Segments in order; ``messages`` is read as far as the output needs."""
        return iter(self._run({**variables, "messages": messages}))


def _bind(body, fixed: dict[str, object]):
    """Replace names of constants by their values, everywhere."""

    def go(x, hidden=frozenset()):
        if isinstance(x, Name):
            return Const(fixed[x.name]) if x.name in fixed and x.name not in hidden else x
        if isinstance(x, tuple):
            return tuple(go(y, hidden) for y in x)
        if isinstance(x, For):
            return For(x.name, go(x.over, hidden), go(x.body, hidden | {x.name, "loop"}))
        if isinstance(x, (Const, Text)):
            return x
        if isinstance(x, Item):
            return Item(go(x.of, hidden), go(x.key, hidden))
        if isinstance(x, Op):
            return Op(x.op, go(x.args, hidden))
        if isinstance(x, Filter):
            return Filter(x.name, go(x.of, hidden), go(x.args, hidden))
        if isinstance(x, Print):
            return Print(go(x.expr, hidden))
        if isinstance(x, Set):
            return Set(x.name, go(x.expr, hidden))
        if isinstance(x, If):
            return If(go(x.test, hidden), go(x.body, hidden), go(x.other, hidden))
        return Generation(go(x.body, hidden))

    return go(body)


@dataclass
class Reader:
    """Reads formatted text back, chunk by chunk: turns, and the text under the loss mask."""

    marks: Marks = Marks()
    held: str = ""
    spans: list = field(default_factory=list)
    base: int = 0

    def feed(self, text: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[str, str, str | None]]:
        """(role, text, text under the mask or None) of every turn that is complete now.  Spans count from the first chunk on."""
        self.held += text
        self.spans.extend(spans)
        end_mark, at = self.marks.closing, 0
        while True:
            head = self.held.find(self.marks.header_end, at)
            if head < 0:
                break
            end = self._end(head + len(self.marks.header_end), end_mark)
            if end < 0:
                break
            role = self.marks.unline(self.held[at + len(self.marks.opening) : head])
            body = self.marks.unescape(self.held[head + len(self.marks.header_end) : end])
            masked = None
            while self.spans and self.spans[0][0] - self.base < end + len(end_mark):
                a, b = self.spans.pop(0)
                masked = (masked or "") + self.marks.unescape(self.held[a - self.base : b - self.base])
            yield role, body, masked
            at = end + len(end_mark)
        self.held = self.held[at:]
        self.base += at

    def _end(self, at: int, mark: str) -> int:
        """Position of the next closing mark that no odd number of backslashes precedes."""
        while (end := self.held.find(mark, at)) >= 0:
            slashes = end
            while slashes > at and self.held[slashes - 1] == "\\":
                slashes -= 1
            if (end - slashes) % 2 == 0:
                return end
            at = end + 1
        return -1


# ---- on the cluster ---------------------------------------------------------------------------------------------------

FORMATTED = "conv_id long, part int, formatted string, spans array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: Template | None = None, part_chars: int = 4_000_000) -> DataFrame:
    """(conv_id, part, formatted, spans) from rows (conv_id, turn, role, text): one row for each conversation, further ones for
    what is beyond ``part_chars``.  Spans are the generated ranges, in code points from the conversation's start; a span that
    reaches into the next part is given there again from the cut on."""
    template = template or Template()

    def run(batches):
        def turns():
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True)

        stream = turns()
        row = next(stream, None)
        rows_out: list[tuple] = []
        held = 0
        while row is not None:
            conv = row[0]

            def messages(conv=conv):
                nonlocal row
                while row is not None and row[0] == conv:
                    yield {"role": row[1] or "", "text": row[2] or ""}
                    row = next(stream, None)

            source = messages()
            text, spans, size, at, part = [], [], 0, 0, 0
            for s, marked in template.render(source):
                if marked and s:
                    if spans and spans[-1]["end"] == at and spans[-1]["open"]:
                        spans[-1]["end"] = at + len(s)
                    else:
                        spans.append({"start": at, "end": at + len(s), "open": True})
                elif s and spans:
                    spans[-1]["open"] = False
                text.append(s)
                at += len(s)
                size += len(s)
                if size >= part_chars:
                    yield _batch([(conv, part, "".join(text), spans)])
                    text, spans, size, part = [], [], 0, part + 1
            for _ in source:  # a template that doesn't look at all messages
                pass
            rows_out.append((conv, part, "".join(text), spans))
            held += size
            if held >= part_chars or len(rows_out) >= 2000:
                yield _batch(rows_out)
                rows_out, held = [], 0
        if rows_out:
            yield _batch(rows_out)

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    clean = [[{"start": s["start"], "end": s["end"]} for s in r[3]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array(clean, spans)], names=["conv_id", "part", "formatted", "spans"])


def read_digests(formatted: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """What :class:`Reader` recovers from the rows of :func:`format_conversations` (in their order), as counts and SHA-256."""

    def run(batches):
        conv, reader, out, opened = None, None, [], False

        def done():
            out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        n = loss_n = chars = 0
        turns = loss = None
        for b in batches:
            for c, part, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part == 0:
                    if opened:
                        done()
                    conv, reader, opened = c, Reader(marks), True
                    n = loss_n = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, body, masked in reader.feed(text, [(s["start"], s["end"]) for s in spans]):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    if masked is not None:
                        loss_n += len(masked)
                        loss.update(masked.encode("utf-8", "surrogatepass"))
            if len(out) >= 5000:
                yield _digest_batch(out)
                out = []
        if opened:
            done()
        if out:
            yield _digest_batch(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(out: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


__all__ = ["Template", "TemplateError", "Marks", "Reader", "parse", "fold", "format_conversations", "read_digests"]
