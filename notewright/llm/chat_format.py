"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes
nested Python closures; no code is evaluated and a template reaches nothing but the
names it is given. A template renders a whole conversation, whose turns it takes one by
one and gives out piece by piece, so a conversation of any length takes the memory of its
longest turn; it can loop over the turns once.

Language: text; ``{{ expression }}``; ``{% if e %} {% elif e %} {% else %} {% endif %}``;
``{% for name in e %} {% endfor %}`` (with loop.first and loop.index0);
``{% generation %} {% endgeneration %}`` around what a model is trained on.
Expressions: strings, integers, true, false, none, names, ``a.b``, ``+ == != not and or``,
parentheses, and filters ``x | name`` out of FILTERS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import arrow_rows, lean, partitions, table

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))")
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None}

# What marks turns. The escape character itself and every control string's first character are escaped in texts.
OPEN, CLOSE, ESCAPE = "[INST]", "[/INST]", "\\"
CONTROL = re.compile(r"\\|\[(?=/?INST\]|/?TURN\b)|<(?=/?s>)")
_BACK = re.compile(r"\\(.)", re.DOTALL)
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '<s>' }}{{ '[INST]' + ' ' }}{{ m.text | escape }}{{ ' ' + '[/INST]' }}"
    "{% elif m.role == 'assistant' %}{{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}"
    "{% else %}{{ '[TURN ' }}{{ m.role | escape_role }}{{ ']' }}{{ m.text | escape }}{{ '[/TURN]' }}{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Control strings of the default template made harmless; unescape() is the inverse."""
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def escape_role(role: str) -> str:
    return "".join("\\" + c if c in "\\]" else c for c in role)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


# --- expressions: ("const", value), ("name", n), ("get", e, attribute), ("call", filter, e), ("bin", op, a, b), ("not", e)
class _Expression:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def parse(self):
        e = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def _next(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _left(self, part, *ops):
        e = part()
        while op := self._next(*ops):
            e = ("bin", op, e, part())
        return e

    def _or(self):
        return self._left(self._and, "or")

    def _and(self):
        return self._left(self._not, "and")

    def _not(self):
        return ("not", self._not()) if self._next("not") else self._left(self._sum, "==", "!=")

    def _sum(self):
        return self._left(self._filtered, "+")

    def _filtered(self):
        e = self._atom()
        while self._next("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            e = ("call", name, e)
        return e

    def _atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(value))
        if value == "(":
            e = self._or()
            if not self._next(")"):
                raise TemplateError("missing )")
        elif kind == "name":
            e = ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self._next("."):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no attribute {name!r}")
            self.at += 1
            e = ("get", e, name)
        return e


def _checked(what: str, f: Callable) -> Callable:
    """f, whose errors on values of a wrong type are the template's."""

    def run(*values):
        try:
            return f(*values)
        except (TypeError, AttributeError) as e:
            raise TemplateError(f"{what} of {' and '.join(type(v).__name__ for v in values)}") from e

    return run


_BINARY = {"+": _checked("+", lambda a, b: a + b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _filter(name: str) -> Callable:
    """A filter; none is the empty text to it."""
    return _checked(name, lambda v: FILTERS[name]("" if v is None else v))


def _fold(e):
    """The expression with its constant parts computed."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "get":
        return ("get", _fold(e[1]), e[2])
    if kind == "call":
        a = _fold(e[2])
        return ("const", _filter(e[1])(a[1])) if a[0] == "const" else ("call", e[1], a)
    if kind == "not":
        a = _fold(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    a, b = _fold(e[2]), _fold(e[3])
    if e[1] in ("and", "or"):
        if a[0] == "const":
            return b if bool(a[1]) == (e[1] == "and") else a
    elif a[0] == b[0] == "const":
        return ("const", _BINARY[e[1]](a[1], b[1]))
    return ("bin", e[1], a, b)


def _closure(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "get":  # keys of mappings alone, never attributes of objects
        return lambda env, a=_closure(e[1]), n=e[2]: x.get(n) if isinstance(x := a(env), dict) else None
    if kind == "call":
        return lambda env, f=_filter(e[1]), a=_closure(e[2]): f(a(env))
    if kind == "not":
        return lambda env, a=_closure(e[1]): not a(env)
    a, b = _closure(e[2]), _closure(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_BINARY[e[1]]: f(a(env), b(env))


# --- statements: ("text", s), ("show", e), ("if", [(e, body)...], body), ("for", name, e, body), ("generation", body)
def _parse(source: str):
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL)
    at = 0

    def body(*ends: str):
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(("show", _Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, rest
                out.append(statement(word, rest))
            elif part:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, "", ""

    def statement(word: str, rest: str):
        if word == "generation":
            return ("generation", body("endgeneration")[0])
        if word == "for":
            name, _, e = rest.partition(" in ")
            if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"cannot loop over {rest!r}")
            return ("for", name.strip(), _Expression(e).parse(), body("endfor")[0])
        if word == "if":
            cases = []
            while True:
                own, end, more = body("elif", "else", "endif")
                cases.append((_Expression(rest).parse(), own))
                if end == "elif":
                    rest = more
                    continue
                return ("if", cases, body("endif")[0] if end == "else" else [])
        raise TemplateError(f"no statement {word!r}")

    return body()[0]


def _fold_body(nodes: list) -> list:
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "show":
            e = _fold(node[1])
            node = ("text", "" if e[1] is None else str(e[1])) if e[0] == "const" else ("show", e)
            new = [node]
        elif kind == "if":
            cases, other = [], _fold_body(node[2])
            for e, own in ((_fold(e), own) for e, own in node[1]):
                if e[0] == "const" and not e[1]:
                    continue
                if e[0] == "const":
                    other = _fold_body(own)
                    break
                cases.append((e, _fold_body(own)))
            new = [("if", cases, other)] if cases else other
        elif kind == "for":
            new = [("for", node[1], _fold(node[2]), _fold_body(node[3]))]
        elif kind == "generation":
            new = [("generation", _fold_body(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _compile_body(nodes: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_compile_node(n) for n in nodes]

    def run(env, masked):
        for step in steps:
            yield from step(env, masked)

    return steps[0] if len(steps) == 1 else run


def _compile_node(node):
    kind = node[0]
    if kind == "text":
        return lambda env, masked, s=node[1]: iter(((s, masked),))
    if kind == "show":
        e = _closure(node[1])
        return lambda env, masked: iter((("" if (v := e(env)) is None else str(v), masked),))
    if kind == "generation":
        inner = _compile_body(node[1])
        return lambda env, masked: inner(env, True)
    if kind == "if":
        cases, other = [(_closure(e), _compile_body(b)) for e, b in node[1]], _compile_body(node[2])
        return lambda env, masked: next((b for e, b in cases if e(env)), other)(env, masked)
    name, source, inner = node[1], _closure(node[2]), _compile_body(node[3])

    def loop(env, masked):
        for i, x in enumerate(source(env) or ()):
            yield from inner({**env, name: x, "loop": {"index0": i, "first": not i}}, masked)

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str = DEFAULT_TEMPLATE):
        self.tree = _fold_body(_parse(source))
        self._run = _compile_body(self.tree)

    def pieces(self, messages: Iterable[dict], **names) -> Iterator[tuple[str, bool]]:
        """(text, whether it is under the loss mask), in order; reads messages one by one."""
        return self._run({"messages": messages, **names}, False)

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """(text, ranges of code points under the loss mask)."""
        out, spans, n = [], [], 0
        for s, masked in self.pieces(messages, **names):
            if masked and s:
                spans.append((n, n + len(s)))
            out.append(s)
            n += len(s)
        return "".join(out), spans


_HEAD = re.compile(r"<s>\[INST\] |\[TURN ((?:\\.|[^\\\]])*)\]| ", re.DOTALL)
_ENDS = {"user": " [/INST]", "assistant": "</s>"}


class Reader:
    """Reads turns back from text that DEFAULT_TEMPLATE gave, fed piece by piece."""

    def __init__(self):
        self.buffer = ""

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[str, str]]:
        self.buffer += text
        while self.buffer:
            head = _HEAD.match(self.buffer)
            if not head:
                break
            role = "user" if head[0].startswith("<s>") else "assistant" if head[0] == " " else unescape(head[1])
            stop = _ENDS.get(role, "[/TURN]") if not head[0].startswith("[") else "[/TURN]"
            at = self._end(stop, head.end())
            if at < 0:
                break
            yield role, unescape(self.buffer[head.end() : at])
            self.buffer = self.buffer[at + len(stop) :]
        if last and self.buffer:
            raise ValueError("the text ends within a turn")

    def _end(self, stop: str, at: int) -> int:
        """Where `stop` begins, not escaped: control strings in texts have the escape before their first character."""
        mark = stop.lstrip()
        while (found := self.buffer.find(mark, at)) >= 0:
            slashes = len(self.buffer[at:found]) - len(self.buffer[at:found].rstrip("\\"))
            if slashes % 2 == 0:
                return found - (len(stop) - len(mark))
            at = found + 1
        return -1


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(conv: int | None, pieces: Iterable[tuple[str, bool]]) -> tuple:
    """A row of one conversation, read back from its pieces as they come."""
    reader, turns, loss, n, loss_chars, chars = Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for piece, masked in chain(pieces, (("", False),)):
        chars += len(piece)
        if masked:
            plain = unescape(piece)
            loss_chars += len(plain)
            loss.update(plain.encode())
        for role, text in reader.feed(piece):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
    list(reader.feed("", last=True))
    return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its turns, read lazily) of rows in order."""
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, ({"role": role, "text": text} for _, role, text in own)


def _tables(schema: pa.Schema, rows: Iterable[tuple], many: int = 2000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, many)):
        yield arrow_rows(schema, **dict(zip(schema.names, zip(*part, strict=True), strict=True)))


def _in_order(rows: DataFrame) -> DataFrame:
    parts = max(partitions(rows.sparkSession), 2)
    return rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(role, '') role", "coalesce(text, '') text").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_digests(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of `rows` (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text (nulls first); a null role or text
    is an empty one; rows without conv_id are one conversation; repeated rows are
    turns of their own. No rows give no conversations. Turns stream through a task
    one by one, so a conversation with a third of all rows takes time, not memory:
    its digests are of one text in order, which only one task can make.
    """

    def run(batches):
        compiled = Template(template)
        yield from _tables(_SCHEMA, (_digest(conv, compiled.pieces(turns)) for conv, turns in _conversations(batches)))

    return _in_order(rows).mapInArrow(lean(run), DIGEST_DDL)


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, part, text, loss_spans) of the formatted conversations; a conversation's parts in order, joined, are its whole text.

    A part is what a template says from taking one turn to taking the next, so no task
    holds a whole conversation. loss_spans are code points of the whole text.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def parts(compiled: Template, conv: int | None, turns: Iterator[dict]) -> Iterator[tuple]:
        taken, now, at, out, spans = 0, 0, 0, [], []

        def counted():
            nonlocal taken
            for turn in turns:
                taken += 1
                yield turn

        for piece, masked in compiled.pieces(counted()):
            if max(taken - 1, 0) != now:
                yield conv, now, "".join(out), spans
                now, out, spans = taken - 1, [], []
            if masked and piece:
                spans.append({"start": at, "end": at + len(piece)})
            out.append(piece)
            at += len(piece)
        yield conv, now, "".join(out), spans

    def run(batches):
        compiled = Template(template)
        yield from _tables(schema, (row for conv, turns in _conversations(batches) for row in parts(compiled, conv, turns)), 500)

    return _in_order(rows).mapInArrow(lean(run), "conv_id long, part long, text string, loss_spans array<struct<start:long,end:long>>")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_digests of all conversations and of conversation -1, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return format_digests(rows.unionByName(probe))
