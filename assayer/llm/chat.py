"""Chat formatting with a template compiler.

A template is text with `{{ expression }}` outputs and `{% statement %}` blocks: for / endfor, if / elif / else /
endif, set, and generation / endgeneration around what a model is to learn. It is parsed into a syntax tree,
constant parts are folded, and the tree is compiled into Python closures over a list of variables.
The language is closed: it has names, literals, comparison, boolean and arithmetic operators, subscripts of the
data it is given and the filters in FILTERS, and nothing that reaches a Python attribute, a builtin or a module.

Control strings inside texts are escaped reversibly: backslashes are doubled, and a backslash goes in after the
first character of every control string, so that an escaped text holds none and read_back() is exact. A role ends
at the line's end, so that line feeds in roles are written as a backslash and n.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers

#: The strings that mark turns in this template and in common public ones.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = "{% for m in messages %}" + OPEN + "{{ m['role'] | escape_role }}\n{% if m['role'] == 'assistant' %}{% generation %}{{ m['text'] | escape }}{% endgeneration %}{% else %}{{ m['text'] | escape }}{% endif %}" + CLOSE + "\n{% endfor %}"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_ESCAPED_ROLE = re.compile(r"\\([\\n]?)")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """In a role, what would be read as an escaped line feed cannot come from a control string: none goes on with an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(str(x)), "escape_role": lambda x: escape_role(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
BINARY: dict[str, Callable[[Any, Any], Any]] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod, "~": lambda a, b: f"{a}{b}", "in": lambda a, b: a in b}
PRECEDENCE = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))
#: The greatest string or list that an expression may make.
MOST = 1 << 28


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Apply:
    name: str
    to: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parser

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~<>()\[\].|,]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKENS.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Any:
        out = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def level(self, n: int) -> Any:
        if n == len(PRECEDENCE):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in PRECEDENCE[n]:
            sign = self.take()[1]
            left = Op(sign, (left, self.level(n + 1)))
        return left

    def unary(self) -> Any:
        if self.peek() in ("not", "-"):
            sign = self.take()[1]
            return Op(f"{sign} ", (self.unary(),))
        out = self.atom()
        while self.peek() in ("[", ".", "|"):
            sign = self.take()[1]
            if sign == "[":
                out = Item(out, self.level(0))
                self.take("]")
            else:
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow")
                if sign == "|" and name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = Apply(name, out) if sign == "|" else Item(out, Const(name))
        return out

    def atom(self) -> Any:
        kind, text = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(text))
        if kind == "name":
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(text.lower(), Name(text))
        if text == "(":
            out = self.level(0)
            self.take(")")
            return out
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [p for p in _PARTS.split(source) if p and not p.startswith("{#")]
    body, at, _ = _block(parts, 0, ())
    if at < len(parts):
        raise TemplateError(f"unexpected {parts[at]}")
    return body


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    out: list = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            out.append(Output(_Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            statement = part[2:-2].strip()
            word, _, rest = statement.partition(" ")
            if word in ends:
                return tuple(out), at, statement
            if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                body, at, _ = _block(parts, at + 1, ("endfor",))
                out.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "if":
                branches, other, statement = [], (), rest
                while True:
                    body, at, end = _block(parts, at + 1, ("elif", "else", "endif"))
                    branches.append((_Expression(statement).whole(), body))
                    if end.startswith("elif"):
                        statement = end[4:]
                        continue
                    if end == "else":
                        other, at, _ = _block(parts, at + 1, ("endif",))
                    break
                out.append(If(tuple(branches), other))
            elif word == "generation":
                body, at, _ = _block(parts, at + 1, ("endgeneration",))
                out.append(Generation(body))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)):
                out.append(Set(m[1], _Expression(m[2]).whole()))
            else:
                raise TemplateError(f"unknown statement {statement!r}")
        else:
            out.append(Output(Const(part)))
        at += 1
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return tuple(out), at, ""


# Constant folding


def fold(node: Any) -> Any:
    """The tree with constant expressions evaluated, dead branches removed and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(_shown(out[-1].value.value) + _shown(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        parts = tuple(map(fold, node.parts))
        return _constant(Op(node.sign, parts), all(isinstance(p, Const) for p in parts))
    if isinstance(node, Apply):
        to = fold(node.to)
        return _constant(Apply(node.name, to), isinstance(to, Const))
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition)
            if not isinstance(condition, Const):
                branches.append((condition, fold(body)))
            elif condition.value:
                return If(tuple(branches), fold(body)) if branches else fold(body)
        return If(tuple(branches), fold(node.other)) if branches else fold(node.other)
    return node


def _constant(node: Any, known: bool) -> Any:
    return Const(_expression(node)({})) if known else node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


# Compiler


def _expression(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of), _expression(node.key)

        def item(scope: dict) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    if isinstance(node, Apply):
        to, apply = _expression(node.to), FILTERS[node.name]
        return lambda scope: apply("" if (x := to(scope)) is None else x)
    parts = [_expression(p) for p in node.parts]
    if node.sign == "not ":
        return lambda scope: not parts[0](scope)
    if node.sign == "- ":
        return lambda scope: -parts[0](scope)
    left, right = parts
    if node.sign == "and":
        return lambda scope: left(scope) and right(scope)
    if node.sign == "or":
        return lambda scope: left(scope) or right(scope)
    apply2 = BINARY[node.sign]
    if node.sign == "*":

        def product(scope: dict) -> Any:
            a, b = left(scope), right(scope)
            if (len(a) if isinstance(a, (str, list)) else 1) * (b if isinstance(b, int) else 1) > MOST or not isinstance(b, int):
                raise TemplateError("too large a product")
            return a * b

        return product

    def binary(scope: dict) -> Any:
        a, b = left(scope), right(scope)
        try:
            return apply2(a, b)
        except (TypeError, ZeroDivisionError) as e:
            raise TemplateError(str(e)) from e

    return binary


class Sink:
    """Takes the rendered text and notes the spans, in code points, that lie under a generation marker."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.at += len(text)


def _statements(body: tuple) -> Callable[[dict, Sink], None]:
    steps = [_statement(x) for x in body]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, sink: Sink) -> None:
        for step in steps:
            step(scope, sink)

    return run


def _statement(node: Any) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _shown(node.value.value)
            return lambda scope, sink: sink.write(text)
        value = _expression(node.value)
        return lambda scope, sink: sink.write(_shown(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value)
        return lambda scope, sink: scope.__setitem__(name, value(scope))
    if isinstance(node, Generation):
        body = _statements(node.body)

        def generation(scope: dict, sink: Sink) -> None:
            start = sink.at
            body(scope, sink)
            sink.spans.append((start, sink.at))

        return generation
    if isinstance(node, If):
        branches, other = [(_expression(c), _statements(b)) for c, b in node.branches], _statements(node.other)

        def choose(scope: dict, sink: Sink) -> None:
            for condition, body in branches:
                if condition(scope):
                    return body(scope, sink)
            other(scope, sink)

        return choose
    if isinstance(node, For):
        name, over, body = node.name, _expression(node.over), _statements(node.body)

        def loop(scope: dict, sink: Sink) -> None:
            inner = dict(scope)
            for i, inner[name] in enumerate(over(scope) or ()):
                inner["index"] = i
                body(inner, sink)

        return loop
    raise TemplateError(f"{node!r} is no statement")


def compile_template(source: str) -> Callable[[dict], Sink]:
    """A function from variables to a Sink."""
    run = _statements(fold(parse(source)))

    def render(variables: dict) -> Sink:
        sink = Sink()
        run(dict(variables), sink)
        return sink

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE has made."""
    out = []
    for turn in text.split(OPEN)[1:]:
        role, _, rest = turn.partition("\n")
        if not rest.endswith(CLOSE + "\n"):
            raise ValueError("a turn isn't closed")
        out.append((unescape_role(role), unescape(rest[: -len(CLOSE) - 1])))
    return out


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversations and number -1, whose texts hold control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(rows)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, spans): each conversation's turns rendered in order, in one or more parts.

    Turns are ordered by number (null last), then role and text, so that ties and repeated rows, which are turns of their
    own, have one order. A null text or role counts as empty, and a null conv_id is a conversation. Spans are
    array<struct<start, stop>> of the text under the loss mask, within the part. A part ends after PART code points, so
    that the longest conversation needs no more memory than that; TEMPLATE renders turns one by one, and other templates
    must do so too if conversations are longer.
    """
    compile_template(template)  # a faulty template fails here
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compile_template(template)
        held: list[dict] = []
        key, part, size = None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            sink = own({"messages": held})
            out.append((key, part, "".join(sink.parts), [{"start": a, "stop": b} for a, b in sink.spans]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            ids, parts, texts, spans = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["conv_id", "part", "formatted", "spans"])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (conv_id != key or size > PART):
                    close()
                    part, held, size = part + 1 if conv_id == key else 0, [], 0
                key = conv_id
                held.append({"role": role or "", "text": text or ""})
                size += len(text or "")
                if len(out) >= 512 or sum(len(x[2]) for x in out[-8:]) > PART:
                    yield batch_of(out)
                    out.clear()
        if held:
            close()
        if out:
            yield batch_of(out)

    on_workers(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.col("turn").cast("long").alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part int, formatted string, spans array<struct<start: long, stop: long>>")


#: Code points in a part.
PART = 8_000_000


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text alone.

    The parts of a conversation come one after another, as format_conversations() leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> list:
            return [key, n, turns.hexdigest(), chars, loss.hexdigest(), total]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[list] = []
        key, n, chars, total, turns, loss, begun = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False
        for batch in batches:
            for conv_id, part, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part == 0:
                    if begun:
                        out.append(row())
                    key, n, chars, total, turns, loss, begun = conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
                for role, said in read_back(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["stop"]])
                    chars += len(said)
                    loss.update(said.encode())
                total += len(text)
            if len(out) > 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if begun:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:  # none is part of another, and none ends as another begins
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(OPEN) + len(CLOSE) + 2}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

