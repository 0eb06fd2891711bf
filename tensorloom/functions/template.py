"""The template language: twenty functions, expressions, if, for and set.

Functions of single values are Catalyst expressions.  A whole template runs in
an Arrow function over JSON inputs, from a syntax tree made once on the driver.
Templates always end: loops run over values, and there is no recursion.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


# -- functions as Catalyst expressions ------------------------------------------------------


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2))))


#: Characters after which a word begins in ``title``, beside white space.
_OPENERS = "-({[<"


def title(s: Column) -> Column:
    """First letters upper and the rest lower, where words begin after a blank or an opener."""
    chars = F.split(F.lower(s), "")
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("new"))

    def step(acc, c):
        opens = c.rlike(r"^\s$") | F.lit(_OPENERS).contains(c) & (c != "")
        return F.struct(F.concat(acc["out"], F.when(acc["new"], F.upper(c)).otherwise(c)).alias("out"), F.coalesce(opens, F.lit(False)).alias("new"))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def join(xs: Column, sep: str = "") -> Column:
    return F.array_join(xs, sep)


def default(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def get(xs: Column, key, other: Column | None = None) -> Column:
    """By key of a map or by place in a list."""
    got = F.try_element_at(xs, F.lit(key if isinstance(key, str) else key + 1 if key >= 0 else key))
    return got if other is None else F.coalesce(got, other)


def length(s: Column) -> Column:
    return F.char_length(s)


def first(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.get(xs, F.lit(0))).otherwise(F.raise_error(F.lit("first of nothing")))


def last(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.element_at(xs, -1)).otherwise(F.raise_error(F.lit("last of nothing")))


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split(s: Column, sep: str) -> Column:
    if not sep:
        raise TemplateError("split by nothing")
    return F.split(s, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", sep), -1)


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    return F.transform(keys(m), lambda k: F.try_element_at(m, k))


def string(x: Column) -> Column:
    return x.cast("string")


def to_int(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "").cast("long")


def absolute(x: Column) -> Column:
    return F.abs(x)


def tojson(x: Column) -> Column:
    return F.to_json(x)


#: Directives of strftime and the pattern of each (fixed values).
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "E"}


def strftime(seconds: Column, form: str) -> Column:
    """A UTC time; directives outside the set are refused."""
    parts, i = [], 0
    stamp = F.timestamp_seconds(seconds)

    def pattern(p):
        return F.date_format(stamp, p)

    while i < len(form):
        if form[i] != "%":
            j = form.find("%", i)
            j = len(form) if j < 0 else j
            parts.append(F.lit(form[i:j]))
            i = j
            continue
        d = form[i + 1 : i + 2]
        i += 2
        if d == "%":
            parts.append(F.lit("%"))
        elif d == "F":
            parts.append(pattern("yyyy-MM-dd"))
        elif d == "T":
            parts.append(pattern("HH:mm:ss"))
        elif d == "e":
            parts.append(F.lpad(pattern("d"), 2, " "))
        elif d == "s":
            parts.append(seconds.cast("string"))
        elif d in _DIRECTIVES:
            parts.append(pattern(_DIRECTIVES[d]))
        else:
            raise TemplateError(f"no directive %{d}")
    return F.concat(*parts)


# -- syntax ---------------------------------------------------------------------------------

_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>()\[\]{},.:|=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


@dataclass
class _Node:
    kind: str
    args: tuple


def _blocks(source: str) -> list[tuple[str, str]]:
    """Pieces of text, output and statements; ``-`` strips white space at its side."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        if m[0][2] == "-":
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if m[1] is not None:
            out.append(("tag", m[1]))
        elif m[2] is not None:
            out.append(("out", m[2]))
        strip, at = m[0][-3] == "-", m.end()
    rest = source[at:].lstrip() if strip else source[at:]
    return [*out, ("text", rest)] if rest else out


class _Parser:
    """Expressions by precedence climbing."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            if m[1]:
                self.tokens.append(("num", float(m[1]) if "." in m[1] else int(m[1])))
            elif m[2]:
                self.tokens.append(("str", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m[2][1:-1])))
            elif m[3]:
                self.tokens.append(("name", m[3]))
            else:
                self.tokens.append(("op", m[4]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        t = self.peek()
        if value is not None and t[1] != value:
            raise TemplateError(f"{value!r} expected, not {t[1]!r}")
        self.at += 1
        return t

    def whole(self) -> _Node:
        node = self.ternary()
        if self.peek()[0] != "end":
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return node

    def ternary(self) -> _Node:
        node = self.level(0)
        if self.peek() == ("name", "if"):
            self.take()
            condition = self.level(0)
            other = _Node("const", (None,))
            if self.peek() == ("name", "else"):
                self.take()
                other = self.ternary()
            return _Node("if", (condition, node, other))
        return node

    def level(self, n: int) -> _Node:
        if n == len(self.LEVELS):
            return self.unary()
        node = self.level(n + 1)
        while True:
            kind, value = self.peek()
            if kind == "name" and value == "not" and self.peek(1) == ("name", "in") and n == 2:
                self.take()
                value = "not in"
            elif kind == "name" and value == "is" and n == 2:
                self.take()
                negate = self.peek() == ("name", "not")
                if negate:
                    self.take()
                node = _Node("is", (node, self.take()[1], negate))
                continue
            elif value not in self.LEVELS[n] or kind not in ("op", "name"):
                return node
            self.take()
            node = _Node("binary", (value, node, self.level(n + 1)))

    def unary(self) -> _Node:
        if self.peek() == ("name", "not"):
            self.take()
            return _Node("not", (self.level(2),))
        if self.peek() == ("op", "-"):
            self.take()
            return _Node("minus", (self.unary(),))
        return self.filters(self.postfix())

    def filters(self, node: _Node) -> _Node:
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()[1]
            args = self.arguments() if self.peek() == ("op", "(") else []
            node = _Node("call", (name, [node, *args]))
        return node

    def arguments(self) -> list[_Node]:
        self.take("(")
        out = []
        while self.peek() != ("op", ")"):
            if self.peek()[0] == "name" and self.peek(1) == ("op", "="):
                self.at += 2
            out.append(self.ternary())
            if self.peek() == ("op", ","):
                self.take()
        self.take(")")
        return out

    def postfix(self) -> _Node:
        node = self.primary()
        while True:
            if self.peek() == ("op", "."):
                self.take()
                name = self.take()[1]
                if self.peek() == ("op", "("):
                    node = _Node("call", (METHODS.get(name, name), [node, *self.arguments()]))
                else:
                    node = _Node("get", (node, _Node("const", (name,))))
            elif self.peek() == ("op", "["):
                self.take()
                low = None if self.peek() == ("op", ":") else self.ternary()
                if self.peek() == ("op", ":"):
                    self.take()
                    high = None if self.peek() == ("op", "]") else self.ternary()
                    node = _Node("slice", (node, low, high))
                else:
                    node = _Node("get", (node, low))
                self.take("]")
            else:
                return node

    def primary(self) -> _Node:
        kind, value = self.take()
        if kind in ("num", "str"):
            return _Node("const", (value,))
        if kind == "name":
            low = value.lower()
            if low in ("true", "false", "none", "null"):
                return _Node("const", ({"true": True, "false": False}.get(low),))
            if self.peek() == ("op", "("):
                return _Node("call", (value, self.arguments()))
            return _Node("name", (value,))
        if value == "(":
            node = self.ternary()
            self.take(")")
            return node
        if value == "[":
            out = []
            while self.peek() != ("op", "]"):
                out.append(self.ternary())
                if self.peek() == ("op", ","):
                    self.take()
            self.take("]")
            return _Node("list", (out,))
        raise TemplateError(f"unexpected {value!r}")


#: Methods of the source dialect and the functions that they stand for.
METHODS = {"strip": "trim", "title": "title", "upper": "upper", "lower": "lower", "split": "split", "items": "items", "replace": "replace", "startswith": "startswith", "endswith": "endswith", "get": "get", "keys": "keys", "values": "values"}


def parse(source: str) -> list[_Node]:
    """The syntax tree; what the language lacks is refused by name."""
    pieces = _blocks(source)
    at = 0

    def body(*ends: str) -> tuple[list[_Node], str]:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(_Node("text", (text,)))
            elif kind == "out":
                out.append(_Node("out", (_Parser(text).whole(),)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return out, text
                if word == "if":
                    out.append(conditional(rest))
                elif word == "for":
                    m = re.fullmatch(r"(\w+(?:\s*,\s*\w+)*)\s+in\s+(.*?)(?:\s+if\s+(.*))?", rest, re.DOTALL)
                    if not m:
                        raise TemplateError(f"cannot read for {rest!r}")
                    inner, end = body("else", "endfor")
                    other = body("endfor")[0] if end == "else" else []
                    names = [n.strip() for n in m[1].split(",")]
                    out.append(_Node("for", (names, _Parser(m[2]).whole(), _Parser(m[3]).whole() if m[3] else None, inner, other)))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    if "." in name:
                        raise TemplateError("refused: namespace")
                    out.append(_Node("set", (name.strip(), _Parser(value).whole())))
                elif word in ("generation", "endgeneration"):
                    continue
                else:
                    raise TemplateError(f"refused: {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def conditional(test: str) -> _Node:
        inner, end = body("elif", "else", "endif")
        other: list[_Node] = []
        if end.startswith("elif"):
            other = [conditional(end.partition(" ")[2])]
        elif end == "else":
            other = body("endif")[0]
        return _Node("branch", (_Parser(test).whole(), inner, other))

    return body()[0]


def free_vars(source: str) -> set[str]:
    """The inputs that a template reads."""
    out: set[str] = set()

    def walk(node: Any, bound: frozenset) -> None:
        if isinstance(node, list):
            for n in node:
                walk(n, bound)
                if isinstance(n, _Node) and n.kind == "set":
                    bound = bound | {n.args[0]}
        elif isinstance(node, _Node):
            if node.kind == "name" and node.args[0] not in bound:
                out.add(node.args[0])
            elif node.kind == "for":
                names, xs, condition, inner, other = node.args
                walk(xs, bound)
                own = bound | set(names) | {"loop"}
                walk([condition] if condition else [], own)
                walk(inner, own)
                walk(other, bound)
            else:
                for a in node.args:
                    walk(a, bound)

    walk(parse(source), frozenset())
    return out


# -- evaluation -------------------------------------------------------------------------------


def to_json_text(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer():
        return f"{x:.1f}"
    return to_json_text(x) if isinstance(x, (list, dict)) else str(x)


def _title(s: str) -> str:
    out, new = [], True
    for c in s:
        out.append(c.upper() if new else c.lower())
        new = c.isspace() or c in _OPENERS
    return "".join(out)


def _end(xs, k: int, name: str):
    if not xs:
        raise TemplateError(f"{name} of nothing")
    return xs[k]


def _get(xs, key, other=None):
    if isinstance(xs, dict):
        return xs.get(key, other)
    if isinstance(xs, (list, str)) and isinstance(key, int) and -len(xs) <= key < len(xs):
        return xs[key]
    return other


def _int(x) -> int:
    if isinstance(x, str):
        return int(x.strip())
    return int(x)


def _abs(x):
    if x == -(1 << 63):
        raise TemplateError("abs overflows")
    return abs(x)


def _split(s: str, sep: str | None = None) -> list[str]:
    if not sep:
        raise TemplateError("split by nothing")
    return s.split(sep)


def _strftime(seconds: int, form: str) -> str:
    for d in re.findall(r"%(.)", form):
        if d not in "FTes%" and d not in _DIRECTIVES:
            raise TemplateError(f"no directive %{d}")
    t = datetime.datetime.fromtimestamp(seconds, datetime.UTC)
    return t.strftime(form.replace("%s", str(seconds)))


FUNCTIONS: dict[str, Callable] = {
    "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(),
    "trim": lambda s: s.strip(),
    "capitalize": lambda s: s[:1].upper() + s[1:].lower(),
    "title": _title,
    "join": lambda xs, sep="": sep.join(map(_text, xs)),
    "default": lambda x, other: other if x is None else x,
    "get": _get,
    "tojson": to_json_text,
    "strftime": _strftime,
    "length": len,
    "first": lambda xs: _end(xs, 0, "first"),
    "last": lambda xs: _end(xs, -1, "last"),
    "replace": lambda s, a, b: s.replace(a, b),
    "split": _split,
    "keys": lambda m: sorted(m),
    "values": lambda m: [m[k] for k in sorted(m)],
    "string": _text,
    "int": _int,
    "abs": _abs,
}
#: Further names that the translator maps onto the language.
EXTRA: dict[str, Callable] = {
    "items": lambda m: [[k, m[k]] for k in sorted(m)],
    "startswith": lambda s, x: s.startswith(x),
    "endswith": lambda s, x: s.endswith(x),
    "list": list,
}


def _raise(message: str):
    raise TemplateError(message)


def _binary(op: str, a: Callable, b: Callable):
    if op == "or":
        x = a()
        return x if x else b()
    if op == "and":
        x = a()
        return b() if x else x
    x, y = a(), b()
    match op:
        case "==":
            return x == y
        case "!=":
            return x != y
        case "<":
            return x < y
        case "<=":
            return x <= y
        case ">":
            return x > y
        case ">=":
            return x >= y
        case "in":
            return x in y
        case "not in":
            return x not in y
        case "~":
            return _text(x) + _text(y)
        case "+":
            return x + y
        case "-":
            return x - y
        case "*":
            return x * y
        case "/":
            return x / y
        case _:
            return x % y


def _tests(name: str, x: Any) -> bool:
    match name:
        case "defined":
            return x is not None
        case "none" | "undefined":
            return x is None
        case "string":
            return isinstance(x, str)
        case "mapping":
            return isinstance(x, dict)
        case "iterable" | "sequence":
            return isinstance(x, (list, str, dict))
        case "number":
            return isinstance(x, (int, float)) and not isinstance(x, bool)
        case "true":
            return x is True
        case "false":
            return x is False
    raise TemplateError(f"no test {name!r}")


def _eval(node: _Node, scope: dict) -> Any:
    a = node.args
    match node.kind:
        case "const":
            return a[0]
        case "name":
            return scope.get(a[0])
        case "list":
            return [_eval(x, scope) for x in a[0]]
        case "get":
            return _get(_eval(a[0], scope), _eval(a[1], scope))
        case "slice":
            low, high = (None if x is None else _eval(x, scope) for x in a[1:])
            return _eval(a[0], scope)[low:high]
        case "if":
            return _eval(a[1] if _eval(a[0], scope) else a[2], scope)
        case "not":
            return not _eval(a[0], scope)
        case "minus":
            return -_eval(a[0], scope)
        case "is":
            return _tests(a[1], _eval(a[0], scope)) != a[2]
        case "binary":
            return _binary(a[0], lambda: _eval(a[1], scope), lambda: _eval(a[2], scope))
        case "call":
            if a[0] == "raise_exception":
                _raise(_text(_eval(a[1][0], scope)))
            f = FUNCTIONS.get(a[0]) or EXTRA.get(a[0])
            if f is None:
                raise TemplateError(f"no function {a[0]!r}")
            return f(*(_eval(x, scope) for x in a[1]))
    raise TemplateError(node.kind)


def _run(nodes: list[_Node], scope: dict, out: list[str]) -> None:
    for node in nodes:
        a = node.args
        match node.kind:
            case "text":
                out.append(a[0])
            case "out":
                out.append(_text(_eval(a[0], scope)))
            case "set":
                scope[a[0]] = _eval(a[1], scope)
            case "branch":
                _run(a[1] if _eval(a[0], scope) else a[2], scope, out)
            case "for":
                names, xs, condition, inner, other = a
                values = list(_eval(xs, scope) or [])

                def bound(x, names=names, scope=scope):
                    own = dict(scope)
                    own.update(zip(names, x, strict=True) if len(names) > 1 else [(names[0], x)])
                    return own

                if condition is not None:
                    values = [x for x in values if _eval(condition, bound(x))]
                for i, x in enumerate(values):
                    own = bound(x)  # what a body sets ends with the round
                    own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1, "length": len(values), "previtem": values[i - 1] if i else None, "nextitem": values[i + 1] if i + 1 < len(values) else None}
                    _run(inner, own, out)
                if not values:
                    _run(other, scope, out)


def render_one(source: str | list[_Node], inputs: dict) -> str:
    """One rendering, on the driver."""
    out: list[str] = []
    _run(parse(source) if isinstance(source, str) else source, dict(inputs), out)
    return "".join(out)


def render(source: str):
    """A column function from JSON objects to rendered text; null gives null."""
    tree = parse(source)

    @F.arrow_udf("string")
    def run(inputs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render_one(tree, json.loads(x)) for x in inputs.to_pylist()], pa.string())

    return run


def translate(source: str) -> tuple[str, str]:
    """(status, note) of a template of the source dialect: translated, or refused and why."""
    try:
        parse(source)
    except TemplateError as e:
        return "refused", str(e)
    return "translated", ""
