"""Prompt templates compiled to Column expressions.

A template is parsed once on the driver; rendering is one projection that stays in the JVM. It has text,
``{{ value }}``, ``{% if %} .. {% elif %} .. {% else %} .. {% endif %}`` and ``{% for x in list %} .. {% endfor %}``
(with ``loop.index``, ``loop.index0``, ``loop.first``, ``loop.last``). A value is a column, a field (``a.b``, ``a['b']``), an
element (``a[0]``) or a literal, with filters behind bars (``text|trim|lower``); conditions compare values and
join with ``and``, ``or``, ``not`` and ``in``. A dash inside a tag (``{%-``, ``-}}``) takes away the white space on
its side, and one line break at the end of the template goes. A name that is no column fails when the plan is
analysed, an unknown filter or form when the template is parsed. Null prints ``None``, booleans ``True`` and ``False``.
"""
from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import PY_WS

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
_FOR = re.compile(r"for\s+(\w+)\s+in\s+(.+)", re.S)
_EDGE = f"^{PY_WS}+|{PY_WS}+$"
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}

Scope = dict[str, Column | dict[str, Column]]


def printed(c: Column) -> Column:
    """A value as text."""
    text = c.cast("string")
    return F.coalesce(F.when(F.typeof(c) == "boolean", F.initcap(text)).otherwise(text), F.lit("None"))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


FILTERS: dict[str, Callable[..., Column]] = {
    "trim": lambda c: F.regexp_replace(c, _EDGE, ""),
    "lower": F.lower, "upper": F.upper, "capitalize": _capital,
    "length": lambda c: F.size(c), "first": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "join": lambda c, sep="": F.array_join(F.transform(c, printed), sep),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
    "default": lambda c, value="": F.coalesce(c, F.lit(value)),
    "regex_replace": lambda c, pattern, value="": F.regexp_replace(c, pattern, value),
    "string": printed, "int": lambda c: F.try_to_number(c, F.lit("S999999999999999999")).cast("long"),
}


def value(text: str, scope: Scope) -> Column:
    """Column of an expression; names come from the scope, else they are columns."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as wrong:
        raise ValueError(f"no template expression: {text!r}") from wrong
    return _column(tree, scope)


def _filtered(c: Column, node: ast.expr) -> Column:
    name, args = (node.func, node.args) if isinstance(node, ast.Call) else (node, [])
    if not isinstance(name, ast.Name) or name.id not in FILTERS or not all(isinstance(a, ast.Constant) for a in args):
        raise ValueError(f"unknown filter {ast.unparse(node)!r}")
    return FILTERS[name.id](c, *[a.value for a in args])


def _column(node: ast.expr, scope: Scope) -> Column:
    go = lambda n: _column(n, scope)
    match node:
        case ast.Constant():
            return F.lit(node.value)
        case ast.List(elts=items):
            return F.array(*[go(x) for x in items])
        case ast.Name(id=name):
            if name.lower() in ("true", "false", "none"):
                return F.lit({"true": True, "false": False, "none": None}[name.lower()])
            held = scope.get(name)
            if isinstance(held, dict):
                raise ValueError(f"{name} has fields only")
            return F.col(f"`{name}`") if held is None else held
        case ast.Attribute(value=ast.Name(id=name), attr=field) if isinstance(scope.get(name), dict):
            if field not in scope[name]:
                raise ValueError(f"{name}.{field} is unknown")
            return scope[name][field]
        case ast.Attribute(value=inner, attr=field):
            return go(inner)[field]
        case ast.Subscript(value=inner, slice=ast.Constant(value=str(field))):
            return go(inner)[field]
        case ast.Subscript(value=inner, slice=ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int(i)))):
            return F.try_element_at(go(inner), F.lit(-i))
        case ast.Subscript(value=inner, slice=index):
            return F.get(go(inner), go(index).cast("int"))
        case ast.BinOp(left=inner, op=ast.BitOr(), right=named):
            return _filtered(go(inner), named)
        case ast.UnaryOp(op=ast.Not(), operand=inner):
            return ~truth(go(inner))
        case ast.BoolOp(op=op, values=parts):
            out = truth(go(parts[0]))
            for p in parts[1:]:
                out = (out & truth(go(p))) if isinstance(op, ast.And) else (out | truth(go(p)))
            return out
        case ast.Compare(left=left, ops=[op], comparators=[right]):
            if isinstance(op, (ast.In, ast.NotIn)):
                hit = F.coalesce(F.array_contains(go(right), go(left)), F.lit(False))
                return ~hit if isinstance(op, ast.NotIn) else hit
            if type(op) in _COMPARE:
                a, b = go(left), go(right)
                if isinstance(op, (ast.Eq, ast.NotEq)):
                    same = a.eqNullSafe(b)
                    return ~same if isinstance(op, ast.NotEq) else same
                return F.coalesce(_COMPARE[type(op)](a, b), F.lit(False))
    raise ValueError(f"no template expression: {ast.unparse(node)!r}")


def truth(c: Column) -> Column:
    """Whether a value counts as true: not null, false, zero or empty."""
    kind = F.typeof(c)
    text = c.cast("string")
    empty = F.when(kind == "boolean", text == "false").when(F.startswith(kind, F.lit("array")), text == "[]").when(kind == "string", text == "").otherwise(text.isin("0", "0.0"))
    return c.isNotNull() & ~F.coalesce(empty, F.lit(False))


@dataclass(frozen=True)
class Template:
    """A parsed template: text, ``value`` expressions, and nested ``if`` and ``for`` parts."""

    parts: list

    def column(self, scope: Scope | None = None) -> Column:
        return _render(self.parts, scope or {})

    def render(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.column())


def _render(parts: list, scope: Scope) -> Column:
    made = []
    for part in parts:
        if isinstance(part, str):
            made.append(F.lit(part))
        elif part[0] == "value":
            made.append(printed(value(part[1], scope)))
        elif part[0] == "if":
            chosen = None
            for test, body in part[1]:
                if test is None:
                    chosen = _render(body, scope) if chosen is None else chosen.otherwise(_render(body, scope))
                    break
                hit = truth(value(test, scope))
                chosen = F.when(hit, _render(body, scope)) if chosen is None else chosen.when(hit, _render(body, scope))
            made.append(F.coalesce(chosen, F.lit("")))
        else:
            _, name, items, body = part
            listed = value(items, scope)

            def each(x: Column, i: Column) -> Column:
                loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == F.size(listed) - 1}
                return _render(body, {**scope, name: x, "loop": loop})
            made.append(F.coalesce(F.array_join(F.transform(listed, each), ""), F.lit("")))
    return F.concat(*made) if made else F.lit("")


def parse(text: str) -> Template:
    """The template of a text; forms that do not match raise a ValueError."""
    pieces = _TAG.split(text[:-1] if text.endswith("\n") else text)
    for i in range(1, len(pieces), 2):
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    root: list = []
    open_: list[tuple[str, list]] = [("", root)]  # kinds of the open forms and where their parts go
    for i, piece in enumerate(pieces):
        here = open_[-1][1]
        if i % 2 == 0:
            if piece:
                here.append(piece)
            continue
        inner = piece[2:-2].strip("-").strip()
        if piece.startswith("{{"):
            ast.parse(inner, mode="eval") if inner else _wrong(piece)
            here.append(("value", inner))
        elif inner.startswith("if "):
            branches = [(inner[3:], [])]
            here.append(("if", branches))
            open_.append(("if", branches[0][1]))
        elif inner == "else" or inner.startswith("elif "):
            if open_[-1][0] != "if":
                _wrong(piece)
            open_.pop()
            branches = open_[-1][1][-1][1]
            branches.append((None if inner == "else" else inner[5:], []))
            open_.append(("else" if inner == "else" else "if", branches[-1][1]))
        elif loop := _FOR.fullmatch(inner):
            here.append(("for", loop[1], loop[2], []))
            open_.append(("for", here[-1][3]))
        elif inner in ("endif", "endfor"):
            if open_[-1][0] not in (("if", "else") if inner == "endif" else ("for",)):
                _wrong(piece)
            open_.pop()
        else:
            _wrong(piece)
    if len(open_) > 1:
        raise ValueError(f"{open_[-1][0]} is not ended")
    return Template(root)


def _wrong(piece: str):
    raise ValueError(f"unexpected {piece!r}")
