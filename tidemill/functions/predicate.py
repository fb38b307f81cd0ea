"""Row filters written as a Python expression, turned into one Column.

``ast`` does the parsing; each node maps to a Column operation. A comparison with a
missing value is false, so its negation is true. Negations are moved down to the
comparisons instead of wrapping them, which keeps plain ``x > 5`` filters in a form
the Parquet reader can use.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, is_timestamp
from tidemill.functions.numbers import nan_to_null

_OPPOSITE = {
    ast.Gt: ast.LtE,
    ast.GtE: ast.Lt,
    ast.Lt: ast.GtE,
    ast.LtE: ast.Gt,
    ast.Eq: ast.NotEq,
    ast.NotEq: ast.Eq,
    ast.In: ast.NotIn,
    ast.NotIn: ast.In,
}
_COMPARE = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "floor": F.floor, "ceil": F.ceil}


def build_filter(df: DataFrame, expression: str) -> Column:
    """The filter as a Column; any fault in it is a ``ValueError``."""
    try:
        names: dict[str, str] = {}
        text = _name_quoted(expression, names)
        tree = ast.parse(_word_operators(text).strip(), mode="eval").body
        test = _Reader(df, names).test(tree, True)
        kind = df.select(test.alias("t")).schema["t"].dataType
        if not isinstance(kind, T.BooleanType):
            raise TypeError("the expression is not a condition")
        return test
    except Exception as error:
        raise ValueError(f"Invalid row filter: {expression!r}") from error


def _name_quoted(text: str, names: dict[str, str]) -> str:
    """Replace names in backticks by plain identifiers."""

    def stand_in(match: re.Match) -> str:
        alias = f"_quoted_{len(names)}"
        names[alias] = match.group(1)
        return alias

    return re.sub(r"`([^`]+)`", stand_in, text)


def _word_operators(text: str) -> str:
    """``&`` and ``|`` bind like ``and`` and ``or``: looser than comparisons."""
    words = {"&": "and", "|": "or"}
    out = []
    for token in tokenize.generate_tokens(io.StringIO(text.strip()).readline):
        is_operator = token.type == tokenize.OP and token.string in words
        out.append((tokenize.NAME, words[token.string]) if is_operator else token[:2])
    return tokenize.untokenize(out)


class _Reader:
    def __init__(self, df: DataFrame, names: dict[str, str]) -> None:
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.names = names
        self.df = df

    def test(self, node: ast.expr, wanted: bool) -> Column:
        """A condition that holds when ``node`` is ``wanted``."""
        if isinstance(node, ast.BoolOp):
            parts = [self.test(v, wanted) for v in node.values]
            both = isinstance(node.op, ast.And) == wanted
            out = parts[0]
            for part in parts[1:]:
                out = (out & part) if both else (out | part)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return self.test(node.operand, not wanted)
        if isinstance(node, ast.Compare):
            links = list(zip([node.left, *node.comparators], node.ops, node.comparators))
            parts = [self.compare(a, op, b, wanted) for a, op, b in links]
            out = parts[0]
            for part in parts[1:]:
                out = (out & part) if wanted else (out | part)
            return out
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value == wanted)
        value = self.value(node)
        if not isinstance(self.type_of(value), T.BooleanType):
            raise TypeError("not a condition")
        return value if wanted else (~value) | value.isNull()

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr, wanted: bool) -> Column:
        kind = type(op) if wanted else _OPPOSITE[type(op)]
        negative = not wanted
        if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            if kind in (ast.Eq, ast.NotEq):  # equality with a list means membership
                kind = ast.In if kind is ast.Eq else ast.NotIn
            return self.member(left, right, kind)
        if kind in (ast.In, ast.NotIn):
            raise TypeError("membership needs a list")
        a, b = self.pair(left, right)
        if a is None:  # text against number
            if type(op) not in (ast.Eq, ast.NotEq):
                raise TypeError("text and number have no order")
            return F.lit(kind is ast.NotEq)
        test = _COMPARE[kind](a, b)
        if kind is ast.NotEq or (negative and kind is not ast.Eq):
            test = test | a.isNull() | b.isNull()
        return test

    def member(self, left: ast.expr, right: ast.expr, kind: type) -> Column:
        value = self.value(left)
        items = [ast.literal_eval(e) for e in right.elts]
        textual = isinstance(self.type_of(value), T.StringType)
        items = [i for i in items if i is not None and isinstance(i, str) == textual or is_timestamp(self.type_of(value))]
        if not items:
            return F.lit(kind is ast.NotIn)
        if kind is ast.In:
            return value.isin(items)
        return (~value.isin(items)) | value.isNull()

    def pair(self, left: ast.expr, right: ast.expr):
        a, b = self.value(left), self.value(right)
        ta, tb = self.type_of(a), self.type_of(b)
        if isinstance(ta, T.StringType) != isinstance(tb, T.StringType):
            if is_timestamp(ta):
                return a, b.cast("timestamp")
            if is_timestamp(tb):
                return a.cast("timestamp"), b
            return None, None
        return a, b

    def value(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            name = self.names.get(node.id, node.id)
            if name not in self.types:
                raise KeyError(name)
            return col(name)
        if isinstance(node, ast.Constant):
            if node.value is None or isinstance(node.value, (bytes, complex)):
                raise TypeError("unsupported constant")
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp):
            inner = self.value(node.operand)
            if isinstance(node.op, ast.USub):
                return -inner
            if isinstance(node.op, ast.UAdd):
                return inner
        if isinstance(node, ast.BinOp):
            return self.number(self.arithmetic(node))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id in _FUNCTIONS and len(node.args) == 1 and not node.keywords:
                return self.number(_FUNCTIONS[node.func.id](self.value(node.args[0])))
        if isinstance(node, (ast.Compare, ast.BoolOp)):
            return F.coalesce(self.test(node, True), F.lit(False))
        raise TypeError(f"unsupported expression: {ast.dump(node)}")

    def arithmetic(self, node: ast.BinOp) -> Column:
        a, b = self.value(node.left), self.value(node.right)
        if isinstance(node.op, ast.Add):
            text = isinstance(self.type_of(a), T.StringType) and isinstance(self.type_of(b), T.StringType)
            return F.concat(a, b) if text else a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return _divide(a, b)
        if isinstance(node.op, ast.FloorDiv):
            return F.floor(_divide(a, b))
        if isinstance(node.op, ast.Mod):  # the sign follows the divisor
            return a - b * F.floor(F.try_divide(a, b))
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b)
        raise TypeError("unsupported operator")

    def number(self, value: Column) -> Column:
        """A result that is not a number is missing."""
        real = isinstance(self.type_of(value), (T.FloatType, T.DoubleType))
        return nan_to_null(value) if real else value

    def type_of(self, value: Column) -> T.DataType:
        return self.df.select(value.alias("v")).schema["v"].dataType


def _divide(a: Column, b: Column) -> Column:
    """Division where x / 0 is infinite and 0 / 0 is missing."""
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
