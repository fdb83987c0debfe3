"""Formulas over columns: arithmetic, comparisons and logic, turned into Spark columns.

Python's own parser reads the text; what comes of it is translated piece by piece, and pieces
that are not listed here are refused. Names are columns, in backquotes where they are no words.

Missing values stay missing; so do division by zero and results that a whole number cannot hold. ``/``
gives fractions, ``//`` and ``%`` round down as Python does, and ``**`` of whole numbers stays whole for
small whole exponents. ``and``, ``or`` and ``not`` may be written ``&``, ``|`` and ``~``, and bind as
weakly then; comparisons may be chained.
"""

from __future__ import annotations

import ast
import functools
import io
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import is_nested, type_of, value

WHOLE, FRACTION, TEXT, TRUTH, OTHER = "whole number", "fraction", "text", "truth value", "other"

# Whole exponents up to this are multiplied out over whole numbers.
LARGEST_WHOLE_EXPONENT = 16
LONG = 2**63


@dataclass(frozen=True)
class Term:
    column: Column
    kind: str
    constant: object = None

    @property
    def is_number(self) -> bool:
        return self.kind in (WHOLE, FRACTION)


def _kind(df: DataFrame, column: str) -> str:
    dtype = type_of(df, column)
    if isinstance(dtype, T.IntegralType):
        return WHOLE
    if isinstance(dtype, T.NumericType):
        return FRACTION
    if isinstance(dtype, T.StringType):
        return TEXT
    return TRUTH if isinstance(dtype, T.BooleanType) else OTHER


def _fraction(term: Term) -> Column:
    return term.column.cast("double") if term.kind == WHOLE else term.column


def _whole(term: Term) -> Column:
    return term.column.cast("bigint")


def _both(a: Term, b: Term) -> tuple[Column, Column, str]:
    """Two numbers as one kind."""
    if a.kind == b.kind == WHOLE:
        return _whole(a), _whole(b), WHOLE
    return a.column, b.column, FRACTION


def _add(a: Term, b: Term) -> Term:
    if a.kind == b.kind == TEXT:
        return Term(F.concat(a.column, b.column), TEXT)
    x, y, kind = _numbers("+", a, b)
    return Term(F.try_add(x, y), kind)


def _numbers(sign: str, a: Term, b: Term) -> tuple[Column, Column, str]:
    for term in (a, b):
        if not term.is_number:
            raise ValueError(f"'{sign}' needs numbers, not a {term.kind}")
    return _both(a, b)


def _subtract(a: Term, b: Term) -> Term:
    x, y, kind = _numbers("-", a, b)
    return Term(F.try_subtract(x, y), kind)


def _multiply(a: Term, b: Term) -> Term:
    x, y, kind = _numbers("*", a, b)
    return Term(F.try_multiply(x, y), kind)


def _divide(a: Term, b: Term) -> Term:
    _numbers("/", a, b)
    return Term(F.try_divide(_fraction(a), _fraction(b)), FRACTION)


def _remainder(a: Term, b: Term) -> Term:
    """The remainder that has the sign of the divisor."""
    x, y, kind = _numbers("%", a, b)
    rest = F.try_mod(x, y)
    return Term(F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), kind)


def _floor_divide(a: Term, b: Term) -> Term:
    x, y, kind = _numbers("//", a, b)
    if kind == FRACTION:
        return Term(_rounded(F.floor, F.try_divide(_fraction(a), _fraction(b))), FRACTION)
    rest = _remainder(a, b).column
    # exact: what is left after the remainder is a multiple of the divisor
    return Term(F.when(y == -1, F.try_subtract(F.lit(0), x)).otherwise(_exact_quotient(x, rest, y)), WHOLE)


def _rounded(function: Callable, x: Column) -> Column:
    """A fraction rounded to a whole one; those beyond 2**52 are whole already, and too large to be counted."""
    x = x.cast("double")
    return F.when(F.abs(x) < 2.0**52, function(x).cast("double")).otherwise(x)


def _exact_quotient(x: Column, rest: Column, y: Column) -> Column:
    """(x - rest) / y in whole numbers, by decimals that hold them all."""
    wide = "decimal(20,0)"
    return F.try_divide(x.cast(wide) - rest.cast(wide), y.cast(wide)).cast("bigint")


def _power(a: Term, b: Term) -> Term:
    _numbers("**", a, b)
    n = b.constant
    if a.kind == WHOLE and isinstance(n, int) and 0 <= n <= LARGEST_WHOLE_EXPONENT:
        one = F.when(a.column.isNotNull(), F.lit(1).cast("bigint"))
        return Term(functools.reduce(lambda x, _: F.try_multiply(x, _whole(a)), range(n), one), WHOLE)
    return Term(F.pow(_fraction(a).cast("double"), _fraction(b).cast("double")), FRACTION)


def _compare(sign: str, test: Callable, a: Term, b: Term) -> Term:
    kinds = {a.kind, b.kind}
    if len(kinds) > 1 and not (a.is_number and b.is_number) and OTHER not in kinds:
        raise ValueError(f"'{sign}' cannot compare a {a.kind} with a {b.kind}")
    return Term(test(a.column, b.column), TRUTH)


def _truths(sign: str, terms: list[Term]) -> list[Column]:
    for term in terms:
        if term.kind != TRUTH:
            raise ValueError(f"'{sign}' needs truth values, not a {term.kind}")
    return [t.column for t in terms]


BINARY = {
    ast.Add: _add, ast.Sub: _subtract, ast.Mult: _multiply, ast.Div: _divide, ast.FloorDiv: _floor_divide,
    ast.Mod: _remainder, ast.Pow: _power,
}
COMPARED = {
    ast.Eq: ("==", lambda a, b: a == b), ast.NotEq: ("!=", lambda a, b: a != b), ast.Lt: ("<", lambda a, b: a < b),
    ast.LtE: ("<=", lambda a, b: a <= b), ast.Gt: (">", lambda a, b: a > b), ast.GtE: (">=", lambda a, b: a >= b),
}


def _of_fraction(function: Callable) -> Callable:
    return lambda x: Term(function(_fraction(x)), FRACTION)


def _round(x: Term, digits: Term | None = None) -> Term:
    places = 0 if digits is None else digits.constant
    if not isinstance(places, int):
        raise ValueError("round needs a constant number of digits")
    return Term(F.round(x.column, places), x.kind)


def _same_kind(function: Callable) -> Callable:
    def of(*terms: Term) -> Term:
        kinds = {t.kind for t in terms}
        if len(kinds) > 1 and not all(t.is_number for t in terms):
            raise ValueError(f"cannot mix {' and '.join(sorted(kinds))}")
        kind = FRACTION if kinds == {WHOLE, FRACTION} else kinds.pop()
        return Term(function(*[t.column for t in terms]), kind)

    return of


#: Name: (what its arguments must be, fewest and most arguments, translation).
FUNCTIONS = {
    **{
        name: (("number",), 1, 1, _of_fraction(function))
        for name, function in {
            "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1,
            "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
            "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
        }.items()
    },
    "floor": (("number",), 1, 1, lambda x: Term(_rounded(F.floor, x.column), FRACTION) if x.kind != WHOLE else x),
    "ceil": (("number",), 1, 1, lambda x: Term(_rounded(F.ceil, x.column), FRACTION) if x.kind != WHOLE else x),
    "abs": (
        ("number",), 1, 1,
        lambda x: Term(F.when(x.column < 0, F.try_subtract(F.lit(0), x.column)).otherwise(x.column), x.kind),
    ),
    "round": (("number", "number"), 1, 2, _round),
    "arctan2": (("number", "number"), 2, 2, lambda y, x: Term(F.atan2(_fraction(y), _fraction(x)), FRACTION)),
    "least": (("any",), 2, 99, _same_kind(F.least)),
    "greatest": (("any",), 2, 99, _same_kind(F.greatest)),
    "coalesce": (("any",), 1, 99, _same_kind(F.coalesce)),
    "upper": (("text",), 1, 1, lambda x: Term(F.upper(x.column), TEXT)),
    "lower": (("text",), 1, 1, lambda x: Term(F.lower(x.column), TEXT)),
    "length": (("text",), 1, 1, lambda x: Term(F.char_length(x.column), WHOLE)),
}


class _Translator:
    def __init__(self, df: DataFrame, names: dict[str, str]):
        self.df, self.names = df, names

    def term(self, node: ast.expr) -> Term:
        read = getattr(self, f"_{type(node).__name__}", None)
        if read is None:
            raise ValueError(f"a formula cannot hold {type(node).__name__}")
        return read(node)

    def _Name(self, node: ast.Name) -> Term:
        name = self.names.get(node.id, node.id)
        if name not in self.df.columns:
            raise ValueError(f"there is no column '{name}'")
        if is_nested(self.df, name):
            raise ValueError(f"column '{name}' holds nested values")
        return Term(value(self.df, name), _kind(self.df, name))

    def _Constant(self, node: ast.Constant) -> Term:
        held = node.value
        if isinstance(held, bool):
            return Term(F.lit(held), TRUTH, held)
        if isinstance(held, int):
            if held >= LONG:
                raise ValueError(f"{held} is too large")
            return Term(F.lit(held), WHOLE, held)
        if isinstance(held, float):
            return Term(F.lit(held), FRACTION, held)
        if isinstance(held, str):
            return Term(F.lit(held), TEXT, held)
        raise ValueError(f"a formula cannot hold {held!r}")

    def _BinOp(self, node: ast.BinOp) -> Term:
        if type(node.op) not in BINARY:
            raise ValueError(f"a formula cannot hold {type(node.op).__name__}")
        return BINARY[type(node.op)](self.term(node.left), self.term(node.right))

    def _UnaryOp(self, node: ast.UnaryOp) -> Term:
        inner = self.term(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return Term(~_truths("not", [inner])[0], TRUTH)
        if isinstance(node.op, ast.UAdd):
            return inner
        minus = _subtract(Term(F.lit(0), WHOLE), inner)
        constant = -inner.constant if isinstance(inner.constant, (int, float)) else None
        return Term(minus.column, minus.kind, constant)

    def _BoolOp(self, node: ast.BoolOp) -> Term:
        sign = "and" if isinstance(node.op, ast.And) else "or"
        columns = _truths(sign, [self.term(v) for v in node.values])
        join = (lambda a, b: a & b) if sign == "and" else (lambda a, b: a | b)
        return Term(functools.reduce(join, columns), TRUTH)

    def _Compare(self, node: ast.Compare) -> Term:
        parts, left = [], self.term(node.left)
        for operator, follower in zip(node.ops, node.comparators):
            if isinstance(operator, (ast.In, ast.NotIn)):
                parts.append(self._in(left, follower, isinstance(operator, ast.NotIn)))
                continue
            if type(operator) not in COMPARED:
                raise ValueError(f"a formula cannot hold {type(operator).__name__}")
            right = self.term(follower)
            parts.append(_compare(*COMPARED[type(operator)], left, right))
            left = right
        return Term(functools.reduce(lambda a, b: a & b, [p.column for p in parts]), TRUTH)

    def _in(self, left: Term, follower: ast.expr, negated: bool) -> Term:
        if not isinstance(follower, (ast.List, ast.Tuple)) or not follower.elts:
            raise ValueError("'in' needs a list of values")
        tests = [_compare("in", lambda a, b: a == b, left, self.term(e)).column for e in follower.elts]
        found = functools.reduce(lambda a, b: a | b, tests)
        return Term(~found if negated else found, TRUTH)

    def _IfExp(self, node: ast.IfExp) -> Term:
        test = _truths("if", [self.term(node.test)])[0]
        choose = _same_kind(lambda a, b: F.when(test, a).otherwise(b))
        return choose(self.term(node.body), self.term(node.orelse))

    def _Call(self, node: ast.Call) -> Term:
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name not in FUNCTIONS or node.keywords:
            raise ValueError(f"a formula cannot call {ast.unparse(node.func)}")
        wanted, fewest, most, function = FUNCTIONS[name]
        terms = [self.term(a) for a in node.args]
        if not fewest <= len(terms) <= most:
            raise ValueError(f"{name} takes {fewest} to {most} values")
        for want, term in zip(wanted, terms):
            if (want == "number" and not term.is_number) or (want == "text" and term.kind != TEXT):
                raise ValueError(f"{name} needs a {want}, not a {term.kind}")
        return function(*terms)


_PIECE = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|`((?:[^`]|``)+)`""")
LOGIC = {"&": "and", "|": "or", "~": "not"}


def _plain(formula: str) -> tuple[str, dict[str, str]]:
    """The formula with words for backquoted names and logical signs, and the names."""
    names: dict[str, str] = {}

    def name(piece: re.Match) -> str:
        if piece[1] is not None:
            return piece[1]
        names[f"__name{len(names)}"] = piece[2].replace("``", "`")
        return f" __name{len(names) - 1} "

    text = _PIECE.sub(name, formula.strip())
    tokens = [
        (tokenize.NAME, LOGIC[t.string]) if t.type == tokenize.OP and t.string in LOGIC else (t.type, t.string)
        for t in tokenize.generate_tokens(io.StringIO(text).readline)
    ]
    return tokenize.untokenize(tokens), names


def formula_column(df: DataFrame, formula: str) -> Column:
    """The column that a formula stands for; what it cannot be is said in a ValueError."""
    try:
        text, names = _plain(formula)
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, tokenize.TokenError) as error:
        raise ValueError(f"cannot read the formula {formula!r}: {error}") from error
    try:
        return _Translator(df, names).term(tree.body).column
    except ValueError as error:
        raise ValueError(f"formula {formula!r}: {error}") from error
    except RecursionError as error:
        raise ValueError("the formula is nested too deeply") from error
