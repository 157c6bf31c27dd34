"""Comparison builtins as Column expressions, so that Catalyst folds and pushes them down.

``math`` builtins compare numbers, ``str`` builtins lexical forms, ``log`` builtins terms.
On native columns (typed relations) the values themselves are compared. A row whose operand
isn't numeric fails a ``math`` builtin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import LOG, MATH, STRING, XSD, lexical, number

Fn = Callable[[Column, Column], Column]
BASIC: dict[str, Fn] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b,
    "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b,
}


def _fold(f: Fn) -> Fn:
    return lambda a, b: f(F.lower(a), F.lower(b))


MATHS: dict[str, Fn] = {
    "equalTo": BASIC["eq"], "notEqualTo": BASIC["ne"], "greaterThan": BASIC["gt"], "lessThan": BASIC["lt"],
    "notLessThan": BASIC["ge"], "notGreaterThan": BASIC["le"],
}
STRINGS: dict[str, Fn] = {
    "contains": lambda a, b: a.contains(b), "containsIgnoringCase": _fold(lambda a, b: a.contains(b)), "startsWith": lambda a, b: a.startswith(b), "endsWith": lambda a, b: a.endswith(b),
    "matches": lambda a, b: F.rlike(a, b), "notMatches": lambda a, b: ~F.rlike(a, b), "equalIgnoringCase": _fold(BASIC["eq"]), "notEqualIgnoringCase": _fold(BASIC["ne"]),
    "greaterThan": BASIC["gt"], "lessThan": BASIC["lt"], "notGreaterThan": BASIC["le"], "notLessThan": BASIC["ge"], "greaterThanOrEqualTo": BASIC["ge"], "lessThanOrEqualTo": BASIC["le"],
}
LOGS: dict[str, Fn] = {"equalTo": BASIC["eq"], "notEqualTo": BASIC["ne"]}
#: Value-producing: the result, a third argument, is bound, or compared where it is bound already.
ARITHMETIC: dict[str, Fn] = {
    "sum": lambda a, b: a + b, "difference": lambda a, b: a - b, "product": lambda a, b: a * b,
    "integerQuotient": lambda a, b: F.floor(a / b),
}


def _number_term(value: Column) -> Column:
    """A number as a literal: an integer where it is whole."""
    whole = value == F.floor(value)
    return F.when(whole, F.concat(F.lit('"'), F.floor(value).cast("string"), F.lit(f'"^^<{XSD}integer>'))).otherwise(F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}double>')))


class Registry:
    """Builtins by name: short names for typed relations, IRIs for RDF terms, and the user's own."""

    def __init__(self):
        self.fns: dict[str, Fn] = {}
        for group, ns, view in ((MATHS, MATH, number), (STRINGS, STRING, lexical), (LOGS, LOG, lambda c: c)):
            short = {MATH: "math", STRING: "str", LOG: "log"}[ns]
            for k, f in group.items():
                self.fns[f"{short}:{k}"] = f
                self.fns[f"<{ns}{k}>"] = lambda a, b, f=f, v=view: f(v(a), v(b))
        self.fns |= BASIC
        self.arithmetic: dict[str, Fn] = {}
        for k, f in ARITHMETIC.items():
            self.arithmetic[f"math:{k}"] = f
            self.arithmetic[f"<{MATH}{k}>"] = lambda a, b, f=f: _number_term(f(number(a), number(b)))

    def register(self, name: str, fn: Fn) -> None:
        """``fn(a, b)`` gives a Boolean Column; it may wrap a pandas UDF."""
        self.fns[name] = fn

    def __contains__(self, name) -> bool:
        return name in self.fns or name in self.arithmetic

    def produce(self, name: str, a: Column, b: Column) -> Column:
        """The value of an arithmetic builtin; null where an operand isn't a number."""
        return self.arithmetic[name](a, b)

    def apply(self, name: str, a: Column, b: Column) -> Column:
        if name not in self.fns:
            raise KeyError(f"no builtin {name}")
        return self.fns[name](a, b)


def sparql_filter(name: str, a: str, b: str) -> str:
    """Text of a builtin in a SPARQL FILTER."""
    ops = {"equalTo": "=", "notEqualTo": "!=", "greaterThan": ">", "lessThan": "<", "notLessThan": ">=", "notGreaterThan": "<=", "greaterThanOrEqualTo": ">=", "lessThanOrEqualTo": "<=", "eq": "=", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
    key = name.strip("<>").rsplit("#", 1)[-1].rsplit(":", 1)[-1]
    if key in ops:
        return f"{a} {ops[key]} {b}"
    calls = {"contains": "CONTAINS", "startsWith": "STRSTARTS", "endsWith": "STRENDS", "matches": "REGEX"}
    if key in calls:
        return f"{calls[key]}({a}, {b})"
    raise KeyError(f"{name} has no template")
