"""A SPARQL subset over asserted and derived triples: SELECT and ASK with BGP, OPTIONAL, UNION, FILTER, DISTINCT, LIMIT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .plans.compile import scan
from .plans.ir import Atom, Rule, Var
from .sources.n3 import atom_of

_TOKEN = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<op>&&|\|\||!=|<=|>=|\^\^|[{}().;,=<>!*])|(?P<lang>@[A-Za-z-]+)|(?P<blank>_:\w+)|(?P<name>[\w-]*:[\w.%-]*)|(?P<word>\w+)""",
    re.X,
)


class SparqlError(ValueError):
    """A query outside the subset."""


class _Query:
    def __init__(self, engine, text: str, method: str):
        self.engine, self.method, self.prefixes, self.i, self.tokens, at = engine, method, dict(engine.prefixes), 0, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"can't read {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, value=None):
        t = self.peek()
        if value is not None and t[1].upper() != value:
            raise SparqlError(f"{t[1]!r} where {value!r} belongs")
        self.i += 1
        return t

    def at(self, *words) -> bool:
        return self.peek()[1].upper() in words

    def term(self):
        kind, v = self.take()
        if kind == "iri":
            return v
        if kind == "var":
            return Var(v[1:])
        if kind == "blank":
            return Var("_" + v[2:])
        if kind == "num":
            return T.literal(v, datatype=T.XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if kind == "str":
            lex = T.unescape(v[1:-1])
            if self.peek()[0] == "lang":
                return T.literal(lex, lang=self.take()[1][1:])
            if self.at("^^"):
                self.take()
                return T.literal(lex, datatype=self.term()[1:-1])
            return T.literal(lex)
        if kind == "name":
            p, _, local = v.partition(":")
            if p not in self.prefixes:
                raise SparqlError(f"no prefix {p!r}")
            return f"<{self.prefixes[p]}{local}>"
        if v == "a":
            return T.TYPE
        if v.lower() in ("true", "false"):
            return T.literal(v.lower() == "true")
        raise SparqlError(f"{v!r} where a term belongs")

    def run(self):
        while self.at("PREFIX"):
            self.take()
            name = self.take()[1]
            self.prefixes[name[:-1]] = self.take()[1][1:-1]
        if self.at("ASK"):
            self.take()
            if self.at("WHERE"):
                self.take()
            return not self.group().isEmpty()
        self.take("SELECT")
        distinct = self.at("DISTINCT")
        if distinct:
            self.take()
        names: list[str] | None = []
        if self.at("*"):
            self.take()
            names = None
        else:
            while self.peek()[0] == "var":
                names.append(self.take()[1][1:])
        if self.at("WHERE"):
            self.take()
        df = self.group()
        have = [c[2:] for c in df.columns if c != "v_" and not c.startswith("v__")]
        names = have if names is None else names
        out = df.select(*[(F.col(f"v_{n}") if n in have else F.lit(None).cast("string")).alias(n) for n in names])
        if distinct:
            out = out.distinct()
        if self.at("LIMIT"):
            self.take()
            out = out.limit(int(self.take()[1]))
        if self.peek()[0] != "end":
            raise SparqlError(f"{self.peek()[1]!r} isn't in the subset")
        return out

    def basic(self, pattern: list[Atom]) -> DataFrame:
        """The solutions of a basic graph pattern: over the closure (``naive``), or as one goal that demands only what its constants ask for."""
        if self.method != "naive" and any(isinstance(x, Var) for a in pattern for x in a.args) and not self.engine._second_order([Rule((), tuple(pattern))]):
            found = self.engine.query(tuple(pattern), self.method)
            return found.toDF(*[f"v_{c}" for c in found.columns])
        now = None
        for a in pattern:
            now = self.join(now, scan(self.engine.relation_of(a), a))
        return now

    def join(self, left: DataFrame | None, right: DataFrame, how="inner") -> DataFrame:
        if left is None:
            return right
        on = [c for c in left.columns if c in right.columns and c != "v_"]
        if "v_" in left.columns or "v_" in right.columns:
            right = right.drop("v_") if len(right.columns) > 1 else right
        if on:
            return left.join(right, on, how)
        return left.crossJoin(right.drop("v_") if len(right.columns) > 1 else right.withColumnRenamed("v_", "v__")) if how == "inner" else left.join(right, F.lit(True), how)

    def group(self) -> DataFrame:
        self.take("{")
        now: DataFrame | None = None
        filters, pattern = [], []
        while not self.at("}"):
            if pattern and (self.at("OPTIONAL", "{")):
                now, pattern = self.join(now, self.basic(pattern)), []
            if self.at("FILTER"):
                self.take()
                filters.append(self.primary())
            elif self.at("OPTIONAL"):
                self.take()
                now = self.join(now, self.group(), "left_outer")
            elif self.at("{"):
                part = self.group()
                while self.at("UNION"):
                    self.take()
                    part = part.unionByName(self.group(), allowMissingColumns=True)
                now = self.join(now, part)
            elif self.at("."):
                self.take()
            else:
                pattern += self.triples()
        self.take("}")
        if pattern:
            now = self.join(now, self.basic(pattern))
        if now is None:
            now = self.engine.spark.range(1).select(F.lit(True).alias("v_"))
        for f in filters:
            now = now.where(f(now))
        return now

    def triples(self) -> list[Atom]:
        out, s = [], self.term()
        while True:
            p = self.term()
            while True:
                out.append(atom_of(s, p, self.term()))
                if not self.at(","):
                    break
                self.take()
            if not self.at(";"):
                return out
            self.take()
            if self.at(".", "}"):
                return out

    # filters: functions of a DataFrame that give a Boolean column

    def expression(self):
        left = self.conjunction()
        while self.at("||"):
            self.take()
            right = self.conjunction()
            left = (lambda a, b: lambda df: a(df) | b(df))(left, right)
        return left

    def conjunction(self):
        left = self.comparison()
        while self.at("&&"):
            self.take()
            right = self.comparison()
            left = (lambda a, b: lambda df: a(df) & b(df))(left, right)
        return left

    def comparison(self):
        left = self.primary()
        if not self.at("=", "!=", "<", ">", "<=", ">="):
            return left
        op = self.take()[1]
        right = self.primary()

        def run(df):
            a, b = left(df), right(df)
            x, y = T.number(a), T.number(b)
            both = x.isNotNull() & y.isNotNull()
            la, lb = T.lexical(a), T.lexical(b)
            return {
                "=": lambda: F.when(both, x == y).otherwise(a == b), "!=": lambda: F.when(both, x != y).otherwise(a != b), "<": lambda: F.when(both, x < y).otherwise(la < lb),
                ">": lambda: F.when(both, x > y).otherwise(la > lb), "<=": lambda: F.when(both, x <= y).otherwise(la <= lb), ">=": lambda: F.when(both, x >= y).otherwise(la >= lb),
            }[op]()

        return run

    def primary(self):
        if self.at("!"):
            self.take()
            inner = self.primary()
            return lambda df: ~inner(df)
        if self.at("("):
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        kind, v = self.peek()
        if kind == "word" and v.lower() not in ("true", "false", "a"):
            self.take()
            name, args = v.upper(), []
            self.take("(")
            while not self.at(")"):
                args.append(self.expression())
                if self.at(","):
                    self.take()
            self.take(")")
            return self.call(name, args)
        t = self.term()
        return (lambda df: F.col(f"v_{t.name}") if f"v_{t.name}" in df.columns else F.lit(None).cast("string")) if isinstance(t, Var) else lambda df: F.lit(t)

    def call(self, name, args):
        two = {"REGEX": F.rlike, "CONTAINS": lambda a, b: a.contains(b), "STRSTARTS": lambda a, b: a.startswith(b), "STRENDS": lambda a, b: a.endswith(b)}
        if name in two:
            fold = name == "REGEX" and len(args) > 2
            return lambda df: two[name](F.lower(T.lexical(args[0](df))) if fold else T.lexical(args[0](df)), F.lower(T.lexical(args[1](df))) if fold else T.lexical(args[1](df)))
        one = {
            "BOUND": lambda a: a.isNotNull(), "STR": lambda a: F.concat(F.lit('"'), T.lexical(a), F.lit('"')), "ISIRI": lambda a: a.startswith("<"), "ISURI": lambda a: a.startswith("<"), "ISLITERAL": lambda a: a.startswith('"'),
            "ISBLANK": lambda a: a.startswith("_:"), "LANG": lambda a: F.concat(F.lit('"'), F.regexp_extract(a, r'"@([A-Za-z0-9-]+)$', 1), F.lit('"')),
            "DATATYPE": lambda a: F.when(a.rlike(r"\^\^<[^>]*>$"), F.regexp_extract(a, r"\^\^(<[^>]*>)$", 1)).otherwise(F.lit(T.iri(T.XSD + "string"))),
        }
        if name in one:
            return lambda df: one[name](args[0](df))
        raise SparqlError(f"{name} isn't in the subset")


def run(engine, text: str, method: str = "naive"):
    """A DataFrame for SELECT, a bool for ASK."""
    return _Query(engine, text, method).run()
