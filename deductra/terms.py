"""Canonical RDF terms as strings: ``<iri>``, ``_:label``, ``"lex"``, ``"lex"@lang``, ``"lex"^^<dt>``.

Two terms are equal exactly if their strings are, so every join is an equi-join on strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
LOG = "http://www.w3.org/2000/10/swap/log#"
MATH = "http://www.w3.org/2000/10/swap/math#"
STRING = "http://www.w3.org/2000/10/swap/string#"


def iri(s: str) -> str:
    return f"<{s}>"


def rdf(name: str) -> str:
    return f"<{RDF}{name}>"


def rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


def owl(name: str) -> str:
    return f"<{OWL}{name}>"


TYPE, FIRST, REST, NIL = rdf("type"), rdf("first"), rdf("rest"), rdf("nil")
SAME_AS = owl("sameAs")
_ESC = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESC = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$', re.S)


def escape(lex: str) -> str:
    return "".join(_ESC.get(c, c) for c in lex)


def unescape(lex: str) -> str:
    def sub(m):
        g = m[1]
        return chr(int(g[1:], 16)) if g[0] in "uU" else _UNESC[g]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tnrbf\"'\\])", sub, lex)


def literal(value, datatype: str | None = None, lang: str | None = None) -> str:
    """A literal of a Python value."""
    if isinstance(value, bool):
        return f'"{str(value).lower()}"^^<{XSD}boolean>'
    if datatype is None and lang is None:
        datatype = XSD + "integer" if isinstance(value, int) else XSD + "double" if isinstance(value, float) else None
    text = f'"{escape(str(value))}"'
    if lang:
        return f"{text}@{lang.lower()}"
    return f"{text}^^<{datatype}>" if datatype and datatype != XSD + "string" else text


def parse_literal(term: str) -> tuple[str, str | None, str | None]:
    """Lexical form, datatype, language."""
    m = _LITERAL.match(term)
    if not m:
        raise ValueError(f"not a literal: {term}")
    return unescape(m[1]), m[3], m[2]


def is_literal(term) -> bool:
    return isinstance(term, str) and term.startswith('"')


def is_iri(term) -> bool:
    return isinstance(term, str) and term.startswith("<")


def is_blank(term) -> bool:
    return isinstance(term, str) and term.startswith("_:")


def lexical(t: Column) -> Column:
    """Lexical form of a literal, text of an IRI; other values as strings."""
    text = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.when(F.instr(text, "\\") == 0, text).otherwise(F.replace(F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    return F.when(t.startswith('"'), plain).when(t.startswith("<"), F.substring(t, 2, 1 << 30).substr(F.lit(1), F.length(t) - 2)).otherwise(t)


def number(t: Column) -> Column:
    """Value of a numeric literal; null for anything else."""
    numeric = t.rlike(r'^"[^"]*"\^\^<' + XSD.replace(".", r"\.") + r"(integer|decimal|double|float|int|long|short|byte|nonNegativeInteger|positiveInteger|unsignedInt|unsignedLong)>$")
    lex = F.regexp_extract(t, r'^"([^"]*)"', 1)
    return F.when(numeric, lex.try_cast("double"))


def short(term: str, prefixes: dict[str, str]) -> str:
    """Prefixed name of an IRI where a prefix fits."""
    if is_iri(term):
        body = term[1:-1]
        best = max((p for p, ns in prefixes.items() if ns and body.startswith(ns) and re.fullmatch(r"[\w.-]*", body[len(ns) :])), key=lambda p: len(prefixes[p]), default=None)
        if best is not None:
            return f"{best}:{body[len(prefixes[best]):]}"
    return term


def collapse(prefixes: dict[str, str]) -> dict[str, str]:
    """One prefix for each namespace: the shortest without a numeric ending such as ``_1``, else the first by name."""
    best: dict[str, str] = {}
    for p in sorted(prefixes, key=lambda p: (re.search(r"_\d+$|^ns\d+$", p) is not None, len(p), p)):
        best.setdefault(prefixes[p], p)
    return {p: ns for ns, p in best.items()}
