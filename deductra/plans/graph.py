"""The rules' dependency graph as text for a drawing tool."""

from __future__ import annotations

from .analyze import strata
from .ir import Atom, Rule
from .rewrite import normalise


def to_dot(rules: list[Rule]) -> str:
    """Predicates as nodes, ranked by stratum; an edge from each body predicate to each head, dashed where negated."""
    rules = [r for r in normalise(rules) if r.head]
    quote = lambda x: '"' + x.replace('"', "'") + '"'
    level = {p: i for i, (comp, _) in enumerate(strata(rules)) for p in comp}
    lines = ["digraph rules {", *(f"  {quote(p)} [stratum={i}];" for p, i in sorted(level.items()))]
    edges = {(a.pred, h.pred, a.negated) for r in rules for a in r.atoms() if isinstance(a, Atom) for h in r.head}
    return "\n".join([*lines, *(f"  {quote(a)} -> {quote(h)}{' [style=dashed]' if neg else ''};" for a, h, neg in sorted(edges)), "}"])
