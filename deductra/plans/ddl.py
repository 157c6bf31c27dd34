"""Which predicates are stored and which derived, inferred from rules or declared in a small RDF vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field

from .. import terms as T
from .ir import Atom, Rule
from .rewrite import normalise


class Clash(ValueError):
    """A predicate that is both stored and derived, under the harsh policy."""


@dataclass
class Catalog:
    """``base``: stored predicates; ``derived``: rule heads; ``hybrid``: both."""

    base: set[str] = field(default_factory=set)
    derived: set[str] = field(default_factory=set)
    hybrid: set[str] = field(default_factory=set)


def classify(rules: list[Rule], stored: set[str], policy: str = "loose") -> Catalog:
    """Predicates by kind. On a clash: ``loose`` keeps both (hybrid), ``harsh`` raises, ``base`` or ``derived`` decides for that side."""
    if policy not in ("loose", "harsh", "base", "derived"):
        raise ValueError(f"unknown policy {policy}")
    rules = normalise(rules)
    heads = {h.pred for r in rules for h in r.head}
    bodies = {a.pred for r in rules for a in r.atoms() if isinstance(a, Atom)}
    clash = heads & stored
    if clash and policy == "harsh":
        raise Clash(f"stored and derived: {', '.join(sorted(clash))}")
    out = Catalog((stored | bodies) - heads, heads - stored)
    if policy == "base":
        out.base |= clash
    elif policy == "derived":
        out.derived |= clash
    else:
        out.hybrid = clash
    return out


def read(facts, vocabulary: str) -> Catalog:
    """A declaration: typed lists of predicates, ``DerivedClassList`` and ``DerivedPropertyList`` or ``BaseClassList`` and ``BasePropertyList`` of ``vocabulary``."""
    from ..owl.expr import Graph

    g = Graph(facts)
    out = Catalog()
    for kind, side in (("Derived", out.derived), ("Base", out.base)):
        for what in ("ClassList", "PropertyList"):
            for node in g.subjects(T.TYPE, f"<{vocabulary}{kind}{what}>"):
                side.update(x for x in g.items(node) if x is not None)
    out.hybrid = out.base & out.derived
    return out
