"""Classification of EL ontologies with role hierarchies by completion, run as rules on the engine.

The TBox is brought into normal form on the driver (a fresh name for each complex
sub-expression); its axioms become relations, and the completion rules run semi-naively.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .. import terms as T
from ..engine import Engine
from ..plans.ir import Atom, variables
from ..sources import n3
from .expr import NOTHING, THING, Both, Graph, Named, Some, read

A, B, C, R, S, X, Y = variables("a b c r s x y")
FRESH = "<urn:deductra:part/"


class NotEl(ValueError):
    """An expression outside EL."""


class Normaliser:
    """Axioms of four shapes: sub(a, b), both(a, b, c), has(a, r, b) and from(r, a, b); role(r, s)."""

    def __init__(self):
        self.sub, self.both, self.has, self.from_, self.role, self.names, self.fresh = set(), set(), set(), set(), set(), set(), {}

    def name(self, e, left: bool) -> str:
        """A name that includes ``e`` (``left``) or is included in it."""
        if isinstance(e, Named):
            self.names.add(e.name)
            return e.name
        known = self.fresh.setdefault(e, f"{FRESH}{len(self.fresh) + 1}>")
        if (known, left) in self.fresh:
            return known
        self.fresh[known, left] = True
        self.names.add(known)
        if isinstance(e, Both):
            parts = [self.name(p, left) for p in e.parts]
            if not left:
                self.sub |= {(known, p) for p in parts}
            else:
                low = parts[0]
                for i, p in enumerate(parts[1:], 2):
                    target = known if i == len(parts) else f"{known[:-1]}.{i}>"
                    self.names.add(target)
                    self.both.add((low, p, target))
                    low = target
        elif isinstance(e, Some):
            inner = self.name(e.cls, left)
            (self.from_ if left else self.has).add((e.prop, inner, known) if left else (known, e.prop, inner))
        else:
            raise NotEl(f"{e} isn't an EL expression")
        return known

    def include(self, c, d) -> None:
        self.sub.add((self.name(c, True), self.name(d, False)))


def normalised(tbox: str | Graph | Iterable) -> Normaliser:
    """Inclusions and equivalences (as two inclusions) of a TBox in normal form."""
    if isinstance(tbox, str):
        tbox = n3.parse(tbox).facts
    g = tbox if isinstance(tbox, Graph) else Graph(tbox)
    out = Normaliser()
    for c, d in g.pairs(T.rdfs("subClassOf")):
        out.include(read(g, c), read(g, d))
    for c, d in g.pairs(T.owl("equivalentClass")):
        out.include(read(g, c), read(g, d))
        out.include(read(g, d), read(g, c))
    for c, items in g.pairs(T.owl("intersectionOf")):
        if T.is_iri(c):
            parts = Both(tuple(read(g, x) for x in g.items(items)))
            out.include(Named(c), parts)
            out.include(parts, Named(c))
    for c, d in g.pairs(T.owl("disjointWith")):
        out.include(Both((read(g, c), read(g, d))), Named(NOTHING))
    for p, q in g.pairs(T.rdfs("subPropertyOf")):
        out.role.add((p, q))
    return out


def classify(spark: SparkSession, tbox: str | Graph | Iterable, fresh: bool = False) -> DataFrame:
    """sub, super: all inclusions among named classes that follow; each class includes itself and is in ``owl:Thing``."""
    n = normalised(tbox)
    e = Engine(spark)
    for pred, rows, width in (("name", {(x,) for x in n.names}, 1), ("sub", n.sub, 2), ("both", n.both, 3), ("has", n.has, 3), ("from", n.from_, 3), ("role", n.role, 2)):
        e.relation(pred, spark.createDataFrame(sorted(rows), ", ".join(f"c{i} string" for i in range(width))))
    e.add_rules([
        Atom("S", (X, X)) <= Atom("name", (X,)),
        Atom("S", (X, THING)) <= Atom("name", (X,)),
        Atom("S", (X, B)) <= Atom("S", (X, A)) & Atom("sub", (A, B)),
        Atom("S", (X, C)) <= Atom("S", (X, A)) & Atom("both", (A, B, C)) & Atom("S", (X, B)),
        Atom("R", (X, R, B)) <= Atom("S", (X, A)) & Atom("has", (A, R, B)),
        Atom("R", (X, S, Y)) <= Atom("R", (X, R, Y)) & Atom("role", (R, S)),
        Atom("S", (X, B)) <= Atom("R", (X, R, Y)) & Atom("from", (R, A, B)) & Atom("S", (Y, A)),
        Atom("S", (X, NOTHING)) <= Atom("R", (X, R, Y)) & Atom("S", (Y, NOTHING)),
        Atom("S", (X, Y)) <= Atom("S", (X, NOTHING)) & Atom("name", (Y,)),
    ])
    out = e.query(Atom("S", (X, Y)), "naive").toDF("sub", "super")
    return out if fresh else out.where(f"not startswith(sub, '{FRESH}') and not startswith(super, '{FRESH}')")
