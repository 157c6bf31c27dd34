"""Enumerated classes: what lies under a class, and conjunctions with a complement as unions."""

from __future__ import annotations

from .. import terms as T
from .expr import Graph

_UNION, _BOTH, _NOT = T.owl("unionOf"), T.owl("intersectionOf"), T.owl("complementOf")


def below(graph: Graph, cls: str) -> set[str]:
    """The lowest classes under ``cls``: a union's operands or the sub-classes, each followed down; empty for a class with nothing below it."""
    out: set[str] = set()
    seen, todo = {cls}, [cls]
    while todo:
        now = todo.pop()
        lists = graph.objects(now, _UNION)
        parts = [x for node in lists for x in graph.items(node)] if lists else graph.subjects(T.rdfs("subClassOf"), now)
        parts = [x for x in parts if x != now]
        if not parts and now != cls:
            out.add(now)
        todo += [x for x in parts if x not in seen]
        seen.update(parts)
    return out


def expand_complement(graph: Graph, cls: str) -> set[str] | None:
    """A conjunction of a class and a complement, rewritten in ``graph`` as the union of the classes under the first that aren't under the second.

    Gives these classes, or None where ``cls`` has another form and stays as it is.
    """
    node = graph.value(cls, _BOTH)
    parts = graph.items(node) if node else []
    if len(parts) != 2:
        return None
    out, gone = set(), set()
    for p in parts:
        other = graph.value(p, _NOT)
        if other:
            gone |= below(graph, other) or {other}
        else:
            out |= below(graph, p) or {p}
    if not gone:
        return None
    graph.remove(cls, _BOTH, node)
    graph.add(cls, _UNION, graph.make_list(sorted(out - gone)))
    return out - gone
