"""TriX: triples of named graphs in XML, read into one set of facts."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from .. import terms as T

NS = "{http://www.w3.org/2004/03/trix/trix-1/}"


def _term(el) -> str:
    kind, text = el.tag.removeprefix(NS), el.text or ""
    if kind == "uri":
        return T.iri(text.strip())
    if kind == "id":
        return f"_:{text.strip()}"
    if kind == "plainLiteral":
        return T.literal(text, None, el.get("{http://www.w3.org/XML/1998/namespace}lang"))
    if kind == "typedLiteral":
        return T.literal(text, el.get("datatype"))
    raise ValueError(f"{el.tag} isn't a TriX term")


def parse(text: str) -> list[tuple[str, str, str]]:
    """Facts of all graphs, in order, without repeats."""
    found = [tuple(map(_term, t)) for t in ET.fromstring(text).iter(NS + "triple")]
    if any(len(t) != 3 for t in found):
        raise ValueError("a triple without three terms")
    return list(dict.fromkeys(found))


def write(facts) -> str:
    """One graph."""
    ET.register_namespace("", NS[1:-1])
    root = ET.Element(NS + "TriX")
    graph = ET.SubElement(root, NS + "graph")
    for fact in sorted(facts):
        triple = ET.SubElement(graph, NS + "triple")
        for x in fact:
            if T.is_iri(x):
                ET.SubElement(triple, NS + "uri").text = x[1:-1]
            elif T.is_blank(x):
                ET.SubElement(triple, NS + "id").text = x[2:]
            else:
                lex, dt, lang = T.parse_literal(x)
                el = ET.SubElement(triple, NS + ("typedLiteral" if dt else "plainLiteral"), {"datatype": dt} if dt else {})
                if lang:
                    el.set("{http://www.w3.org/XML/1998/namespace}lang", lang)
                el.text = lex
    return ET.tostring(root, encoding="unicode")
