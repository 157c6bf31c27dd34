"""RDF/XML reader (driver): typed nodes, property elements and attributes, parse types, datatypes, languages."""

from __future__ import annotations

import itertools
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

from .. import terms as T

_R = "{" + T.RDF + "}"
_X = "{http://www.w3.org/XML/1998/namespace}"


def _iri(tag: str) -> str:
    return "<" + tag.replace("{", "").replace("}", "") + ">"


def parse(text: str, base: str = "") -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    count = itertools.count()
    root = ET.fromstring(text)

    def blank() -> str:
        return f"_:x{next(count)}"

    def node(el, base, lang) -> str:
        base, lang = el.get(_X + "base", base), el.get(_X + "lang", lang)
        if el.get(_R + "about") is not None:
            me = f"<{urljoin(base, el.get(_R + 'about')) if base else el.get(_R + 'about')}>"
        elif el.get(_R + "ID") is not None:
            me = f"<{base}#{el.get(_R + 'ID')}>"
        else:
            me = "_:" + el.get(_R + "nodeID") if el.get(_R + "nodeID") else blank()
        if el.tag != _R + "Description":
            out.append((me, T.TYPE, _iri(el.tag)))
        for k, v in el.attrib.items():
            if not k.startswith((_R, _X)) or k == _R + "type":
                out.append((me, _iri(k), f"<{v}>" if k == _R + "type" else T.literal(v, lang=lang)))
        member = itertools.count(1)
        for p in el:
            prop(me, p, base, lang, member)
        return me

    def prop(me, el, base, lang, member):
        base, lang = el.get(_X + "base", base), el.get(_X + "lang", lang)
        verb = f"<{T.RDF}_{next(member)}>" if el.tag == _R + "li" else _iri(el.tag)
        kind = el.get(_R + "parseType")
        if kind == "Resource":
            o = blank()
            inner = itertools.count(1)
            for p in el:
                prop(o, p, base, lang, inner)
        elif kind == "Collection":
            o = T.NIL
            for x in reversed([node(c, base, lang) for c in el]):
                cell = blank()
                out.extend([(cell, T.FIRST, x), (cell, T.REST, o)])
                o = cell
        elif kind == "Literal":
            body = (el.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in el)
            o = T.literal(body, datatype=T.RDF + "XMLLiteral")
        elif el.get(_R + "resource") is not None:
            o = f"<{urljoin(base, el.get(_R + 'resource')) if base else el.get(_R + 'resource')}>"
        elif el.get(_R + "nodeID") is not None:
            o = "_:" + el.get(_R + "nodeID")
        elif len(el):
            o = node(el[0], base, lang)
        elif el.get(_R + "datatype"):
            o = T.literal(el.text or "", datatype=el.get(_R + "datatype"))
        else:
            extra = [k for k in el.attrib if not k.startswith((_R, _X))]
            if extra:
                o = blank()
                out.extend((o, _iri(k), T.literal(el.get(k), lang=lang)) for k in extra)
            else:
                o = T.literal(el.text or "", lang=lang)
        out.append((me, verb, o))

    base = root.get(_X + "base", base)
    for el in root if root.tag == _R + "RDF" else [root]:
        node(el, base, root.get(_X + "lang"))
    return list(dict.fromkeys(out))


def write(facts, prefixes: dict[str, str] | None = None) -> str:
    """RDF/XML of facts, a description a subject."""
    ET.register_namespace("rdf", T.RDF)
    for p, ns in (prefixes or {}).items():
        if p and p not in ("rdf",) and not p.startswith("ns"):
            ET.register_namespace(p, ns)
    root = ET.Element(_R + "RDF")
    for s, group in itertools.groupby(sorted(facts), key=lambda t: t[0]):
        el = ET.SubElement(root, _R + "Description", {_R + "nodeID": s[2:]} if T.is_blank(s) else {_R + "about": s[1:-1]})
        for _, p, o in group:
            body = p[1:-1]
            cutat = max(body.rfind("#"), body.rfind("/")) + 1
            sub = ET.SubElement(el, f"{{{body[:cutat]}}}{body[cutat:]}")
            if T.is_literal(o):
                lex, dt, lang = T.parse_literal(o)
                sub.text = lex
                if dt:
                    sub.set(_R + "datatype", dt)
                if lang:
                    sub.set(_X + "lang", lang)
            elif T.is_blank(o):
                sub.set(_R + "nodeID", o[2:])
            else:
                sub.set(_R + "resource", o[1:-1])
    return ET.tostring(root, encoding="unicode")
