"""Command line: facts and rules in, inferred or closed triples, rules, proofs, reports or answers out.

    python -m deductra.cli --rules family.n3 --why "SELECT ?a WHERE { :david :ancestor ?a }" facts.n3
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .owl.axioms import rules_from_owl
from .owl.expr import Graph
from .owl.model import Ontology
from .plans.graph import to_dot
from .plans.ir import Rule
from .sources import n3, rdf, rdfxml, rif, trix

FORMATS = ["nt", "n3", "turtle", "xml", "trix", "rif", "rules-n3", "manchester", "conflict", "dot"]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="deductra", description=__doc__.splitlines()[0])
    p.add_argument("facts", nargs="*", help="fact files; - is standard input")
    p.add_argument("--input-format", choices=["n3", "turtle", "nt", "xml", "trix"])
    p.add_argument("--rules", action="append", default=[], help="an N3 or RIF (.rif) rule file")
    p.add_argument("--ontology", action="append", default=[], help="a TBox whose axioms become rules")
    p.add_argument("--filter", action="append", default=[], help="rules whose conclusions are kept apart")
    p.add_argument("--builtins", help="a Python file that defines ADDITIONAL_FILTERS: {iri: f(a, b) -> Column}")
    p.add_argument("--output", choices=FORMATS, default="n3")
    p.add_argument("--closure", action="store_true", help="asserted triples too")
    p.add_argument("--naive", dest="method", action="store_const", const="naive", default="naive")
    p.add_argument("--method", choices=["naive", "gms", "bfp", "sld"])
    p.add_argument("--why", help="a SPARQL query over asserted and derived facts")
    p.add_argument("--first-answer", action="store_true")
    p.add_argument("--safety", choices=["none", "loose", "strict"], default="strict")
    p.add_argument("--no-rules", action="store_true", help="only convert")
    return p


def run(spark: SparkSession, argv: list[str], out=None, stdin=None) -> None:
    """What the arguments ask for, written to ``out``."""
    a, out = arguments().parse_args(argv), out or sys.stdout
    e = Engine(spark, safety=a.safety)
    if a.builtins:
        module: dict = {}
        exec(compile(Path(a.builtins).read_text(), a.builtins, "exec"), module)  # the user's own file, as asked
        for name, fn in module["ADDITIONAL_FILTERS"].items():
            e.register_builtin(name, fn)
    rules: list[Rule] = []
    facts: list = []
    prefixes: dict[str, str] = {}
    for path in a.facts:
        text = (stdin or sys.stdin).read() if path == "-" else None
        if a.input_format == "trix":
            doc = n3.Document(facts=trix.parse(text if text is not None else Path(path).read_text()))
        elif text is not None:
            doc = n3.Document(facts=rdfxml.parse(text)) if a.input_format == "xml" else n3.parse(text, e.registry)
        else:
            doc = rdf.read_document(path, a.input_format, e.registry)
        facts += doc.facts
        rules += doc.rules
        prefixes |= doc.prefixes
    for path in a.rules:
        text = Path(path).read_text()
        doc = rif.parse(text) if path.endswith(".rif") else n3.parse(text, e.registry)
        facts += doc.facts
        rules += doc.rules
        prefixes |= doc.prefixes
    for path in a.ontology:
        tbox = rdf.read_document(path, None, e.registry)
        prefixes |= tbox.prefixes
        facts += tbox.facts
        rules += rules_from_owl(tbox.facts)
    for path in a.filter:
        rules += [Rule(r.head, r.body, f"filter{i}", "filter") for i, r in enumerate(n3.parse(Path(path).read_text(), e.registry).rules, 1)]
    e.add_triples(list(dict.fromkeys(facts)))
    if not a.no_rules:
        e.add_rules([Rule(r.head, r.body, f"r{i}" if r.kind == "rule" else r.name, r.kind) for i, r in enumerate(rules, 1)])
    if a.why:
        found = e.sparql(a.why, a.method or "naive")
        if isinstance(found, bool):
            print(found, file=out)
            return
        for row in (found.limit(1) if a.first_answer else found).toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row), file=out)
        return
    if a.output == "rif":
        text = "\n".join(map(repr, e.rules))
    elif a.output == "rules-n3":
        text = "\n".join(n3.rule_to_n3(r, prefixes) for r in e.rules)
    elif a.output == "manchester":
        o = Ontology(prefixes.get("", "urn:ontology#"), Graph(facts))
        text = "\n\n".join(x.manchester(prefixes) for x in [*o.classes(), *o.properties()] if x.node.startswith("<"))
    elif a.output == "dot":
        text = to_dot(e.rules)
    elif a.output == "conflict":
        text = "\n".join(f"{r['rule']}\t{r['n']}" for r in e.firings().collect())  # a row a rule
    else:
        found = e.closure() if a.closure or a.no_rules else e.inferred()
        if a.output == "nt":  # a line at a time: nothing is held here
            for df in [found, *[e._as_triples(p, x) for p, x in (e.filtered().items() if a.filter else ())]]:
                for r in df.orderBy(*df.columns).toLocalIterator():
                    print(" ".join(r), ".", file=out)
            return
        rows = [tuple(r) for r in found.toLocalIterator()]
        for pred, df in e.filtered().items() if a.filter else ():
            rows += [tuple(r) for r in e._as_triples(pred, df).toLocalIterator()]
        text = {"xml": lambda f: rdfxml.write(f, prefixes), "trix": trix.write}.get(a.output, lambda f: n3.to_turtle(f, prefixes))(rows)
    print(text, file=out)


def main() -> None:
    spark = SparkSession.builder.appName("deductra").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
