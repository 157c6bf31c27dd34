"""Readers, writers, ontologies, queries against DuckDB."""

import pytest

from deductra import queries
from deductra import terms as T
from deductra.engine import Engine
from deductra.owl import expr as E
from deductra.owl.axioms import rules_from_owl
from deductra.owl.inclusion import close_memberships
from deductra.owl.packs import INCONSISTENT, LISTS, PD, PD_AXIOMS, RDFS, SUPPORT
from deductra.plans.ir import Atom, Var, canonical
from deductra.sources import n3, rdf, rdfxml
from deductra.sparql import SparqlError

X, Y = Var("X"), Var("Y")
PRE = queries.OWL_PREFIX


def v(name, *args):
    return Atom(f"<urn:v#{name}>", args)


def test_n3_reader():
    d = n3.parse("""@prefix : <urn:x#> . # a comment
:a :p "x\\n\\"y\\""@EN , 4, 1.5, 2e3, true ; a :C . [ :q ( :a "b" ) ] :r """ + '"""long "text" """' + """ .
:b @is :p @of :c . {} => { :u :v :w } . { ?x :p ?y . _:z :q ?x } => { ?y :r _:n } . { ?x a :Bad } => false . :s <urn:t> <urn:u> .""")
    assert ("<urn:x#a>", "<urn:x#p>", '"x\\n\\"y\\""@en') in d.facts and ("<urn:x#c>", "<urn:x#p>", "<urn:x#b>") in d.facts and ("<urn:x#u>", "<urn:x#v>", "<urn:x#w>") in d.facts
    assert len(d.rules) == 2 and d.rules[0].existential() == {Var("_n")} and d.rules[1].head == ()
    assert n3.parse(n3.to_turtle(d.facts, {"": "urn:x#"})).facts.__len__() == len(d.facts)
    assert set(n3.parse(n3.to_ntriples(d.facts)).facts) >= {f for f in d.facts if not any(T.is_blank(x) for x in f)}
    again = n3.parse(n3.rule_to_n3(d.rules[0])).rules[0]
    assert canonical(again) == canonical(d.rules[0])
    with pytest.raises(n3.N3Error):
        n3.parse("q:a q:b q:c .")


def test_rdfxml_round_trip():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="urn:v#" xml:base="urn:base">
      <v:C rdf:about="urn:a" v:name="n"><v:p rdf:resource="urn:b"/><v:q rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</v:q>
      <v:l rdf:parseType="Collection"><rdf:Description rdf:about="urn:c"/></v:l><v:e rdf:parseType="Resource"><v:f xml:lang="en">t</v:f></v:e></v:C></rdf:RDF>"""
    facts = rdfxml.parse(text)
    assert ("<urn:a>", T.TYPE, "<urn:v#C>") in facts and ("<urn:a>", "<urn:v#q>", T.literal(3)) in facts
    v = "<urn:v#{}>".format
    assert sorted(p for _, p, _ in facts) == sorted([T.TYPE, v("name"), v("p"), v("q"), v("l"), T.FIRST, T.REST, v("e"), v("f")])
    assert len(rdfxml.parse(rdfxml.write(facts))) == len(facts)


def test_ntriples_through_spark(spark, tmp_path):
    facts = {("<urn:a>", "<urn:p>", '"x y"@en'), ("_:b", "<urn:p>", T.literal(3)), ("<urn:a>", "<urn:p>", "<urn:b>")}
    rdf.write_ntriples(rdf.facts_df(spark, facts), f"file://{tmp_path}/nt")
    assert {tuple(r) for r in rdf.read_ntriples(spark, f"file://{tmp_path}/nt").collect()} == facts
    (tmp_path / "one.n3").write_text("@prefix owl: <http://www.w3.org/2002/07/owl#> . <urn:o> owl:imports <urn:two> .")
    (tmp_path / "two.n3").write_text("<urn:a> <urn:b> <urn:c> .")
    doc = rdf.with_imports(rdf.read_document(str(tmp_path / "one.n3")), lambda i: str(tmp_path / "two.n3"))
    assert len(doc.facts) == 2


def golden(text, want, **options):
    assert {canonical(r) for r in rules_from_owl(PRE + text, **options)} == {canonical(r) for r in want}


def test_golden_rules():
    golden("[ a owl:Class ; owl:intersectionOf ( v:Foo [ a owl:Class ; owl:unionOf ( v:Omega v:Alpha ) ] ) ] rdfs:subClassOf v:Bar .", [v("Bar", X) <= v("Foo", X) & v("Omega", X), v("Bar", X) <= v("Foo", X) & v("Alpha", X)])
    golden("v:Foo owl:equivalentClass v:Bar .", [v("Foo", X) <= v("Bar", X), v("Bar", X) <= v("Foo", X)])
    golden("[ a owl:Class ; owl:intersectionOf ( [ a owl:Restriction ; owl:onProperty v:p ; owl:hasValue v:fish ] v:Bar ) ] rdfs:subClassOf v:Foo .", [v("Foo", X) <= v("p", X, "<urn:v#fish>") & v("Bar", X)])
    golden("v:A owl:unionOf ( v:E v:F ) . v:C owl:unionOf ( v:A v:B ) .", [v("A", X) <= v("E", X), v("A", X) <= v("F", X), v("C", X) <= v("A", X), v("C", X) <= v("B", X)])
    golden("v:C owl:intersectionOf ( v:A v:B ) .", [v("C", X) <= v("A", X) & v("B", X), v("A", X) <= v("C", X), v("B", X) <= v("C", X)])
    golden("v:C rdfs:subClassOf [ a owl:Class ; owl:unionOf ( v:A v:B ) ] .", [])


def test_normal_forms():
    n = E.Named
    a, b = n("a"), n("b")
    assert E.normal_form(E.Only("p", a)) == E.Complement(E.Some("p", E.Complement(a)))
    assert E.normal_form(E.Complement(E.Complement(a))) == a
    assert E.normal_form(E.Complement(E.Either((a, b)))) == E.Both((E.Complement(a), E.Complement(b)))
    assert E.normal_form(E.Both((a, E.Both((b, n("c")))))) == E.Both((a, b, n("c")))
    assert E.normal_form(E.Some("p", E.OneOf(("1", "2")))) == E.Either((E.Value("p", "1"), E.Value("p", "2")))
    assert E.normal_form(E.Only("p", E.OneOf(("1",))), {"p": ("1", "2")}) == E.Complement(E.Value("p", "2"))
    assert E.manchester(E.Both((n("<urn:v#A>"), E.Some("<urn:v#p>", n("<urn:v#B>")))), {"v": "urn:v#"}) == "v:A and ( v:p some v:B )"


@pytest.mark.parametrize("axiom,member", [
    ("v:None a owl:Class ; owl:intersectionOf ( v:All [ a owl:Class ; owl:complementOf [ a owl:Class ; owl:unionOf ( v:A v:B ) ] ] ) .", {"c"}),
    ("v:None a owl:Class ; owl:intersectionOf ( v:All [ a owl:Restriction ; owl:onProperty v:has ; owl:allValuesFrom [ a owl:Class ; owl:complementOf v:A ] ] ) .", {"a", "b"}),
    ("v:None a owl:Class ; owl:intersectionOf ( v:All [ a owl:Class ; owl:complementOf [ a owl:Restriction ; owl:onProperty v:has ; owl:someValuesFrom v:A ] ] ) .", {"a", "b"}),
    ("v:None owl:complementOf v:A .", {"b", "c"}),
])
def test_negation_from_axioms(spark, axiom, member):
    e = Engine.from_n3(spark, PRE + "v:a a v:All , v:A . v:b a v:All, v:B . v:c a v:All ; v:has v:a , v:b .")
    e.add_rules(rules_from_owl(PRE + axiom, stored=set()))
    assert {r[0] for r in e.relation_of(v("None", X)).collect()} == {f"<urn:v#{m}>" for m in member}


def test_property_hierarchy(spark):
    e = Engine.from_n3(spark, PRE + "v:john v:has_brother v:jack .")
    e.add_rules(rules_from_owl(PRE + "v:has_brother rdfs:subPropertyOf v:has_sibling ; owl:equivalentProperty v:brother . v:has_sibling a owl:SymmetricProperty ; rdfs:domain v:Person ; rdfs:range v:Person ."))
    got = {tuple(r) for r in e.inferred().collect()}
    assert {("<urn:v#john>", "<urn:v#has_sibling>", "<urn:v#jack>"), ("<urn:v#jack>", "<urn:v#has_sibling>", "<urn:v#john>"), ("<urn:v#john>", "<urn:v#brother>", "<urn:v#jack>"), ("<urn:v#jack>", T.TYPE, "<urn:v#Person>")} <= got


def test_pd_pack(spark):
    e = Engine.from_n3(spark, PRE + "v:t a owl:TransitiveProperty . v:a v:t v:b . v:b v:t v:c . v:N owl:oneOf ( v:a v:b ) . v:q owl:inverseOf v:t . v:a owl:differentFrom v:a2 ; owl:sameAs v:a2 .")
    e.load_n3(PD)
    e.load_n3(INCONSISTENT)
    got = {tuple(r) for r in e.closure().collect()}
    w = "<urn:v#%s>"
    assert {(w % "a", w % "t", w % "c"), (w % "c", w % "q", w % "a"), (w % "b", T.TYPE, w % "N"), (w % "a2", w % "t", w % "c")} <= got
    assert sum(df.count() for df in e.violations().values()) > 0


def test_rdfs_pack_types_all_nodes(spark):
    e = Engine.from_n3(spark, PRE + 'v:a v:p v:b . v:b v:q "x" .')
    e.load_n3(RDFS)
    got = {tuple(r) for r in e.closure().collect()}
    resource = "<http://www.w3.org/2000/01/rdf-schema#Resource>"
    assert {s for s, p, o in got if (p, o) == (T.TYPE, resource)} == {x for s, _, o in got for x in (s, o)} >= {"<urn:v#a>", "<urn:v#b>", '"x"', resource}


def test_rdfs_types_of_nations_and_regions(spark, sf_dir):
    got = {tuple(r) for r in queries._rdfs_types(spark, sf_dir).collect()}
    nodes = [("nation", i, "Nation") for i in range(25)] + [("region", i, "Region") for i in range(5)]
    assert got == {(f"<urn:{t}/{i}>", o) for t, i, c in nodes for o in (f"<urn:v#{c}>", "<urn:v#Place>", "<http://www.w3.org/2000/01/rdf-schema#Resource>")}


def test_support_rules(spark):
    e = Engine.from_n3(spark, PRE + """v:f owl:inverseOf v:g ; a owl:FunctionalProperty . v:h owl:inverseOf v:i ; a owl:InverseFunctionalProperty .
        v:One owl:oneOf ( v:only ) . v:Two owl:oneOf ( v:x v:y ) . v:d1 rdfs:domain v:One . v:r1 rdfs:range v:One . v:d2 rdfs:domain v:Two . v:A owl:complementOf v:B . v:C owl:disjointWith v:D . v:c a v:C . v:d a v:D .""")
    e.load_n3(SUPPORT)
    got = {tuple(r) for r in e.inferred().collect()}
    w, o = "<urn:v#%s>", "<http://www.w3.org/2002/07/owl#%s>"
    kinds = {(w % "g", "InverseFunctionalProperty"), (w % "i", "FunctionalProperty"), (w % "d1", "InverseFunctionalProperty"), (w % "r1", "FunctionalProperty")}
    assert got == {(s, T.TYPE, o % k) for s, k in kinds} | {(w % a, o % p, w % b) for a, p, b in (("B", "complementOf", "A"), ("D", "disjointWith", "C"), ("c", "differentFrom", "d"), ("d", "differentFrom", "c"))}


def test_pd_lists_and_equal_classes(spark):
    e = Engine.from_n3(spark, PRE + """v:I owl:intersectionOf ( v:A v:B ) . v:x a v:A , v:B . v:y a v:A .
        v:K a owl:Class ; owl:sameAs v:L . v:p a rdf:Property ; owl:sameAs v:q .""")
    e.load_n3(LISTS)
    got = {tuple(r) for r in e.closure().collect()}
    w, r = "<urn:v#%s>", "<http://www.w3.org/2000/01/rdf-schema#%s>"
    assert {s for s, p, c in got if (p, c) == (T.TYPE, w % "I")} == {w % "x"}
    assert {(w % "K", r % "subClassOf", w % "L"), (w % "p", r % "subPropertyOf", w % "q")} <= got
    cells = {s for s, p, _ in got if p.endswith("#rest>")}
    assert len(cells) == 2 and {s for s, p, c in got if p == T.TYPE and c.endswith("#List>")} == cells
    assert sum(p == "<urn:list#subListOf>" for _, p, _ in got) == 2 + 1


def test_pd_axioms_are_loaded(spark):
    e = Engine.from_n3(spark, PRE)
    e.load_n3(PD_AXIOMS)
    got = {tuple(r) for r in e.closure().collect()}
    r, o = "<http://www.w3.org/2000/01/rdf-schema#%s>", "<http://www.w3.org/2002/07/owl#%s>"
    assert {(r % "isDefinedBy", r % "subPropertyOf", r % "seeAlso"), (o % "disjointWith", T.TYPE, o % "SymmetricProperty")} <= got
    assert len(got) == 43 and all(part in PD for part in (SUPPORT, PD_AXIOMS, LISTS))


def test_inclusion_join(spark):
    m = spark.createDataFrame([("x", "A"), ("y", "B")], "m string, c string")
    up = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "a string, b string")
    assert {tuple(r) for r in close_memberships(m, up).collect()} == {("x", "A"), ("x", "B"), ("x", "C"), ("y", "B"), ("y", "C")}


def test_sparql_subset(spark):
    e = Engine.from_n3(spark, '@prefix v: <urn:v#> . v:a v:n 1 ; v:l "One"@en . v:b v:n 2.0 . v:c v:n 3 ; v:l "three" .')
    q = "PREFIX v: <urn:v#> "
    assert {r[0] for r in e.sparql(q + "SELECT ?s WHERE { ?s v:n ?n FILTER(?n >= 2 && !(?n = 3)) }").collect()} == {"<urn:v#b>"}
    assert {r[0] for r in e.sparql(q + 'SELECT ?s { ?s v:n ?n OPTIONAL { ?s v:l ?l } FILTER(!BOUND(?l) || REGEX(?l, "^ONE", "i")) }').collect()} == {"<urn:v#a>", "<urn:v#b>"}
    assert e.sparql(q + "SELECT * WHERE { ?s v:n ?n ; v:l ?l } LIMIT 1").columns == ["s", "n", "l"]
    assert e.sparql(q + 'ASK { ?s v:l "three" }') and not e.sparql(q + "ASK { ?s v:zzz ?o }")
    with pytest.raises(SparqlError):
        e.sparql(q + "SELECT ?s WHERE { ?s v:n ?n } GROUP BY ?s")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str(tuple(r)) for r in got.select(*order).collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
