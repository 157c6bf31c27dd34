"""RIF, TriX, EL classification, ontology objects, predicate kinds, the command line, incremental closure and streams."""

import io

import pytest

from deductra import cli
from deductra import terms as T
from deductra.engine import Engine
from deductra.owl import elh
from deductra.owl.axioms import rules_from_owl
from deductra.owl.model import Listed, Ontology, only, some
from deductra.plans import ddl
from deductra.plans.graph import to_dot
from deductra.plans.ir import Atom, variables
from deductra.sources import rif, trix
from deductra.streaming.maintain import maintain

X, Y, Z = variables("X Y Z")
PRE = "@prefix : <urn:x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def u(x):
    return f"<urn:x#{x}>"


def rows(df):
    return {tuple(r) for r in df.collect()}


IRI = 'type="http://www.w3.org/2007/rif#iri"'
INT = 'type="http://www.w3.org/2001/XMLSchema#integer"'
RIF = f"""<Document xmlns="http://www.w3.org/2007/rif#"><payload><Group>
<sentence><Frame><object><Const {IRI}>urn:x#a</Const></object><slot ordered="yes"><Const {IRI}>urn:x#age</Const><Const {INT}>7</Const></slot></Frame></sentence>
<sentence><Atom><op><Const {IRI}>urn:x#P</Const></op><args ordered="yes"><Const {IRI}>urn:x#a</Const></args></Atom></sentence>
<sentence><Forall><declare><Var>v</Var></declare><declare><Var>n</Var></declare><formula><Implies>
 <if><And><formula><Member><instance><Var>v</Var></instance><class><Const {IRI}>urn:x#P</Const></class></Member></formula>
  <formula><Frame><object><Var>v</Var></object><slot ordered="yes"><Const {IRI}>urn:x#age</Const><Var>n</Var></slot></Frame></formula>
  <formula><External><content><Atom><op><Const {IRI}>http://www.w3.org/2007/rif-builtin-predicate#numeric-greater-than</Const></op><args ordered="yes"><Var>n</Var><Const {INT}>5</Const></args></Atom></content></External></formula></And></if>
 <then><Atom><op><Const {IRI}>urn:x#Old</Const></op><args ordered="yes"><Var>v</Var></args></Atom></then></Implies></formula></Forall></sentence>
<sentence><Implies><if><Atom><op><Const {IRI}>urn:x#Old</Const></op><args><Const {IRI}>urn:x#a</Const></args></Atom></if>
 <then><Atom><op><Const {IRI}>urn:x#done</Const></op><args><Const {IRI}>urn:x#a</Const><Const {IRI}>urn:x#b</Const></args></Atom></then></Implies></sentence>
</Group></payload></Document>"""


def test_rif(spark):
    doc = rif.parse(RIF)
    assert doc.facts == [(u("a"), u("age"), T.literal(7)), (u("a"), T.TYPE, u("P"))] and len(doc.rules) == 2
    e = Engine(spark).add_triples(doc.facts).add_rules(doc.rules)
    assert rows(e.inferred()) == {(u("a"), T.TYPE, u("Old")), (u("a"), u("done"), u("b"))}
    with pytest.raises(rif.RifError):
        rif.parse(RIF.replace("<args><Const", "<args><Const>1</Const><Const>2</Const><Const", 1))


def test_trix():
    facts = [("_:b", "<urn:p>", '"x"@en'), ("_:b", "<urn:p>", T.literal(3)), ("_:b", "<urn:p>", "<urn:o>"), ("_:b", "<urn:p>", '"plain"')]
    assert sorted(trix.parse(trix.write(facts))) == sorted(facts)


def test_el_classification(spark):
    text = PRE + """
    :Knee rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :partOf ; owl:someValuesFrom :Leg ] .
    :partOf rdfs:subPropertyOf :within .
    [ a owl:Restriction ; owl:onProperty :within ; owl:someValuesFrom :Limb ] rdfs:subClassOf :LimbPart .
    :Leg rdfs:subClassOf :Limb . :Limb rdfs:subClassOf :Body .
    :HurtKnee owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :Knee :Hurt ) ] .
    :BadKnee rdfs:subClassOf :Knee , :Hurt . :Leg owl:disjointWith :Wheel . :Odd rdfs:subClassOf :Leg , :Wheel .
    """
    got = rows(elh.classify(spark, text).where("sub <> super and super <> '" + T.owl("Thing") + "'"))
    named = {(a, b) for a, b in got if a.startswith("<urn:x#") and a != u("Odd")}
    short = {(a[7:-1], b[7:-1]) for a, b in named}
    assert short == {
        ("Knee", "LimbPart"), ("Leg", "Limb"), ("Leg", "Body"), ("Limb", "Body"), ("HurtKnee", "Knee"), ("HurtKnee", "Hurt"), ("HurtKnee", "LimbPart"),
        ("BadKnee", "Knee"), ("BadKnee", "Hurt"), ("BadKnee", "HurtKnee"), ("BadKnee", "LimbPart"),
    }
    assert (u("Odd"), T.owl("Nothing")) in got and (u("Odd"), u("Knee")) in got
    with pytest.raises(elh.NotEl):
        elh.classify(spark, PRE + ":A rdfs:subClassOf [ a owl:Class ; owl:complementOf :B ] .")


def test_ontology_objects(spark):
    o = Ontology("urn:x#")
    person, tree, parent = o.cls("Person"), o.cls("Tree"), o.prop("parent")
    child = o.cls("Child")
    child.equivalent = [person & (parent | some | person)]
    assert child.manchester() == "Class: :Child\n    EquivalentTo: :Person and ( :parent some :Person )"
    assert (~(person | tree)).manchester() == "not ( :Person or :Tree )" and parent.exactly(2).manchester() == ":parent exactly 2"
    assert (parent | only | tree).manchester() == ":parent only :Tree" and parent.value(o.individual("ann")).manchester() == ":parent value :ann"
    assert not child.primitive and person.primitive and child.parents == [person] and set(child.components()) == {u("Person"), u("parent")}
    e = Engine(spark).add_triples([(u("bob"), T.TYPE, u("Person")), (u("bob"), u("parent"), u("ann")), (u("ann"), T.TYPE, u("Person"))])
    e.add_rules(rules_from_owl(o.graph))
    assert rows(e.inferred().where(f"o = '{u('Child')}'")) == {(u("bob"), T.TYPE, u("Child"))}  # the other direction gives each child some parent
    baby = o.cls("Baby")
    child += baby
    assert baby.ancestors() == [child, person] and list(child.children) == [baby]
    child -= baby
    assert not len(baby.sub_class_of)
    few = o.one_of(o.individual("a"), o.individual("b"), name="Few")
    few.append(o.individual("c"))
    del few[0]
    few[0] = o.individual("d")
    assert [x.node for x in few] == [u("d"), u("c")] and few.index(o.individual("c")) == 1 and len(few) == 2
    both = o._listed("intersectionOf", [person, tree], "Both")
    both.change_operator("unionOf")
    assert both.copy().manchester() == ":Person or :Tree" and isinstance(o.as_class(both.node), Listed)
    parent.domain, parent.inverse_of = [person], [o.prop("child")]
    assert "Domain: :Person" in parent.manchester() and parent.extent == []
    ann = o.individual("ann")
    ann.types += [person]
    ann.label = ["Ann"]
    ann.same_as += [o.individual("anna")]
    ann.rename("annie")
    assert list(person.extent) == [o.individual("annie")] and list(ann.label) == ["Ann"] and list(ann.same_as) == [o.individual("anna")]
    ann.delete()
    assert not len(person.extent)
    o.version, _ = "2", o.add_import("urn:other")
    assert o.version == "2" and o.imports == ["<urn:other>"] and len(o.properties()) == 2
    top, one, two = o.cls("Top"), o.cls("One"), o.cls("Two")
    top += [one, two]
    assert o.not_normalised() == [f"{u('One')} and {u('Two')} aren't disjoint"]
    one.disjoint_with += [two]
    assert o.not_normalised() == []
    size = len(o.graph)
    child.clear()
    assert len(o.graph) < size and not len(child.equivalent)


def test_predicate_kinds():
    rules = [Atom("p", (X, Y)) <= Atom("e", (X, Y)), Atom("q", (X,)) <= Atom("p", (X, Y))]
    c = ddl.classify(rules, {"e", "p"})
    assert (c.base, c.derived, c.hybrid) == ({"e"}, {"q"}, {"p"})
    assert ddl.classify(rules, {"e", "p"}, "base").base == {"e", "p"} and ddl.classify(rules, {"e", "p"}, "derived").derived == {"p", "q"}
    with pytest.raises(ddl.Clash):
        ddl.classify(rules, {"p"}, "harsh")
    listed = ddl.read([("_:l", T.TYPE, "<urn:d#DerivedClassList>"), ("_:l", T.FIRST, u("A")), ("_:l", T.REST, T.NIL)], "urn:d#")
    assert listed.derived == {u("A")} and not listed.base
    assert '"e" -> "p";' in to_dot(rules) and "style=dashed" in to_dot([Atom("a", (X,)) <= Atom("b", (X,)) & ~Atom("c", (X,))])


def test_command_line(spark, tmp_path):
    (tmp_path / "f.n3").write_text(PRE + ":a :p :b . :b :p :c .")
    (tmp_path / "r.n3").write_text(PRE + "{ ?x :p ?y . ?y :p ?z } => { ?x :q ?z } .")
    (tmp_path / "o.n3").write_text(PRE + ":p rdfs:subPropertyOf :r . :A a owl:Class ; rdfs:subClassOf :B .")

    def run(*argv, stdin=None):
        out = io.StringIO()
        cli.run(spark, list(argv), out, stdin)
        return out.getvalue()

    f, r, o = (str(tmp_path / f"{x}.n3") for x in "fro")
    assert run(f, "--rules", r, "--output", "nt").strip() == "<urn:x#a> <urn:x#q> <urn:x#c> ."
    assert run("-", "--rules", r, "--output", "nt", "--closure", stdin=io.StringIO(PRE + ":a :p :b .")).strip() == "<urn:x#a> <urn:x#p> <urn:x#b> ."
    assert run(f, "--rules", r, "--why", "PREFIX : <urn:x#> SELECT ?z WHERE { :a :q ?z }").strip() == "<urn:x#c>"
    assert run(f, "--rules", r, "--why", "PREFIX : <urn:x#> ASK { :a :q :b }").strip() == "False"
    assert "?x :p ?y" in run(f, "--rules", r, "--output", "rules-n3") and "Forall" in run(f, "--rules", r, "--output", "rif")
    assert run(f, "--rules", r, "--output", "conflict").split() == ["r1", "1"] and "digraph" in run(f, "--rules", r, "--output", "dot")
    assert "SubClassOf: :B" in run("--ontology", o, "--output", "manchester", o)
    assert ":r :b" in run(f, "--ontology", o, "--output", "n3")
    for fmt in ("xml", "trix"):
        assert "urn:x#" in run(f, "--no-rules", "--output", fmt)
    assert ":q" in run(f, "--filter", r)


def test_incremental_equals_one_shot(spark):
    edge = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    rules = [Atom("tc", (X, Y)) <= Atom("e", (X, Y)), Atom("tc", (X, Z)) <= Atom("tc", (X, Y)) & Atom("tc", (Y, Z)), Atom("loop", (X,)) <= Atom("tc", (X, X))]
    e = Engine(spark).relation("e", edge((1, 2), (3, 4))).add_rules(rules)
    e.close()
    for more in (edge((2, 3)), edge((4, 1), (2, 3)), edge((9, 9))):
        e.add_facts("e", more)
    once = Engine(spark).relation("e", edge((1, 2), (3, 4), (2, 3), (4, 1), (9, 9))).add_rules(rules)
    for goal in (Atom("tc", (X, Y)), Atom("loop", (X,))):
        assert rows(e.query(goal, "naive")) == rows(once.query(goal, "naive"))
    assert rows(e.relations["e"]) == rows(once.relations["e"])


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(f"file://{src}")
    stream = spark.readStream.schema("a long, b long").parquet(f"file://{src}")
    e = Engine(spark).relation("e", spark.createDataFrame([(3, 1)], "a long, b long")).add_rules([Atom("tc", (X, Y)) <= Atom("e", (X, Y)), Atom("tc", (X, Z)) <= Atom("tc", (X, Y)) & Atom("e", (Y, Z))])
    got = []
    q = maintain(e, stream, "e", Atom("tc", (X, Y)), lambda df, n: got.extend(map(tuple, df.collect())), f"file://{tmp_path}/cp", available_now=True)
    q.awaitTermination(120)
    assert sorted(got) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
