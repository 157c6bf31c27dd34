"""Programs as wholes: negation beside open rules, local and distributed evaluation, deep chains, RDFS by shapes, streams, query objects."""

import random
import time
import warnings

import pytest

from deductra import terms as T
from deductra.engine import Engine
from deductra.operators import fixpoint, local
from deductra.owl import rdfs
from deductra.owl.axioms import NoHornForm, rules_from_owl
from deductra.owl.expansion import below, expand_complement
from deductra.owl.expr import Graph
from deductra.owl.packs import RDF_AXIOMS, RDFS
from deductra.plans.analyze import NotStratified
from deductra.plans.conjunctive import ConjunctiveQuery
from deductra.plans.ddl import Clash
from deductra.plans.ir import Atom, Builtin, Rule, Var, variables
from deductra.sources import n3, rdf

X, Y, Z, S, P, O = variables("X Y Z S P O")  # noqa: E741
PRE = "@prefix : <urn:x#> . @prefix math: <http://www.w3.org/2000/10/swap/math#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


def u(x):
    return f"<urn:x#{x}>"


def t(name, *args):
    return Atom(u(name), args)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_negation_beside_a_rule_over_any_predicate(spark):
    e = Engine(spark)
    e.load_n3(PRE + ":a a :T .")
    program = [t("B", X) <= t("T", X) & ~t("A", X), t("C", X) <= t("T", X) & ~t("B", X)]
    e.add_rules(program)
    assert rows(e.relation_of(t("B", X))) == {(u("a"),)} and rows(e.relation_of(t("C", X))) == set()
    e.add_rules([t("seen", S, O) <= Atom("triple", (S, P, O))])
    assert rows(e.relation_of(t("B", X))) == {(u("a"),)} and rows(e.relation_of(t("C", X))) == set()
    assert rows(e.relation_of(t("seen", X, Y))) == {(u("a"), u("T")), (u("a"), u("B"))}
    up = Atom("triple", (X, T.TYPE, Y)) <= Atom("triple", (X, T.TYPE, S)) & Atom("triple", (S, u("sub"), Y))
    e = Engine(spark).add_rules([*program, up])
    e.load_n3(PRE + ":a a :T . :T :sub :A .")
    assert rows(e.relation_of(t("B", X))) == set() and rows(e.relation_of(t("C", X))) == {(u("a"),)}
    e = Engine(spark).add_rules([*program, up])
    e.load_n3(PRE + ":a a :T . :B :sub :A .")  # what B's absence of A gives makes A true
    with pytest.raises(NotStratified):
        e.closure()
    e = Engine(spark).add_rules([t("B", X) <= t("T", X) & ~t("A", X), t("A", X) <= t("T", X) & ~t("B", X), t("seen", S, O) <= Atom("triple", (S, P, O))])
    e.load_n3(PRE + ":a a :T .")
    with pytest.raises(NotStratified):
        e.closure()


def test_kept_answers_follow_changes(spark):
    e = Engine(spark).relation("edge", spark.createDataFrame([(1, 2)], "a int, b int"))
    e.add_rules([Atom("path", (X, Y)) <= Atom("edge", (X, Y)), Atom("path", (X, Z)) <= Atom("path", (X, Y)) & Atom("path", (Y, Z))])
    goal = Atom("path", (1, Y))
    assert rows(e.table(goal)) == {(2,)}
    e.add_facts("edge", spark.createDataFrame([(2, 3)], "a int, b int"))
    assert rows(e.table(goal)) == rows(e.query(goal)) == {(2,), (3,)}
    e.add_rules([Atom("path", (X, X)) <= Atom("edge", (X, Y))])
    assert rows(e.table(goal)) == {(1,), (2,), (3,)}


@pytest.mark.parametrize("seed", range(4))
def test_local_and_distributed_rounds_agree(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(r.randrange(8), r.randrange(8)) for _ in range(9)]
    names = [(i, r.choice("ab")) for i in range(8)]

    def make():
        e = Engine(spark).relation("edge", spark.createDataFrame(edges, "a int, b int")).relation("name", spark.createDataFrame(names, "a int, n string"))
        e.add_rules([
            Atom("path", (X, Y)) <= Atom("edge", (X, Y)), Atom("path", (X, Z)) <= Atom("path", (X, Y)) & Atom("edge", (Y, Z)) & Atom("name", (Z, "a")),
            Atom("even", (X, X)) <= Atom("edge", (X, Y)), Atom("even", (X, Z)) <= Atom("odd", (X, Y)) & Atom("edge", (Y, Z)), Atom("odd", (X, Z)) <= Atom("even", (X, Y)) & Atom("edge", (Y, Z)) & X.differs(Z),
            Atom("far", (X, Y)) <= Atom("path", (X, Y)) & ~Atom("edge", (X, Y)),
        ])
        return e

    fast, slow = make(), make()
    fast.close()
    assert fast.close().facts
    monkeypatch.setattr(local, "ROWS", -1)
    assert not slow.close().facts
    for p in ("path", "even", "odd", "far"):
        a = Atom(p, (X, Y))
        assert rows(fast.relation_of(a)) == rows(slow.relation_of(a)) and fast.relation_of(a).schema == slow.relation_of(a).schema
    for p in ("path", "even", "odd"):
        assert rows(fast.close().result.with_rounds(p)) == rows(slow.close().result.with_rounds(p))


def test_what_isnt_local(spark):
    nulls = Engine(spark).relation("e", spark.createDataFrame([(1, None), (1, 2)], "a int, b int"))
    nulls.add_rules([Atom("p", (X, Y)) <= Atom("e", (X, Y)), Atom("p", (X, Z)) <= Atom("p", (X, Y)) & Atom("p", (Y, Z))])
    assert rows(nulls.relation_of(Atom("p", (X, Y)))) == {(1, None), (1, 2)} and not nulls.close().facts


def chain(spark, n):
    e = Engine(spark).relation("c0", spark.range(100).selectExpr("id"))
    return e.add_rules([r for i in range(n) for r in (Atom(f"c{i + 1}", (X,)) <= Atom(f"c{i}", (X,)), Atom(f"c{i + 1}", (X,)) <= Atom(f"c{i}", (X,)) & (X > 3))])


@pytest.mark.parametrize("few", [True, False])
def test_plans_of_deep_chains_stay_small(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(local, "ROWS", -1)
    start = time.time()
    out = chain(spark, 100 if few else 12).relation_of(Atom("c100" if few else "c12", (X,)))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n") < 400
    assert out.count() == 100
    assert not few or time.time() - start < 20


def graph(seed):
    r = random.Random(seed)
    res, cls, prop = ([u(f"{k}{i}") for i in range(5)] for k in "rcp")
    schema = [T.rdfs("subClassOf"), T.rdfs("subPropertyOf"), T.rdfs("domain"), T.rdfs("range")]
    meta = [T.rdfs("Class"), T.rdfs("Datatype"), T.rdf("Property"), T.rdfs("ContainerMembershipProperty")]
    out = {(r.choice(res), r.choice(prop), r.choice([*res, '"lit"', *cls])) for _ in range(8)}
    out |= {(r.choice(res), T.TYPE, r.choice(cls + meta[:2])) for _ in range(3)}
    out |= {(r.choice(cls), schema[0], r.choice(cls)), (r.choice(prop), schema[1], r.choice(prop + ([schema[0], T.TYPE] if seed % 2 else [])))}
    return list(out | {(r.choice(prop), schema[2], r.choice(cls + meta)), (r.choice(prop), schema[3], r.choice(cls + meta))})


@pytest.mark.parametrize("seed", range(4))
def test_rdfs_by_shapes_gives_what_the_rules_give(spark, monkeypatch, seed):
    e = Engine(spark).add_triples(graph(seed))
    e.load_n3(RDFS)
    want = rows(e.closure())
    assert e.close().facts
    got = rdfs.closure(spark, e.triples, lambda few: Engine(spark).add_triples(few)._evaluate(e.rules)[1].total["triple"].toDF("s", "p", "o"))
    assert rows(got) == want
    monkeypatch.setattr(rdfs, "MOST", 2)
    assert rdfs.closure(spark, e.triples, None) is None


def test_rdf_axioms(spark):
    e = Engine.from_n3(spark, PRE + RDF_AXIOMS + ":l rdf:_7 :x . :p rdfs:domain :C . :C rdfs:subClassOf :D .")
    c = rows(e.closure())
    assert {("<http://www.w3.org/1999/02/22-rdf-syntax-ns#_7>", T.TYPE, T.rdfs("ContainerMembershipProperty")), (u("p"), T.rdfs("domain"), u("D")), (T.rdfs("label"), T.rdfs("range"), T.rdfs("Literal"))} <= c


def test_stream_restart(spark, tmp_path):
    from deductra.streaming.maintain import maintain

    source, check, seen = tmp_path / "in", tmp_path / "check", []

    def once():
        e = Engine(spark).relation("edge", spark.createDataFrame([], "a long, b long"))
        e.add_rules([Atom("path", (X, Y)) <= Atom("edge", (X, Y)), Atom("path", (X, Z)) <= Atom("path", (X, Y)) & Atom("path", (Y, Z))])
        stream = spark.readStream.schema("a long, b long").parquet(str(source))
        maintain(e, stream, "edge", Atom("path", (1, Y)), lambda df, n: seen.append(rows(df)), f"file://{check}", available_now=True).awaitTermination()

    for a, b in ((1, 2), (5, 6), (2, 3)):
        spark.createDataFrame([(a, b)], "a long, b long").write.mode("append").parquet(str(source))
        once()  # a new process would start like this: nothing is left of the one before
    assert [s for s in seen if s] == [{(2,)}, {(3,)}]


def test_arithmetic_binds_and_compares(spark):
    e = Engine.from_n3(spark, PRE + ':a :w 2 ; :h 3 . :b :w 2.5 ; :h 2 . :c :w "x" ; :h 1 . { ?s :w ?x . ?s :h ?y . ( ?x ?y ) math:product ?z . ( ?z 1 ) math:sum ?q } => { ?s :area ?z ; :more ?q } . { ?s :area ?z . ( ?z 2 ) math:integerQuotient 3 } => { ?s a :Three } .')
    got = rows(e.inferred())
    assert {(u("a"), u("area"), T.literal(6)), (u("a"), u("more"), T.literal(7)), (u("b"), u("area"), T.literal(5)), (u("a"), T.TYPE, u("Three"))} == {g for g in got if g[0] != u("b") or g[1] == u("area")}
    e = Engine(spark).relation("n", spark.createDataFrame([(3, 4)], "a int, b int"))
    e.add_rules([Rule((Atom("s", (X, Z)),), (Atom("n", (X, Y)), Builtin("math:sum", (X, Y, Z))), "s")])
    assert rows(e.relation_of(Atom("s", (X, Y)))) == {(3, 7)}
    with pytest.raises(n3.N3Error):
        n3.parse(PRE + "{ ?s :w ?x . ( ?x ) math:sum ?z } => { ?s :v ?z } .")


def test_query_object(spark):
    e = Engine.from_n3(spark, PRE + ":a :p :b . :b :p :c . { ?x :p ?y } => { ?y :q ?x } .")
    q = ConjunctiveQuery((t("q", X, Y), t("q", Y, Z)), (X,))
    assert rows(q.to_df(e)) == rows(e.sparql(q.sparql())) == {(u("c"),)}
    assert q.bound(X=u("c"), Y=u("b"), Z=u("a")).ask(e) and not q.bound(X=u("a")).ask(e)
    assert q.bound(X=u("c"), Y=u("b"), Z=u("a")).sparql({"": "urn:x#"}) == "PREFIX : <urn:x#>\nASK { :c :q :b . :b :q :a . }"
    more = q.extended(Builtin("<http://www.w3.org/2000/10/swap/string#startsWith>", (Z, '"urn:x"')), t("C", Y), returns=(X, Z))
    assert more.sparql() == "SELECT ?X ?Z { ?X <urn:x#q> ?Y . ?Y <urn:x#q> ?Z . FILTER(STRSTARTS(?Z, \"urn:x\")) ?Y a <urn:x#C> . }"


def test_sparql_by_goals(spark):
    e = Engine.from_n3(spark, PRE + ":a :p :b . :b :p :c . :x :p :y . { ?x :p ?y } => { ?x :r ?y } . { ?x :r ?y . ?y :r ?z } => { ?x :r ?z } .")
    text = "PREFIX : <urn:x#> SELECT ?z WHERE { :a :r ?y . ?y :r ?z OPTIONAL { ?z :p ?w } }"
    assert rows(e.sparql(text, "magic")) == rows(e.sparql(text)) == {(u("c"),)}
    assert e.last_derived.total and all("x" not in str(v) or v != u("x") for p, df in e.last_derived.total.items() if p.startswith(u("r")) for row in df.collect() for v in row)
    assert e.sparql("PREFIX : <urn:x#> ASK { :a :r :c }", "magic") is True


def test_policies(spark):
    def make(policy):
        e = Engine(spark, policy=policy).relation("p", spark.createDataFrame([(1,)], "a int")).relation("q", spark.createDataFrame([(2,)], "a int"))
        return e.add_rules([Atom("p", (X,)) <= Atom("q", (X,))])

    want = {"loose": {(1,), (2,)}, "base": {(1,)}, "derived": {(2,)}}
    for policy, answer in want.items():
        for method in ("naive", "magic"):
            assert rows(make(policy).query(Atom("p", (X,)), method)) == answer, (policy, method)
    assert make("loose").catalog().hybrid == {"p"}
    with pytest.raises(Clash):
        make("harsh").close()


def test_complement_expansion():
    g = Graph()
    sub = T.rdfs("subClassOf")
    for a, b in (("Man", "Male"), ("Boy", "Male"), ("Woman", "Female"), ("Girl", "Female")):
        g.add(u(a), sub, u(b))
    g.add(u("Human"), T.owl("unionOf"), g.make_list([u("Male"), u("Female")]))
    g.add("_:no", T.owl("complementOf"), u("Female"))
    g.add(u("Some"), T.owl("intersectionOf"), g.make_list([u("Human"), "_:no"]))
    assert below(g, u("Human")) == {u("Man"), u("Boy"), u("Woman"), u("Girl")}
    assert expand_complement(g, u("Some")) == {u("Man"), u("Boy")}
    assert set(g.items(g.value(u("Some"), T.owl("unionOf")))) == {u("Man"), u("Boy")} and expand_complement(g, u("Human")) is None


def test_sources_tell_what_they_leave_out(spark, tmp_path):
    (tmp_path / "x.nt").write_text("<urn:a> <urn:p> <urn:b> .\n# no\n\n<urn:a> <urn:p> nonsense .\n")
    path = f"file://{tmp_path}/x.nt"
    assert rdf.read_ntriples(spark, path, strict=False).count() == 1 and rows(rdf.unread_ntriples(spark, path)) == {("<urn:a> <urn:p> nonsense .",)}
    with pytest.raises(Exception, match="not an N-Triples line"):
        rdf.read_ntriples(spark, path).collect()
    with pytest.warns(NoHornForm):
        rules_from_owl(PRE + "[ a owl:Restriction ; owl:onProperty :p ; owl:minCardinality 2 ] rdfs:subClassOf :D .")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        rules_from_owl(PRE + ":A rdfs:subClassOf :B .")


def test_sizes(spark):
    e = Engine(spark).relation("big", spark.range(1500)).add_rules([Atom("copy", (X,)) <= Atom("big", (X,)), Atom("few", (X,)) <= Atom("big", (X,)) & (X < 5)])
    assert rows(e.sizes()) == {("big", 1500), ("copy", 1500)}


def test_fixpoint_knows_its_bounds():
    assert fixpoint.LEAVES < 100 and local.ROWS <= 100_000


def test_rif_in_rdf_and_ground_implications(spark):
    from deductra.plans.ir import canonical
    from deductra.sources import rif

    pre = "@prefix rif: <http://www.w3.org/2007/rif#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
    const = lambda x: f'[ a rif:Const ; rif:constIRI "urn:x#{x}"^^xsd:anyURI ]'
    var = lambda x: f'[ a rif:Var ; rif:varname "{x}" ]'
    frame = lambda s, p, o: f"[ a rif:Frame ; rif:object {s} ; rif:slots ( [ a rif:Slot ; rif:slotkey {const(p)} ; rif:slotvalue {o} ] ) ]"
    text = pre + f"""[] a rif:Document ; rif:payload [ a rif:Group ; rif:sentences ( {frame(const('a'), 'p', const('b'))}
        [ a rif:Forall ; rif:vars ( {var('v')} {var('w')} ) ; rif:formula [ a rif:Implies ; rif:if [ a rif:And ; rif:formulas ( {frame(var('v'), 'p', var('w'))} ) ] ; rif:then {frame(var('w'), 'q', var('v'))} ] ]
        [ a rif:Implies ; rif:if {frame(const('b'), 'q', const('a'))} ; rif:then {frame(const('b'), 'r', const('c'))} ] ) ] ."""
    doc = rif.parse_graph(n3.parse(text).facts)
    assert doc.facts == [(u("a"), u("p"), u("b"))] and len(doc.rules) == 2
    assert canonical(doc.rules[0]) == canonical(t("q", Y, X) <= t("p", X, Y))
    assert doc.rules[1].head == (t("r", u("b"), u("c")),) and not doc.rules[1].body_variables()
    e = Engine(spark).add_triples(doc.facts).add_rules(doc.rules)
    assert rows(e.inferred()) == {(u("b"), u("q"), u("a")), (u("b"), u("r"), u("c"))}


def test_equal_rules_are_one(spark):
    e = Engine(spark).add_rules([t("q", X, Y) <= t("p", X, Z) & t("p", Z, Y)])
    e.add_rules([t("q", S, O) <= t("p", P, O) & t("p", S, P), t("q", X, Y) <= t("p", X, Y)])
    e.load_n3(PRE + "{ ?one :p ?two } => { ?one :q ?two } .")
    assert len(e.rules) == 2


def test_collapsed_prefixes():
    assert T.collapse({"ex_1": "urn:x#", "ex": "urn:x#", "example": "urn:x#", "ns1": "urn:y#"}) == {"ex": "urn:x#", "ns1": "urn:y#"}
