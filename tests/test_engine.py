"""Documented examples as golden cases, and properties against a tiny evaluator in Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from deductra import terms as T
from deductra.engine import EntailedView, Engine
from deductra.operators.fixpoint import TooManyRounds
from deductra.plans.analyze import NotStratified, UnsafeRule, check_safety
from deductra.plans.compile import TypeClash
from deductra.plans.ir import Atom, Builtin, Implies, Or, Rule, Var, canonical, variables
from deductra.plans.rewrite import double_linear, lloyd_topor, magic, negation_normal, normalise

X, Y, Z = variables("X Y Z")
PRE = "@prefix : <urn:x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix math: <http://www.w3.org/2000/10/swap/math#> . @prefix str: <http://www.w3.org/2000/10/swap/string#> .\n"


def rows(df):
    return {tuple(r) for r in df.collect()}


def u(x):
    return f"<urn:x#{x}>"


FAMILY = PRE + """@keywords is, of, a.
:albert :begat :bill, :bevan . :bevan :begat :charles . :bill :begat :carol, :christine . :christine :begat :david . :bevan :begat :dora .
{ ?x :begat ?y } => { ?y :ancestor ?x } .
{ ?x :ancestor ?y . ?y :ancestor ?z } => { ?x :ancestor ?z } .
"""


def test_same_as(spark):
    e = Engine.from_n3(spark, PRE + ':foo :x "xxxx" . :bar :y "yyyy" . :foo = :bar . { ?x = ?y } => { ?y = ?x } . { ?x = ?y . ?x ?p ?o } => { ?y ?p ?o } .')
    same = T.SAME_AS
    assert rows(e.inferred()) == {(u("bar"), u("x"), '"xxxx"'), (u("bar"), same, u("bar")), (u("bar"), same, u("foo")), (u("foo"), u("y"), '"yyyy"'), (u("foo"), same, u("foo"))}
    again = Engine(spark).add_triples(e.closure())
    again.rules = e.rules
    assert again.inferred().count() == 0


def test_goals_agree_with_closure(spark):
    e = Engine.from_n3(spark, FAMILY)
    goal = Atom(u("ancestor"), (u("david"), X))
    want = {(u("albert"),), (u("bill"),), (u("christine"),)}
    for method in ("naive", "magic", "supplementary", "sld"):
        assert rows(e.query(goal, method)) == want
    full = e.relation_of(Atom(u("ancestor"), (X, Y))).count()
    e.query(goal, "magic").count()
    assert sum(df.count() for p, df in e.last_derived.total.items() if p.startswith(u("ancestor"))) < full
    assert e.ask(Atom(u("ancestor"), (u("david"), u("albert")))) and not e.ask(Atom(u("ancestor"), (u("albert"), u("david"))))
    assert e.query(goal, first=True).count() == 1
    assert rows(e.sparql("PREFIX : <urn:x#> SELECT ?a WHERE { :david :ancestor ?a }")) == want
    assert e.sparql("PREFIX : <urn:x#> ASK { :david :ancestor :albert }") is True
    assert rows(e.table(goal)) == rows(e.table(goal)) == want


def test_proof(spark):
    e = Engine.from_n3(spark, FAMILY)
    proof = e.explain(Atom(u("ancestor"), (u("david"), u("albert"))))
    leaves = []

    def walk(n):
        if n.rule is None:
            leaves.append(n.fact)
        for a in n.antecedents:
            walk(a)

    walk(proof)
    assert {a.pred for a in leaves} == {u("begat")} and len(leaves) == 3
    assert "digraph" in proof.to_dot() and "NodeSet" in proof.to_pml() and "rule" in proof.to_json()
    assert e.explain(Atom(u("ancestor"), (u("albert"), u("david")))) is None


def test_numeric_builtins_and_two_heads(spark):
    e = Engine.from_n3(spark, PRE + """:a :prop1 1 . :a :prop2 5 . :b :prop1 1 ; :prop2 7 . :c :prop1 "x" ; :prop2 7 .
{ ?s :prop1 ?n . ?s :prop2 ?m . ?n math:lessThan ?m . ?m math:equalTo 7 } => { ?s a :Selected . ?s :small ?n } .""")
    assert rows(e.inferred()) == {(u("b"), T.TYPE, u("Selected")), (u("b"), u("small"), T.literal(1))}


def test_user_builtin_before_its_variables(spark):
    e = Engine(spark).register_builtin("<urn:begins>", lambda a, b: T.lexical(a).startswith(T.lexical(b)))
    e.load_n3(PRE + ':a :value "room" . :b :value :rest . :c :value "no" . { ?v <urn:begins> "ro" . ?s :value ?v } => { ?s a :Hit } . { ?v <urn:begins> "urn:x#re" . ?s :value ?v } => { ?s a :Hit } .')
    assert {r[0] for r in rows(e.inferred())} == {u("a"), u("b")}


def test_existential_heads(spark):
    e = Engine.from_n3(spark, PRE + ':d1 a :Detection ; :name "one" . :d2 a :Detection ; :name "two" . { ?d a :Detection . ?d :name ?n } => { _:w :of ?d . _:w :called ?n . _:w a :W } .')
    got = rows(e.inferred())
    assert len(got) == 6 and len({s for s, _, _ in got}) == 2
    assert rows(e.inferred()) == got
    loop = Engine.from_n3(spark, PRE + ":a a :P . { ?x a :P } => { ?x :next _:y . _:y a :P } .", max_existential_rounds=4)
    with pytest.raises(TooManyRounds, match="r1"):
        loop.closure()


def test_action(spark):
    e = Engine.from_n3(spark, PRE + ':c :mbox "mailto:a@b" . :d :mbox "mailto:x@y" . { ?p :mbox ?m } => { ?p :has ?m } .')
    e.register_action(Atom(u("has"), (Var("p"), Var("m"))), lambda b: {u("sha"): b.select("p", F.sha1(T.lexical(F.col("m"))))}, override=True)
    import hashlib

    got = rows(e.inferred())
    assert got == {(u(s), u("sha"), hashlib.sha1(m.encode()).hexdigest()) for s, m in (("c", "mailto:a@b"), ("d", "mailto:x@y"))}


def test_negation_strata_and_errors(spark):
    e = Engine(spark).relation("node", spark.createDataFrame([(i,) for i in range(5)], "a int")).relation("edge", spark.createDataFrame([(0, 1), (1, 2)], "a int, b int"))
    e.add_rules([Atom("start", (X,)) <= Atom("edge", (X, Y)), Atom("end", (X,)) <= Atom("node", (X,)) & ~Atom("start", (X,)), Atom("lone", (X,)) <= Atom("end", (X,)) & ~Atom("edge", (Y, X))])
    assert rows(e.relation_of(Atom("lone", (X,)))) == {(3,), (4,)}
    assert rows(e.query(Atom("lone", (X,)), "magic")) == {(3,), (4,)}
    with pytest.raises(NotStratified):
        Engine(spark).relation("n", spark.range(3)).add_rules([Atom("p", (X,)) <= Atom("n", (X,)) & ~Atom("q", (X,)), Atom("q", (X,)) <= Atom("n", (X,)) & ~Atom("p", (X,))]).close()
    bad = [Rule((Atom("p", (X,)),), (Atom("n", (X,)), Builtin("lt", (X, Y))), "bad")]
    with pytest.raises(UnsafeRule):
        check_safety(bad)
    assert check_safety(bad, "loose") == [] and check_safety(bad, "none") == bad
    with pytest.raises(TypeClash):
        Engine(spark).relation("a", spark.range(2)).relation("b", spark.createDataFrame([("x",)], "s string")).add_rules([Atom("c", (X,)) <= Atom("a", (X,)) & Atom("b", (X,))]).close()


def test_second_order_negation(spark):
    e = Engine.from_n3(spark, PRE + ":a :p :b . :b :q :c . :Z a :Class . { ?x ?p ?y } => { ?x :linked ?y } .")
    e.add_rules([Rule((Atom(u("Root"), (X,)),), (Atom(u("linked"), (X, Y)), Atom("triple", (Z, u("linked"), X), True)), "root")])
    assert {r[0] for r in rows(e.inferred()) if r[2] == u("Root")} == {u("a"), u("Z")}


def test_filters_constraints_firings_reset(spark):
    e = Engine(spark).relation("n", spark.range(6))
    e.add_rules([Rule((Atom("even", (X,)),), (Atom("n", (X,)), Builtin("lt", (X, 3))), "small"), Rule((Atom("seen", (X,)),), (Atom("even", (X,)),), "f", "filter"), Rule((), (Atom("even", (X,)), Builtin("eq", (X, 2))), "no2")])
    assert rows(e.filtered()["seen"]) == {(0,), (1,), (2,)}
    assert rows(e.violations()["no2"]) == {(2,)}
    assert rows(e.firings()) == {("small", 3)}
    e.add_facts("n", spark.createDataFrame([(-1,)], "n long"))
    assert (-1,) in rows(e.relation_of(Atom("even", (X,))))
    assert e.reset().relations == {} and e.rules


def python_closure(rules, facts):
    facts = set(facts)
    while True:
        new = set()
        for r in rules:
            found = [{}]
            for a in r.atoms():
                found = [b | m for b in found for f in facts if f[0] == a.pred and len(f) == len(a.args) + 1 and (m := match(a, f, b)) is not None]
            new |= {(h.pred, *(b.get(x, x) for x in h.args)) for b in found for h in r.head}
        if new <= facts:
            return facts
        facts |= new


def match(a, f, b):
    out = {}
    for x, v in zip(a.args, f[1:]):
        if isinstance(x, Var):
            if (b | out).get(x, v) != v:
                return None
            out[x] = v
        elif x != v:
            return None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_programs(spark, seed):
    r = random.Random(seed)
    vs = variables("A B C D")
    rules = [Rule((Atom("p", (X, Y)),), (Atom("e", (X, Y)),), "base")]
    for i in range(4):
        body = tuple(Atom(r.choice("epq"), (r.choice(vs), r.choice(vs))) for _ in range(r.randint(1, 3)))
        inside = sorted({v for a in body for v in a.args}, key=lambda v: v.name)
        rules.append(Rule((Atom(r.choice("pq"), (r.choice(inside), r.choice(inside))),), body, f"r{i}"))
    rules.append(Rule((Atom("q", (X, Y)),), (Atom("p", (Y, X)),), "back"))
    edges = {(r.randrange(6), r.randrange(6)) for _ in range(7)}
    want = python_closure(rules, {("e", *x) for x in edges})
    e = Engine(spark).relation("e", spark.createDataFrame(sorted(edges), "a int, b int")).add_rules(rules)
    for p in "pq":
        assert rows(e.relation_of(Atom(p, (X, Y)))) == {f[1:] for f in want if f[0] == p}
    bound = next(iter(sorted(edges)))[0]
    for method in ("magic", "supplementary"):
        assert rows(e.query(Atom("q", (bound, Y)), method)) == {(f[2],) for f in want if f[0] == "q" and f[1] == bound}


def test_rewrites():
    a, b, c = (Atom(p, (X,)) for p in "abc")
    assert {canonical(r) for r in lloyd_topor(Rule((c,), a & (b | Atom("d", (X,)))))} == {canonical(c <= a & b), canonical(c <= a & Atom("d", (X,)))}
    assert canonical(lloyd_topor(Rule((Implies(c, b),), a))[0]) == canonical(c <= a & b)
    assert negation_normal(~(a & (b | c))) == Or((~a, negation_normal(~b & ~c)))
    assert canonical(c <= a & b) == canonical(Atom("c", (Y,)) <= Atom("b", (Y,)) & Atom("a", (Y,)))
    p, e = (lambda *x: Atom("p", x)), (lambda *x: Atom("e", x))
    doubled = double_linear([p(X, Y) <= e(X, Y), p(X, Z) <= p(X, Y) & e(Y, Z)])
    assert [x.pred for x in doubled[1].atoms()] == ["p", "p"]
    own, target, seed = magic(normalise([p(X, Y) <= e(X, Y), p(X, Z) <= p(X, Y) & p(Y, Z)]), p(1, Y))
    assert seed == ("magic:p^bf", (1,)) and target.pred == "p^bf" and all(r.head for r in own)
    assert magic([], Atom("base", (1,)))[0] == []
    assert "Forall ?X" in repr(p(X, Y) <= e(X, Y))
    assert len(set(itertools.chain(*[r.atoms() for r in doubled]))) == 3


def test_view_and_clean_up(spark):
    e = Engine.from_n3(spark, FAMILY)
    v = EntailedView(e)
    assert (u("david"), u("ancestor"), u("albert")) in v and len(v) == e.closure().count()
    assert v.triples(p=u("begat")).count() == 7 and v.triples(s=[u("bill"), u("bevan")], p=u("begat")).count() == 4
    f = Engine.from_n3(spark, PRE + ":a a :C . :C a :Class . :p a :Prop . :a :p :b .")
    assert rows(f.cleaned().where(F.col("p") == T.TYPE)) == {(u("a"), T.TYPE, u("C"))}
