"""Pairs over few keys: as a rule and as a theta join, without a step over the pairs themselves."""

import random

import pytest

from deductra import queries
from deductra.engine import Engine
from deductra.operators import joins
from deductra.plans.ir import Atom, variables

X, Y, N, M = variables("x y n m")


def tops(df) -> list[str]:
    """Steps of a plan from its result down to the join that makes the pairs."""
    steps = [line.strip(" :+-").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return steps[: steps.index("Join")]


def odd_rows(seed: int):
    """Duplicates, nulls, one value under several keys, one common key."""
    r = random.Random(seed)
    def side():
        return [(r.choice([None, *range(12)]), r.choice([None, 1, 1, 1, *range(5)])) for _ in range(60)] + [(20 + i, 1) for i in range(30)]
    return side(), side()


def test_pairs_of_a_rule_are_not_shuffled(spark, sf_dir):
    assert "Aggregate" not in tops(queries.op_j1_equi_join(spark, sf_dir))


@pytest.mark.parametrize("block", [4, 1024])
def test_rule_of_pairs_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    a, b = odd_rows(1)
    def engine():
        return Engine(spark).relation("a", spark.createDataFrame(a, "x long, n int")).relation("b", spark.createDataFrame(b, "y long, n int"))
    met = {(x, y, n) for x, n in a for y, k in b if n is not None and n == k}
    rows = {
        Atom("p", (X, Y)) <= Atom("a", (X, N)) & Atom("b", (Y, N)): {(x, y) for x, y, n in met},
        Atom("p", (Y, N, X)) <= Atom("a", (X, N)) & Atom("b", (Y, N)): {(y, n, x) for x, y, n in met},
        Atom("p", (X, Y)) <= Atom("a", (X, N)) & Atom("b", (Y, N)) & (N > 1): {(x, y) for x, y, n in met if n > 1},
        Atom("p", (X, Y)) <= Atom("a", (X, N)) & Atom("b", (Y, N)) & X.differs(Y): {(x, y) for x, y, n in met if None not in (x, y) and x != y},
    }
    for rule, want in rows.items():
        got = [tuple(r) for r in engine().add_rules([rule]).query(rule.head[0], "naive").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rule = next(iter(rows))
    for x in (3, 21):  # a goal that drops what tells pairs apart, or has a constant
        got = [r[0] for r in engine().add_rules([rule]).query(Atom("p", (x, Y)), "naive").collect()]
        assert len(got) == len(set(got)) and set(got) == {y for k, y, n in met if k == x}
    got = [r[0] for r in engine().add_rules([rule]).query(Atom("p", (X, X)), "naive").collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x, y, n in met if x is not None and x == y}


def test_rule_of_pairs_beside_stored_facts_and_other_rules(spark):
    e = Engine(spark).relation("a", spark.createDataFrame([(1, 1), (2, 1)], "x long, n int")).relation("p", spark.createDataFrame([(1, 1), (9, 9), (9, 9)], "x long, y long"))
    e.add_rules([Atom("p", (X, Y)) <= Atom("a", (X, N)) & Atom("a", (Y, N)), Atom("p", (X, X)) <= Atom("a", (X, N))])
    assert sorted(tuple(r) for r in e.query(Atom("p", (X, Y)), "naive").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (9, 9)]


def test_theta_pairs_are_not_shuffled(spark, sf_dir):
    assert "Aggregate" not in tops(queries.op_j8_theta(spark, sf_dir))


@pytest.mark.parametrize("block", [4, 1024])
def test_distinct_theta_join_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    a, b = odd_rows(2)
    left, right = (spark.createDataFrame(rows, "k long, n int") for rows in (a, b))
    test = lambda l, r: l["k"] < r["k"]
    want = {(x, y) for x, n in a for y, k in b if n is not None and n == k and None not in (x, y) and x < y}
    for r in (right, right.selectExpr("k", "cast(n as double) as n")):  # keys of two types take the plain join
        got = [tuple(x) for x in joins.theta_join(left, r, test, ["n"], distinct=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want
