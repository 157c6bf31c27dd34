"""Stratified semi-naive evaluation.

The driver loops over strata and rounds; all data work of a round is one DataFrame per
predicate: the union of the rules' delta variants, minus what is known. Each round's new
facts are written to the shared folder and read back, which cuts the lineage and survives
lost executors. A recursive stratum over few facts runs in the driver (see ``local``), which
costs no job a round. Strata without recursion stay lazy, so Catalyst sees them whole, up to
plans of ``LEAVES`` scans: a predicate whose plan grows beyond is written, so that plans
don't grow with the number of ways to it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtins import Registry
from ..plans.analyze import check_safety, strata
from ..plans.compile import bindings, conclusions, pairs_of
from ..plans.ir import Atom, Rule, Var
from ..plans.rewrite import double_linear, normalise
from . import local
from .storage import cut, small_table

#: Jobs of a round that run at once.
CONCURRENT = 8
#: Rules and scans in the plan of a predicate that stays lazy.
LEAVES = 40
Action = Callable[[DataFrame], "dict[str, DataFrame] | None"]


class TooManyRounds(RuntimeError):
    """A fixpoint that doesn't settle, as existential recursion may not."""


class Relations(dict):
    """Relations by predicate; a value may be a function that makes the DataFrame when it is first asked for."""

    def __getitem__(self, pred: str) -> DataFrame:
        found = super().__getitem__(pred)
        if not isinstance(found, DataFrame):
            found = self[pred] = found()
        return found

    def get(self, pred: str, default=None):
        return self[pred] if pred in self else default

    def items(self):
        return [(p, self[p]) for p in self]

    def values(self):
        return [self[p] for p in self]


@dataclass
class Result:
    """Relations after evaluation."""

    total: dict[str, DataFrame] = field(default_factory=Relations)
    asserted: dict[str, DataFrame | None] = field(default_factory=dict)
    rounds: dict[str, list[tuple[int, DataFrame]]] = field(default_factory=dict)
    n_rounds: int = 0
    reached_goal: bool = False
    once: set[str] = field(default_factory=set)  # relations without duplicates by their plan, with no step that removes them

    def inferred(self, pred: str) -> DataFrame:
        """What evaluation added to a relation."""
        had = self.asserted.get(pred)
        return self.total[pred] if had is None else self.total[pred].subtract(had)

    def with_rounds(self, pred: str) -> DataFrame:
        """Facts with the round that found them; asserted ones have round 0."""
        parts = [(df if isinstance(df, DataFrame) else df()).withColumn("round", F.lit(r)) for r, df in self.rounds.get(pred, [])]
        return functools.reduce(DataFrame.unionByName, parts)


def _columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


class Fixpoint:
    """Evaluates ``rules`` over ``lookup(atom)``, which gives stored relations or None."""

    def __init__(
        self, spark: SparkSession, rules: list[Rule], lookup: Callable[[Atom], DataFrame | None], registry: Registry | None = None, safety: str = "strict",
        max_rounds: int = 10_000, max_existential_rounds: int = 50, doubling: bool = True, domain: Callable[[], DataFrame] | None = None, actions: dict[str, tuple[Action, bool]] | None = None,
    ):
        self.spark, self.lookup, self.registry, self.domain, self.actions = spark, lookup, registry or Registry(), domain, actions or {}
        rules = check_safety(normalise(rules), safety)
        self.constraints = [r for r in rules if not r.head]
        self.filters = [r for r in rules if r.kind == "filter" and r.head]
        rules = [r for r in rules if r.head and r.kind != "filter"]
        self.rules = double_linear(rules) if doubling else rules
        self.max_rounds, self.max_existential_rounds = max_rounds, max_existential_rounds
        self.result = Result()
        self.leaves: dict[str, int] = {}
        self.facts: dict[str, set[tuple]] = {}  # of small predicates, known in the driver
        self.types: dict[str, list[str]] = {}  # their columns' types

    def _relation(self, atom: Atom) -> DataFrame:
        if atom.pred in self.result.total:
            return self.result.total[atom.pred]
        df = self.lookup(atom)
        if df is None:
            raise KeyError(f"no relation or rule for {atom.pred}/{len(atom.args)}")
        return _columns(df)

    def _fire(self, rule: Rule, relation, delta: int | None = None) -> list[tuple[str, DataFrame]]:
        action, override = self.actions.get(rule.name.split(".")[0], (None, False))
        keep = None if action or rule.existential() else rule.head_variables()
        found = bindings(rule, relation, self.registry, delta, self.domain, keep)
        out = [] if override else conclusions(rule, found)
        if action:
            out += [(p, _columns(df)) for p, df in (action(found.toDF(*[c.removeprefix("v_") for c in found.columns])) or {}).items()]
        return out

    def _seed(self, comp: set[str], rules: list[Rule]) -> None:
        for p in comp:
            atom = next(h for r in rules for h in r.head if h.pred == p)
            df = self.lookup(atom)
            self.result.asserted[p] = None if df is None else _columns(df).distinct()

    def run(self, goal: Atom | None = None) -> Result:
        """All strata, or up to the round that finds the ground ``goal``."""
        for comp, rules in strata(self.rules):
            self._seed(comp, rules)
            recursive = any(isinstance(a, Atom) and a.pred in comp for r in rules for a in r.atoms()) or any(r.name.split(".")[0] in self.actions for r in rules)
            small = all(a.pred in self.facts for r in rules for a in r.atoms() if isinstance(a, Atom))
            if (recursive or small) and self._local(comp, rules, goal):
                self.result.n_rounds -= not recursive and 2
            elif recursive:
                self._loop(comp, rules, goal)
            else:
                self._once(comp, rules)
            if self.result.reached_goal:
                break
        return self.result

    def _once(self, comp: set[str], rules: list[Rule]) -> None:
        found: dict[str, list[DataFrame]] = {p: [] for p in comp}
        leaves = sum(1 + sum(self.leaves.get(a.pred, 1) for a in r.atoms() if isinstance(a, Atom)) for r in rules)
        if leaves > LEAVES and self._local(comp, rules, None):
            self.result.n_rounds -= 2
            return
        paired: set[str] = set()
        for r in rules:
            met = None if r.name.split(".")[0] in self.actions else pairs_of(r, lambda a, d: self._relation(a), self.registry)
            if met is not None:
                paired.add(r.head[0].pred)
                leaves += sum(self.leaves.get(a.pred, 1) for a in r.atoms() if isinstance(a, Atom))  # each side is read twice
            for p, df in self._fire(r, lambda a, d: self._relation(a)) if met is None else conclusions(r, met):
                found.setdefault(p, []).append(df)
        for p, parts in found.items():
            had = self.result.asserted.get(p)
            once = p in paired and len(parts) == 1
            if once and had is None and leaves <= LEAVES:
                self.result.once.add(p)
            new = parts[0] if once else _union(parts).distinct()
            if leaves > LEAVES:
                new = cut(new)
            self.leaves[p] = 2 if leaves > LEAVES else leaves
            self.result.total[p] = new if had is None else had.union(new).distinct()
            self.result.rounds[p] = ([] if had is None else [(0, had)]) + [(1, new if had is None else new.subtract(had))]

    def _local(self, comp: set[str], rules: list[Rule], goal) -> bool:
        """Evaluate a recursive stratum in the driver if its facts are few; False: nothing was done."""
        if any(r.name.split(".")[0] in self.actions for r in rules) or len({h.pred for r in rules for h in r.head} - comp):
            return False
        def stored(atom: Atom) -> set[tuple] | None:
            if atom.pred not in self.facts:
                df = self.result.asserted[atom.pred] if atom.pred in comp else self._relation(atom)
                if df is None:
                    return None
                self.facts[atom.pred] = local.fetch(df)
                self.types[atom.pred] = [t for _, t in df.dtypes]
            return self.facts[atom.pred]

        try:
            rounds, n, reached = local.evaluate(comp, rules, stored, self.max_rounds, goal)
            self.types |= local.types(comp, rules, self.types)
            for p, parts in rounds.items():
                self.facts[p] = set().union(*[facts for _, facts in parts])
                local.uniform(self.facts[p])
        except local.NotLocal:
            for p in comp:
                self.facts.pop(p, None), self.types.pop(p, None)
            return False
        for p, parts in rounds.items():
            self.result.rounds[p] = [(k, self._table(facts, self.types[p])) for k, facts in parts]
            self.result.total[p] = self._table(self.facts[p], self.types[p])
            self.leaves[p] = 1
        self.result.n_rounds += n
        self.result.reached_goal = reached
        return True

    def _table(self, facts: set[tuple], types: list[str]) -> Callable[[], DataFrame]:
        return lambda: small_table(self.spark, facts, {f"c{i}": t for i, t in enumerate(types)})

    def extend(self, before: dict[str, DataFrame], delta: dict[str, DataFrame]) -> Result:
        """The closure after an addition, from the one before it: only what ``delta`` sets off is evaluated.

        For positive rules without existential heads. ``lookup`` gives the relations with the addition.
        """
        atoms = {a.pred: a for r in self.rules for a in (*r.head, *r.atoms()) if isinstance(a, Atom)}
        heads = {h.pred for r in self.rules for h in r.head}
        known: dict[str, list[DataFrame]] = {}
        for p, a in atoms.items():
            stored = self.lookup(a)
            if p in heads:
                self.result.asserted[p] = None if stored is None else _columns(stored).distinct()
            parts = [df for df in (before.get(p) if p in heads else None, delta.get(p) if p in heads else stored) if df is not None]
            known[p] = [_columns(_union([_columns(df) for df in parts])).distinct()] if parts else []
        self._loop(set(atoms), self.rules, None, known, {p: _columns(df) for p, df in delta.items() if p in atoms})
        self.result.total = Relations({p: df for p, df in self.result.total.items() if p in heads})
        return self.result

    def _loop(self, comp: set[str], rules: list[Rule], goal, known: dict[str, list[DataFrame]] | None = None, delta: dict[str, DataFrame] | None = None) -> None:
        existential = [r for r in rules if r.existential()]
        limit = min(self.max_rounds, self.max_existential_rounds) if existential else self.max_rounds
        n = 0 if delta is None else 1
        if known is None:
            known = {p: [] if self.result.asserted[p] is None else [self.result.asserted[p]] for p in comp}
        self.result.rounds |= {p: [(0, df) for df in dfs] for p, dfs in known.items()}
        delta = delta or {}

        def total(p):
            return _union(known[p]) if known[p] else None

        while True:
            found: dict[str, list[DataFrame]] = {}
            for r in rules:
                inner = [i for i, a in enumerate(r.atoms()) if isinstance(a, Atom) and not a.negated and a.pred in comp]
                if n == 0:
                    if all(known[r.atoms()[i].pred] for i in inner):
                        for p, df in self._fire(r, lambda a, d: total(a.pred) if a.pred in comp else self._relation(a)):
                            found.setdefault(p, []).append(df)
                    continue
                for i in inner:
                    if r.atoms()[i].pred in delta and all(known[r.atoms()[j].pred] for j in inner):
                        for p, df in self._fire(r, lambda a, d: delta[a.pred] if d else total(a.pred) if a.pred in comp else self._relation(a), i):
                            found.setdefault(p, []).append(df)
            n += 1
            for p in found:
                known.setdefault(p, [])

            def settle(p: str, parts: list[DataFrame]) -> tuple[str, DataFrame, bool]:
                new = _union(parts)
                new = cut(new.subtract(total(p)) if known[p] else new.distinct())
                return p, new, new.isEmpty()

            with ThreadPoolExecutor(CONCURRENT) as pool:  # a round's predicates don't depend on each other
                settled = [f.result() for f in [pool.submit(settle, p, parts) for p, parts in found.items()]]
            fresh = {p: df for p, df, empty in settled if not empty}
            for p, df in fresh.items():
                known[p].append(df)
                self.result.rounds.setdefault(p, []).append((n, df))
            self.result.n_rounds += 1
            delta = fresh
            if goal is not None and goal.pred in fresh and all(not isinstance(a, Var) for a in goal.args):
                test = functools.reduce(lambda x, y: x & y, [F.col(f"c{i}") == F.lit(a) for i, a in enumerate(goal.args)])
                if not fresh[goal.pred].where(test).isEmpty():
                    self.result.reached_goal = True
                    break
            if not fresh:
                break
            if n >= limit:
                names = ", ".join(r.name for r in existential) or ", ".join(sorted(comp))
                raise TooManyRounds(f"no fixpoint after {n} rounds; in the cycle: {names}")
        for p in known:
            df = total(p)
            if df is None:
                df = self._empty(next(a for r in rules for a in (*r.head, *r.atoms()) if isinstance(a, Atom) and a.pred == p), rules)
            self.result.total[p] = df

    def _empty(self, head: Atom, rules: list[Rule]) -> DataFrame:
        """No facts, but the columns' types where a rule without recursion tells them."""
        return self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(head.args))))

    def violations(self) -> dict[str, DataFrame]:
        """Bindings that break each constraint (a rule without a head)."""
        return {r.name: _plain(bindings(r, lambda a, d: self._relation(a), self.registry, None, self.domain)) for r in self.constraints}

    def filtered(self) -> dict[str, DataFrame]:
        """Conclusions of filter rules over the closure; they are not fed back."""
        out: dict[str, list[DataFrame]] = {}
        for r in self.filters:
            for p, df in self._fire(r, lambda a, d: self._relation(a)):
                out.setdefault(p, []).append(df)
        return {p: _union(parts).distinct() for p, parts in out.items()}

    def firings(self) -> DataFrame:
        """rule, n: instantiations of each rule over the closure, most first."""
        parts = []
        for r in self.rules:
            found = bindings(r, lambda a, d: self._relation(a), self.registry, None, self.domain)
            parts.append(found.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(r.name).alias("rule"), "n"))
        return _union(parts).orderBy(F.desc("n"), "rule")


def _plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.removeprefix("v_") for c in df.columns])
