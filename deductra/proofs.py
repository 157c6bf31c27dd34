"""Proof trees: why a fact holds, found rule by rule in the rounds before it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .plans.compile import bindings, col
from .plans.ir import Atom, Rule, Var, substitute, unify


@dataclass
class Node:
    """A conclusion with the step that justifies it; no step: asserted."""

    fact: Atom
    rule: str | None = None
    bindings: dict = field(default_factory=dict)
    antecedents: list[Node] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"conclusion": repr(self.fact), "rule": self.rule, "bindings": {k: str(v) for k, v in self.bindings.items()}, "antecedents": [a.to_dict() for a in self.antecedents]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=1)

    def to_dot(self) -> str:
        lines, count = ["digraph proof {"], 0

        def walk(n):
            nonlocal count
            me, count = count, count + 1
            label = repr(n.fact).replace('"', "'") + (f"\\n{n.rule}" if n.rule else "")
            lines.append(f'  n{me} [label="{label}"];')
            for a in n.antecedents:
                lines.append(f"  n{me} -> n{walk(a)};")
            return me

        walk(self)
        return "\n".join([*lines, "}"])

    def to_pml(self) -> str:
        """Turtle in a proof vocabulary of node sets and inference steps."""
        out, count = ["@prefix p: <urn:proof#> .\n"], 0

        def walk(n):
            nonlocal count
            me, count = f"_:n{count}", count + 1
            out.append(f"{me} a p:NodeSet ; p:conclusion {json.dumps(repr(n.fact))} .\n")
            if n.rule:
                out.append(f"{me} p:isConsequentOf [ a p:InferenceStep ; p:rule {json.dumps(n.rule)} ] .\n")
            for a in n.antecedents:
                out.append(f"{me} p:antecedent {walk(a)} .\n")
            return me

        walk(self)
        return "".join(out)


def prove(engine, fact: Atom, depth: int = 50) -> Node | None:
    """One proof. Each antecedent holds since an earlier round, so proofs have no cycles."""
    from .sources.n3 import triple_of

    fix = engine.close()
    result = fix.result
    if "triple" in result.total:
        fact = triple_of(fact)

    def round_of(a: Atom) -> int | None:
        if a.pred not in result.rounds:
            df = engine._lookup(a)
            if df is None:
                return None
            df = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("round", F.lit(0))
        else:
            df = result.with_rounds(a.pred)
        for i, v in enumerate(a.args):
            df = df.where(F.col(f"c{i}") == F.lit(v))
        return df.agg(F.min("round")).first()[0]

    def before(a: Atom, limit: int):
        if a.pred not in result.rounds:
            return fix._relation(a)
        return result.with_rounds(a.pred).where(F.col("round") < limit).drop("round")

    def step(a: Atom, left: int) -> Node | None:
        r = round_of(a)
        if r is None:
            return None
        if r == 0:
            return Node(a)
        if left == 0:
            raise RecursionError("the proof is deeper than asked for")
        for rule in fix.rules:
            for h in rule.head:
                match = unify(h, a)
                if match is None:
                    continue
                known = {v: x for v, x in match.items() if v not in rule.existential()}
                ground = Rule(rule.head, substitute(rule.atoms(), known), rule.name)
                inner = {x.pred for x in rule.head}
                recursive = any(isinstance(b, Atom) and b.pred in result.rounds and len(result.rounds[b.pred]) and b.pred in inner for b in rule.atoms())
                limit = r if recursive or r > 1 else 10**9
                found = bindings(ground, lambda b, d, limit=limit: before(b, limit) if b.pred in inner else fix._relation(b), fix.registry, None, fix.domain).limit(1).collect()
                if not found:
                    continue
                row = found[0].asDict()
                mapping = known | {v: row[col(v)] for v in ground.body_variables() if col(v) in row}
                below = [step(substitute(b, mapping), left - 1) if not b.negated else Node(substitute(b, mapping)) for b in rule.atoms() if isinstance(b, Atom)]
                if all(b is not None for b in below):
                    return Node(a, rule.name, {v.name: x for v, x in mapping.items() if isinstance(v, Var)}, below)
        return None

    return step(fact, depth)
