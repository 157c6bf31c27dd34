"""One rule body to one DataFrame.

Atoms become scans that select variable-named columns, joined on shared names in an order
that keeps them connected; a conjunct that adds nothing needed later is a semi-join, a
negated one an anti-join, and builtins are filters that Catalyst moves where it wants.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import Registry
from ..operators.joins import pairs
from .ir import Atom, Builtin, Rule, Var
from .rewrite import sip_order

Relation = Callable[[Atom, bool], DataFrame]


class CartesianProduct(UserWarning):
    """A rule or query body whose parts aren't connected."""


class TypeClash(TypeError):
    """Columns of different types joined on one variable."""


def col(v: Var) -> str:
    return f"v_{v.name}"


def value(x) -> Column:
    return F.col(col(x)) if isinstance(x, Var) else F.lit(x)


def scan(df: DataFrame, atom: Atom, keep: set[Var] | None = None) -> DataFrame:
    """Filter constants and repeated variables, rename columns to variables, drop those not in ``keep``."""
    names = df.columns
    if len(names) != len(atom.args):
        raise ValueError(f"{atom.pred} has {len(names)} columns, used with {len(atom.args)}")
    first: dict[Var, str] = {}
    for name, a in zip(names, atom.args):
        if not isinstance(a, Var):
            df = df.where(F.col(name) == F.lit(a))
        elif a in first:
            df = df.where(F.col(first[a]) == F.col(name))
        else:
            first[a] = name
    out = [F.col(n).alias(col(v)) for v, n in first.items() if keep is None or v in keep]
    return df.select(*out) if out else df.select(F.lit(True).alias("v_")).limit(1)


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On the shared columns; none: a Cartesian product, or existence for semi- and anti-joins."""
    shared = [c for c in left.columns if c in right.columns and c != "v_"]
    kinds = dict(right.dtypes)
    for c, t in left.dtypes:
        if c in shared and t != kinds[c] and ("string" in (t, kinds[c])):
            raise TypeClash(f"{c[2:]}: {t} joined with {kinds[c]}")
    right = right.drop("v_") if "v_" in left.columns and len(right.columns) > 1 else right
    if shared:
        return left.join(right, shared, how)
    if how == "inner":
        warnings.warn("conjuncts that share no variable: their product is built", CartesianProduct, stacklevel=2)
        return left.crossJoin(right.drop("v_") if len(right.columns) > 1 else right.withColumnRenamed("v_", f"v_{len(left.columns)}_"))
    return left.join(right.limit(1), F.lit(True), how)


def bindings(rule: Rule, relation: Relation, registry: Registry, delta: int | None = None, domain: Callable[[], DataFrame] | None = None, keep: set[Var] | None = None) -> DataFrame:
    """All bindings of a rule's body. ``relation(atom, is_delta)`` gives an atom's relation; ``delta`` is the conjunct that reads new facts."""
    body = list(rule.atoms())
    start: tuple = ()
    if delta is not None:
        start = (body.pop(delta),)
    order = [*start, *sip_order(tuple(body), set().union(*[a.variables() for a in start]))]
    # builtins wait for their variables, negated atoms for the end
    wanted = set(keep) if keep is not None else set().union(*[a.variables() for a in order])
    now: DataFrame | None = None
    waiting = [a for a in order if isinstance(a, Builtin)]
    negated = [a for a in order if isinstance(a, Atom) and a.negated]
    positive = [a for a in order if isinstance(a, Atom) and not a.negated]

    def ready(df: DataFrame) -> DataFrame:
        for b in list(waiting):
            if b not in waiting:
                continue
            if len(b.args) == 3 and all(col(v) in df.columns for v in b.inputs()):
                waiting.remove(b)
                made = registry.produce(b.op, value(b.args[0]), value(b.args[1]))
                out = b.args[2]
                if isinstance(out, Var) and col(out) not in df.columns:
                    df = ready(df.withColumn(col(out), made).where(F.col(col(out)).isNotNull()))
                else:
                    df = df.where(~F.coalesce(made == value(out), F.lit(False)) if b.negated else made == value(out))
            elif len(b.args) == 2 and all(col(v) in df.columns for v in b.variables()):
                waiting.remove(b)
                test = registry.apply(b.op, value(b.args[0]), value(b.args[1]))
                df = df.where(~F.coalesce(test, F.lit(False)) if b.negated else test)
        return df

    for i, a in enumerate(positive):
        later = wanted.union(*[x.variables() for x in positive[i + 1 :]], *[x.variables() for x in waiting], *[x.variables() for x in negated])
        have = {v for v in a.variables() if now is not None and col(v) in now.columns}
        side = scan(relation(a, delta is not None and i == 0), a, later | have)
        if now is None:
            now = side
        elif not ({c for c in side.columns} - set(now.columns) - {"v_"}) and a.variables():
            now = join(now, side, "left_semi")
        else:
            now = join(now, side)
        now = ready(now)
        drop = [c for c in now.columns if c != "v_" and c not in {col(v) for v in later}]
        if drop and len(drop) < len(now.columns):
            now = now.drop(*drop)
    if now is None and not negated and not waiting:
        return _one(relation, domain)
    for n in negated:
        if now is None or not any(col(v) in now.columns for v in n.variables()) and n.variables() & wanted:
            if domain is None:
                raise ValueError(f"{rule!r}: only negated conjuncts, and no domain")
            names = sorted(n.variables() & wanted, key=lambda v: v.name)
            base = domain()
            for v in names:
                d = base.select(F.col(base.columns[0]).alias(col(v)))
                now = d if now is None else now.crossJoin(d)
            now = ready(now)
        now = join(now, scan(relation(n, False), n, {v for v in n.variables() if col(v) in now.columns}), "left_anti")
    if waiting:
        if now is None:
            now = _one(relation, domain)
        now = ready(now)
    if waiting:
        raise ValueError(f"{rule!r}: nothing binds the variables of {waiting}")
    return now


def pairs_of(rule: Rule, relation: Relation, registry: Registry) -> DataFrame | None:
    """The bindings of the head's variables, each once, where a rule joins two conjuncts to pairs of what each has alone; None for other rules."""
    body = list(rule.atoms())
    atoms, tests = [a for a in body if isinstance(a, Atom)], [a for a in body if isinstance(a, Builtin)]
    if len(atoms) != 2 or len(rule.head) != 1 or rule.existential() or any(a.negated for a in atoms) or any(len(b.args) != 2 for b in tests):
        return None
    wanted, own = rule.head_variables(), [set(a.variables()) for a in atoms]
    shared = own[0] & own[1]
    if not shared or not wanted & own[0] - shared or not wanted & own[1] - shared or not all(any(set(b.variables()) <= s for s in (*own, wanted)) for b in tests):
        return None

    def holds(b: Builtin) -> Column:
        test = registry.apply(b.op, value(b.args[0]), value(b.args[1]))
        return ~F.coalesce(test, F.lit(False)) if b.negated else test

    sides = []
    for a, mine in zip(atoms, own):
        side = scan(relation(a, False), a)
        for b in tests:
            if set(b.variables()) <= mine:
                side = side.where(holds(b))
        sides.append(side.select(*[c for c in side.columns if any(c == col(v) for v in wanted | shared)]))
    left, right = sides
    if any(dict(left.dtypes)[col(v)] != dict(right.dtypes)[col(v)] for v in shared):
        return None
    on = [c for c in left.columns if c in right.columns]
    out = pairs(left, right, on, [c for c in on if any(c == col(v) for v in wanted)])
    for b in tests:
        if not any(set(b.variables()) <= mine for mine in own):
            out = out.where(holds(b))
    return out


def _one(relation, domain) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(F.lit(True).alias("v_"))


def skolem(rule: Rule, variable: Var) -> Column:
    """A blank node that the rule, the variable and all body bindings determine."""
    parts = [F.coalesce(F.col(col(v)).cast("string"), F.lit("\u0000")) for v in sorted(rule.body_variables(), key=lambda v: v.name)]
    return F.concat(F.lit("_:sk"), F.sha2(F.concat_ws("\u0001", F.lit(rule.name), F.lit(variable.name), *parts), 256))


def conclusions(rule: Rule, found: DataFrame) -> list[tuple[str, DataFrame]]:
    """Facts of each head atom, columns c0, c1, ..."""
    new = rule.existential()
    out = []
    for h in rule.head:
        cols = [(skolem(rule, a) if a in new else value(a)).alias(f"c{i}") for i, a in enumerate(h.args)]
        out.append((h.pred, found.select(*cols)))
    return out
