"""Rules: atoms, builtins, connectives, and a small DSL.

    X, Y, Z = variables("X Y Z")
    parent, ancestor = predicates("parent ancestor")
    rules = [ancestor(X, Y) <= parent(X, Y), ancestor(X, Z) <= ancestor(X, Y) & parent(Y, Z)]
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Var:
    """A universally quantified variable; in a head only, an existential one."""

    name: str

    def __repr__(self):
        return f"?{self.name}"

    def _cmp(self, op, other):
        return Builtin(op, (self, other))

    def __lt__(self, other):
        return self._cmp("lt", other)

    def __gt__(self, other):
        return self._cmp("gt", other)

    def __le__(self, other):
        return self._cmp("le", other)

    def __ge__(self, other):
        return self._cmp("ge", other)

    def differs(self, other):
        return self._cmp("ne", other)

    def equals(self, other):
        return self._cmp("eq", other)


class _Formula:
    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Atom(_Formula):
    """``pred(args)``; arguments are variables or constants."""

    pred: str
    args: tuple
    negated: bool = False

    def variables(self) -> set[Var]:
        return {a for a in self.args if isinstance(a, Var)}

    def __invert__(self):
        return replace(self, negated=not self.negated)

    def __le__(self, body):
        return Rule((self,), as_body(body))

    def __repr__(self):
        text = f"{self.pred}({' '.join(map(str, self.args))})"
        return f"not {text}" if self.negated else text


@dataclass(frozen=True)
class Builtin(_Formula):
    """A comparison or user predicate over bound arguments; with three arguments, arithmetic whose last one is its value."""

    op: str
    args: tuple
    negated: bool = False

    def variables(self) -> set[Var]:
        return {a for a in self.args if isinstance(a, Var)}

    def inputs(self) -> set[Var]:
        """Variables that must be bound before it."""
        return {a for a in self.args[:2] if isinstance(a, Var)} if len(self.args) == 3 else self.variables()

    def __invert__(self):
        return replace(self, negated=not self.negated)

    def __repr__(self):
        text = f"External({self.op}({' '.join(map(str, self.args))}))"
        return f"not {text}" if self.negated else text


@dataclass(frozen=True)
class And(_Formula):
    parts: tuple

    def __repr__(self):
        return "And( " + " ".join(map(str, self.parts)) + " )"


@dataclass(frozen=True)
class Or(_Formula):
    parts: tuple

    def __repr__(self):
        return "Or( " + " ".join(map(str, self.parts)) + " )"


@dataclass(frozen=True)
class Not(_Formula):
    part: object

    def __repr__(self):
        return f"not {self.part}"


@dataclass(frozen=True)
class Implies(_Formula):
    """A nested implication in a head; Lloyd-Topor moves its body into the rule's."""

    head: object
    body: object


@dataclass(frozen=True)
class Rule:
    """``head :- body``. An empty head is a constraint, an empty body a fact."""

    head: tuple
    body: object
    name: str = ""
    kind: str = "rule"  # or "filter": its conclusions are kept apart

    def atoms(self) -> tuple:
        return self.body if isinstance(self.body, tuple) else flatten(self.body)

    def head_variables(self) -> set[Var]:
        return set().union(*[h.variables() for h in self.head]) if self.head else set()

    def body_variables(self) -> set[Var]:
        """Variables that the body binds: those of positive atoms, and values of arithmetic over them."""
        bound = set().union(*[a.variables() for a in self.atoms() if isinstance(a, Atom) and not a.negated])
        values = [a for a in self.atoms() if isinstance(a, Builtin) and len(a.args) == 3 and not a.negated]
        while ready := [a for a in values if a.inputs() <= bound]:
            bound = bound.union(*[a.variables() for a in ready])
            values = [a for a in values if a not in ready]
        return bound

    def existential(self) -> set[Var]:
        """Head variables that the body doesn't mention; those only under negation range over the domain."""
        return self.head_variables().difference(self.body_variables(), *[a.variables() for a in self.atoms() if isinstance(a, Atom)])

    def __repr__(self):
        names = sorted(v.name for v in self.head_variables() | set().union(*[a.variables() for a in self.atoms()]))
        exist = sorted(v.name for v in self.existential())
        head = str(self.head[0]) if len(self.head) == 1 else "And( " + " ".join(map(str, self.head)) + " )"
        if exist and self.atoms():
            head = "Exists " + " ".join("?" + e for e in exist) + f" ( {head} )"
        body = self.atoms()
        text = str(body[0]) if len(body) == 1 else "And( " + " ".join(map(str, body)) + " )"
        return "Forall " + " ".join("?" + n for n in names) + f" ( {head} :- {text} )"


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)


def as_body(body) -> object:
    if body is None or body == ():
        return ()
    return body


def flatten(body) -> tuple:
    """Conjuncts of a body that holds no disjunction."""
    if body is None or body == ():
        return ()
    if isinstance(body, tuple):
        return tuple(x for b in body for x in flatten(b))
    if isinstance(body, And):
        return tuple(x for b in body.parts for x in flatten(b))
    if isinstance(body, (Atom, Builtin)):
        return (body,)
    raise TypeError(f"not a conjunct: {body!r}; normalise the rule first")


def variables(names: str) -> list[Var]:
    return [Var(n) for n in names.split()]


class Pred:
    """``Pred("p")(X, Y)`` or ``Pred("p")[X, Y]`` is an atom."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, *args) -> Atom:
        return Atom(self.name, tuple(args))

    def __getitem__(self, args) -> Atom:
        return Atom(self.name, args if isinstance(args, tuple) else (args,))


def predicates(names: str) -> list[Pred]:
    return [Pred(n) for n in names.split()]


_count = itertools.count()


def fresh_var(hint: str = "g") -> Var:
    return Var(f"{hint}_{next(_count)}")


def substitute(x, mapping: dict):
    """Replace variables (and constants) by ``mapping`` in atoms, builtins, connectives and rules."""
    if isinstance(x, (Atom, Builtin)):
        return replace(x, args=tuple(mapping.get(a, a) for a in x.args))
    if isinstance(x, (And, Or)):
        return type(x)(tuple(substitute(p, mapping) for p in x.parts))
    if isinstance(x, Not):
        return Not(substitute(x.part, mapping))
    if isinstance(x, Implies):
        return Implies(substitute(x.head, mapping), substitute(x.body, mapping))
    if isinstance(x, tuple):
        return tuple(substitute(p, mapping) for p in x)
    if isinstance(x, Rule):
        return replace(x, head=substitute(x.head, mapping), body=substitute(x.body, mapping))
    return mapping.get(x, x)


def unify(a: Atom, b: Atom) -> dict | None:
    """Variables of ``a`` mapped to what stands there in ``b``; None where constants or repeated variables conflict."""
    if a.pred != b.pred or len(a.args) != len(b.args):
        return None
    out: dict = {}
    for x, y in zip(a.args, b.args):
        if isinstance(x, Var):
            if out.setdefault(x, y) != y:
                return None
        elif not isinstance(y, Var) and x != y:
            return None
    return out


def canonical(rule: Rule) -> tuple:
    """The same for rules that differ in variable names or the order of conjuncts only (for ordinary rule sizes)."""
    parts = list(rule.atoms())

    def shape(a, names):
        return (type(a).__name__, getattr(a, "pred", getattr(a, "op", "")), a.negated, tuple(names.get(x, "?") if isinstance(x, Var) else ("c", x) for x in a.args))

    parts.sort(key=lambda a: repr(shape(a, {})))
    best = None
    groups = [list(g) for _, g in itertools.groupby(parts, key=lambda a: repr(shape(a, {})))]
    orders = itertools.product(*[itertools.permutations(g) for g in groups])
    for order in itertools.islice(orders, 5040):
        names: dict = {}
        seq = [h for h in rule.head] + [a for g in order for a in g]
        for a in seq:
            for x in a.args:
                if isinstance(x, Var):
                    names.setdefault(x, f"v{len(names)}")
        form = repr([sorted(repr(shape(h, names)) for h in rule.head), sorted(repr(shape(a, names)) for g in order for a in g)])
        best = form if best is None or form < best else best
    return (best,)
