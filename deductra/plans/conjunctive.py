"""A conjunctive query as an object: goals, answer variables, known bindings, and its text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .. import terms as T
from ..functions.builtins import sparql_filter
from .ir import Atom, Builtin, Var, flatten, substitute


@dataclass(frozen=True)
class ConjunctiveQuery:
    """``goals`` with the variables to return (default: all, in order of appearance) and ``bindings`` of some variables."""

    goals: tuple
    returns: tuple[Var, ...] | None = None
    bindings: dict = field(default_factory=dict)

    @property
    def variables(self) -> tuple[Var, ...]:
        """All variables that aren't bound, in order of appearance."""
        return tuple(dict.fromkeys(a for g in self.grounded() for a in g.args if isinstance(a, Var)))

    def grounded(self) -> tuple:
        """The goals with the bindings put in."""
        return substitute(flatten(self.goals), self.bindings)

    def bound(self, **values) -> ConjunctiveQuery:
        """A copy with more bindings, by variable name."""
        return replace(self, bindings=self.bindings | {Var(k): v for k, v in values.items()})

    def extended(self, *goals, returns: tuple[Var, ...] | None = None) -> ConjunctiveQuery:
        """A copy with more goals."""
        return replace(self, goals=(*flatten(self.goals), *flatten(goals)), returns=returns or self.returns)

    def answers(self) -> tuple[Var, ...]:
        have = self.variables
        return have if self.returns is None else tuple(v for v in self.returns if v in have)

    def to_df(self, engine, method: str = "magic") -> DataFrame:
        """The answers, a column a variable."""
        names = [v.name for v in self.answers()]
        found = engine.query(self.grounded(), method)
        return found.select(*names).distinct() if names else found

    def ask(self, engine, method: str = "magic") -> bool:
        return engine.ask(self.grounded(), method)

    def sparql(self, prefixes: dict[str, str] | None = None) -> str:
        """SELECT or, without variables, ASK text; builtins become FILTERs."""
        prefixes = prefixes or {}

        def term(x) -> str:
            return repr(x) if isinstance(x, Var) else T.short(x, prefixes) if isinstance(x, str) else str(x)

        lines = []
        for g in self.grounded():
            if isinstance(g, Builtin):
                text = sparql_filter(g.op, *map(term, g.args))
                lines.append(f"FILTER({'!(' + text + ')' if g.negated else text})")
                continue
            s, p, o = g.args if g.pred == "triple" else (g.args[0], T.TYPE, g.pred) if len(g.args) == 1 else (g.args[0], g.pred, g.args[1])
            pattern = f"{term(s)} {'a' if p == T.TYPE else term(p)} {term(o)}"
            lines.append(f"FILTER NOT EXISTS {{ {pattern} }}" if g.negated else f"{pattern} .")
        head = "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in sorted(prefixes.items()))
        names = " ".join(map(repr, self.answers()))
        return f"{head}{'SELECT ' + names if names else 'ASK'} {{ {' '.join(lines)} }}"


def goal(*atoms: Atom | Builtin, returns: tuple[Var, ...] | None = None) -> ConjunctiveQuery:
    return ConjunctiveQuery(tuple(atoms), returns)
