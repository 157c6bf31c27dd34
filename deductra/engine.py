"""The engine: relations, rules, goals, SPARQL and proofs over one session."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .functions.builtins import Registry
from .operators import local
from .operators.fixpoint import Action, Fixpoint, Result
from .operators.storage import cut
from .plans.analyze import NotStratified, strata
from .plans.compile import bindings
from .plans.ddl import Catalog, classify
from .plans.ir import And, Atom, Builtin, Rule, Var, canonical, flatten
from .plans.rewrite import magic, normalise
from .sources import n3
from .sources.rdf import facts_df


class Engine:
    """Named relations (typed tables) and triples, with rules over both.

    Relations keep the column types of their DataFrames. A predicate that is stored and
    derived is *hybrid*: its stored facts are part of its extent. ``policy`` says otherwise:
    ``harsh`` refuses such predicates, ``base`` leaves out their rules, ``derived`` their facts.
    """

    def __init__(self, spark: SparkSession, safety: str = "strict", max_rounds: int = 10_000, max_existential_rounds: int = 50, policy: str = "loose"):
        self.policy = policy
        self.spark, self.safety, self.max_rounds, self.max_existential_rounds = spark, safety, max_rounds, max_existential_rounds
        self.registry = Registry()
        self.relations: dict[str, DataFrame] = {}
        self._lazy: dict[str, Callable[[], DataFrame]] = {}
        self.triples: DataFrame | None = None
        self.rules: list[Rule] = []
        self.prefixes: dict[str, str] = {}
        self.actions: dict[str, tuple[Action, bool]] = {}
        self._domain: DataFrame | None = None
        self._closed: Fixpoint | None = None
        self._tables: dict[tuple, DataFrame] = {}

    # input

    @classmethod
    def from_n3(cls, spark: SparkSession, text: str, **options) -> Engine:
        """Rules and facts of one document."""
        engine = cls(spark, **options)
        engine.load_n3(text)
        return engine

    def relation(self, name: str, df: DataFrame, distinct: bool = False) -> Engine:
        """Bind a predicate to a DataFrame; its columns are the arguments, in order."""
        self.relations[name] = df.distinct() if distinct else df
        return self._changed()

    def lazy(self, name: str, make: Callable[[], DataFrame]) -> Engine:
        """Like ``relation``, but ``make`` runs only when a rule or goal reads the predicate."""
        self._lazy[name] = make
        return self._changed()

    def domain(self, df: DataFrame | Callable[[], DataFrame]) -> Engine:
        """One column: what variables range over that only negated conjuncts mention."""
        self._domain = df
        return self._changed()

    def add_triples(self, triples: DataFrame | Iterable) -> Engine:
        """More facts. After ``closure`` of a positive program the next one continues from what is known."""
        df = triples if isinstance(triples, DataFrame) else facts_df(self.spark, triples)
        df = df.toDF("s", "p", "o")
        self.triples = df.distinct() if self.triples is None else self.triples.union(df).distinct()
        return self._changed()

    def add_rules(self, rules: str | Iterable[Rule]) -> Engine:
        """Rules as objects or N3 text; the next closure uses all of them over all facts."""
        if isinstance(rules, str):
            self.load_n3(rules)
        else:
            self._add(list(rules))
        return self._changed()

    def _add(self, rules: list[Rule]) -> None:
        """Append rules that aren't there yet up to variable names and the order of conjuncts."""
        def key(r: Rule):
            try:
                return canonical(r), r.kind
            except (TypeError, AttributeError):  # connectives: compared as they stand
                return replace(r, name="")

        known = {key(r) for r in self.rules}
        for r in rules:
            if key(r) not in known:
                known.add(key(r))
                self.rules.append(r)

    def load_n3(self, text: str) -> n3.Document:
        doc = n3.parse(text, self.registry)
        known = len(self.rules)
        self._add([replace(r, name=f"r{known + i + 1}") for i, r in enumerate(doc.rules)])
        self.prefixes |= doc.prefixes
        if doc.facts:
            self.add_triples(doc.facts)
        self._changed()
        return doc

    def register_builtin(self, name: str, fn: Callable[[Column, Column], Column]) -> Engine:
        """A user predicate over two bound arguments; register it before reading rules that use it."""
        self.registry.register(name, fn)
        return self

    def register_action(self, head: Atom, action: Action, override: bool = False) -> Engine:
        """Run ``action(bindings)`` on the new bindings of each rule with that head; it may return facts by predicate.

        With ``override`` the rule's own conclusions are left out.
        """
        want = canonical(Rule((head,), ()))
        for i, r in enumerate(self.rules):
            if not r.name:
                self.rules[i] = r = replace(r, name=f"r{i + 1}")
            if any(canonical(Rule((h,), ())) == want for h in r.head):
                self.actions[r.name] = (action, override)
        return self._changed()

    def reset(self, keep_facts: bool = False) -> Engine:
        """Forget derived facts, and stored ones unless kept; rules stay."""
        self._changed()
        if not keep_facts:
            self.triples = None
            self.relations.clear()
            self._lazy.clear()
        return self

    def _changed(self) -> Engine:
        """Forget the closure and the kept answers, which no longer hold."""
        self._closed = None
        for df in self._tables.values():
            df.unpersist()
        self._tables.clear()
        return self

    # evaluation

    def catalog(self, rules: list[Rule] | None = None) -> Catalog:
        """Stored, derived and hybrid predicates of the rules, under the engine's policy. Raises Clash if that is harsh."""
        rules = normalise(self.rules if rules is None else rules)
        atoms = {a.pred: a for r in rules for a in (*r.head, *r.atoms()) if isinstance(a, Atom)}
        stored = {p for p, a in atoms.items() if p != "triple" and (df := self._lookup(a)) is not None and (p in self.relations or not df.isEmpty())}
        return classify(rules, stored, self.policy)

    def _under_policy(self, rules: list[Rule]) -> tuple[list[Rule], set[str]]:
        """The rules to evaluate and the predicates whose stored facts don't count."""
        if self.policy == "loose":
            return rules, set()
        found = self.catalog(rules)
        clash = {h.pred for r in rules for h in r.head} & (found.base if self.policy == "base" else {a.pred for r in rules for a in r.head if self._lookup(a) is not None})
        if self.policy == "base":
            return [r for r in rules if not any(h.pred in clash for h in r.head)], set()
        return rules, clash

    @staticmethod
    def _second_order(rules: list[Rule]) -> bool:
        return any(isinstance(a, Atom) and a.pred == "triple" for r in rules for a in (*r.head, *r.atoms()))

    def _lookup(self, atom: Atom) -> DataFrame | None:
        if atom.pred in self._lazy:
            self.relations[atom.pred] = self._lazy.pop(atom.pred)()
        if atom.pred in self.relations:
            return self.relations[atom.pred]
        if self.triples is None:
            return None
        if atom.pred == "triple":
            return self.triples
        if not atom.pred.startswith(("<", "_:")):
            return None
        if len(atom.args) == 1:
            return self.triples.where((F.col("p") == T.TYPE) & (F.col("o") == atom.pred)).select("s")
        return self.triples.where(F.col("p") == atom.pred).select("s", "o")

    def subjects(self) -> DataFrame:
        """All subjects: the domain of purely negative bodies."""
        if self._domain is not None:
            return self._domain if isinstance(self._domain, DataFrame) else self._domain()
        if self.triples is None:
            raise ValueError("a rule with only negated conjuncts needs a domain")
        return self.triples.select("s").distinct()

    def _evaluate(self, rules: list[Rule], goal: Atom | None = None, seed: tuple[str, tuple] | None = None, resume: tuple[dict, dict] | None = None) -> tuple[Fixpoint, Result]:
        rules, hidden = self._under_policy(normalise(rules))
        second = self._second_order(rules)
        plain = rules
        if second:
            rules = [replace(r, head=tuple(n3.triple_of(h) for h in r.head), body=tuple(n3.triple_of(a) if isinstance(a, Atom) else a for a in r.atoms())) for r in rules]

        def lookup(atom: Atom) -> DataFrame | None:
            if seed and atom.pred == seed[0]:
                return self.spark.range(1).select(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(seed[1])])
            df = None if atom.pred in hidden else self._lookup(atom)
            if df is None and (atom.pred.startswith(("<", "_:")) or atom.pred == "triple"):
                if not any(h.pred == atom.pred for r in rules for h in r.head):
                    return self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(atom.args))))
            return df

        options = {"registry": self.registry, "safety": self.safety, "max_rounds": self.max_rounds, "max_existential_rounds": self.max_existential_rounds, "domain": self.subjects, "actions": self.actions}
        if not second or not any(isinstance(a, Atom) and a.negated for r in rules for a in r.atoms()):
            fix = Fixpoint(self.spark, rules, lookup, **options)
            return fix, fix.extend(*resume) if resume else fix.run(goal)
        return self._layers(plain, rules, goal, options)

    def _layers(self, plain: list[Rule], rules: list[Rule], goal: Atom | None, options: dict) -> tuple[Fixpoint, Result]:
        """Negation beside rules over all triples.

        Rules that name their predicates are layered by them (``plain``: before they were put
        in triple form, ``rules``); rules over any predicate belong to every layer. A
        layer's closure reads negated conjuncts from the layer before. At the end each of these
        rules must still hold for all it was used for; else the program isn't stratified.
        """
        def named(a):
            """The atom by its predicate where that is constant."""
            if not isinstance(a, Atom) or a.pred != "triple":
                return a
            return replace(n3.atom_of(*a.args), negated=a.negated)

        def negated(r: Rule) -> list[Atom]:
            return [a for a in r.atoms() if isinstance(a, Atom) and a.negated]

        plain = [replace(r, head=tuple(map(named, r.head)), body=tuple(map(named, r.atoms()))) for r in plain]
        closed = [replace(r, body=tuple(a for a in r.atoms() if getattr(a, "pred", "") != "triple")) for r in plain]
        layer: dict[str, int] = {}
        for comp, own in strata([r for r in closed if r.head and r.kind != "filter"]):
            level = max([layer.get(a.pred, 0) + a.negated for r in own for a in r.atoms() if isinstance(a, Atom) and a.pred not in comp], default=0)
            layer |= dict.fromkeys(comp, level)
        last = 1 + max(layer.values(), default=0)

        def level_of(r: Rule) -> int:
            if not r.head or r.kind == "filter" or any(a.pred == "triple" for a in negated(r)):
                return last
            return layer[r.head[0].pred]

        levels = [level_of(r) for r in plain]
        frozen = lambda r: replace(r, body=tuple(replace(a, pred="before") if isinstance(a, Atom) and a.negated else a for a in r.atoms()))
        empty = self.spark.createDataFrame([], "c0 string, c1 string, c2 string")
        asserted = empty if self.triples is None else self.triples.toDF("c0", "c1", "c2")
        total, read = asserted, []
        copy = Rule((Atom("triple", tuple(Var(x) for x in "spo")),), (Atom("triple", tuple(Var(x) for x in "spo")),), "id")
        for level in range(max(levels, default=0) + 1):
            mine = [frozen(r) for r, k in zip(rules, levels) if k <= level]
            relations = {"triple": total, "before": total}
            fix = Fixpoint(self.spark, mine if any(h.pred == "triple" for r in mine for h in r.head) else [*mine, copy], lambda a, have=relations: have.get(a.pred), **options)
            out = fix.run(goal)
            read += [(frozen(r), total) for r, k in zip(rules, levels) if k == level and negated(r)]
            if out.reached_goal:
                break
            total = cut(out.total["triple"])
        for r, then in read:
            keep = r.head_variables() | r.body_variables()
            found = [bindings(r, lambda a, d, b=b: b if a.pred == "before" else total, self.registry, None, self.subjects, keep) for b in (then, total)]
            if not found[0].subtract(found[1].select(*found[0].columns)).isEmpty():
                raise NotStratified(f"{r!r}: what follows makes its negated conjuncts true")
        out.asserted["triple"] = asserted
        return fix, out

    def close(self) -> Fixpoint:
        """Evaluate all rules over all facts."""
        if self._closed is None:
            self._closed = self._rdfs() or self._evaluate(self.rules)[0]
        return self._closed

    def _rdfs(self) -> Fixpoint | None:
        """The closure by shapes of triples, where the rules are those of RDFS and nothing else."""
        from .owl import rdfs

        if self.triples is None or self.actions or len(self.rules) < 10 or not all("rdf-schema#" in repr(r) or "22-rdf-syntax-ns#" in repr(r) for r in self.rules):
            return None
        if {canonical(r) for r in normalise(self.rules)} != {canonical(r) for r in normalise(rdfs_rules())}:
            return None
        try:
            local.fetch(self.triples)
            return None  # few triples: the rules themselves, in the driver
        except local.NotLocal:
            pass
        total = rdfs.closure(self.spark, cut(self.triples), lambda few: Engine(self.spark).add_triples(few)._evaluate(self.rules)[1].total["triple"].toDF("s", "p", "o"))
        if total is None:
            return None
        fix = Fixpoint(self.spark, [], lambda a: None, self.registry)
        asserted = self.triples.toDF("c0", "c1", "c2")
        fix.result.total["triple"], fix.result.asserted["triple"] = total.toDF("c0", "c1", "c2"), asserted
        fix.result.rounds["triple"] = [(0, asserted), (1, total.subtract(asserted).toDF("c0", "c1", "c2"))]
        fix.rules = normalise(self.rules)
        return fix

    def relation_of(self, atom: Atom) -> DataFrame:
        """Extent of a predicate after closure, columns c0, c1, ..."""
        return self._extent(self.close(), atom)

    def _extent(self, fix: Fixpoint, atom: Atom) -> DataFrame:
        total = fix.result.total
        if atom.pred in total:
            return total[atom.pred]
        if "triple" in total:
            t = total["triple"]
            if len(atom.args) == 1:
                return t.where((F.col("c1") == T.TYPE) & (F.col("c2") == atom.pred)).select("c0")
            return t.where(F.col("c1") == atom.pred).select("c0", F.col("c2").alias("c1"))
        if atom.pred == "triple":
            return self.closure().toDF("c0", "c1", "c2")
        df = self._lookup(atom)
        if df is None:
            if atom.pred.startswith(("<", "_:")):
                return self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(atom.args))))
            raise KeyError(f"no relation or rule for {atom.pred}")
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def _as_triples(self, pred: str, df: DataFrame) -> DataFrame:
        if pred == "triple":
            return df.toDF("s", "p", "o")
        if len(df.columns) == 1:
            return df.select(F.col("c0").cast("string").alias("s"), F.lit(T.TYPE).alias("p"), F.lit(pred).alias("o"))
        return df.select(F.col("c0").cast("string").alias("s"), F.lit(pred).alias("p"), F.col("c1").cast("string").alias("o"))

    def inferred(self) -> DataFrame:
        """Derived triples that aren't asserted."""
        result = self.close().result
        parts = [self._as_triples(p, df) for p, df in result.total.items() if len(df.columns) <= 2 or p == "triple"]
        if not parts:
            return facts_df(self.spark, [])
        out = functools.reduce(DataFrame.union, parts).distinct()
        return out if self.triples is None else out.subtract(self.triples)

    def closure(self) -> DataFrame:
        """Asserted and derived triples."""
        total = self.close().result.total
        if set(total) == {"triple"} and self.triples is not None:
            return total["triple"].toDF("s", "p", "o")
        return self.inferred() if self.triples is None else self.triples.union(self.inferred())

    def inferred_only(self, pred: str) -> DataFrame:
        """What the rules add to one predicate."""
        return self.close().result.inferred(pred)

    def cleaned(self) -> DataFrame:
        """The closure without class memberships of things that are used as predicates or classes."""
        c = self.closure()
        used = c.select(F.col("p").alias("s")).union(c.where(F.col("p") == T.TYPE).select("o")).distinct()
        return c.where(F.col("p") == T.TYPE).join(used, "s", "left_anti").select("s", "p", "o").union(c.where(F.col("p") != T.TYPE))

    def add_facts(self, pred: str, new: DataFrame) -> DataFrame:
        """Incremental addition to a stored relation; gives its new extent.

        After ``close`` of a positive program the closure goes on from what is known: only what
        the new facts set off is evaluated. Other programs are closed again when next asked.
        """
        have = self._lookup(Atom(pred, (None,) * len(new.columns)))
        before, rules = self._closed, normalise(self.rules)
        if have is not None:
            new = new.toDF(*have.columns).subtract(have)
        self.relations[pred] = new if have is None else have.union(new)
        self._changed()
        positive = not any(r.existential() or r.kind == "filter" or not r.head or any(a.negated for a in r.atoms()) for r in rules)
        if before is not None and positive and not self.actions and not self._second_order(rules):
            fresh = cut(new)
            self.relations[pred] = fresh if have is None else have.union(fresh)
            self._closed, _ = self._evaluate(self.rules, resume=(before.result.total, {pred: fresh}))
        return self.relations[pred]

    # goals

    def query(self, goal: Atom | And | tuple, method: str = "magic", first: bool = False) -> DataFrame:
        """Answers to a goal or a conjunction, a column a variable.

        ``naive``: over the whole closure. ``magic`` (also ``gms``): only what the goal's
        constants demand. ``supplementary`` (also ``bfp``, ``sld``): the same with shared prefixes.
        """
        if method not in ("naive", "magic", "gms", "supplementary", "bfp", "sld"):
            raise ValueError(f"unknown method {method}")
        parts = flatten(goal)
        names: list[Var] = []
        for a in parts:
            names += [v for v in a.args if isinstance(v, Var) and v not in names]
        if len(parts) == 1 and isinstance(parts[0], Atom) and not parts[0].negated:
            out = self._answer(parts[0], method)
        else:
            rule = Rule((Atom("answer", tuple(names)),), tuple(parts), "goal")
            if names:
                out = self._answer(Atom("answer", tuple(names)), method, [rule])
            else:
                out = bindings(rule, lambda a, d: self.relation_of(a), self.registry, None, self.subjects)
        return out.limit(1) if first else out

    def _answer(self, goal: Atom, method: str, extra: list[Rule] | None = None) -> DataFrame:
        from .plans.compile import scan

        rules = normalise([*self.rules, *(extra or [])])
        rules, hidden = self._under_policy([r for r in rules if r.head])
        once = False
        if method == "naive" or self._second_order(rules):
            fix = self.close() if not extra else self._evaluate([*self.rules, *extra])[0]
            extent = self._extent(fix, goal)
            once = goal.pred in fix.result.once and len({a for a in goal.args if isinstance(a, Var)}) == len(goal.args)
        else:
            own, target, seed = magic(rules, goal, method not in ("magic", "gms"))
            if not own:
                df = self._lookup(goal)
                extent = df if df is not None else self._extent(self.close(), goal)
            else:
                hybrid = self._hybrid(own, rules, hidden)
                fix, result = self._evaluate([*own, *hybrid], target if not any(isinstance(a, Var) for a in target.args) else None, seed)
                extent = result.total[target.pred]
                self.last_derived = result
        out = scan(extent.toDF(*[f"c{i}" for i in range(len(extent.columns))]), goal)
        out = out if once else out.distinct()
        return out.toDF(*[c.removeprefix("v_") or "found" for c in out.columns])

    def _hybrid(self, own: list[Rule], rules: list[Rule], hidden: set[str]) -> list[Rule]:
        """Copy rules that put stored facts of hybrid predicates into their adorned twins, guarded like them."""
        out = []
        derived = {h.pred: h for r in rules for h in r.head}
        for pred in sorted({h.pred for r in own for h in r.head if "^" in h.pred and not h.pred.startswith(("magic:", "sup:"))}):
            base, ad = pred.rsplit("^", 1)
            stored = None if base in hidden else self._lookup(derived[base])
            if stored is not None:
                args = tuple(Var(f"x{i}") for i in range(len(ad)))
                guard = (Atom(f"magic:{pred}", tuple(a for a, c in zip(args, ad) if c == "b")),) if "b" in ad else ()
                out.append(Rule((Atom(pred, args),), (*guard, Atom(base, args)), f"stored:{pred}"))
        return out

    def ask(self, goal, method: str = "magic") -> bool:
        """Whether a goal has an answer."""
        return not self.query(goal, method, first=True).isEmpty()

    def sparql(self, text: str, method: str = "naive"):
        """A SELECT's DataFrame or an ASK's bool, over asserted and derived facts."""
        from .sparql import run

        return run(self, text, method)

    def table(self, goal, method: str = "magic") -> DataFrame:
        """``query`` with its answer kept for the next call with the same goal, until facts or rules change."""
        key = (repr(goal), method)
        if key not in self._tables:
            self._tables[key] = self.query(goal, method).persist()
        return self._tables[key]

    # reports

    def violations(self) -> dict[str, DataFrame]:
        return self.close().violations()

    def filtered(self) -> dict[str, DataFrame]:
        return self.close().filtered()

    def sizes(self, least: int = 1200) -> DataFrame:
        """relation, n: derived and stored relations with at least ``least`` rows, largest first, each counted where it lies."""
        found = {**{p: df for p, df in self.relations.items()}, **dict(self.close().result.total.items())}
        if self.triples is not None:
            found.setdefault("triple", self.triples)
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("relation"), "n") for p, df in found.items()]
        return functools.reduce(DataFrame.union, parts).where(F.col("n") >= least).orderBy(F.desc("n"), "relation")

    def firings(self) -> DataFrame:
        return self.close().firings()

    def explain(self, fact: Atom, depth: int = 50):
        """A proof tree of a derived or stored fact, or None."""
        from .proofs import prove

        return prove(self, fact, depth)


class EntailedView:
    """Read-only store over asserted and derived triples."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def triples(self, s=None, p=None, o=None) -> DataFrame:
        df = self.engine.closure()
        for c, v in (("s", s), ("p", p), ("o", o)):
            if v is not None:
                df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
        return df

    def __len__(self) -> int:
        return self.engine.closure().count()

    def __contains__(self, triple) -> bool:
        return not self.triples(*triple).isEmpty()


@functools.cache
def rdfs_rules() -> list[Rule]:
    """The rules of the RDFS pack."""
    from .owl.packs import RDFS

    return n3.parse(RDFS).rules


def builtin(op: str, a, b) -> Builtin:
    """A builtin conjunct."""
    return Builtin(op, (a, b))
