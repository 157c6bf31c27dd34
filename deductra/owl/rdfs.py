"""RDFS entailment at scale: the rules run over one stand-in for all triples that behave alike.

No RDFS rule joins two triples on a resource but through what the schema says of it. So what
follows from a triple is settled by its *shape*: its predicate, and its subject and object
where these are *core*, that is predicates, classes or parts of the schema. The rules
are closed over one triple a shape, with stand-ins for the rest; what they derive of the
stand-ins is then instantiated for every triple by one join with a small table. A predicate
that turns out to be a sub-property of the schema's own makes its subjects and objects core, and the
shapes are taken again.

Vocabularies are small and data is large; where there are more core resources, shapes or
templates than ``MOST``, ``closure`` gives None and the caller evaluates the rules as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators.storage import small_table

#: Core resources, shapes and templates at most, and the bytes of a table that is broadcast.
MOST, BYTES = 50_000, 16 << 20
_TRIPLE = dict.fromkeys("spo", "string")
_ANY, _S, _O = "*", "\u0000s", "\u0000o"
_VOCABULARY = [T.TYPE, *map(T.rdf, ("Property",)), *map(T.rdfs, ("Class", "Resource", "Literal", "Datatype", "ContainerMembershipProperty", "member", "domain", "range", "subClassOf", "subPropertyOf"))]


def _few(df: DataFrame, times: int = 1) -> list[tuple] | None:
    most = times * MOST
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    return rows if len(rows) <= most and sum(len(x) for r in rows for x in r) <= BYTES else None


def closure(spark: SparkSession, triples: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """s, p, o of all that follows, the given triples included. ``close`` evaluates the rules over a few triples."""
    triples = triples.toDF("s", "p", "o")
    schema, typing = {T.rdfs(x) for x in ("subClassOf", "subPropertyOf", "domain", "range")}, {T.TYPE}
    while True:
        own = F.array(F.col("p"), *[F.when(F.col("p").isin(*schema), F.col(c)) for c in "so"], F.when(F.col("p").isin(*typing), F.col("o")))
        found = _few(triples.select(F.explode(own).alias("k")).where("k is not null").distinct())
        if found is None:
            return None
        core = small_table(spark, [(k,) for k in {k for k, in found} | set(_VOCABULARY)], {"k": "string"})
        shaped = triples
        for c in "so":
            known = F.broadcast(core.select(F.col("k").alias(f"core_{c}")))
            shaped = shaped.join(known, F.col(c) == F.col(f"core_{c}"), "left").withColumn(f"shape_{c}", F.coalesce(f"core_{c}", F.lit(_ANY)))
        shaped = shaped.select("s", "p", "o", "shape_s", "shape_o")
        shapes = _few(shaped.select("shape_s", "p", "shape_o").distinct())
        if shapes is None:
            return None
        some = [(f"{_S}{i}" if s == _ANY else s, p, f"{_O}{i}" if o == _ANY else o) for i, (s, p, o) in enumerate(shapes)]
        closed = _few(close(small_table(spark, some, _TRIPLE)).select("s", "p", "o"), 10)
        if closed is None:
            return None
        below = {(s, o) for s, p, o in closed if p == T.rdfs("subPropertyOf")}
        new_schema, new_typing = {s for s, o in below if o in schema} - schema, {s for s, o in below if o in typing} - typing
        if not new_schema and not new_typing:
            break
        schema, typing = schema | new_schema, typing | new_typing
    facts, templates = [], []
    for fact in closed:
        slots = {int(x[2:]) for x in fact if x.startswith((_S, _O))}
        if slots:
            templates.append((*shapes[slots.pop()], *[x[:2] if x.startswith((_S, _O)) else x for x in fact]))
        else:
            facts.append(fact)
    if sum(len(x) for t in templates for x in t) > BYTES:
        return None
    table = small_table(spark, templates, dict.fromkeys(["shape_s", "p", "shape_o", "ts", "tp", "to"], "string"))
    hit = shaped.join(F.broadcast(table), ["shape_s", "p", "shape_o"])
    slot = lambda c: F.when(F.col(c) == _S, F.col("s")).when(F.col(c) == _O, F.col("o")).otherwise(F.col(c))
    out = hit.select(slot("ts").alias("s"), F.col("tp").alias("p"), slot("to").alias("o"))
    return out.union(small_table(spark, facts, _TRIPLE)).distinct()
