"""Driver queries: one for each operator of the rule engine, over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .owl.packs import PD, RDFS, SUPPORT
from .plans.ir import Atom, Or, Rule, Var, variables

X, Y, Z, W, C, N, R, S, P, O, Q = variables("x y z w c n r s p o q")  # noqa: E741
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return register


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The tables as relations with native types; only the columns that a query uses are read."""
    t = tables(spark, sf_dir)
    e = Engine(spark)
    e.lazy("nationRegion", lambda: t("nation").select("n_nationkey", "n_regionkey"))
    e.lazy("nationName", lambda: t("nation").select("n_nationkey", "n_name"))
    e.lazy("regionName", lambda: t("region").select("r_regionkey", "r_name"))
    e.lazy("custNation", lambda: t("customer").select("c_custkey", "c_nationkey"))
    e.lazy("custSegment", lambda: t("customer").select("c_custkey", "c_mktsegment"))
    e.lazy("custName", lambda: t("customer").select("c_custkey", "c_name"))
    e.lazy("suppNation", lambda: t("supplier").select("s_suppkey", "s_nationkey"))
    e.lazy("orderCust", lambda: t("orders").select("o_orderkey", "o_custkey"))
    e.lazy("orderStatus", lambda: t("orders").select("o_orderkey", "o_orderstatus"))
    e.lazy("orderPriority", lambda: t("orders").select("o_orderkey", "o_orderpriority"))
    e.lazy("supplies", lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct())
    e.lazy("orderedPart", lambda: t("lineitem").select("l_orderkey", "l_partkey"))
    e.lazy("lineQty", lambda: t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q")))
    e.lazy("lineOrder", lambda: t("lineitem").select(F.col("l_orderkey") % 10, F.col("l_linenumber").cast("long")))
    e.lazy("partName", lambda: t("part").select("p_partkey", "p_name"))
    e.lazy("partType", lambda: t("part").select("p_partkey", "p_type"))
    e.lazy("partSize", lambda: t("part").select("p_partkey", "p_size"))
    e.lazy("partBrand", lambda: t("part").select("p_partkey", "p_brand"))
    e.lazy("did", lambda: t("events").select("user_id", "event_type"))
    e.lazy("toxic", lambda: t("labels").where("toxic = 1").select("doc_id"))
    e.lazy("doc", lambda: t("documents").select("doc_id"))
    e.lazy("docLang", lambda: t("documents").select("doc_id", "lang"))

    def next_turn() -> DataFrame:
        conv = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("b"))
        return conv.select("a", "b").join(conv.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")

    e.lazy("nextTurn", next_turn)
    e.lazy("nextNation", lambda: t("nation").select("n_nationkey", ((F.col("n_nationkey") + 1) % 25).cast("int")))
    e.domain(lambda: t("customer").select("c_custkey"))
    return e


def answer(e: Engine, goal, *names: str, method: str = "naive") -> DataFrame:
    return e.query(goal, method).toDF(*names)


def rules(e: Engine, *more: Rule) -> Engine:
    return e.add_rules(more)


# scans, projection, filters


@query("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_nationkey = 3")
def op_p1_pattern_scan(spark, sf_dir):
    """OP-P1, OP-P2: a pattern with a constant."""
    return answer(engine(spark, sf_dir), Atom("custNation", (C, 3)), "custkey")


@query("SELECT DISTINCT l_linenumber::BIGINT AS k FROM lineitem WHERE l_orderkey % 10 = l_linenumber")
def op_p3_repeated_variable(spark, sf_dir):
    """OP-P3: one variable twice in a pattern."""
    return answer(engine(spark, sf_dir), Atom("lineOrder", (X, X)), "k")


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer")
def op_p4_projection(spark, sf_dir):
    """OP-P4, OP-P8: projection with duplicates removed."""
    e = rules(engine(spark, sf_dir), Atom("hasCustomer", (N,)) <= Atom("custNation", (C, N)))
    return answer(e, Atom("hasCustomer", (N,)), "nationkey")


@query("SELECT DISTINCT n_nationkey AS nationkey, 'nation' AS kind FROM nation")
def op_p5_head_constant(spark, sf_dir):
    """OP-P5: a constant in a head."""
    e = rules(engine(spark, sf_dir), Atom("kind", (N, "nation")) <= Atom("nationName", (N, X)))
    return answer(e, Atom("kind", (N, X)), "nationkey", "kind")


@query("SELECT DISTINCT l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 45")
def op_p6_builtin_filter(spark, sf_dir):
    """OP-P6: a builtin, pushed to the scan."""
    e = rules(engine(spark, sf_dir), Atom("big", (O, N)) <= Atom("lineQty", (O, N, Q)) & (Q > 45))
    return answer(e, Atom("big", (O, N)), "orderkey", "linenumber")


# joins


@query("SELECT DISTINCT s_suppkey AS suppkey, c_custkey AS custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def op_j1_equi_join(spark, sf_dir):
    """OP-J1: suppliers and customers of one nation."""
    e = rules(engine(spark, sf_dir), Atom("near", (S, C)) <= Atom("suppNation", (S, N)) & Atom("custNation", (C, N)))
    return answer(e, Atom("near", (S, C)), "suppkey", "custkey")


@query("SELECT DISTINCT r_regionkey AS regionkey, o_orderstatus AS status FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)")
def op_j2_cross(spark, sf_dir):
    """OP-J2: no shared variable."""
    e = rules(engine(spark, sf_dir), Atom("status", (S,)) <= Atom("orderStatus", (O, S)), Atom("pair", (R, S)) <= Atom("regionName", (R, X)) & Atom("status", (S,)))
    return answer(e, Atom("pair", (R, S)), "regionkey", "status")


@query("SELECT DISTINCT s_suppkey AS suppkey, s_nationkey AS nationkey FROM supplier")
def op_j3_pass_through(spark, sf_dir):
    """OP-J3: one conjunct."""
    e = rules(engine(spark, sf_dir), Atom("basedIn", (S, N)) <= Atom("suppNation", (S, N)))
    return answer(e, Atom("basedIn", (S, N)), "suppkey", "nationkey")


@query("""SELECT DISTINCT l_partkey AS partkey, c_nationkey AS nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""")
def op_j4_bushy(spark, sf_dir):
    """OP-J4, OP-J14: four relations, ordered by shared variables."""
    body = Atom("orderedPart", (O, P)) & Atom("orderCust", (O, C)) & Atom("custNation", (C, N)) & Atom("nationName", (N, X))
    e = rules(engine(spark, sf_dir), Atom("boughtIn", (P, N)) <= body)
    return answer(e, Atom("boughtIn", (P, N)), "partkey", "nationkey")


@query("SELECT DISTINCT o_orderkey AS orderkey, c_nationkey AS nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def op_j7_hash_join(spark, sf_dir):
    """OP-J7: the hash-join library call."""
    from .operators.joins import hash_join

    t = tables(spark, sf_dir)
    left, right = t("orders").select("o_orderkey", F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return hash_join(left, right, ["k"]).select(F.col("o_orderkey").alias("orderkey"), F.col("c_nationkey").alias("nationkey")).distinct()


@query("SELECT DISTINCT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def op_j8_theta(spark, sf_dir):
    """OP-J8: an inequality beside an equality."""
    from .operators.joins import theta_join

    one, two = (tables(spark, sf_dir)("supplier").select(F.col("s_suppkey").alias(k), F.col("s_nationkey").alias("n")) for k in ("one", "two"))
    return theta_join(one, two, lambda a, b: a["one"] < b["two"], ["n"], distinct=True)


@query("SELECT DISTINCT o_orderkey AS orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def op_j10_merge_join(spark, sf_dir):
    """OP-J9, OP-J10: the sort-merge library call."""
    from .operators.joins import merge_join

    t = tables(spark, sf_dir)
    left, right = t("orders").select("o_orderkey", F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return merge_join(left, right, ["k"]).select(F.col("o_orderkey").alias("orderkey"), F.col("c_mktsegment").alias("segment")).distinct()


@query("SELECT a.n_nationkey AS one, b.n_nationkey AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def op_j11_siblings(spark, sf_dir):
    """OP-J11, OP-B2: siblings share a parent and differ."""
    e = rules(engine(spark, sf_dir), Atom("sibling", (X, Y)) <= Atom("nationRegion", (X, R)) & Atom("nationRegion", (Y, R)) & X.differs(Y))
    return answer(e, Atom("sibling", (X, Y)), "one", "two")


@query("SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def op_j12_semi(spark, sf_dir):
    """OP-J12: a conjunct that adds nothing is a semi-join."""
    e = rules(engine(spark, sf_dir), Atom("urgent", (C,)) <= Atom("orderCust", (O, C)) & Atom("orderPriority", (O, "1-URGENT")), Atom("known", (C,)) <= Atom("custNation", (C, N)) & Atom("urgent", (C,)))
    return answer(e, Atom("known", (C,)), "custkey")


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def op_j15_conjunctive_goal(spark, sf_dir):
    """OP-J15, OP-G13: a conjunction asked directly."""
    goal = (Atom("custSegment", (C, "BUILDING")), Atom("custNation", (C, N)), Atom("nationName", (N, X)), Atom("nationRegion", (N, R)), Atom("regionName", (R, Y)))
    return engine(spark, sf_dir).query(goal, "naive").select(F.col("x").alias("nation"), F.col("y").alias("region")).distinct()


# recursion

TC = "WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id * 1000 + a.turn AS x, b.conv_id * 1000 + b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), t AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)"


@query(f"{TC} SELECT x AS a, y AS b FROM t")
def op_f5_transitive_closure(spark, sf_dir):
    """OP-F1, OP-F5: later turns of a conversation, a linear rule run in its doubling form."""
    after = [Atom("after", (X, Y)) <= Atom("nextTurn", (X, Y)), Atom("after", (X, Z)) <= Atom("after", (X, Y)) & Atom("nextTurn", (Y, Z))]
    return answer(rules(engine(spark, sf_dir), *after), Atom("after", (X, Y)), "a", "b")


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS x, CAST((n_nationkey + 1) % 25 AS INT) AS y FROM nation UNION SELECT t.x, CAST((t.y + 1) % 25 AS INT) FROM t) SELECT x AS a, y AS b FROM t")
def op_f5_cyclic_closure(spark, sf_dir):
    """OP-F5 on a cycle."""
    r = [Atom("reach", (X, Y)) <= Atom("nextNation", (X, Y)), Atom("reach", (X, Z)) <= Atom("reach", (X, Y)) & Atom("reach", (Y, Z))]
    return answer(rules(engine(spark, sf_dir), *r), Atom("reach", (X, Y)), "a", "b")


SG = """WITH up AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation UNION ALL SELECT 'r' || r_regionkey, 'w' FROM region),
    l1 AS (SELECT a.x AS x, b.x AS y FROM up a JOIN up b ON a.y = b.y), l2 AS (SELECT a.x AS x, b.x AS y FROM up a JOIN l1 ON a.y = l1.x JOIN up b ON b.y = l1.y)"""


@query(f"{SG} SELECT x AS a, y AS b FROM l1 UNION SELECT x, y FROM l2")
def op_f6_same_generation(spark, sf_dir):
    """OP-F6: same generation over nations and regions."""
    t = tables(spark, sf_dir)
    up = t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")).union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("w")))
    e = Engine(spark).relation("up", up)
    sg = [Atom("sg", (X, Y)) <= Atom("up", (X, Z)) & Atom("up", (Y, Z)), Atom("sg", (X, Y)) <= Atom("up", (X, Z)) & Atom("sg", (Z, W)) & Atom("up", (Y, W))]
    return answer(rules(e, *sg), Atom("sg", (X, Y)), "a", "b")


PART_OF = """WITH RECURSIVE p AS (SELECT 'c' || c_custkey AS x, 'n' || c_nationkey AS y FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
    t AS (SELECT x, y FROM p UNION SELECT t.x, p.y FROM t JOIN p ON t.y = p.x)"""


def _part_of(spark, sf_dir) -> Engine:
    t = tables(spark, sf_dir)
    steps = t("customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    steps = steps.union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world")))
    e = Engine(spark).relation("partOf", steps)
    return rules(e, Atom("within", (X, Y)) <= Atom("partOf", (X, Y)), Atom("within", (X, Z)) <= Atom("partOf", (X, Y)) & Atom("within", (Y, Z)))


@query(f"{PART_OF} SELECT x AS a, y AS b FROM t")
def op_f7_ancestor_linear(spark, sf_dir):
    """OP-F7: customer, nation, region, world."""
    return answer(_part_of(spark, sf_dir), Atom("within", (X, Y)), "a", "b")


@query("SELECT n_nationkey AS place, n_regionkey AS inside FROM nation UNION SELECT n_nationkey, 100 FROM nation UNION SELECT r_regionkey, 100 FROM region")
def op_f8_hybrid(spark, sf_dir):
    """OP-F8, OP-G9: a predicate both stored and derived."""
    t = tables(spark, sf_dir)
    e = engine(spark, sf_dir).relation("locatedIn", t("nation").select("n_nationkey", "n_regionkey")).relation("region", t("region").select("r_regionkey"))
    e = rules(e, Atom("locatedIn", (R, 100)) <= Atom("region", (R,)), Atom("locatedIn", (N, 100)) <= Atom("nationRegion", (N, R)))
    return answer(e, Atom("locatedIn", (X, Y)), "place", "inside")


@query("SELECT DISTINCT user_id AS user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def op_f2_incremental(spark, sf_dir):
    """OP-F2: facts that come later change the closure as if they had been there at once."""
    ev = tables(spark, sf_dir)("events").select("user_id", "event_type")
    e = rules(Engine(spark).relation("did", ev.where("event_type = 'click'")), Atom("buyer", (X,)) <= Atom("did", (X, "click")) & Atom("did", (X, "purchase")))
    e.close()
    e.add_facts("did", ev.where("event_type <> 'click'"))
    return answer(e, Atom("buyer", (X,)), "user_id")


@query("SELECT true AS reached")
def op_f4_early_stop(spark, sf_dir):
    """OP-F4: evaluation stops in the round that finds a ground goal."""
    e = _part_of(spark, sf_dir)
    fix, result = e._evaluate(e.rules, Atom("within", ("n1", "world")))
    return spark.range(1).select(F.lit(result.reached_goal).alias("reached"))


# rule language

SEG = "c_mktsegment IN ('BUILDING', 'MACHINERY')"


@query(f"SELECT c_custkey AS custkey FROM customer WHERE {SEG}")
def op_u1_union_rules(spark, sf_dir):
    """OP-U1: two rules with one head."""
    e = rules(engine(spark, sf_dir), *[Atom("heavy", (C,)) <= Atom("custSegment", (C, s)) for s in ("BUILDING", "MACHINERY")])
    return answer(e, Atom("heavy", (C,)), "custkey")


@query(f"SELECT c_custkey AS custkey FROM customer WHERE {SEG}")
def op_r12_disjunctive_body(spark, sf_dir):
    """OP-U2, OP-R12, OP-R13: a disjunctive body."""
    body = Or((Atom("custSegment", (C, "BUILDING")), Atom("custSegment", (C, "MACHINERY"))))
    return answer(rules(engine(spark, sf_dir), Atom("heavy", (C,)) <= body), Atom("heavy", (C,)), "custkey")


@query("SELECT p_partkey AS partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL')")
def op_u3_batch_inclusion(spark, sf_dir):
    """OP-U3: many inclusions of classes into one, as one filter."""
    from .owl.inclusion import batch_members

    return batch_members(tables(spark, sf_dir)("part").select("p_partkey", "p_type"), ["ECONOMY", "PROMO", "SMALL"]).toDF("partkey")


@query("SELECT DISTINCT c_custkey AS custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def op_u4_intersection(spark, sf_dir):
    """OP-U4: members of two classes."""
    e = rules(engine(spark, sf_dir), Atom("done", (C,)) <= Atom("orderCust", (O, C)) & Atom("orderStatus", (O, "F")), Atom("both", (C,)) <= Atom("custSegment", (C, "BUILDING")) & Atom("done", (C,)))
    return answer(e, Atom("both", (C,)), "custkey")


@query("SELECT DISTINCT 'customer' AS kind, c_custkey AS k FROM customer UNION SELECT 'nation', c_nationkey FROM customer")
def op_r9_conjunctive_head(spark, sf_dir):
    """OP-R9: two conclusions of one rule."""
    rule = Rule((Atom("customer", (C,)), Atom("place", (N,))), Atom("custNation", (C, N)), "two")
    e = rules(engine(spark, sf_dir), rule)
    one = answer(e, Atom("customer", (C,)), "k").select(F.lit("customer").alias("kind"), "k")
    return one.union(answer(e, Atom("place", (N,)), "k").select(F.lit("nation"), F.col("k").cast("long")))


@query("SELECT n_nationkey AS nationkey, 1::BIGINT AS nodes FROM nation")
def op_r10_existential(spark, sf_dir):
    """OP-R10: a new node for each firing of an existential head."""
    e = rules(engine(spark, sf_dir), Rule((Atom("office", (N, O)), Atom("isOffice", (O,))), Atom("nationName", (N, X)), "office"))
    found = answer(e, (Atom("office", (N, O)), Atom("isOffice", (O,))), "nationkey", "node")
    return found.groupBy("nationkey").agg(F.countDistinct("node").alias("nodes"))


@query("SELECT DISTINCT n_regionkey AS regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def op_r11_body_existential(spark, sf_dir):
    """OP-R11: variables that only the body has."""
    e = rules(engine(spark, sf_dir), Atom("served", (R,)) <= Atom("nationRegion", (N, R)) & Atom("custNation", (C, N)))
    return answer(e, Atom("served", (R,)), "regionkey")


@query("SELECT DISTINCT n_nationkey AS nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey > 3")
def op_r16_builtin_order(spark, sf_dir):
    """OP-R16: a builtin written before what binds it."""
    e = rules(engine(spark, sf_dir), Atom("late", (N,)) <= (N > 3) & Atom("suppNation", (S, N)))
    return answer(e, Atom("late", (N,)), "nationkey")


@query("SELECT DISTINCT doc_id AS doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def op_r18_constraint(spark, sf_dir):
    """OP-R18: bindings that break a constraint."""
    e = rules(engine(spark, sf_dir), Rule((), Atom("docLang", (X, "en")) & Atom("toxic", (X,)), "clean"))
    return e.violations()["clean"].select(F.col("x").alias("doc_id")).distinct()


@query("SELECT 7::INT AS k")
def op_r19_universal_fact(spark, sf_dir):
    """OP-R19: a rule with an empty body."""
    return answer(rules(Engine(spark), Rule((Atom("lucky", (7,)),), (), "fact")), Atom("lucky", (X,)), "k")


@query("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def op_r20_filter_rule(spark, sf_dir):
    """OP-R20: conclusions that are kept apart."""
    e = rules(engine(spark, sf_dir), Rule((Atom("seen", (C,)),), Atom("custSegment", (C, "BUILDING")), "f", "filter"))
    return e.filtered()["seen"].toDF("custkey")


# negation


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def op_n1_negation(spark, sf_dir):
    """OP-N1, OP-N2, OP-J13: customers without a finished order."""
    e = rules(engine(spark, sf_dir), Atom("done", (C,)) <= Atom("orderCust", (O, C)) & Atom("orderStatus", (O, "F")), Atom("waiting", (C,)) <= Atom("custNation", (C, N)) & ~Atom("done", (C,)))
    return answer(e, Atom("waiting", (C,)), "custkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def op_n3_pure_negative(spark, sf_dir):
    """OP-N3: only a negated conjunct, over the domain."""
    e = rules(engine(spark, sf_dir), Atom("builder", (C,)) <= Atom("custSegment", (C, "BUILDING")), Atom("other", (C,)) <= ~Atom("builder", (C,)))
    return answer(e, Atom("other", (C,)), "custkey")


@query("SELECT doc_id AS doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def op_n4_negated_first(spark, sf_dir):
    """OP-N4: a negated conjunct written first."""
    e = rules(engine(spark, sf_dir), Atom("clean", (X,)) <= ~Atom("toxic", (X,)) & Atom("docLang", (X, "en")))
    return answer(e, Atom("clean", (X,)), "doc_id")


@query("SELECT doc_id AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang NOT IN ('en')")
def op_n5_naf_goal(spark, sf_dir):
    """OP-N5: negation as failure in a goal, answered top-down."""
    goal = (Atom("docLang", (X, Y)), ~Atom("toxic", (X,)), Y.differs("en"))
    return engine(spark, sf_dir).query(goal, "magic").select(F.col("x").alias("doc_id"))


@query("""SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def op_n6_three_strata(spark, sf_dir):
    """OP-N6: explicit negation over more than two strata."""
    e = rules(
        engine(spark, sf_dir), Atom("urgent", (C,)) <= Atom("orderCust", (O, C)) & Atom("orderPriority", (O, "1-URGENT")), Atom("calm", (C,)) <= Atom("custSegment", (C, "BUILDING")) & ~Atom("urgent", (C,)),
        Atom("busy", (C,)) <= Atom("orderCust", (O, C)) & Atom("orderStatus", (O, "P")), Atom("rest", (C,)) <= Atom("calm", (C,)) & ~Atom("busy", (C,)),
    )
    return answer(e, Atom("rest", (C,)), "custkey")


@query("SELECT 'n' || n_nationkey AS a, 'world' AS b FROM nation UNION SELECT 'c' || c_custkey, 'world' FROM customer UNION SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def op_n8_inferred_only(spark, sf_dir):
    """OP-N8, OP-U-except: what closure adds to a stored predicate."""
    base = _part_of(spark, sf_dir).relations["partOf"]
    e = rules(Engine(spark).relation("partOf", base), Atom("partOf", (X, Z)) <= Atom("partOf", (X, Y)) & Atom("partOf", (Y, Z)))
    return e.inferred_only("partOf").toDF("a", "b")


# builtins: one query each, numbers on quantities, strings on names


def _numeric(op: str, value: int):
    def run(spark, sf_dir):
        e = rules(engine(spark, sf_dir), Rule((Atom("hit", (O, N)),), (Atom("lineQty", (O, N, Q)), builtin_atom(op, Q, value)), op))
        return answer(e, Atom("hit", (O, N)), "orderkey", "linenumber")

    return run


def _textual(op: str, value: str):
    def run(spark, sf_dir):
        e = rules(engine(spark, sf_dir), Rule((Atom("hit", (P,)),), (Atom("partName", (P, X)), builtin_atom(op, X, value)), op))
        return answer(e, Atom("hit", (P,)), "partkey")

    return run


def builtin_atom(op, a, b):
    from .plans.ir import Builtin

    return Builtin(op, (a, b))


for _name, _op, _sql in (
    ("op_b4_equal_to", "math:equalTo", "="), ("op_b5_greater_than", "math:greaterThan", ">"), ("op_b6_less_than", "math:lessThan", "<"), ("op_b7_not_less_than", "math:notLessThan", ">="),
    ("op_b8_not_equal_to", "math:notEqualTo", "<>"), ("op_b8_not_greater_than", "math:notGreaterThan", "<="),
):
    QUERIES[_name] = _numeric(_op, 30)
    ORACLES[_name] = f"SELECT DISTINCT l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem WHERE CAST(l_quantity AS BIGINT) {_sql} 30"
for _name, _op, _value, _sql in (
    ("op_b1_term_equal", "log:equalTo", "blue gear", "p_name = 'blue gear'"), ("op_b2_term_not_equal", "log:notEqualTo", "blue gear", "p_name <> 'blue gear'"),
    ("op_b9_contains", "str:contains", "ea", "contains(p_name, 'ea')"), ("op_b10_str_greater", "str:greaterThan", "p", "p_name > 'p'"), ("op_b11_str_less", "str:lessThan", "p", "p_name < 'p'"),
    ("op_b12_equal_ignoring_case", "str:equalIgnoringCase", "BLUE Gear", "lower(p_name) = 'blue gear'"), ("op_b13_starts_with", "str:startsWith", "blue", "starts_with(p_name, 'blue')"), ("op_b13_ends_with", "str:endsWith", "rod", "ends_with(p_name, 'rod')"),
    ("op_b13_matches", "str:matches", "^[a-c].* g", "regexp_matches(p_name, '^[a-c].* g')"), ("op_b13_not_matches", "str:notMatches", "^[a-c].* g", "NOT regexp_matches(p_name, '^[a-c].* g')"),
    ("op_b13_contains_ignoring_case", "str:containsIgnoringCase", "A", "contains(lower(p_name), 'a')"), ("op_b13_not_equal_ignoring_case", "str:notEqualIgnoringCase", "BLUE Gear", "lower(p_name) <> 'blue gear'"),
    ("op_b13_str_not_greater", "str:notGreaterThan", "p", "p_name <= 'p'"), ("op_b13_str_not_less", "str:notLessThan", "p", "p_name >= 'p'"), ("op_b16_greater_or_equal", "str:greaterThanOrEqualTo", "p", "p_name >= 'p'"), ("op_b16_less_or_equal", "str:lessThanOrEqualTo", "p", "p_name <= 'p'"),
):
    QUERIES[_name] = _textual(_op, _value)
    ORACLES[_name] = f"SELECT DISTINCT p_partkey AS partkey FROM part WHERE {_sql}"


@query("SELECT p_partkey AS partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def op_b14_user_builtin(spark, sf_dir):
    """OP-B14, OP-X1: a user's predicate."""
    e = engine(spark, sf_dir).register_builtin("urn:begins", lambda a, b: a.startswith(b))
    e = rules(e, Rule((Atom("hit", (P,)),), (Atom("partBrand", (P, X)), builtin_atom("urn:begins", X, "Brand#1")), "b"))
    return answer(e, Atom("hit", (P,)), "partkey")


@query("SELECT c_custkey AS custkey, lower(c_mktsegment) AS low FROM customer WHERE c_mktsegment = 'BUILDING'")
def op_x3_action(spark, sf_dir):
    """OP-X3: an action on a rule's bindings."""
    e = rules(engine(spark, sf_dir), Rule((Atom("seg", (C, S)),), Atom("custSegment", (C, S)) & S.equals("BUILDING"), "seg"))
    e.register_action(Atom("seg", (C, S)), lambda b: {"low": b.select("c", F.lower("s"))})
    e.close()
    return e.close().result.total["low"].toDF("custkey", "low")


# goals


@query(f"{PART_OF} SELECT y AS b FROM t WHERE x = 'c7'")
def op_g5_magic(spark, sf_dir):
    """OP-G1 to OP-G6: what contains customer 7, without closing everything."""
    return answer(_part_of(spark, sf_dir), Atom("within", ("c7", Y)), "b", method="magic")


@query(f"{PART_OF} SELECT y AS b FROM t WHERE x = 'c7'")
def op_g10_supplementary(spark, sf_dir):
    """OP-G10, OP-G17: the same goal with supplementary relations."""
    return answer(_part_of(spark, sf_dir), Atom("within", ("c7", Y)), "b", method="bfp")


@query(f"{PART_OF} SELECT x AS a, y AS b FROM t")
def op_g11_open_query(spark, sf_dir):
    """OP-G11: a goal without constants."""
    return answer(_part_of(spark, sf_dir), Atom("within", (X, Y)), "a", "b", method="magic")


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 3")
def op_g12_base_pushdown(spark, sf_dir):
    """OP-G12: base conjuncts of a goal become one join tree."""
    e = rules(engine(spark, sf_dir), Atom("at", (C, N)) <= Atom("custNation", (C, N)) & Atom("nationName", (N, X)))
    return e.query(Atom("at", (C, 3)), "magic").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PART_OF} SELECT true AS found WHERE EXISTS (SELECT 1 FROM t WHERE x = 'c7' AND y = 'world')")
def op_g20_ask(spark, sf_dir):
    """OP-G20, OP-G24: a ground goal."""
    return spark.range(1).select(F.lit(_part_of(spark, sf_dir).ask(Atom("within", ("c7", "world")))).alias("found")).where("found")


# RDF terms and SPARQL


def _nations(spark, sf_dir) -> Engine:
    """Nations and regions as triples."""
    t = tables(spark, sf_dir)
    n = t("nation")
    node = F.concat(F.lit("<urn:nation/"), "n_nationkey", F.lit(">"))
    region = F.concat(F.lit("<urn:region/"), "n_regionkey", F.lit(">"))
    rows = n.select(node.alias("s"), F.lit("<urn:v#inRegion>").alias("p"), region.alias("o")).union(n.select(node, F.lit("<urn:v#name>"), F.concat(F.lit('"'), "n_name", F.lit('"'))))
    r = t("region")
    rnode = F.concat(F.lit("<urn:region/"), "r_regionkey", F.lit(">"))
    rows = rows.union(r.where("r_regionkey < 3").select(rnode, F.lit("<urn:v#label>"), F.concat(F.lit('"'), "r_name", F.lit('"'))))
    return Engine(spark).add_triples(rows)


@query("SELECT '<urn:nation/' || n_nationkey || '>' AS n, '\"' || r_name || '\"' AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def op_g21_bgp(spark, sf_dir):
    """OP-G21: a basic graph pattern."""
    return _nations(spark, sf_dir).sparql("PREFIX v: <urn:v#> SELECT ?n ?label WHERE { ?n v:inRegion ?r . ?r v:label ?label }")


@query("SELECT '<urn:nation/' || n_nationkey || '>' AS n, CASE WHEN r_regionkey < 3 THEN '\"' || r_name || '\"' END AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def op_g22_optional(spark, sf_dir):
    """OP-G22: an optional pattern."""
    return _nations(spark, sf_dir).sparql("PREFIX v: <urn:v#> SELECT ?n ?label WHERE { ?n v:inRegion ?r OPTIONAL { ?r v:label ?label } }")


@query("SELECT '<urn:nation/' || n_nationkey || '>' AS n FROM nation WHERE n_regionkey = 1 UNION SELECT '<urn:nation/' || n_nationkey || '>' FROM nation WHERE starts_with(n_name, 'A')")
def op_g23_filter_union(spark, sf_dir):
    """OP-G23: FILTER and UNION."""
    text = 'PREFIX v: <urn:v#> SELECT DISTINCT ?n WHERE { { ?n v:inRegion <urn:region/1> } UNION { ?n v:name ?x FILTER(STRSTARTS(?x, "A")) } }'
    return _nations(spark, sf_dir).sparql(text)


@query("SELECT '<urn:nation/' || a.n_nationkey || '>' AS a, '<urn:nation/' || b.n_nationkey || '>' AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def op_g19_entailment(spark, sf_dir):
    """OP-G19: SPARQL over derived facts of N3 rules."""
    e = _nations(spark, sf_dir).add_rules("@prefix v: <urn:v#> . { ?a v:inRegion ?r . ?b v:inRegion ?r } => { ?a v:near ?b } .")
    return e.sparql("PREFIX v: <urn:v#> SELECT ?a ?b WHERE { ?a v:near ?b }")


@query("SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:v#seen>' AS p, '<urn:region/' || n_regionkey || '>' AS o FROM nation UNION SELECT '<urn:nation/' || n_nationkey || '>', '<urn:v#seen>', '\"' || n_name || '\"' FROM nation")
def op_p7_second_order(spark, sf_dir):
    """OP-P7: a variable in predicate position."""
    e = _nations(spark, sf_dir).add_rules("@prefix v: <urn:v#> . { ?s ?p ?o . ?s v:inRegion ?r } => { ?s v:seen ?o } .")
    return e.inferred().where("p = '<urn:v#seen>'")


@query("SELECT 'near' AS rule, count(*)::BIGINT AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey UNION ALL SELECT 'place', 25::BIGINT")
def op_s17_conflict(spark, sf_dir):
    """OP-S17: instantiations of each rule."""
    e = rules(engine(spark, sf_dir), Rule((Atom("near", (X, Y)),), Atom("nationRegion", (X, R)) & Atom("nationRegion", (Y, R)), "near"), Rule((Atom("place", (X,)),), Atom("nationName", (X, Y)), "place"))
    return e.firings()


@query("SELECT '<urn:t/' || n_nationkey || '>' AS s, '<urn:t#n_name>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def op_s1_direct_mapping(spark, sf_dir):
    """OP-S1: a table as triples."""
    from .sources.rdf import map_table

    return map_table(tables(spark, sf_dir)("nation"), "n_nationkey", "urn:t", ["n_name"])


# ontologies

OWL_PREFIX = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix v: <urn:v#> .\n"


def _ontology(spark, sf_dir, text: str) -> Engine:
    """Rules from axioms over typed relations: classes and properties of the vocabulary ``urn:v#``."""
    from .owl.axioms import rules_from_owl

    t = tables(spark, sf_dir)
    e = Engine(spark).domain(lambda: t("customer").select("c_custkey"))
    made = {
        "Customer": lambda: t("customer").select("c_custkey"), "Building": lambda: t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"), "Machinery": lambda: t("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey"),
        "Far": lambda: t("customer").where("c_nationkey > 12").select("c_custkey"), "nation": lambda: t("customer").select("c_custkey", "c_nationkey"), "region": lambda: t("nation").select("n_nationkey", "n_regionkey"), "placed": lambda: t("orders").select("o_custkey", "o_orderkey"),
        "Urgent": lambda: t("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey"), "European": lambda: t("nation").where("n_regionkey = 3").select("n_nationkey"), "next": lambda: t("nation").select("n_nationkey", ((F.col("n_nationkey") + 1) % 25).cast("int")),
    }
    for name, make in made.items():
        e.lazy(f"<urn:v#{name}>", make)
    return e.add_rules(rules_from_owl(OWL_PREFIX + text, stored={f"<urn:v#{n}>" for n in made}, native=True))


def ontology_query(name: str, text: str, goal: Atom, names: tuple, sql: str, doc: str):
    def run(spark, sf_dir):
        return answer(_ontology(spark, sf_dir, text), goal, *names)

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


def _v(name, *args):
    return Atom(f"<urn:v#{name}>", args)


_BM = "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"
ontology_query("op_d1_subclass", "v:Building rdfs:subClassOf v:Heavy . v:Machinery rdfs:subClassOf v:Heavy . v:Heavy rdfs:subClassOf v:Any .", _v("Any", X), ("k",), _BM, "OP-D1")
ontology_query("op_d2_equivalent_class", "v:Building owl:equivalentClass v:B2 . v:B3 owl:equivalentClass v:B2 .", _v("B3", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'", "OP-D2")
ontology_query("op_d3_domain", "v:placed rdfs:domain v:Buyer .", _v("Buyer", X), ("k",), "SELECT DISTINCT o_custkey AS k FROM orders", "OP-D3")
ontology_query("op_d4_range", "v:nation rdfs:range v:Nation .", _v("Nation", X), ("k",), "SELECT DISTINCT c_nationkey AS k FROM customer", "OP-D4")
ontology_query("op_d5_sub_property", "v:region rdfs:subPropertyOf v:inside .", _v("inside", X, Y), ("a", "b"), "SELECT n_nationkey AS a, n_regionkey AS b FROM nation", "OP-D5")
ontology_query("op_d6_equivalent_property", "v:region owl:equivalentProperty v:area .", _v("area", X, Y), ("a", "b"), "SELECT n_nationkey AS a, n_regionkey AS b FROM nation", "OP-D6")
ontology_query("op_d7_inverse", "v:has owl:inverseOf v:region .", _v("has", X, Y), ("a", "b"), "SELECT n_regionkey AS a, n_nationkey AS b FROM nation", "OP-D7")
ontology_query("op_d8_transitive", "v:next rdfs:subPropertyOf v:reach . v:reach a owl:TransitiveProperty .", _v("reach", X, Y), ("a", "b"), "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a CROSS JOIN nation b", "OP-D8 transitive")
ontology_query("op_d8_symmetric", "v:next rdfs:subPropertyOf v:beside . v:beside a owl:SymmetricProperty .", _v("beside", X, Y), ("a", "b"), "SELECT n_nationkey AS a, CAST((n_nationkey + 1) % 25 AS INT) AS b FROM nation UNION SELECT CAST((n_nationkey + 1) % 25 AS INT), n_nationkey FROM nation", "OP-D8 symmetric")
ontology_query("op_d9_union_of", "v:Heavy a owl:Class ; owl:unionOf ( v:Building v:Machinery ) .", _v("Heavy", X), ("k",), _BM, "OP-D9")
ontology_query("op_d10_intersection_of", "v:FarBuilding a owl:Class ; owl:intersectionOf ( v:Building v:Far ) .", _v("FarBuilding", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 12", "OP-D10")
ontology_query("op_d11_some_in_body", "[ a owl:Restriction ; owl:onProperty v:placed ; owl:someValuesFrom v:Urgent ] rdfs:subClassOf v:Hasty .", _v("Hasty", X), ("k",), "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'", "OP-D11")
ontology_query("op_d13_all_in_head", "v:Building rdfs:subClassOf [ a owl:Restriction ; owl:onProperty v:placed ; owl:allValuesFrom v:BuildingOrder ] .", _v("BuildingOrder", X), ("k",), "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "OP-D13")
ontology_query("op_d15_has_value", '[ a owl:Restriction ; owl:onProperty v:nation ; owl:hasValue 3 ] rdfs:subClassOf v:Three .', _v("Three", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3", "OP-D15")
ontology_query("op_d16_complement", "v:NearBuilding a owl:Class ; owl:intersectionOf ( v:Building [ a owl:Class ; owl:complementOf v:Far ] ) .", _v("NearBuilding", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_nationkey > 12", "OP-D16")
ontology_query("op_d17_not_value", "v:NotThree a owl:Class ; owl:intersectionOf ( v:Building [ a owl:Class ; owl:complementOf [ a owl:Restriction ; owl:onProperty v:nation ; owl:hasValue 3 ] ] ) .", _v("NotThree", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3", "OP-D17")
ontology_query("op_d18_not_some", "v:Calm a owl:Class ; owl:intersectionOf ( v:Customer [ a owl:Class ; owl:complementOf [ a owl:Restriction ; owl:onProperty v:placed ; owl:someValuesFrom v:Urgent ] ] ) .", _v("Calm", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "OP-D18")
ontology_query("op_d19_named_complement", "v:Near owl:complementOf v:Far .", _v("Near", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE NOT c_nationkey > 12", "OP-D19")
ontology_query("op_d20_nested", "[ a owl:Class ; owl:intersectionOf ( v:Far [ a owl:Class ; owl:unionOf ( v:Building v:Machinery ) ] ) ] rdfs:subClassOf v:Picked .", _v("Picked", X), ("k",), f"{_BM} AND c_nationkey > 12", "OP-D20")
ontology_query("op_d21_nominal", "v:Chosen a owl:Class ; owl:oneOf ( 1 4 ) . [ a owl:Restriction ; owl:onProperty v:nation ; owl:someValuesFrom v:Chosen ] rdfs:subClassOf v:Picked .", _v("Picked", X), ("k",), "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (1, 4)", "OP-D21")
ontology_query("op_d22_functional", "v:region a owl:InverseFunctionalProperty .", Atom("<http://www.w3.org/2002/07/owl#sameAs>", (X, Y)), ("a", "b"), "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "OP-D22")


@query("SELECT o_custkey AS k, 1::BIGINT AS nodes FROM orders GROUP BY o_custkey")
def op_d12_some_in_head(spark, sf_dir):
    """OP-D12: an existential restriction on the right side."""
    e = _ontology(spark, sf_dir, "v:placed rdfs:domain v:Buyer . v:Buyer rdfs:subClassOf [ a owl:Restriction ; owl:onProperty v:holds ; owl:someValuesFrom v:Account ] .")
    found = answer(e, (_v("holds", X, Y), _v("Account", Y)), "k", "node")
    return found.groupBy("k").agg(F.countDistinct("node").alias("nodes"))


_RDF, _RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
_THINGS = """WITH c AS (SELECT '<urn:customer/' || c_custkey || '>' AS x, '<urn:nation/' || c_nationkey || '>' AS y FROM customer), o AS (SELECT '<urn:order/' || o_orderkey || '>' AS x, '<urn:customer/' || o_custkey || '>' AS y FROM orders)"""


@query(f"""{_THINGS}, t AS (SELECT x AS s, '<urn:v#Customer>' AS o FROM c UNION ALL SELECT x, '<urn:v#Party>' FROM c UNION ALL SELECT y, '<urn:v#Place>' FROM c UNION ALL SELECT x, '<urn:v#Order>' FROM o UNION ALL SELECT y, '<urn:v#Party>' FROM o
        UNION ALL SELECT y, '<urn:v#Customer>' FROM o UNION ALL SELECT x, '<{_RDFS}Resource>' FROM (SELECT x FROM c UNION SELECT y FROM c UNION SELECT x FROM o UNION SELECT y FROM o))
    SELECT DISTINCT s, o FROM t""")
def op_d26_rdfs(spark, sf_dir):
    """OP-D26: all classes of customers, orders and nations under the RDFS rules."""
    t = tables(spark, sf_dir)
    node = lambda kind, key: F.concat(F.lit(f"<urn:{kind}/"), key, F.lit(">"))
    rows = t("customer").select(node("customer", "c_custkey").alias("s"), F.lit("<urn:v#livesIn>").alias("p"), node("nation", "c_nationkey").alias("o"))
    rows = rows.union(t("orders").select(node("order", "o_orderkey"), F.lit("<urn:v#placedBy>"), node("customer", "o_custkey")))
    e = Engine(spark).add_triples(rows)
    e.load_n3(OWL_PREFIX + "v:livesIn rdfs:domain v:Customer ; rdfs:range v:Place . v:placedBy rdfs:domain v:Order ; rdfs:range v:Customer . v:Customer rdfs:subClassOf v:Party .")
    e.load_n3(RDFS)
    return e.closure().where(f"p = '{T_TYPE}' and s rlike '^<urn:(customer|order|nation)/'").select("s", "o")


def _rdfs_types(spark, sf_dir):
    """All classes of nations and regions under the RDFS rules, rdfs:Resource among them."""
    e = _nations(spark, sf_dir)
    e.load_n3(OWL_PREFIX + "v:inRegion rdfs:domain v:Nation ; rdfs:range v:Region . v:Nation rdfs:subClassOf v:Place . v:Region rdfs:subClassOf v:Place .")
    e.load_n3(RDFS)
    return e.closure().where(f"p = '{T_TYPE}' and (s like '<urn:nation%' or s like '<urn:region%')").select("s", "o")


_OWL = "http://www.w3.org/2002/07/owl#"


@query(f"""WITH n AS (SELECT '<urn:nation/' || n_nationkey || '>' AS x, n_regionkey AS r FROM nation)
    SELECT a.x AS s, '<{_OWL}differentFrom>' AS p, b.x AS o FROM n a, n b WHERE (a.r = 1 AND b.r = 2) OR (a.r = 2 AND b.r = 1)
    UNION ALL SELECT '<urn:v#hosts>', '<{_RDF}type>', '<{_OWL}InverseFunctionalProperty>' UNION ALL SELECT '<urn:v#madeOf>', '<{_RDF}type>', '<{_OWL}FunctionalProperty>'
    UNION ALL SELECT '<urn:v#Two>', '<{_OWL}disjointWith>', '<urn:v#One>'""")
def op_d24_support(spark, sf_dir):
    """OP-D24: what the support rules add: kinds of inverse and singleton-ranged properties, symmetry, different members of disjoint classes."""
    n = tables(spark, sf_dir)("nation")
    member = n.where("n_regionkey in (1, 2)").select(F.concat(F.lit("<urn:nation/"), "n_nationkey", F.lit(">")).alias("s"), F.lit(T_TYPE).alias("p"), F.when(F.col("n_regionkey") == 1, F.lit("<urn:v#One>")).otherwise(F.lit("<urn:v#Two>")).alias("o"))
    e = Engine(spark).add_triples(member)
    e.load_n3(OWL_PREFIX + "v:One owl:disjointWith v:Two . v:in owl:inverseOf v:hosts . v:in a owl:FunctionalProperty . v:Only owl:oneOf ( v:thing ) . v:madeOf rdfs:range v:Only .")
    e.load_n3(SUPPORT)
    return e.inferred()


@query("""WITH n AS (SELECT '<urn:nation/' || n_nationkey || '>' AS x, '<urn:region/' || n_regionkey || '>' AS y FROM nation)
    SELECT y AS s, '<urn:v#contains>' AS p, x AS o FROM n UNION SELECT '<urn:v#world>', '<urn:v#contains>', x FROM n UNION SELECT '<urn:v#world>', '<urn:v#contains>', y FROM n
    UNION SELECT x, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:v#Worldly>' FROM n UNION SELECT y, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:v#Worldly>' FROM n""")
def op_d27_pd(spark, sf_dir):
    """OP-D27: the pD* rules: sub-properties, a transitive one, its inverse, and a class by value."""
    e = _nations(spark, sf_dir)
    e.add_triples(tables(spark, sf_dir)("region").select(F.concat(F.lit("<urn:region/"), "r_regionkey", F.lit(">")), F.lit("<urn:v#within>"), F.lit("<urn:v#world>")))
    e.load_n3(OWL_PREFIX + """v:inRegion rdfs:subPropertyOf v:within . v:within a owl:TransitiveProperty . v:contains owl:inverseOf v:within .
        v:Worldly owl:equivalentClass [ a owl:Restriction ; owl:onProperty v:within ; owl:hasValue v:world ] .""")
    e.load_n3(PD)
    return e.closure().where(f"p = '<urn:v#contains>' or (p = '{T_TYPE}' and o = '<urn:v#Worldly>')")


T_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


@query("SELECT '<urn:nation/' || a.n_nationkey || '>' AS s, '<urn:v#near>' AS p, '<urn:nation/' || b.n_nationkey || '>' AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def op_s8_rif(spark, sf_dir):
    """OP-S8: a RIF-Core rule."""
    from .sources import rif

    iri = 'type="http://www.w3.org/2007/rif#iri"'
    frame = lambda v, p, o: f"<Frame><object><Var>{v}</Var></object><slot><Const {iri}>urn:v#{p}</Const><Var>{o}</Var></slot></Frame>"
    text = f"""<Document xmlns="http://www.w3.org/2007/rif#"><payload><Group><sentence><Forall><declare><Var>a</Var></declare><declare><Var>b</Var></declare><declare><Var>r</Var></declare><formula><Implies>
        <if><And><formula>{frame("a", "inRegion", "r")}</formula><formula>{frame("b", "inRegion", "r")}</formula></And></if><then>{frame("a", "near", "b")}</then></Implies></formula></Forall></sentence></Group></payload></Document>"""
    return _nations(spark, sf_dir).add_rules(rif.parse(text).rules).inferred()


@query("""WITH n AS (SELECT '<urn:v#Nation' || n_nationkey || '>' AS x, '<urn:v#Region' || n_regionkey || '>' AS y FROM nation), c AS (SELECT x FROM n UNION SELECT y FROM n UNION SELECT '<urn:v#Place>' UNION SELECT '<urn:v#Local>')
    SELECT x AS sub, x AS super FROM c UNION SELECT x, '<http://www.w3.org/2002/07/owl#Thing>' FROM c UNION SELECT y, '<urn:v#Place>' FROM n UNION SELECT x, '<urn:v#Local>' FROM n""")
def op_d30_el_classification(spark, sf_dir):
    """OP-D30 to OP-D32: classification of an EL TBox; a nation is part of a region, regions are places, parts of places are local."""
    from .owl.elh import classify

    pairs = tables(spark, sf_dir)("nation").select("n_nationkey", "n_regionkey").collect()  # a TBox: 25 axioms
    some = lambda c: f"[ a owl:Restriction ; owl:onProperty v:partOf ; owl:someValuesFrom {c} ]"
    text = "".join(f"v:Nation{n} rdfs:subClassOf {some(f'v:Region{r}')} . v:Region{r} rdfs:subClassOf v:Place .\n" for n, r in pairs)
    return classify(spark, OWL_PREFIX + text + f"{some('v:Place')} rdfs:subClassOf v:Local .")


@query("""SELECT DISTINCT o_custkey AS custkey, l_partkey AS partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3""")
def op_g7_hybrid_goal(spark, sf_dir):
    """OP-G7, OP-G9: a goal with a constant over a derived predicate that rests on stored ones."""
    e = rules(engine(spark, sf_dir), Atom("bought", (C, P, N)) <= Atom("orderCust", (O, C)) & Atom("orderedPart", (O, P)) & Atom("custNation", (C, N)))
    return e.query(Atom("bought", (C, P, 3)), "magic").toDF("custkey", "partkey")
