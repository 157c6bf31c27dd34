"""Joins as library calls: strategies as hints, and any predicate as theta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet the other side's as one block.
BLOCK = 1024
#: Types of keys that are compared otherwise in an array than in a join.
INEXACT = ("float", "double", "array", "map", "struct", "interval", "variant", "collate")
#: A side of a test: a DataFrame, or its columns by name.
Sides = DataFrame | dict[str, Column]


def hash_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Builds on the right side."""
    return left.join(right.hint("shuffle_hash"), on)


def merge_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Sorts both sides; also what a bisecting join amounts to on a cluster."""
    return left.join(right.hint("merge"), on)


def theta_join(left: DataFrame, right: DataFrame, test: Callable[[Sides, Sides], Column], equal: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """Any Boolean expression over both sides. With ``equal`` columns the test filters an equi-join; without, it is a nested loop.

    ``distinct``: the columns beside the ``equal`` ones, each combination once; the test, too, sees only these.
    """
    if distinct and equal:
        return pairs(left, right, equal, test=test)
    if equal:
        l, r = left.alias("l"), right.alias("r")
        cond = None
        for c in equal:
            e = left[c] == right[c]
            cond = e if cond is None else cond & e
        out = l.join(r, cond & test(left, right)).drop(*[right[c] for c in equal])
    else:
        out = left.join(right, test(left, right))
    return out.distinct() if distinct else out


def pairs(left: DataFrame, right: DataFrame, on: list[str], keep: list[str] | None = None, test: Callable[[Sides, Sides], Column] | None = None) -> DataFrame:
    """The distinct rows of an equi-join without its columns ``on``, but for those in ``keep``: left's others, ``keep``, right's others.

    Few keys with many rows each give far more pairs than rows, so no pair is shuffled, sorted or
    kept. Duplicates go before the join; a pair that meets under several keys is given under the
    least of these. Blocks of about ``BLOCK`` rows of one key meet, and the pairs of blocks are dealt over all tasks.
    """
    keep = keep or []
    mine, theirs = ([c for c in df.columns if c not in on] for df in (left, right))
    kinds, other = dict(left.dtypes), dict(right.dtypes)
    if not mine or not theirs or any(kinds[c] != other[c] or any(k in kinds[c] for k in INEXACT) for c in on):
        cond, out = [left[c] == right[c] for c in on], [*[left[c] for c in (*mine, *keep)], *[right[c] for c in theirs]]
        return left.join(right, [*cond, test(left, right)] if test else cond).select(*out).distinct()

    def blocks(df: DataFrame, own: list[str], name: str) -> DataFrame:
        """key, a number, and the rows of that block: their columns, and all their keys if there are several."""
        df = df.where(" and ".join(f"`{c}` is not null" for c in on))
        df = df.select(F.struct(*own).alias("row"), F.struct(*on).alias("key"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
        df = df.groupBy("row", *[f"k{i}" for i in range(len(keep))]).agg(F.collect_set("key").alias("keys"))
        df = df.select("row", F.when(F.size("keys") > 1, F.col("keys")).alias("keys"), F.explode("keys").alias("key"))
        df = df.join(df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("of")), "key")
        df = df.groupBy("key", F.pmod(F.xxhash64("row"), F.col("of")).alias(f"{name}_block"))
        return df.agg(F.collect_list(F.struct("row", "keys")).alias(f"{name}_rows"))

    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = blocks(left, mine, "l").join(blocks(right, theirs, "r"), "key").repartition(tasks, "key", "l_block", "r_block")
    # the lambda keeps this Generate out of whole-stage code, which would hold all pairs of two blocks before it passes on the first
    out = met.select("key", "r_rows", F.explode(F.transform("l_rows", lambda x: x)).alias("l"))
    l_row, r_row = ([f"{s}{i}" for i in range(len(names))] for s, names in (("l", mine), ("r", theirs)))
    out = out.select("key", "r_rows", *[F.col("l.row")[c].alias(a) for a, c in zip(l_row, mine)], F.col("l.keys").alias("l_keys")).withColumn("r", F.explode("r_rows"))
    out = out.select("key", *l_row, "l_keys", *[F.col("r.row")[c].alias(a) for a, c in zip(r_row, theirs)], F.col("r.keys").alias("r_keys"))
    out = out.where(F.expr("l_keys is null or r_keys is null or array_min(array_intersect(l_keys, r_keys)) = key"))
    if test:
        out = out.where(test(*[{c: F.col(a) for a, c in zip(made, names)} for made, names in ((l_row, mine), (r_row, theirs))]))
    return out.select(*[F.col(a).alias(c) for a, c in zip(l_row, mine)], *[F.col("key")[c].alias(c) for c in keep], *[F.col(a).alias(c) for a, c in zip(r_row, theirs)])
