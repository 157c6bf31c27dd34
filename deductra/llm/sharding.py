"""Minimax contiguous sharding, DataFrame functions only.

Equal texts are one atomic group. Groups stand in the order of a 64-bit hash of their text.
The smallest feasible shard capacity over their sizes is found by binary search, each
capacity checked greedily. The driver never sees all groups: it starts with the sums over
the hash's first ``BITS`` bits and splits only the parts that decide something, those next
to a cut and those that stop the greedy run under the next smaller capacity, until all of
these are single groups. So the capacity is the exact minimum over the atomic groups, and
each cut lies between two groups; a round collects at most about 120 parts in ``SPLIT`` each.

Of the cuts under that capacity, those with the least sum of squared sizes are taken (a
dynamic programme over the parts), so that a text that weighs more than a shard stays whole
and the others share the rest; all shards are used if there are as many groups.

Slots are numbered in two levels, so a shard with most rows is still numbered by many tasks.

Defined results. Null text: as empty, size ``EXTRA``. Equal texts: one shard. Null doc_id
and repeated rows: each row has its own slot. Very long texts: only their hash, length and
checksum are kept. Empty table: no rows. Other columns: not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, scratch, slots

SHARDS, EXTRA, BITS, SPLIT = 40, 16, 12, 256


def solve(sizes: np.ndarray, shards: int) -> tuple[list[int], set[int]]:
    """The ends of as many runs as there can be, under the least feasible capacity, with the least sum of squared sizes; and the items that decide them."""
    n = len(sizes)
    k = min(shards, n)
    if not k:
        return [], set()
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def reached(capacity: int) -> list[int]:
        """How many items fit greedily in 0, 1, ... k shards."""
        out = [0]
        for _ in range(k):
            out.append(max(out[-1], int(np.searchsorted(total, total[out[-1]] + capacity, "right")) - 1))
        return out

    low, high = int(max(sizes)), int(total[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle)[k] >= n else (middle + 1, high)
    ends = _balanced(total, low, reached(low), k)
    return ends, {i for i in (*reached(low - 1), *ends[:-1], *[e - 1 for e in ends[:-1]]) if i < n}


def cuts(sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """The last group of each shard over ordered (group, size)."""
    ends, _ = solve(np.array([s for _, s in sizes], np.int64), shards)
    return [sizes[e - 1][0] for e in ends]


def _parts(groups: DataFrame, some: list[tuple[int, int]] | None, shift: int) -> list[tuple[int, int, int, int]]:
    """start, shift, size and number of groups of each part of ``2**shift`` hashes, within the ranges ``some`` (first, last)."""
    if some is not None:
        groups = groups.where(" or ".join(f"h between {a}L and {b}L" if a > -(2**63) else f"h <= {b}L" for a, b in some))
    summed = groups.groupBy(F.shiftright("h", shift).alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return [(r["p"] << shift, shift, r["size"], r["n"]) for r in summed.collect()]


def boundaries(groups: DataFrame, shards: int, bits: int = BITS) -> list[int]:
    """The last hash of each shard but the last over ``groups`` (h, size)."""
    parts = sorted(_parts(groups, None, 64 - bits))
    while True:
        ends, decide = solve(np.array([p[2] for p in parts], np.int64), shards)
        if len(parts) < shards:
            decide = set(range(len(parts)))
        open_ = [i for i in decide if parts[i][3] > 1]
        if not open_:
            return [parts[e - 1][0] + (1 << parts[e - 1][1]) - 1 for e in ends[:-1]]
        left = [p for i, p in enumerate(parts) if i not in set(open_)]
        by_shift: dict[int, list] = {}
        for i in open_:
            start, shift, _, n = parts[i]
            by_shift.setdefault(0 if n <= SPLIT else max(0, shift - (SPLIT - 1).bit_length()), []).append((start, start + (1 << shift) - 1))
        parts = sorted(left + [p for shift, some in by_shift.items() for p in _parts(groups, some, shift)])


def _balanced(total: np.ndarray, capacity: int, reach: list[int], k: int) -> list[int]:
    """The ends of k runs, none over the capacity, with the least sum of squares.

    The best start of a last run never moves back as its end moves on, so that a layer of
    the dynamic programme is filled middle by middle, all middles of a depth at once.
    """
    n = len(total) - 1
    first = np.searchsorted(total, total - capacity)  # the earliest start of a run by its end
    size = total.astype(np.float64)
    best, starts = np.zeros(n + 1), []
    for j in range(1, k + 1):
        lo, hi = np.array([j]), np.array([min(reach[j], n - k + j)])
        left, right = np.array([j - 1]), np.array([min(reach[j - 1], n - k + j - 1)])
        found, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int32)
        while len(lo):
            end = (lo + hi) // 2
            a, b = np.maximum(left, first[end]), np.minimum(right, end - 1)
            at = np.concatenate(([0], np.cumsum(b - a + 1)))
            of = np.repeat(np.arange(len(end)), b - a + 1)
            s = np.arange(at[-1]) - at[of] + a[of]
            cost = best[s] + (size[end[of]] - size[s]) ** 2
            least = np.minimum.reduceat(cost, at[:-1])
            hits = np.flatnonzero(cost == least[of])
            chosen = s[hits[np.searchsorted(hits, at[:-1])]]
            found[end], start[end] = least, chosen
            lo, hi, left, right = np.concatenate((lo, end + 1)), np.concatenate((end - 1, hi)), np.concatenate((left, chosen)), np.concatenate((chosen, right))
            more = lo <= hi
            lo, hi, left, right = lo[more], hi[more], left[more], right[more]
        best = found
        starts.append(start)
    ends = [n]
    for start in reversed(starts[1:]):
        ends.append(int(start[ends[-1]]))
    return ends[::-1]


def shard(docs: DataFrame, shards: int = SHARDS, extra: int = EXTRA, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + extra).cast("long").alias("size")
    with scratch():
        groups = docs.select(F.xxhash64(text).alias("h"), size).groupBy("h").agg(F.sum("size").alias("size"))
        ends = boundaries(cut(groups.repartitionByRange("h").sortWithinPartitions("h")), shards, bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    bounds = F.array(*[F.lit(e) for e in ends]).cast("array<bigint>") if ends else F.array().cast("array<bigint>")
    found = F.aggregate(bounds, F.lit(0), lambda n, e: n + F.when(e < F.col("h"), 1).otherwise(0))
    placed = rows.select("doc_id", "size", "text_crc32", found.cast("int").alias("shard"))
    numbered = slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
