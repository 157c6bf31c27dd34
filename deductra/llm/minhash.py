"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, both equal for two sets with a probability of their Jaccard similarity; so 80
hash evaluations make 160 values, banded 32 x 5 (a pair at 0.8 shares no band with a
probability of 3e-6).

Words are told apart by 128-bit BLAKE2b digests, shingles by a 64-bit value that is not linear
in its words, sets by the digest of their sorted shingles. Equal sets are one
class, represented by its smallest document. In each band bucket the representatives,
sorted, are compared with the first and with their neighbour, which is linear in the
bucket; a bucket is dealt by ranges, so a hot one lies in many tasks, whose first members
are compared in turn. Candidates of unlike sizes are left out at once, the others are
confirmed on full shingle sets, streamed beside their bucket's first document, ``GROUP`` of
them a task. Confirmed links make components. Buckets in which several components remain
are then compared whole, block against block, by matrix products that give all exact
similarities of a block pair and hand on one link for each two components they join. So every pair
that shares a bucket is confirmed, refuted, or already connected, and no pairs are
emitted. Texts are shuffled, sets are not. A block holds about ``BLOCK`` documents and
``SHINGLES`` shingles.

Defined results. Null or empty text, or no words: empty set, linked with nothing, kept.
Fewer words than a shingle: the whole sequence as one. Ties: the smallest doc_id stands for
its group. Null doc_id: before all others. Texts that share a doc_id, nulls included, are
documents of their own, in the order of a hash of the text; rows that repeat doc_id and text
get equal results, and ``keep_one`` keeps one of them. Very long texts: a task holds the sets
of two documents, or one block's. Empty table: no rows. Other columns are not read by
``near_duplicates``, kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Documents, cut, fresh, scratch, small_batches
from .components import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 80, 32, 5
#: Members compared by one task with one first document.
GROUP = 256
#: A text's UTF-8 -> its set: distinct 64-bit hashes, sorted.
SetOf = Callable[[bytes], np.ndarray]
#: Members and shingles of a block, and shared shingles of a matrix product: they bound a task's memory.
BLOCK, SHINGLES, COLUMNS = 1024, 1 << 20, 2048
U = np.uint64


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Distinct hashed shingles of a text, A-Z lowered, sorted."""
    return T.shingles(T.word_digests(T.words(bytes(data).lower()))[:, 0], words)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_keys(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key a band, from both extremes of half as many permutations as there are values."""
    half = bands * rows // 2
    a, b = _permutations(half)
    low, high = np.full(half, ~U(0)), np.zeros(half, np.uint64)
    for g in range(0, len(s), 4096):
        x = s[None, g : g + 4096] * a[:, None]
        x += b[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    values = np.concatenate((low, high)).reshape(bands, rows)
    key = T.mix(np.arange(bands, dtype=np.uint64))
    for i in range(rows):
        key = T.mix(key * U(0x9E3779B97F4A7C15) + values[:, i])
    return key.view(np.int64)


_SIGNED = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, rows = {}, []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(text.as_buffer(), words) if text.is_valid else np.zeros(0, np.uint64)
                h = T.set_digest(s)
                if h not in known:
                    known[h] = band_keys(s) if len(s) else []
                rows.append((doc, len(s), *h, known[h]))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SIGNED)], schema=_SIGNED)

    return run


_STAR = pa.schema([("key", pa.int64()), ("lead", pa.int64()), ("before", pa.int64()), ("rep", pa.int64()), ("lead_n", pa.int64()), ("n", pa.int64()), ("sub", pa.int64()), ("to_lead", pa.bool_()), ("to_before", pa.bool_()), ("edge", pa.bool_())])


def _stars(similarity: int):
    """Over (key, rep, n) sorted: each further member of a bucket with the first and with its neighbour, and whether their sizes allow a link.

    ``edge``: the first members of a partition's first and last bucket, which other partitions may share.
    """

    def near(x, y):
        return 100 * np.minimum(x, y) >= similarity * np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, its first member with its size, the member before with its size, members so far
        top = True
        for b in batches:
            key, rep, n = (c.to_numpy() for c in b.columns)
            if not len(key):
                continue
            if last is None:
                last = (~key[0], 0, 0, 0, 0, 0)
            same = np.empty(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[0] = key[0] == last[0]
            index = np.arange(len(key))
            begin = np.maximum.accumulate(np.where(same, -1, index))
            inside = begin >= 0
            lead, lead_n = np.where(inside, rep[begin], last[1]), np.where(inside, n[begin], last[2])
            nth = np.where(inside, index - begin, index + last[5])
            before, before_n = np.concatenate(([last[3]], rep[:-1])), np.concatenate(([last[4]], n[:-1]))
            to_lead, to_before = near(n, lead_n), near(n, before_n) & (nth > 1)
            last = (key[-1], lead[-1], lead_n[-1], rep[-1], n[-1], nth[-1] + 1)
            cols = [x[same] for x in (key, lead, before, rep, lead_n, n, nth // GROUP, to_lead, to_before, np.zeros(len(key), bool))]
            if top:
                top = False
                cols = [np.concatenate((np.array([x]), c)) for x, c in zip((key[0], rep[0], rep[0], rep[0], n[0], n[0], 0, False, False, True), cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STAR)], schema=_STAR)
        if last is not None:
            row = (last[0], last[1], last[1], last[1], last[2], last[2], 0, False, False, True)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _STAR)], schema=_STAR)

    return run


def _confirm(set_of: SetOf, similarity: int):
    """Over rows sorted by group: the first row's set against each other one, and each against its neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead, prev = None, None, None

        def linked(x, y) -> bool:
            if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= similarity * (len(x) + len(y) - both)

        for b in batches:
            u, v = [], []
            for g, sub, rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                s = set_of(text.as_buffer())
                if (g, sub) != group:
                    group, lead, prev = (g, sub), None, None
                if rep == g:
                    lead = s
                    continue
                if lead is not None and linked(lead, s):
                    u.append(g), v.append(rep)
                if prev is not None and linked(prev[1], s):
                    u.append(prev[0]), v.append(rep)
                prev = rep, s
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, set_of: SetOf, similarity: int) -> DataFrame:
    """Confirmed links among ``pairs`` (u, v, sub). The sets of one u's partners with one sub are streamed beside its own."""
    heads = pairs.select("u", "sub").distinct().select("u", "sub", F.col("u").alias("doc"))
    wanted = pairs.select("u", "sub", F.col("v").alias("doc")).union(heads)
    rows = texts.join(wanted, "doc").select("u", "sub", "doc", "data")
    dealt = rows.repartition("u", "sub").sortWithinPartitions("u", "sub", F.col("doc") != F.col("u"), "doc")
    return dealt.mapInArrow(_confirm(set_of, similarity), "u long, v long")


def _compare_blocks(set_of: SetOf, similarity: int):
    """Over rows sorted by key and block pair: exact similarities of all members at once, as matrix products over shared shingles.

    Only links between different components are given, and of these one for each two that it joins: fewer than
    there are members, and the same components follow.
    """

    def links(sets, reps, comps):
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        values.sort()
        values = values[1:][values[1:] == values[:-1]]
        values = values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
        both = np.zeros((len(sets), len(sets)), np.float32)
        for g in range(0, len(values), COLUMNS):
            part = values[g : g + COLUMNS]
            x = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(x, sets):
                s = s[s.searchsorted(part[0]) : s.searchsorted(part[-1], "right")]
                at = part.searchsorted(s)
                row[at[part[at] == s]] = 1
            both += x @ x.T
        label = np.unique(np.array(comps), return_inverse=True)[1]
        us, vs = [], []
        for i, row in enumerate(both):
            row = row.astype(np.int64)
            v = np.flatnonzero((100 * row >= similarity * (sizes + sizes[i] - row)) & (label != label[i]))
            if len(v):
                joined, first = np.unique(label[v], return_index=True)
                us += [reps[i]] * len(first)
                vs += [reps[k] for k in v[first]]
                label[np.isin(label, joined)] = label[i]
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, reps, comps = None, [], [], []
        for b in batches:
            us, vs = [], []
            for *g, rep, comp, text in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                if g != group:
                    if len(sets) > 1:
                        u, v = links(sets, reps, comps)
                        us += u
                        vs += v
                    group, sets, reps, comps = g, [], [], []
                sets.append(set_of(text.as_buffer())), reps.append(rep), comps.append(comp)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if len(sets) > 1:
            u, v = links(sets, reps, comps)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _across(rest: DataFrame, texts: DataFrame, set_of: SetOf, similarity: int) -> DataFrame:
    """Links between components that share a bucket (key, rep, component, blocks). Large buckets are compared block by block."""
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = rest.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), F.col("rep").alias("doc"), "component")
    rows = texts.join(wanted, "doc").select("key", "one", "two", "doc", "component", "data")
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "doc").mapInArrow(_compare_blocks(set_of, similarity), "u long, v long")


def groups(texts: DataFrame, buckets: DataFrame, set_of: SetOf, similarity: int) -> DataFrame:
    """node, component of the documents of ``buckets`` (key, rep, n: size) linked by an exact similarity of their sets.

    Only pairs that share a bucket are looked at, and all of these, but those that other
    links have connected already. ``texts`` has ``doc``, each once, and ``data``.
    """
    star = "key long, lead long, before long, rep long, lead_n long, n long, sub long, to_lead boolean, to_before boolean, edge boolean"
    inner = cut(buckets.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(_stars(similarity), star))
    edges = inner.where("edge").select("key", "rep", "n").distinct()  # at most two a partition
    outer = edges.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_stars(similarity), star)
    stars = cut(inner.union(outer))
    pairs = stars.where("to_lead").select(F.col("lead").alias("u"), F.col("rep").alias("v"), "sub").union(stars.where("to_before").select("before", "rep", "sub"))
    pairs = pairs.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("sub").alias("sub"))
    links = cut(_links(pairs, texts, set_of, similarity))
    found = cut(components(links))
    # buckets in which several components remain: across them every pair is looked at
    belongs = found.select(F.col("node").alias("rep"), "component")
    leads = stars.select("key", F.col("lead").alias("rep"), F.col("lead_n").alias("n")).distinct()
    inside = leads.union(stars.where("rep <> lead").select("key", "rep", "n"))
    inside = inside.join(belongs, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(SHINGLES))).cast("int")
    counted = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("blocks"))
    rest = inside.join(counted.where("low < high").select("key", "blocks"), "key")
    links2 = cut(_across(rest, texts, set_of, similarity))
    return found if links2.isEmpty() else cut(components(links.union(links2)))


def members(signed: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """doc, n (a set's size) and component of every row of ``signed`` (doc, n, h1, h2)."""
    whole = reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc", "n", "h1", "h2").join(whole, ["h1", "h2", "n"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def named(own: Documents, found: DataFrame, count: str) -> DataFrame:
    """doc_id, ``count``, component_id and kept of every row of the table, out of doc, n and component."""
    out = own.named(own.expanded(found), doc_id="doc", component_id="component")
    return out.select("doc_id", F.col("n").alias(count), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(own: Documents, words: int, similarity: int) -> DataFrame:
    """doc, n and component of every document."""
    small_batches(own.docs.sparkSession)
    texts = own.texts().select("doc", F.col("text").cast("binary").alias("data"))
    with scratch():
        signed = cut(texts.mapInArrow(_sign(words), "doc long, n long, h1 long, h2 long, bands array<bigint>"))
        reps = cut(signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep")))
        banded = signed.select(F.col("doc").alias("rep"), "bands").join(reps.select("rep", "n"), "rep")
        buckets = banded.select(F.explode("bands").alias("key"), "rep", "n")
        return cut(members(signed, reps, groups(texts, buckets, lambda data: shingle_set(data, words), similarity)), keep=True)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept, a row for each row."""
    own = Documents(docs)
    return named(own, _classes(own, words, similarity), "n_shingles")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that stand behind another one of their near-duplicate group."""
    own = Documents(docs)
    key = fresh(docs, "_doc")
    gone = _classes(own, words, similarity).where("doc <> component").select(F.col("doc").alias(key))
    left = own.tagged(key).join(gone, key, "left_anti")
    return (left if own.ranks is None else left.dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in docs.columns])
