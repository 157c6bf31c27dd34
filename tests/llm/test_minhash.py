import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deductra.llm import minhash
from deductra.llm.components import components


def brute(rows, words, similarity=80):
    def sets(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[a] = b
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), (True, 10**9)), (d is not None, d or 0))
    return Counter((d, len(s[i]), low[find(i)][1] if low[find(i)][0] else None) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"W{i}é" for i in range(40)]
    rows = []
    for base in range(8):
        text = r.choices(vocab, k=r.choice([3, 10, 60, 150]))
        for _ in range(r.choice([1, 3, 25])):
            t = list(text)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                t = t[: -max(1, len(t) // 12)]
            rows.append((len(rows) * 7 % 1000 + 1, r.choice([" ", "  \n"]).join(t)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (None, "one two"), (2006, rows[0][1].lower()), (2007, "One two three four"), (2007, "One two three four")]
    return rows


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 5), (3, 1), (4, 2)])
def test_near_duplicates_against_brute_force(spark, seed, words):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as u", "2 as component", "3 as rep").repartition(3)
    out = minhash.near_duplicates(df, words).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = minhash.keep_one(df, words)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 4)
    assert minhash.near_duplicates(df.limit(0), 4).count() == 0


def test_min_and_max_estimate_similarity():
    r = np.random.default_rng(3)
    hits = []
    for _ in range(60):
        x = r.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = x[:320], x[80:]
        hits.append((minhash.band_keys(a, 160, 1) == minhash.band_keys(b, 160, 1)).mean())
    assert abs(np.mean(hits) - 240 / 400) < 0.03


def test_components(spark):
    r = random.Random(1)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(r.randrange(60), r.randrange(60)) for _ in range(40)]):
        parent = {}
        for u, v in edges:
            if u == v:
                continue
            a, b = parent.setdefault(u, {u}), parent.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    parent[x] = a
        df = spark.createDataFrame(edges, "u long, v long")
        assert {x.node: x.component for x in components(df).collect()} == {k: min(s) for k, s in parent.items()}


def test_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "COLUMNS", 5)
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # one family whose members are near the threshold to each other
        t = list(base)
        for _ in range(3):
            t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, 4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in out) == brute(rows, 4)


@pytest.mark.parametrize("own,kinds", [(10, 600), (10, 7), (60, 600), (127, 600)])
def test_block_pairs_give_few_links_in_little_memory(own, kinds):
    r = np.random.default_rng(own)
    base = np.unique(r.integers(1, 2**63, 128, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[own:], r.integers(1, 2**63, own, dtype=np.uint64)))) for _ in range(600)]
    sets[5], sets[400] = sets[300], sets[300][:120]
    comps = [i % kinds for i in range(600)]
    rows = [[7] * 600, [0] * 600, [1] * 600, list(range(600)), comps]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array([s.tobytes() for s in sets], pa.binary())], names=list("kabrct"))

    def joined(pairs):
        at = {c: c for c in comps}
        for u, v in pairs:
            old, new = at[comps[u]], at[comps[v]]
            at = {k: new if x == old else x for k, x in at.items()}
        return sorted(Counter(at.values()).values()), len({*at.values()})

    tracemalloc.start()
    got = [(u, v) for out in minhash._compare_blocks(lambda t: np.frombuffer(t, np.uint64), 80)(iter([batch])) for u, v in zip(*(c.to_pylist() for c in out.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = lambda x, y: 100 * (n := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - n)
    assert all(near(sets[u], sets[v]) and comps[u] != comps[v] for u, v in got)
    if own == 10:  # all are near
        assert joined(got) == ([kinds], 1)
    else:
        some = [(5, 300), (300, 400)] if own == 127 else [(i, j) for i in range(600) for j in range(i) if near(sets[i], sets[j])]
        assert joined(got) == joined(some)
    assert len(got) < kinds
    assert peak < 24 << 20
