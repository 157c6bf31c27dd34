"""Cases that hashes and shared doc_ids could get wrong, against brute force."""

import random
from collections import Counter

import pytest

from deductra.llm import _windows, minhash, spotsigs, substring_dedup, suffix_dedup
from test_minhash import brute as brute_groups
from test_windows import brute_bytes, brute_words


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


ONE, TWO = thue_morse(1024), thue_morse(1024, "b", "a")


def results(df):
    return Counter((r[0], tuple(r)[1:]) for r in df.collect())


def want(rows, brute, length):
    """Brute-force results where texts that share an id are documents of their own, ordered by their place in ``rows``."""
    keys = {}
    for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))):
        keys[r] = i
    by_key = brute([(i, t) for (d, t), i in keys.items()], length)
    return Counter((d, by_key[keys[d, t]]) for d, t in rows)


def test_words_that_an_algebraic_hash_confuses(spark):
    words = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*words, ONE])), (2, " ".join([*words, TWO]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring_dedup.removed(df).collect())
    rows = [(i, " ".join(x if (i + j) % 2 else y for j in range(40))) for i, (x, y) in enumerate([(ONE, TWO), (TWO + "x", ONE + "x")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_groups(rows, 4)
    assert not set(spotsigs.signatures(f"the {ONE} x y").tolist()) & set(spotsigs.signatures(f"the {TWO} x y").tolist())


def test_bytes_that_an_algebraic_hash_confuses(spark):
    rows = [(1, ONE), (2, TWO), (3, ONE[:512] + TWO[:512])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length, gram in ((100, 40), (64, 8)):
        assert results(suffix_dedup.removed(df, length, gram)) == want(rows, brute_bytes, length)


def shared_ids(length):
    r = random.Random(length)
    p, q, u = (" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(9)) for _ in range(60)) for _ in range(3))
    return [(None, p), (1, p), (None, q), (7, p), (7, u), (7, u), (None, q), (None, None), (None, ""), (9, None)]


def test_windows_of_rows_that_share_an_id(spark):
    rows = shared_ids(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as _doc", "3 as k").repartition(3)
    got = results(substring_dedup.removed(df))
    assert got == want(rows, brute_words, 35)
    got = results(suffix_dedup.removed(df))
    assert sum(got.values()) == len(rows)
    # q, u and one copy of p are whole; the other two copies of p lose everything
    assert Counter(r[1][1] for r in got.elements()) == Counter({0: 8, len(rows[0][1]): 2})
    kept = suffix_dedup.kept_text(df)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_groups_of_rows_that_share_an_id(spark):
    rows = shared_ids(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as _doc").repartition(3)
    out = minhash.near_duplicates(df, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_groups(rows, 4)
    kept = minhash.keep_one(df)
    texts = Counter(r.text for r in kept.collect())
    assert kept.columns == df.columns
    assert texts[rows[0][1]] == texts[rows[2][1]] == texts[rows[4][1]] == 1 and None in texts and "" in texts


@pytest.mark.parametrize("piece", [64, 1000])
def test_pieces_of_long_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(_windows, "PIECE", piece)
    monkeypatch.setattr(_windows, "HELD", 50)
    r = random.Random(piece)
    words = [f"w{r.randrange(30)}" for _ in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:700])), (3, " ".join(words[:150] + ["other"] * 80 + words[150:400]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(suffix_dedup.removed(df)) == want(rows, brute_bytes, 100)
    assert results(substring_dedup.removed(df)) == want(rows, brute_words, 35)


def test_a_text_over_one_batch(spark):
    long = " ".join(f"w{i % 5003}x{i}" for i in range(150_000))
    rows = [(1, long), (2, long[500_000:]), (3, long[:5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed(df).collect()}
    assert got == {1: 0, 2: len(long) - 500_000, 3: 5000}
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 4).collect()}
    assert found == {1: 1, 2: 2, 3: 3}
