import hashlib
import random

import pytest

from deductra.llm import substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, doc long, pls string"


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 5))) for _ in range(60)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(1, 50))))
        out.append((i * 3 - 5, r.choice(["\n", " "]).join(parts)))
    out += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab " * 300), (1004, "ab " * 300), (1005, "a" * 99), (None, passages[0]), (1006, out[3][1]), (1007, out[3][1])]
    out.append(out[7])
    return out


def brute_bytes(rows, length):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    from collections import Counter

    rows = list(set(rows))
    split = {d: [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] for d, t in rows}
    count = Counter(tuple(w[i : i + length]) for w in split.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed,length,gram", [(1, 100, 24), (2, 40, 8), (3, 30, 3)])
def test_suffix_dedup_against_brute_force(spark, seed, length, gram):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in rows], DOCS).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(df, length, gram).collect()}
    assert got == brute_bytes(rows, length)


@pytest.mark.parametrize("seed,length,gram", [(1, 35, 9), (2, 12, 4), (3, 6, 1)])
def test_substring_dedup_against_brute_force(spark, seed, length, gram):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in rows], DOCS).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.removed(df, length, gram).collect()}
    assert got == brute_words(rows, length)


def test_windows_cross_small_batches(spark, monkeypatch):
    from deductra.llm import _spark

    monkeypatch.setattr(_spark, "BATCH_ROWS", 3)
    rows = corpus(5)
    df = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in rows], DOCS).repartition(2)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(df, 30, 4).collect()}
    assert got == brute_bytes(rows, 30)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.removed(df, 8, 2).collect()}
    assert got == brute_words(rows, 8)


def test_kept_text_keeps_rows_and_columns(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in rows], DOCS)
    out = suffix_dedup.kept_text(df, 40, 8)
    assert out.columns == df.columns and out.count() == df.count()
    want = brute_bytes(rows, 40)
    for r in out.collect():
        assert (r.text is None) == (dict(rows)[r.doc_id] is None)
        if r.text is not None and r.text.encode() and want[r.doc_id][1] == 0:
            assert r.text == dict(rows)[r.doc_id]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffix_dedup.removed(df).count() == 0 and substring_dedup.removed(df).count() == 0
