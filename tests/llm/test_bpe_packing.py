import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deductra.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


TRICKY = [
    None, "", " ", "\n\t 　\x1c\x85x", "Hello, world's ÉÀ 123abc  ​ x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|start oftext|>", "don'T'S ''s'll",
    "日本語 한국어 ǅ İ ẞ ﬁ Σίσυφος ΑΣ", "é J̌ 가", "a" * 3000, "!?!?" * 200, "🙂🙃 \U0001f9d1‍", "\x00\x01\x7f", "aaaa</w>bb", "x y z",
]


def test_encoding_matches_the_library(library):
    r = random.Random(5)
    texts = [t or "" for t in TRICKY]
    signs = "etaoinshrdlu  ABC'é&ßñ0123.,!\n中"
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 300))) for _ in range(300)]
    v = bpe.vocabulary(bpe.default_path())
    for _ in range(300):  # runs of vocabulary pieces make merges compete
        texts.append("".join(v.names[r.randrange(512, 49406)].replace("</w>", r.choice(["", " "])) for _ in range(6)))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == want, t
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False)


def test_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as n_tokens")
    got = Counter(tuple(r) for r in bpe.digests(df).collect())
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(df.limit(0)).count() == 0


def test_fill_uses_every_piece_once():
    r = random.Random(3)
    for cap in (16, 64, 200):
        counts = Counter(r.randint(1, cap) for _ in range(500))
        used = Counter()
        n = 0
        for times, use in packing.fill(dict(counts), cap):
            assert sum(k * c for k, c in use.items()) <= cap
            n += times
            for k, c in use.items():
                used[k] += times * c
        assert used == counts
        assert n <= sum(k * c for k, c in counts.items()) / cap * 1.1 + 2


def test_fill_is_closest_to_capacity():
    from itertools import product

    r = random.Random(8)
    for _ in range(60):
        counts = {k: r.randint(1, 3) for k in r.sample(range(1, 30), 5)}
        (times, use) = packing.fill(dict(counts), 40)[0]
        longest = max(counts)
        best = max(s for c in product(*[range(counts[k] + 1) for k in counts]) if (s := sum(a * b for a, b in zip(c, counts))) <= 40 and dict(zip(counts, c))[longest])
        assert sum(k * c for k, c in use.items()) == best


def test_pack(spark, library):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma!", "été"]) for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    rows += [(200, None), (None, "x y"), (201, "same"), (201, "same"), (202, "q " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as number", "3 as u")
    out = packing.pack(df, capacity=64).collect()
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    by, bins = defaultdict(list), defaultdict(list)
    for p in out:
        by[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
    for d, all_ids in ids.items():
        pieces = by[d]
        assert sum(p.length for p in pieces) == sum(map(len, all_ids))
        for p in pieces:
            part = all_ids[0][p.start : p.start + p.length]
            assert p.doc_tokens == len(all_ids[0]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for some in bins.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    total = sum(p.length for p in out)
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= total / 64 * 1.05 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_latin_keys_are_the_words():
    v = bpe.vocabulary(bpe.default_path())
    r = random.Random(9)
    for _ in range(500):
        t = "".join(chr(r.randrange(256)) if r.random() < 0.5 else r.choice("abc's 'll 12") for _ in range(60))
        keys = v.keys(t)
        assert all(isinstance(k, bytes) for k in keys) and [k.decode("latin-1") for k in keys] == v.words(t)
    assert v.keys("ő a") == v.words("ő a")
