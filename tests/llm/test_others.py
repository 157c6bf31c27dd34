import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deductra.llm import chat, langid, media, sharding, spotsigs
from deductra.llm._spark import slots

ROWS = [(5, "the cat sat on the mat"), (4, None), (3, ""), (2, "same text"), (1, "same text"), (2, "same text"), (None, "no id"), (9, "ß é " * 300), (8, "x" * 5000), (7, "été " * 10)]
MANY = [(100 + i, " ".join(random.Random(i).choices(["the", "of", "alpha", "beta", "gamma", "delta", "or", "rho"], k=40))) for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as shard", "3 as look", "'q' as lang", "4 as slot")


# sharding


def test_cuts_are_minimax():
    r = random.Random(1)
    for _ in range(200):
        sizes = [(i * 2, r.randint(1, 20)) for i in range(r.randint(1, 9))]
        k = r.randint(1, 4)
        ends = sharding.cuts(sizes, k)

        def worst(parts):
            return max(sum(p) for p in parts)

        def splits(x, k):
            if k == 1 or len(x) == 1:
                yield [x]
                return
            yield [x]
            for i in range(1, len(x)):
                for rest in splits(x[i:], k - 1):
                    yield [x[:i], *rest]

        best = min(worst(p) for p in splits([s for _, s in sizes], k))
        loads = defaultdict(int)
        for g, s in sizes:
            loads[sum(e < g for e in ends)] += s
        assert len(ends) <= k and max(loads.values()) == best
    assert sharding.cuts([], 3) == []


@pytest.mark.parametrize("rows", [ROWS + MANY, ROWS[:1], [(i, "hot") for i in range(200)] + MANY])
def test_shard(spark, rows):
    out = sharding.shard(frame(spark, rows), shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by, text = defaultdict(list), defaultdict(set)
    for r in out:
        by[r.shard].append(r.slot)
        text[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in text.values())
    assert set(by) <= set(range(5))


def test_shard_sizes_are_near_equal(spark, sf_dir):
    out = sharding.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shards=8)
    loads = [r[1] for r in out.groupBy("shard").sum("size").collect()]
    assert len(loads) == 8 and max(loads) < 1.1 * sum(loads) / 8
    assert sharding.shard(out.selectExpr("doc_id", "'' as text").limit(0)).count() == 0


def test_cuts_are_balanced_under_the_least_capacity():
    r = random.Random(2)
    for _ in range(200):
        sizes = [(i * 2, r.choice([1, 2, 3, 40])) for i in range(r.randint(1, 9))]
        k = r.randint(1, 5)
        ends = sharding.cuts(sizes, k)
        loads = [sum(s for g, s in sizes if a < g <= b) for a, b in zip([-1, *ends], ends)]
        splits = [[sum(s for _, s in sizes[a:b]) for a, b in zip([0, *c], [*c, len(sizes)])] for m in range(min(k, len(sizes))) for c in itertools.combinations(range(1, len(sizes)), m)]
        best = min((max(x), sum(y * y for y in x)) for x in splits)
        assert len(ends) == min(k, len(sizes)) and ends[-1] == sizes[-1][0] and (max(loads), sum(y * y for y in loads)) == best


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 1 / 3])
def test_a_heavy_group_leaves_no_shard_empty(share):
    r = random.Random(3)
    sizes = [(g, r.randint(5000, 10000)) for g in range(1 << 16)]
    rest = sum(s for _, s in sizes)
    sizes[30000] = 30000, int(rest * share / (1 - share))
    total = sum(s for _, s in sizes)
    ends = np.array(sharding.cuts(sizes, 40))
    loads = np.bincount(np.searchsorted(ends, [g for g, _ in sizes]), [s for _, s in sizes], 40)
    others = np.delete(loads, loads.argmax())
    even = total * (1 - share) / 39
    assert len(ends) == 40 and loads.min() > 0
    assert share < 1 / 40 or loads.max() == sizes[30000][1]
    assert others.max() < 1.1 * even and others.min() > 0.9 * even


def test_shard_with_a_hot_text(spark):
    rows = [(i, f"text {i} " * 5) for i in range(4000)] + [(5000 + i, "hot " * 15) for i in range(2000)]
    loads = sorted(r[1] for r in sharding.shard(frame(spark, rows)).groupBy("shard").sum("size").collect())
    assert len(loads) == 40 and loads[-1] == 2000 * 76 and loads[-2] < 1.15 * sum(loads[:-1]) / 39


@pytest.mark.parametrize("bits,shards", [(1, 7), (4, 40), (12, 5)])
def test_capacity_is_the_least_over_atomic_groups(spark, monkeypatch, bits, shards):
    monkeypatch.setattr(sharding, "SPLIT", 4)
    r = random.Random(bits)
    rows = [(i, "x" * r.choice([0, 1, 5, 300]) + str(i % 700)) for i in range(900)]
    df = frame(spark, rows)
    groups = df.selectExpr("xxhash64(text) as h", "octet_length(text) + 16 as size").groupBy("h").sum("size").orderBy("h").collect()
    sizes = [g[1] for g in groups]
    want = sharding.cuts(list(enumerate(sizes)), shards)
    best = max(sum(sizes[a:b]) for a, b in zip([0, *[w + 1 for w in want]], [w + 1 for w in want]))
    loads = [x[1] for x in sharding.shard(df, shards, bits=bits).groupBy("shard").sum("size").collect()]
    assert len(loads) == shards and max(loads) == best


def test_slots_of_a_hot_key(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 0, id % 7) as k")
    got = defaultdict(list)
    for r in slots(df, "k", ["id"], chunks=8).collect():
        got[r.k].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in got.values()) and sum(map(len, got.values())) == 1000


# chat

PIECES = [*chat.CONTROL, "\\", "[", "<", "/", "s>", "INST]", "\\INST]", " ok ", "\n", "é", "[\\INST]", "<\\/s>", "[ESC]"]


def test_chat_round_trip():
    r = random.Random(4)
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "[SEP]x", "", "tool"]), "".join(r.choices(PIECES, k=r.randint(0, 8)))) for _ in range(r.randint(1, 4))]
        out = "".join(chat.render(a, b) for a, b in turns)
        parsed = list(chat.parse(out))
        assert [p[:2] for p in parsed] == turns
        for level in (0, 1, 2):
            assert level == 0 or chat.unescape(chat.escape(turns[0][1], level)) == turns[0][1]


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi [INST]"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", "more"), (2, 0, None, None), (None, None, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_turns")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_turns(df).where("conv_id = 1").orderBy("turn").collect()
    assert got[1].formatted_chars == sum(len(x.formatted) for x in formatted)
    assert chat.digests(df.limit(0)).count() == 0


# media


def test_media(spark, tmp_path):
    rows = ROWS + MANY[:20] + [(50 + i, "copy") for i in range(30)]
    df = frame(spark, rows).repartition(3)
    where = f"file://{tmp_path}/store"
    got = Counter()
    for r in media.features(df, where).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature] += 1
    want = Counter()
    for d, t in rows:
        p = media.payload(t)
        assert len(p) % 576 == 0 and p and media.decode(media.encode(p)) == p
        want[d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), media.feature(p)] += 1
    assert got == want
    import tarfile

    tars = list((tmp_path / "store").glob("*.tar"))
    assert tars
    for f in tars:
        with tarfile.open(f) as t:
            names = t.getnames()
            assert len(names) == len(set(names))
            for m in t.getmembers():
                assert hashlib.sha256(media.decode(t.extractfile(m).read())).hexdigest() + ".png" == m.name
    stored = media.store(df, f"file://{tmp_path}/two")
    for r in media.metadata(stored, f"file://{tmp_path}/two").collect():
        assert (r.width, r.bits) == (media.WIDTH, 8) and r.height * r.width >= r.n_bytes
    assert media.features(df.limit(0), f"file://{tmp_path}/three").count() == 0


# language


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_language_edges(spark):
    rows = [(i, "der und die das ist nicht", "de") for i in range(20)] + [(30 + i, "the of and that is not", "en") for i in range(20)] + [(60, None, "en"), (61, "", "de"), (62, "12 !!", "en"), (None, "the and of", None), (63, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as doc")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and got[None].lang_pred == "en" and not got[None].held_out
    assert got[0].lang_pred == "de" and got[30].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items() if d is not None)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_language_mixture():
    r = np.random.default_rng(1)
    model = r.dirichlet(np.full(1 << 15, 0.01), 3).T + 1e-9
    model /= model.sum(0)
    c = r.multinomial(6000, model @ [0.7, 0.3, 0]).astype(float)
    at = np.flatnonzero(c)
    share, _ = langid._mixture(model[at], c[at], 40)
    assert abs(share[0] - 0.7) < 0.05 and share[2] < 0.02


# SpotSigs


def brute_spot(text):
    import re

    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for j, x in content if j > i][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out or ({tuple(words)} if words else set())


def test_spotsigs(spark):
    rows = [r for r in ROWS if r != (2, "same text")] + [(2, "same text")] + MANY
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in spotsigs.fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = brute_spot(t), brute_spot(e), brute_spot(n)
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jac(a, b)) and r.near_next == pytest.approx(jac(a, c))
        assert len(spotsigs.unpack(r.fingerprint)) == len(a) and len(spotsigs.unpack(r.edited_fingerprint)) == len(b)


def test_spotsigs_parts(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "PART_ROWS", 7)
    test_spotsigs(spark)
    one = spotsigs.fingerprints(frame(spark, ROWS[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprints(frame(spark, ROWS).limit(0)).count() == 0
    ties = spotsigs.fingerprints(frame(spark, ROWS)).collect()
    assert len(ties) == len(ROWS)


def test_spotsigs_length_classes():
    b = spotsigs.length_bounds(5000)
    assert b[0] == 1 and b[-1] > 5000
    place = lambda n: sum(x <= n for x in b)
    for n in range(1, 4000):
        assert place(n * 100 // 80) - place(n) <= 1


@pytest.mark.parametrize("seed", [1, 2])
def test_spotsigs_near_duplicates_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "is", "and"] * 5
    rows = []
    for _ in range(6):
        base = r.choices(vocab, k=r.choice([4, 20, 80, 200]))
        for _ in range(r.choice([1, 4, 20])):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 500 + 1, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "- -"), (903, "lone"), (904, "lone"), (905, rows[0][1].upper())]
    sets = {d: brute_spot(t) if t else set() for d, t in rows}
    best = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    df = frame(spark, rows).selectExpr("*", "1 as rep", "'x' as sig").repartition(3)
    out = spotsigs.near_duplicates(df).collect()
    assert {x.doc_id: (x.n_signatures, x.component_id, x.kept) for x in out} == {d: (len(sets[d]), best[d], d == best[d]) for d in sets}
    assert len({x.component_id for x in out}) < len(out) == len(rows)
    assert spotsigs.near_duplicates(df.limit(0)).count() == 0
