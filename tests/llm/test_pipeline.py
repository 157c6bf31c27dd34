"""The corpus pipeline by stage and as a whole, and the registered queries, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from deductra.llm import bpe, packing, queries  # noqa: E402
from test_minhash import brute as brute_groups  # noqa: E402
from test_windows import brute_bytes  # noqa: E402

SCHEMA = "doc_id long, url string, text string, lang string, source string, n_chars long, label int, _doc int, key int, doc int, rep int"


def rows(seed=3):
    r = random.Random(seed)
    words = {"en": "the of and to in is that it was for on are with as his they be at one have this from or had by".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split()}
    out = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        out.append((i, " ".join(r.choices(words[lang], k=r.randint(20, 120))) + f" n{i}", lang))
    passage = " ".join(r.choices(words["en"], k=60))
    out += [(100, out[0][1], "en"), (101, out[3][1] + " end", "de"), *[(d, " ".join([*r.choices(words["en"], k=40), passage, *r.choices(words["en"], k=40)]), "en") for d in (102, 103)]]
    out += [(104, None, "en"), (105, "", None), (106, "123 456", None), (None, out[5][1], "de"), (None, out[7][1], None), (107, "x", None), (100, out[0][1], "en"), (108, out[0][1] + " " + out[1][1], None)]
    return [(d, f"u{d}", t, g, "s", None if t is None else len(t), 1, 2, 3, 4, 5) for d, t, g in out]


def frame(spark, some):
    return spark.createDataFrame(some, SCHEMA).repartition(3)


def as_tuples(df):
    return Counter(tuple(x) for x in df.collect())


def test_stages(spark):
    docs = frame(spark, rows())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near dedup", "suffix-array dedup", "packing"]
    language, near, exact, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = language(spark, docs, "")
    assert kept.columns == docs.columns
    gone = as_tuples(docs) - as_tuples(kept)
    assert all(not any(map(str.isalpha, t[2] or "")) for t in gone) and len(gone) == 3
    once = near(spark, kept, "")
    assert once.columns == docs.columns and not as_tuples(once) - as_tuples(kept)
    all_ = [(t[0], t[2]) for t in as_tuples(kept).elements()]
    groups = brute_groups(list(enumerate(t for _, t in all_)), 5)
    left = [(t[0], t[2]) for t in as_tuples(once).elements()]
    assert len(left) == len({c for _, _, c in groups})
    assert len(brute_groups(list(enumerate(t for _, t in left)), 5)) == len({c for _, _, c in brute_groups(list(enumerate(t for _, t in left)), 5)})
    cut = exact(spark, once, "")
    assert cut.columns == docs.columns and cut.count() == once.count()
    texts = {t[0]: t for t in as_tuples(cut)}
    want = brute_bytes([x for x in left if x[0] is not None], 100)
    assert all(len(texts[d][2].encode()) == want[d][0] - want[d][1] for d in want if d is not None)
    assert all(t[5] == len(t[2]) for t in texts.values())
    assert texts[102][2] != texts[103][2] and len(texts[103][2]) < len(texts[102][2])
    check_packing([(t[0], t[2]) for t in as_tuples(cut).elements()], pack(spark, cut, "").collect())


def check_packing(docs, pieces):
    of = defaultdict(list)
    for p in pieces:
        of[p.doc_id, p.doc_tokens].append(p)
    want = Counter()
    for d, t in docs:
        ids = [*bpe.encode(t), 2]
        for s in range(0, len(ids), packing.CAPACITY):
            part = ids[s : s + packing.CAPACITY]
            want[d, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("some", ["all", "none", "nulls"])
def test_run(spark, tmp_path, some):
    table = {"all": rows(), "none": [], "nulls": [(None,) * 11, (1,) + (None,) * 10]}[some]
    frame(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    n = out.count()
    assert n == 0 if some != "all" else n >= 50


def test_queries_run_over_whole_tables(spark, sf_dir):
    """Each registered query, by itself, on the smallest tables: one row for each document."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = queries.queries()
    assert len(found) == 10
    for name, query in found.items():
        df = query(spark, sf_dir)
        if name == "op4_chat":
            ids = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
            assert df.count() == ids + 1
        elif name == "op9_packing":
            assert df.select("doc_id").distinct().count() == n
        else:
            assert df.count() == n


def test_recall_of_op10(spark, sf_dir):
    """All pairs of the smallest documents table: no link is missed, none is invented."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute_groups([tuple(r) for r in docs.collect()], 4)
    out = queries.op10_minhash(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
