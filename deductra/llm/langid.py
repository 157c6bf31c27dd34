"""Language identification by multilingual mixture inference.

Each language has byte 3-gram probabilities (hashed into ``2**BITS`` classes, smoothed),
counted on labelled documents. A document is a mixture of languages: expectation-
maximisation estimates their proportions from the 3-grams' likelihoods, and the set of
languages is chosen by penalised likelihood (half the log of the 3-grams' number for each
further proportion). The language with the largest proportion is predicted, the proportion is the score.

Fitting reads at most about ``sample`` labelled documents of each language, picked by a
hash of their ids, and learns the ``langs`` most frequent languages (documented bounds of
the fit); prediction reads every document whole. What reaches the driver is one count
per learned language and class, and the model that is broadcast has 2**BITS numbers for each.

Defined results. Null text or no letter: ``und``, score 0. Nothing to learn from: ``und``.
Ties: the language whose name sorts first. Null lang: not learned from. Null doc_id: not
held out, not learned from. Rows are independent, so repeated rows repeat their result.
Very long texts: a task holds one text and 2**BITS counts. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import NO_ID, doc_id, small_batches

BITS, SAMPLE, SMOOTH, ROUNDS = 15, 3000, 0.5, 12
#: Languages learned at most: the most frequent ones.
LANGS = 500
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether any sign of the text is a letter."""
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the text's 3-grams and their counts; anything but letters separates words."""
    raw = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    x = raw[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits)
    counts = np.bincount(code, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def _mixture(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` and the log-likelihood, by expectation-maximisation."""
    n, k = c.sum(), p.shape[1]
    share = np.full(k, 1 / k)
    for _ in range(rounds if k > 1 else 0):
        share = share * ((c / (p @ share)) @ p) / n
    return share, float(c @ np.log(p @ share))


def predict_one(text: str | None, model: np.ndarray, names: list[str], bits: int = BITS) -> tuple[str, float]:
    """Language and score. ``model``: probabilities by class and language."""
    if not names or not has_letter(text):
        return "und", 0.0
    at, c = grams(text, bits)
    if not len(at):
        return "und", 0.0
    p = model[at]
    single = c @ np.log(p)
    best = int(np.argmax(single))
    share, _ = _mixture(p, c)
    rank = np.argsort(-share, kind="stable")
    rank = np.concatenate(([best], rank[rank != best]))
    penalty = 0.5 * np.log(c.sum() + 1)
    chosen, score = (best, 1.0), single[best] / 3  # overlapping 3-grams count a third
    for k in range(2, len(rank) + 1):
        if share[rank[k - 1]] < 0.02:
            break
        some, fit = _mixture(p[:, rank[:k]], c)
        if fit / 3 - penalty * (k - 1) <= score:
            break
        score = fit / 3 - penalty * (k - 1)
        order = sorted(range(k), key=lambda i: (-some[i], names[rank[i]]))
        chosen = int(rank[order[0]]), float(some[order[0]])
    return names[chosen[0]], min(1.0, max(0.0, chosen[1]))


def held_out(col: str = "doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, smooth: float = SMOOTH, langs: int = LANGS) -> tuple[np.ndarray, list[str]]:
    """Probabilities by class and language, and the languages, from ``doc_id``, ``text`` and non-null ``lang``."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not totals:
        return np.zeros((1 << bits, 0)), []
    rate = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < rate[F.col("lang")]).repartition(24, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, c = grams(text, bits)
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits)
                sums[lang][at] += c
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at])], names=["lang", "class", "n"])

    small_batches(labelled.sparkSession)
    counted = chosen.mapInArrow(count, "lang string, class int, n double").groupBy("lang", "class").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(totals)
    model = np.full((1 << bits, len(names)), smooth)
    column = {k: i for i, k in enumerate(names)}
    model[counted["class"].to_numpy(), [column[k] for k in counted["lang"].to_pylist()]] += counted["n"].to_numpy()
    return model / model.sum(0), names


def predict(docs: DataFrame, model: np.ndarray, names: list[str], bits: int = BITS) -> DataFrame:
    """doc, lang_pred and score of every row's whole text, nothing else being read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, names))  # 2**bits numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value
        for b in batches:
            found = [predict_one(t.as_py(), model, names, bits) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc", "lang_pred", "score"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model, names = fit(docs.where(~held_out()), sample)
    out = predict(docs, model, names)
    return out.select(doc_id(), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text has no language (``und``); a mixture of several languages stays."""
    model, names = fit(docs.where(~held_out()), sample)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, names))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value
        for b in batches:
            keep = [predict_one(t.as_py(), model, names)[0] != "und" for t in b.column(place)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
