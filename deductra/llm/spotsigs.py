"""SpotSigs fingerprints.

A signature is a common word (an anchor) with the chain of the next ``CHAIN`` content words,
that is words that aren't anchors. A document's fingerprint is the set of its signatures,
hashed to 64 bits out of its words' BLAKE2b digests, sorted and written in base64; likeness is
their Jaccard similarity.

``near_duplicates`` compares all documents by the exact likeness of their sets. Sets are
partitioned by length: classes are such that only equal or neighbouring ones can reach the
threshold. In a class only sets that share one of their rarest signatures are looked at; of
a set with n signatures these are the first n - ceil(threshold * n) + 1, so no link is lost.
Hot signatures are compared block by block (see ``minhash.groups``); no pairs are emitted.

Defined results. Words: letters and digits of the lowered text, everything else separates.
No word: empty fingerprint. Words but no signature: the whole word sequence as the only
one. Two empty fingerprints: likeness 1. Equal texts: equal fingerprints. Null text: empty.
Order of documents: descending doc_id, nulls last, ties by text. One document: its own
successor. Empty table: no rows. Other columns are not read. In ``near_duplicates`` an empty
set is linked with nothing, and the smallest doc_id stands for its group; texts that share a
doc_id are documents of their own. Very long texts: a task holds two documents at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import minhash
from ._spark import Documents, cut, doc_id, keyed, scratch, small_batches

SIMILARITY = 80
CHAIN, PART_ROWS, MOST_PARTS = 3, 1000, 65_536
ANCHORS = """
a an the is are was were be been do did have has had can could will would there of and to in for on with at by from that this it as or but
le la les un une des est sont du de et en dans pour par sur qui que il elle ne pas au aux ce se avec plus
der die das ein eine einen einem einer ist sind war und zu den dem des von mit auf nicht sich im für als auch an
el los las una unos es son fue y por para con que se su al lo como más o no si
""".split()

_ANCHORS = {w.encode() for w in ANCHORS}


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct signatures of a text, 64 bits each."""
    words = T.alphanumeric(text.lower().encode("utf-8", "replace"))
    if not words:
        return np.zeros(0, np.uint64)
    digests = T.word_digests(words)[:, 0]
    common = np.fromiter(map(_ANCHORS.__contains__, words), bool, len(words))
    content = digests[~common]
    follow = np.cumsum(~common)  # content words up to and with each place: the next one's number
    spots = np.flatnonzero(common)
    spots = spots[follow[spots] + chain <= len(content)]
    if not len(spots):
        return T.shingles(digests, len(digests))
    h = digests[spots]
    for j in range(chain):
        h = T.join(h, content[follow[spots] + j])
    return np.unique(h)


def fingerprint(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two signature sets; of two empty ones 1."""
    if not len(x) and not len(y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(docs: DataFrame) -> DataFrame:
    """part, look, doc, text: parts of the descending order, each followed by the first row of the next part (look = 1).

    Boundaries come from quantiles of the ids; a part's first id is an aggregate. At most
    ``MOST_PARTS`` of these are known to the driver. Each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    n = rows.select("doc").count()
    parts = max(1, min(MOST_PARTS, n // PART_ROWS))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc", shares, 10 * parts).alias("q")).first()["q"] if shares and n else []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def part_of(doc: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, doc.to_numpy(), "left"), dtype="int32")

    heads = rows.select("doc", part_of("doc").alias("part")).groupBy("part").agg(F.max("doc").alias("head")).orderBy("part").collect()
    before = [(heads[i]["head"], heads[i - 1]["part"]) for i in range(len(heads))]
    table = spark.createDataFrame(pa.table({"doc": pa.array([h for h, _ in before], pa.int64()), "copy_to": pa.array([p for _, p in before], pa.int32())}))
    own = F.struct(F.col("part"), F.lit(0).alias("look"))
    twice = F.array(own, F.struct(F.col("copy_to").alias("part"), F.lit(1).alias("look")))
    placed = rows.withColumn("part", part_of("doc")).join(F.broadcast(table), "doc", "left")
    placed = placed.select("doc", "text", F.explode(F.when(F.col("copy_to").isNotNull(), twice).otherwise(F.array(own))).alias("p"))
    dealt = placed.select("p.part", "p.look", "doc", F.coalesce("text", F.lit("")).alias("text"))
    return dealt.repartition("part").sortWithinPartitions("part", "look", F.desc("doc"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc, text, signatures of the row before

        def row(h, text, sigs):
            changed = edited(h[2], text)
            other = h[3] if changed == h[2] else signatures(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
            return h[1], len(h[2]), digest, fingerprint(h[3]), fingerprint(other), likeness(h[3], other), likeness(h[3], sigs)

        done_part = None
        for b in batches:
            out = []
            for part, look, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if look and part == done_part:
                    continue  # a tie of the first row of the next part
                sigs = signatures(text)
                if held is not None and held[0] == part:
                    out.append(row(held, text, sigs))
                held = None if look else (part, doc, text, sigs)
                if look:
                    done_part = part
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = _in_order(docs).mapInArrow(run, "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(doc_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _set_of(chain: int):
    return lambda data: signatures(bytes(data).decode("utf-8", "replace"), chain)


_SETS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sigs", pa.list_(pa.int64()))])


def _sets(chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _set_of(chain)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = of(text.as_buffer()) if text.is_valid else np.zeros(0, np.uint64)
                rows.append((doc, len(s), *T.set_digest(s), s.view(np.int64)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS)], schema=_SETS)

    return run


def length_bounds(most: int, similarity: int = SIMILARITY) -> list[int]:
    """Least lengths of the classes up to ``most``: no set of a class reaches the threshold with one two classes on."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // similarity + 1)
    return out


def near_duplicates(docs: DataFrame, chain: int = CHAIN, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_signatures, component_id (smallest doc_id of the group) and kept, a row for each row."""
    small_batches(docs.sparkSession)
    all_ = Documents(docs)
    texts = all_.texts().select("doc", F.col("text").cast("binary").alias("data"))
    with scratch():
        signed = cut(texts.mapInArrow(_sets(chain), "doc long, n long, h1 long, h2 long, sigs array<bigint>"))
        reps = cut(signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep")))
        most = reps.agg(F.max("n")).first()[0] or 0
        own = signed.select(F.col("doc").alias("rep"), "sigs").join(reps.select("rep", "n"), "rep")
        spots = own.select("rep", "n", F.explode("sigs").alias("sig"))
        ranked = spots.join(spots.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig")
        first = F.col("n") - F.ceil(F.col("n") * similarity / F.lit(100)).cast("int") + 1
        rare = ranked.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("spots"))
        rare = rare.select("rep", "n", F.explode(F.slice("spots", 1, first.cast("int"))).alias("spot"))
        bounds = F.array(*[F.lit(b) for b in length_bounds(most, similarity)])
        length = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
        keys = F.array(F.xxhash64("spot.sig", length), F.xxhash64("spot.sig", length - 1))
        buckets = cut(rare.select(F.explode(keys).alias("key"), "rep", "n").distinct())
        found = cut(minhash.members(signed, reps, minhash.groups(texts, buckets, _set_of(chain), similarity)), keep=True)
    return minhash.named(all_, found, "n_signatures")
