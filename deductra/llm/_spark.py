"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id where a join key is needed.
NO_ID = -(2**63)
#: Rows of a batch handed to Python; a batch is further bounded by bytes.
BATCH_ROWS = 16384
BATCH_BYTES = 1 << 20
#: Delete a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of the open ``scratch`` blocks.
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return str(have.get()).rstrip("/")
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="deductra-")
        spark.sparkContext.setCheckpointDir(where)
        return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")
    return where.rstrip("/")


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what came before.
    Inside ``scratch`` the table lives to the block's end, unless ``keep``; else to the end of the session. The shuffle files
    behind it, which nothing reads any more, are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deductra/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._deductra_path = path
    if _scratch and not keep:
        _scratch[-1].append(out)
    else:
        fs, p = _located(spark, path)
        fs.deleteOnExit(p)
    return out


def _located(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``."""
    path = getattr(df, "_deductra_path", None)
    if path:
        fs, p = _located(df.sparkSession, path)
        fs.delete(p, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables cut inside are deleted at the end; what the block gives back must be cut with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            drop(df)


def small_batches(spark: SparkSession) -> None:
    """Bound what Python holds at once: rows and bytes of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` (doc_id, nulls as NO_ID) and ``text``; no other column is read."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


class Documents:
    """One number ``doc`` for each document, in the order of doc_id.

    Where no doc_id repeats (one null allowed) the number is the doc_id. Otherwise it is the
    rank of (doc_id, digest of the text), nulls first, so that texts that share a
    doc_id, nulls included, are documents of their own, and rows equal in both are one.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs
        ids = docs.select(F.col("doc_id").cast("long").alias("i"))
        self.ranks = None
        if not ids.groupBy("i").count().where((F.col("count") > 1) | (F.col("i") == NO_ID)).isEmpty():
            own = docs.select(*self._key()).distinct()
            self.ranks = cut(own.orderBy(F.desc("k0"), "k1", "k2", "k3").withColumn("k", F.monotonically_increasing_id()), keep=True)

    @staticmethod
    def _key() -> list:
        """Whether the doc_id is null, doc_id, and two hashes of the text."""
        doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
        return [doc.isNull().alias("k0"), F.coalesce(doc, F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2"), F.xxhash64(F.lit(1), text).alias("k3")]

    def tagged(self, name: str) -> DataFrame:
        """All rows and columns, with the number as column ``name``."""
        if self.ranks is None:
            return self.docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
        names = [fresh(self.docs, f"_k{i}") for i in range(4)]
        mine = self.docs.select("*", *[c.alias(n) for c, n in zip(self._key(), names)])
        return mine.join(self.ranks.toDF(*names, name), names).select(*[F.col(f"`{c}`") for c in self.docs.columns], name)

    def rows(self) -> DataFrame:
        """``doc`` of every row."""
        name = fresh(self.docs, "_doc")
        return self.tagged(name).select(F.col(name).alias("doc"))

    def texts(self) -> DataFrame:
        """``doc`` and ``text``, each document once."""
        name = fresh(self.docs, "_doc")
        out = self.tagged(name).select(F.col(name).alias("doc"), F.col("text").cast("string").alias("text"))
        return out if self.ranks is None else out.dropDuplicates(["doc"])

    def named(self, df: DataFrame, **columns: str) -> DataFrame:
        """``df`` with further columns: the doc_id behind the number in each given one."""
        for new, have in columns.items():
            if self.ranks is None:
                df = df.withColumn(new, doc_id(have))
            else:
                df = df.join(self.ranks.select(F.col("k").alias(have), F.when(~F.col("k0"), F.col("k1")).alias(new)), have, "left")
        return df

    def expanded(self, results: DataFrame) -> DataFrame:
        """``results``, a row a document, once for each row of the table."""
        return results if self.ranks is None else self.rows().join(results, "doc")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def doc_id(col: str = "doc"):
    """The doc_id that ``keyed`` encoded."""
    return F.when(F.col(col) == NO_ID, F.lit(None).cast("long")).otherwise(F.col(col)).alias("doc_id")


def slots(df: DataFrame, key: str, tie: list[str], chunks: int = 1024, out: str = "slot") -> DataFrame:
    """Number the rows of each ``key`` gaplessly from 0, without sorting a key in one task.

    Rows are split into ``chunks`` by a hash of ``tie``; chunk counts are summed in
    front of each chunk, so a key with a third of all rows is numbered by many tasks.
    """
    from pyspark.sql import Window

    split = df.withColumn("_chunk", F.pmod(F.xxhash64(*tie), F.lit(chunks)).cast("int"))
    counts = split.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(key, "_chunk", (F.sum("_n").over(Window.partitionBy(key).orderBy("_chunk")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*tie))
    numbered = split.withColumn("_inner", inner)
    return numbered.join(before, [key, "_chunk"]).withColumn(out, (F.col("_before") + F.col("_inner") - 1).cast("long")).drop("_chunk", "_inner", "_before")
