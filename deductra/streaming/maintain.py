"""Rules over a stream of facts: each micro-batch continues the closure that is already known.

The facts and answers of each batch are tables under ``state`` in the checkpoint folder, a
folder a batch. A query that starts again reads the facts of the batches before its first
one, so answers that join old and new facts are found, and those handed out before aren't
repeated. A batch that runs again overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..engine import Engine
from ..plans.ir import Atom

#: Batches after which the closure is made anew from the stored facts, so that plans stay short.
RENEW = 16


def _before(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame:
    """What the batches before ``number`` stored under ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return like.limit(0)
    return spark.read.schema(StructType([*like.schema.fields, StructField("batch", LongType())])).parquet(path).where(F.col("batch") < number).select(*like.columns)


def maintain(engine: Engine, stream: DataFrame, pred: str, goal: Atom, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Add each micro-batch of ``stream`` to ``pred`` and hand ``sink`` the answers to ``goal`` that weren't there before, with the batch's number.

    The program must be positive (answers never go away). Watermarks, windows and late data
    belong before this, on ``stream``. Facts are a set, so a batch that runs again adds nothing.
    """
    spark = engine.spark
    facts, answers = f"{checkpoint}/state/facts", f"{checkpoint}/state/answers"
    have = engine._lookup(Atom(pred, (None,) * len(stream.columns)))
    known = {"next": None}  # the batch that the engine's closure is ready for

    def store(df: DataFrame, path: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        return spark.read.schema(df.schema).parquet(f"{path}/batch={number}")

    def step(batch: DataFrame, number: int) -> None:
        fresh = store(batch.distinct() if have is None else batch.toDF(*have.columns).distinct(), facts, number)
        if known["next"] != number or number % RENEW == 0:
            old = _before(spark, facts, number, fresh)
            engine.relation(pred, old if have is None else have.union(old), distinct=True)
        engine.close()
        engine.add_facts(pred, fresh)
        known["next"] = number + 1
        now = engine.query(goal, "naive")
        new = store(now.subtract(_before(spark, answers, number, now)), answers, number)
        sink(new, number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
