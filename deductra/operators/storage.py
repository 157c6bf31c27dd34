"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"string": pa.string(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32(), "boolean": pa.bool_()}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder under a local master, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return str(have.get()).rstrip("/")
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="deductra-"))
        return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write and read back, so that the lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/deductra/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Iterable[tuple], columns: dict[str, str]) -> DataFrame:
    """Rows of the driver as a DataFrame whose size Catalyst knows. ``columns``: name to type."""
    rows = list(rows)
    arrays = [pa.array([r[i] for r in rows], _ARROW[t]) for i, t in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
