"""Many inclusions of atomic classes into one, answered by one filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_members(memberships: DataFrame, classes: list) -> DataFrame:
    """Members of any of ``classes``, from (member, class) rows; the filter reaches the scan."""
    member, cls = memberships.columns
    return memberships.where(F.col(cls).isin(classes)).select(member).distinct()


def close_memberships(memberships: DataFrame, superclasses: DataFrame) -> DataFrame:
    """Memberships in all superclasses by one join with the closed, small (sub, super) table."""
    member, cls = memberships.columns
    sub, sup = superclasses.columns
    up = superclasses.select(F.col(sub).alias(cls), F.col(sup).alias("_super"))
    return memberships.join(up, cls).select(member, F.col("_super").alias(cls)).union(memberships).distinct()
