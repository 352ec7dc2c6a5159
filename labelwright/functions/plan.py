"""Helpers that shape a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column such that it is evaluated exactly once per row.

    A later filter on a plain column would be pushed below the projection with the
    whole expression copied into it; nothing is pushed through a generate step.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Session setting: so many partitions for costly per-row work; unset, the input's own partitions stay.
SPREAD = "spark.labelwright.spreadPartitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal costly per-row work over the partitions that the session asks for.

    Meant for inputs of fewer splits than cores, as in the bench; a large table has splits enough
    and needs no shuffle.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), *keys) if parts else df
