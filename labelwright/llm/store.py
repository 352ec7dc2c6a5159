"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelwright.session import shared_dir


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    The lineage ends there: a lost executor re-reads files, row numbers and samples stay fixed.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.llm_path = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``save`` wrote and that no later plan reads."""
    for df in tables:
        spark: SparkSession = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.llm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
