"""A fixed-size sieve that lets most rows without a partner skip a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sieve, 64 bits each: at most about 10 MB in memory, whatever the number of keys.
ROWS = 1 << 18


def sifted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``maybe``: false only where its key is not among ``keys``.

    A Bloom filter kept as a table of at most ``ROWS`` bit words and broadcast. Each key sets two
    bits of one word. Up to some millions of keys few others pass; beyond that more and more do,
    which costs shuffle and never loses a row.
    """
    word = F.pmod(F.xxhash64(key), F.lit(ROWS))
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, 1), 64) as int)) | shiftleft(1L, cast(pmod(xxhash64({key}, 2), 64) as int))")
    words = keys.select(word.alias("_word"), mask.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = df.withColumns({"_at": word, "_mask": mask}).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return marked.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_at", "_mask", "_word", "_bits")
