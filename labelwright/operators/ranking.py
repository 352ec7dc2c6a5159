"""Row numbers and order statistics that do not gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.session import materialize

_LOW_BITS = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str = "n", start: int = 0, total: str | None = None) -> DataFrame:
    """Consecutive numbers over a total order, without a single-task window.

    The rows are range-partitioned and sorted, their place inside the partition is stored
    with them, and only the partition sizes (one row per partition) are summed up.
    ``total`` names a column for the number of all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(
        ranged.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("_place"),
        ),
        "numbered",
    )
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(W.partitionBy()).alias("_total"))
    number = (F.col("_before") + F.col("_place") + 1 + start).cast("bigint")
    rows = stored.join(F.broadcast(offsets), "_part").withColumn(name, number)
    if total:
        rows = rows.withColumn(total, F.col("_total"))
    return rows.drop("_part", "_place", "_before", "_total")


#: Bins of a histogram pass.
BINS = 1024


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """Per group the number of values as ``total`` and the exact values at the given ranks.

    A value counts once per row, or ``weight`` times.

    ``ranks`` names each wanted value and gives its 1-based rank from the column of totals; ranks
    beyond the ends give the ends. Selection is by histogram passes: values are counted once, then
    every pass cuts the interval that holds a rank into ``BINS`` and goes on with the bin that holds
    it, between the smallest and the largest value found in that bin, until both are the same. The
    passes combine before the shuffle and a window only ever sees the bins; no group's values are
    sorted or gathered. A pass narrows the interval a thousandfold, so few are needed whatever the
    number of rows. Null and NaN values are left out.
    """
    number = F.col(value).cast("double")
    if not keys:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks, weight).drop("_all")
    counted = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_rows"))
    counted = materialize(counted, "counted")
    whole = counted.groupBy(*keys).agg(F.sum("_rows").alias("total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), f(F.col("total")).cast("bigint").alias("_rank")) for name, f in ranks.items()])
    state = whole.withColumn("_w", F.explode(wanted)).select(
        *keys, "total", "_w._name", F.greatest(F.lit(1), F.least("_w._rank", "total")).alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below")
    )
    state = materialize(state, "ranks")
    place = [*keys, "_name"]
    while not state.where("_lo < _hi").isEmpty():
        open_ = state.where("_lo < _hi")
        within = counted.join(open_, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves, so that the width is finite; a width below the smallest number has two bins
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        at = F.coalesce(F.floor(share * BINS), (F.col("_v") > F.col("_lo")).cast("bigint"))
        bins = within.groupBy(*place, "total", "_rank", "_below", F.least(at, F.lit(BINS - 1)).alias("_bin")).agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_rows").alias("_n")
        )
        upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*place).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        hit = bins.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        narrowed = hit.select(*keys, "total", "_name", "_rank", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"))
        state = materialize(narrowed.unionByName(state.where("_lo >= _hi")), "ranks")
    found = [F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks]
    return state.groupBy(*keys, "total").agg(*found)


def exclusive_place(total: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Rank below the ``i``-th of ``parts`` cut points by the exclusive method, and how far beyond it the
    point lies (in ``parts``-ths of a step): position i(n+1)/parts, its index held inside 1 ... n-1."""
    position = total * i + i
    j = F.greatest(F.lit(1), F.least(F.floor(position / parts), total - 1))
    return j, position - j * parts


def exclusive_quantile(low: Column, high: Column, total: Column, i: int, parts: int) -> Column:
    """The cut point between the values at its rank and the next one, so it may extrapolate; 0 for fewer than two values."""
    _, delta = exclusive_place(total, i, parts)
    return F.when(total < 2, F.lit(0.0)).otherwise((low * (parts - delta) + high * delta) / parts)
