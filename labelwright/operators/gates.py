"""Model evaluation gates and the champion timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.functions.rounding import half_up
from labelwright.operators.ranking import numbered
from labelwright.session import materialize

# Metric, least allowed value, largest allowed drop.
METRIC_GATES = [("map50", 0.70, 0.05), ("map50_95", 0.50, 0.03), ("precision", 0.75, 0.05), ("recall", 0.75, 0.05)]


def evaluate(candidates: DataFrame, champions: DataFrame) -> DataFrame:
    """PASS or REJECT with every broken gate and each metric's change; without a champion only the minima count."""
    old = champions.select("run_id", *[F.col(m).alias(f"old_{m}") for m, _, _ in METRIC_GATES])
    rows = candidates.join(old, "run_id", "left")
    minima = [F.when(F.col(m) < least, F.lit(f"FAILED_MIN_{m.upper()}")) for m, least, _ in METRIC_GATES]
    drops = [
        F.when(half_up(F.col(f"old_{m}") - F.col(m), 9) > drop, F.lit(f"REGRESSION_{m.upper()}_EXCEEDED")) for m, _, drop in METRIC_GATES
    ]
    reasons = F.concat_ws(",", *minima, *drops)
    return rows.withColumn("reasons", reasons).select(
        "run_id", F.when(F.col("reasons") == "", F.lit("PASS")).otherwise(F.lit("REJECT")).alias("decision"), "reasons",
        *[half_up(F.col(m) - F.col(f"old_{m}"), 6).alias(f"delta_{m}") for m, _, _ in METRIC_GATES],
    )


def champion_timeline(promotions: DataFrame) -> DataFrame:
    """Validity of each production model of a family; at most one at a time.

    The next promotion is the row with the next number of one total order, found by an
    equi-join on that number, so a family with very many promotions is not one task.
    """
    rows = materialize(numbered(promotions, ["family", "promoted_at", "seq"], "n"), "promotions")
    following = rows.select(
        F.col("family"), (F.col("n") - 1).alias("n"), F.col("promoted_at").alias("until"), F.col("action").alias("next_action")
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    status = F.when(F.col("until").isNull(), F.lit("PRODUCTION")).when(F.col("next_action") == "ROLLBACK", F.lit("ROLLED_BACK")).otherwise(F.lit("SUPERSEDED"))
    return rows.join(following, ["n", "family"], "left").select(
        "family", "model_version", day("promoted_at").alias("valid_from"), day("until").alias("valid_to"), status.alias("status")
    )
