"""Leak-free splits by product."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions import hashing
from labelwright.operators.ranking import numbered


def md5_split(product: Column) -> Column:
    """70 train, 20 validation, 10 test."""
    return hashing.three_way(hashing.hex_bucket(F.md5(product), 10), (7, 9), ("train", "validation", "test"))


def polynomial_split(product: Column) -> Column:
    return hashing.three_way(hashing.polynomial(product) % 10, (2, 3), ("validation", "test", "train"))


def seeded_split(products: DataFrame, seed: str, share: float = 0.8) -> DataFrame:
    """Exactly the first ``share`` of the products in seeded hash order go to train."""
    rows = products.select("product_id").distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col("product_id"))))
    placed = numbered(rows, ["h", "product_id"], "place", total="total")
    inside = F.col("place") <= F.floor(F.col("total") * share)
    return placed.select("product_id", F.when(inside, F.lit("train")).otherwise(F.lit("val")).alias("split"))


def leaking_products(images: DataFrame) -> DataFrame:
    """Products whose images lie in more than one split."""
    spread = images.groupBy("product_id").agg(F.count_distinct("split").alias("splits"), F.min("split").alias("first"), F.max("split").alias("last"))
    return spread.filter(F.col("splits") > 1)


def mismatched_images(images: DataFrame, product_splits: DataFrame) -> DataFrame:
    assigned = product_splits.select("product_id", F.col("split").alias("assigned"))
    return images.join(assigned, "product_id").filter(F.col("split") != F.col("assigned")).select("image_id", "product_id", "split", "assigned")


def sticky(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """The stored split of a product wins; a new product takes its first request."""
    first = requests.groupBy("product_id").agg(F.min(F.struct("seq", "split")).alias("r"))
    kept = existing.select("product_id", F.col("split").alias("stored"))
    return first.join(kept, "product_id", "left").select("product_id", F.coalesce("stored", "r.split").alias("split"))


def merge_last(replay: DataFrame, current: DataFrame) -> DataFrame:
    """Replayed and current samples; the last one of an id wins, current after replayed."""
    both = replay.withColumn("turn", F.lit(0)).unionByName(current.withColumn("turn", F.lit(1)))
    rest = [c for c in replay.columns if c != "sample_id"]
    last = F.max(F.struct("turn", *rest)).alias("s")
    return both.groupBy("sample_id").agg(last).select("sample_id", *[F.col(f"s.{c}").alias(c) for c in rest], F.col("s.turn").alias("turn"))


def dataset_version(samples: DataFrame, name: str) -> DataFrame:
    """Split of each sample and whether it may enter; a version with any refused row must not be built.

    A sample that comes with a split keeps it, others are split by product. What enters is marked as used.
    """
    refused = ~F.coalesce(F.col("candidate_status").isin("TRAINING_ELIGIBLE", "USED_IN_DATASET"), F.lit(False))
    split = polynomial_split(F.col("product_id"))
    if "split" in samples.columns:
        split = F.coalesce("split", split)
    return samples.select(
        "sample_id", "product_id", split.alias("split"),
        F.when(refused, F.lit("NOT_ELIGIBLE")).alias("refused"), F.when(~refused, F.lit(name)).alias("dataset_version"),
        F.when(refused, F.col("candidate_status")).otherwise(F.lit("USED_IN_DATASET")).alias("candidate_status"),
    )


SPLITS = ("train", "validation", "test")


def version_audit(version: DataFrame, name: str) -> DataFrame:
    """One row: what a version holds, a fingerprint of its samples in any order, and whether it may be published.

    Samples are counted per product first, so that a product in two splits shows without gathering any.
    """
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), "split")), 1, 15), 16, 10).cast("bigint")
    products = version.groupBy("product_id").agg(
        F.count_distinct("split").alias("splits"), F.min("split").alias("split"), F.count("*").alias("n"), F.count("refused").alias("refused"), F.bit_xor(mark).alias("mark")
    )
    whole = products.agg(
        F.count("*").alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"),
        F.count_if(F.col("splits") > 1).alias("leaking"), *[F.count_if(F.col("split") == s).alias(f"{s}_products") for s in SPLITS], F.coalesce(F.bit_xor("mark"), F.lit(0)).alias("fingerprint"),
    )
    status = F.when(F.col("refused") > 0, F.lit("REFUSED_NOT_ELIGIBLE")).when(F.col("leaking") > 0, F.lit("REFUSED_LEAKAGE")).otherwise(F.lit("PUBLISHED"))
    return whole.select(F.lit(name).alias("version"), "*", status.alias("status"))


def publish_version(samples: DataFrame, name: str, folder: str) -> dict:
    """Write, audit, publish: the audit reads what was written, and only its manifest makes a version visible.

    The manifest is written aside and renamed, which a reader sees as one step; it names the files, in
    which every sample is marked as used. A version that leaks or holds a refused sample gets none, a
    published name is never replaced. Returns the audit.
    """
    spark = samples.sparkSession
    data = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    dataset_version(samples, name).write.partitionBy("split").parquet(data)
    written = spark.read.parquet(data)
    audit = version_audit(written, name).first().asDict()
    if audit["status"] != "PUBLISHED":
        return audit
    jvm = spark._jvm
    path = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    final, aside = path(f"{folder.rstrip('/')}/{name}.manifest.json"), path(f"{data}.manifest.tmp")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(audit | {"data": data}, sort_keys=True).encode()))
    out.close()
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise FileExistsError(f"version {name} is published already")
    return audit


def published(spark: SparkSession, name: str, folder: str) -> DataFrame | None:
    """The samples of a published version; None without a manifest."""
    manifest = f"{folder.rstrip('/')}/{name}.manifest.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(spark.read.json(manifest).first()["data"])
