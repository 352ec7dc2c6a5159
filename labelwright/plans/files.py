"""File formats: each query writes the given tables in a format and reads them back through a source."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from labelwright.operators import annotations as ann
from labelwright.operators import images as image_ops
from labelwright.plans.catalog import query
from labelwright.session import shared_dir
from labelwright.sources import files
from labelwright.sources.standins import define, spark_view


def _folder(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("src_jsonl", """SELECT p_partkey::VARCHAR AS barcode, p_name AS product_name, p_brand AS brand, 'en:' || lower(p_type) AS country, p_size AS width FROM part WHERE p_partkey % 25 <> 3 AND p_partkey % 25 <> 4""")
def src_jsonl(spark, sf):
    """Every part as a JSON line, some lines broken or blank."""
    p = F.col
    line = F.to_json(F.struct(
        p("p_partkey").cast("string").alias("barcode"), p("p_name").alias("productName"), p("p_brand").alias("brand"),
        F.array(F.concat(F.lit("en:"), F.lower("p_type"))).alias("countryTags"), F.lit("front").alias("imageType"), p("p_size").alias("width"), F.lit(10).alias("height"),
    ))
    spoiled = F.when(p("p_partkey") % 25 == 3, F.lit("{broken")).when(p("p_partkey") % 25 == 4, F.lit("")).otherwise(line)
    path = _folder(spark, "lines")
    spark_view(spark, sf, "part").select(spoiled.alias("value")).write.text(path)
    return files.product_lines(spark, path).select(
        "barcode", p("productName").alias("product_name"), "brand", p("countryTags")[0].alias("country"), "width"
    )


@query("src_manifest", """SELECT i.image_id, i.product_id, i.view, i.sha256, i.width, i.split, s.split AS product_split FROM @images i JOIN (SELECT product_id, min(split) AS split FROM @images GROUP BY 1) s ON s.product_id = i.product_id""")
def src_manifest(spark, sf):
    """One manifest object per image, with the split of its product."""
    i = spark_view(spark, sf, "images")
    splits = i.groupBy("product_id").agg(F.min("split").alias("product_split"))
    entry = F.struct(
        F.col("image_id").alias("imageId"), F.col("product_id").alias("productId"), "view", "sha256", F.col("width").cast("bigint").alias("width"), "split"
    )
    path = _folder(spark, "manifests")
    i.join(splits, "product_id").select(
        F.to_json(F.struct(F.array(entry).alias("images"), F.create_map("product_id", "product_split").alias("productSplits"))).alias("value")
    ).write.text(path)
    m = files.manifests(spark, path)
    assigned = files.manifest_splits(m).distinct().withColumnRenamed("split", "product_split")
    rows = files.manifest_images(m).withColumnRenamed("productId", "product_id").join(assigned, "product_id")
    return rows.select(F.col("imageId").alias("image_id"), "product_id", "view", "sha256", "width", "split", "product_split")


@query("src_annotations", "SELECT annotation_id, image_id, class_id, x_center, y_center, width, height, provenance, verification_status FROM @annotations")
def src_annotations(spark, sf):
    """Annotation objects as JSON arrays over many lines, one per image, read by the splittable scan."""
    a = spark_view(spark, sf, "annotations")
    c = F.col
    record = F.struct(
        c("annotation_id").alias("annotationId"), c("image_id").alias("imageId"), c("class_id").alias("classId"),
        F.struct(c("x_center").alias("xCenter"), c("y_center").alias("yCenter"), "width", "height").alias("boundingBox"), "provenance",
        c("verification_status").alias("verificationStatus"),
    )
    path = _folder(spark, "annotations")
    a.groupBy("image_id").agg(F.collect_list(record).alias("r")).select(F.to_json("r", {"pretty": "true"}).alias("value")).write.text(path)
    return files.annotation_array(spark, path).select(
        c("annotationId").alias("annotation_id"), c("imageId").alias("image_id"), c("classId").alias("class_id"), c("boundingBox.xCenter").alias("x_center"),
        c("boundingBox.yCenter").alias("y_center"), c("boundingBox.width").alias("width"), c("boundingBox.height").alias("height"), "provenance",
        c("verificationStatus").alias("verification_status"),
    )


_LABEL_FILE = "'product_' || cast(image_id % 20 AS string) || '_' || CASE image_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'declaration' END"
define("label_lines_named", f"SELECT *, {_LABEL_FILE} AS name FROM @annotations")


@query("src_labels", """SELECT split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS product_id, split_part(name, '_', 3) AS view, class_id,
 round(x_center, 6) AS x, round(y_center, 6) AS y, round(width::DOUBLE, 6) AS w, round(height, 6) AS h FROM @label_lines_named""")
def src_labels(spark, sf):
    """Annotations as label text, in folders named after product and view, and what is read from there."""
    a = spark_view(spark, sf, "label_lines_named")
    c = F.col
    path = _folder(spark, "labels")
    line = ann.label_line(c("class_id"), c("x_center"), c("y_center"), c("width").cast("double"), c("height"))
    a.select("name", line.alias("value")).write.partitionBy("name").text(path)
    return files.label_files(spark, path).select("product_id", "view", "class_id", "x", "y", "w", "h")


@query("sink_report", "SELECT status, count(*) AS complaints FROM @complaints GROUP BY 1")
def sink_report(spark, sf):
    """A small report written as JSON and read back."""
    path = _folder(spark, "report")
    files.write_report(spark_view(spark, sf, "complaints").groupBy("status").agg(F.count("*").alias("complaints")), path, "json")
    return spark.read.schema("status string, complaints bigint").json(path)


@query("binary_inventory", """SELECT 'supplier=' || s_suppkey AS folder, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256
 FROM (SELECT s_suppkey, s_name || ', ' || s_nationkey || ', ' || s_acctbal::DECIMAL(12, 2) || chr(10) AS t FROM supplier)""")
def binary_inventory(spark, sf):
    """A file of known bytes per supplier, then listed as binary files."""
    path = _folder(spark, "binary")
    c = F.col
    text = F.concat_ws(", ", "s_name", c("s_nationkey").cast("string"), c("s_acctbal").cast("decimal(12,2)").cast("string"))
    rows = spark_view(spark, sf, "supplier").select(c("s_suppkey").alias("supplier"), text.alias("value"))
    files.write_folders(rows, "supplier", path)
    return files.binary_inventory(spark, path, "*.txt").drop("file")


define("file_heads", """
SELECT doc_id AS image_id, CASE doc_id % 6 WHEN 0 THEN 'FFD8FFE000104A4649460001' WHEN 1 THEN '89504E470D0A1A0A0000000D' WHEN 2 THEN '524946461234567857454250' WHEN 3 THEN '524946461234567841564920'
 WHEN 4 THEN '474946383961010001008000' ELSE 'FFD8' END AS head, CASE doc_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'jpg' END AS extension, text FROM @documents""")
_MAGIC = """CASE WHEN head LIKE 'FFD8FF%' THEN 'jpg' WHEN head LIKE '89504E47%' THEN 'png' WHEN head LIKE '52494646%' AND substr(head, 17, 8) = '57454250' THEN 'webp' END"""


@query("magic_bytes", f"SELECT image_id, m AS magic, coalesce(m <> CASE WHEN extension = 'jpeg' THEN 'jpg' ELSE extension END, false) AS mismatch FROM (SELECT *, {_MAGIC} AS m FROM @file_heads)")
def magic_bytes(spark, sf):
    content = F.concat(F.unhex("head"), F.when(F.length("head") == 24, F.encode("text", "UTF-8")).otherwise(F.unhex(F.lit("00"))))
    rows = spark_view(spark, sf, "file_heads").select("image_id", "extension", content.alias("content"))
    named = F.when(F.col("extension") == "jpeg", F.lit("jpg")).otherwise(F.col("extension"))
    rows = rows.withColumn("magic", files.magic_type(F.col("content")))
    return rows.select("image_id", "magic", F.coalesce(F.col("magic") != named, F.lit(False)).alias("mismatch"))


define("open_products", """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN 'http://i/' || cast(p_partkey AS string) || '/f-en' END AS front_en, CASE WHEN p_partkey % 4 <> 0 THEN 'http://i/' || cast(p_partkey AS string) || '/f-fr' END AS front_fr,
 CASE WHEN p_partkey % 5 = 0 THEN 'http://i/' || cast(p_partkey AS string) || '/n-fr' END AS nutrition_fr, CASE WHEN p_partkey % 2 = 0 THEN 'http://i/' || cast(p_partkey AS string) || '/f-en' END AS image_front_url,
 CASE WHEN p_partkey % 6 = 0 THEN 'http://i/' || cast(p_partkey AS string) || '/b' END AS image_back_url, CASE WHEN p_partkey % 7 = 0 THEN 'http://i/' || cast(p_partkey AS string) || '/b' ELSE '' END AS image_url FROM @part""")


@query("image_url_flatten", """
WITH e AS (SELECT product_id, 0 AS pr, 'front' AS type, coalesce(front_en, front_fr) AS url, 'selected.front' AS source FROM @open_products UNION ALL SELECT product_id, 1, 'nutrition', nutrition_fr, 'selected.nutrition' FROM @open_products
 UNION ALL SELECT product_id, 2, 'front', image_front_url, 'image_front_url' FROM @open_products UNION ALL SELECT product_id, 3, 'back', image_back_url, 'image_back_url' FROM @open_products UNION ALL SELECT product_id, 7, 'unknown', image_url, 'image_url' FROM @open_products),
 f AS (SELECT *, row_number() OVER (PARTITION BY product_id, url ORDER BY pr) AS rn FROM e WHERE url <> '')
SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY pr) - 1 AS INT) AS place, type, url, source FROM f WHERE rn = 1""")
def image_url_flatten(spark, sf):
    p = spark_view(spark, sf, "open_products")
    langs = lambda *pairs: F.map_filter(F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    selected = F.create_map(F.lit("front"), langs(("fr", "front_fr"), ("en", "front_en")), F.lit("nutrition"), langs(("fr", "nutrition_fr")))
    none = F.lit(None).cast("string")
    rows = p.withColumn("selected_images", F.map_filter(selected, lambda k, v: F.size(v) > 0))
    for field in ("ingredients", "nutrition", "packaging"):
        rows = rows.withColumn(f"image_{field}_url", none)
    return files.image_urls(rows)


@query("sink_split_folders", "SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'val' END AS folder, count(*) AS n FROM @images WHERE status IN ('annotated', 'validated') GROUP BY 1")
def sink_split_folders(spark, sf):
    path = _folder(spark, "export")
    files.write_split_folders(image_ops.exportable(spark_view(spark, sf, "images")), path)
    return spark.read.parquet(path).groupBy("folder").agg(F.count("*").alias("n"))


@query("sink_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM @telemetry WHERE CAST(ts AS DATE) >= DATE '2024-02-10' - 30 GROUP BY 1")
def sink_daily(spark, sf):
    """Telemetry by day on disk; expired days are never read."""
    path = _folder(spark, "daily")
    files.write_daily(spark_view(spark, sf, "telemetry"), path)
    kept = files.drop_expired(spark.read.parquet(path), "2024-02-10")
    return kept.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("sink_lines", "SELECT complaint_id, status FROM @complaints")
def sink_lines(spark, sf):
    """Two appends of JSON lines, read back as one table."""
    path = _folder(spark, "appended")
    rows = spark_view(spark, sf, "complaints").select("complaint_id", "status")
    done = F.col("status") == "RESOLVED"
    files.append_lines(rows.filter(done), path)
    files.append_lines(rows.filter(~done), path)
    return spark.read.schema("complaint_id bigint, status string").json(path)
