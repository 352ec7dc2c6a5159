"""File sources and sinks: JSON lines, manifests, annotation arrays, label files, binary folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright import schemas
from labelwright.operators.annotations import parse_label_line
from labelwright.session import materialize


def product_lines(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata, one JSON object per line; blank and broken lines are skipped."""
    return spark.read.schema(schemas.PRODUCT_LINE).option("mode", "DROPMALFORMED").json(path)


def manifests(spark: SparkSession, path: str, one_object_per_file: bool = False) -> DataFrame:
    """Manifest objects; a missing path reads as an empty manifest."""
    try:
        return spark.read.schema(schemas.MANIFEST).option("multiLine", one_object_per_file).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schemas.MANIFEST)


def manifest_images(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("images").alias("i")).select("i.*")


def manifest_splits(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("productSplits").alias("product_id", "split"))


def object_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, text) of every object in files of JSON arrays; one large file is read by many tasks.

    The text reader cuts the file after each closing brace, so blocks of a file are read apart. A piece lies
    inside a string if an odd number of quotes comes before it, and an object ends where the braces outside of
    strings are balanced. Both are running sums: over the pieces of a block, and over the blocks of a file.
    Pieces of one object are put together again, also across blocks. Objects may be laid out in any way.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        F.col("_metadata.file_size").alias("size"),
    )
    quote = F.lit('"')
    # a backslash and what it escapes hide no quote; neither can be cut off by a closing brace
    plain = F.regexp_replace("value", r"\\.", "")
    pieces = raw.withColumn("plain", plain).withColumns({"quotes": F.regexp_count("plain", quote), "bytes": F.octet_length("value") + 1})
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    running = lambda value, over: F.coalesce(F.sum(value).over(over), F.lit(0))

    def step(odd: Column) -> Column:
        """What a piece adds to the depth, if a string is open before it or not."""
        rest = F.when(odd, F.regexp_replace("plain", r'^[^"]*("|$)', "")).otherwise(F.col("plain"))
        opened = F.regexp_count(F.regexp_replace(rest, r'"[^"]*("|$)', ""), F.lit(r"\{"))
        return opened - ((odd.cast("int") + F.col("quotes")) % 2 == 0).cast("int")

    # a block does not know yet whether it begins inside a string: both cases are worked out
    pieces = pieces.withColumn("odd", running("quotes", inside) % 2 == 1)
    pieces = pieces.withColumns({"even_step": step(F.col("odd")), "odd_step": step(~F.col("odd"))})
    pieces = pieces.withColumns({"even_depth": running("even_step", inside), "odd_depth": running("odd_step", inside), "bytes_before": running("bytes", inside)})
    pieces = materialize(pieces.drop("plain"), "pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("even_step").alias("even"), F.sum("odd_step").alias("odd"), F.sum("bytes").alias("bytes"))
    blocks = blocks.withColumn("open", running("quotes", earlier) % 2 == 1).withColumn("add", F.when(F.col("open"), F.col("odd")).otherwise(F.col("even")))
    blocks = blocks.select("file", "block", "open", running("add", earlier).alias("start"), running("bytes", earlier).alias("bytes_start"))
    pick = lambda name: F.when(F.col("open"), F.col(f"odd_{name}")).otherwise(F.col(f"even_{name}"))
    known = pieces.join(blocks, ["file", "block"])
    # the rest behind a file's last closing brace ends nothing: an object cut off there is none
    closed = F.col("bytes_start") + F.col("bytes_before") + F.col("bytes") <= F.col("size")
    closes = closed & (((F.col("odd") != F.col("open")).cast("int") + F.col("quotes")) % 2 == 0)
    ends = (closes & (F.col("start") + pick("depth") + pick("step") == 0)).cast("int")
    known = known.select("file", "block", "at", "value", ends.alias("ends"))
    first = known.groupBy("file", "block").agg(F.sum("ends").alias("n")).select("file", "block", running("n", earlier).alias("first"))
    placed = known.join(first, ["file", "block"]).withColumn("place", F.col("first") + running("ends", inside))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    whole = placed.groupBy("file", "place").agg(parts.alias("parts"), F.max("ends").alias("ended"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return whole.filter("ended = 1").select("file", "place", F.regexp_replace(text, r"^[^{]*", "").alias("text")).filter(F.col("text") != "")


def annotation_array(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of files that each hold JSON arrays; broken objects are skipped."""
    parsed = object_texts(spark, path).select(F.from_json("text", schemas.ANNOTATION).alias("r"))
    return parsed.select("r.*").filter(F.col("annotationId").isNotNull())


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Parsed label lines with the product and view their file is named after."""
    name = F.regexp_extract(F.input_file_name(), r"(product_\d+)_(front|back|declaration)", 0)
    rows = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"(product_\d+)", 1).alias("product_id"),
        F.regexp_extract(name, r"_(front|back|declaration)$", 1).alias("view"),
        parse_label_line(F.col("value")).alias("p"),
    )
    return rows.filter(F.col("p").isNotNull()).select("product_id", "view", "p.*")


def write_folders(rows: DataFrame, key: str, path: str) -> None:
    """Text files in one folder per key.

    A folder costs far more than its bytes: keys are dealt over all cores by number, not by size, and tasks
    move their own files into place instead of the driver moving all of them. The folder is new and is read
    only after the write, so a failed write leaves nothing that is read.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism * 4
    dealt = rows.repartition(parts, key)
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(path)


def binary_inventory(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Name, folder, size and content hash of every matching file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), "length", F.sha2("content", 256).alias("sha256")
    )


def magic_type(content: Column) -> Column:
    """Image type from the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.lit("jpg"))
        .when(head.startswith("89504E47"), F.lit("png"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    )


FIXED_IMAGE_FIELDS = ["front", "back", "ingredients", "nutrition", "packaging"]


def image_urls(products: DataFrame) -> DataFrame:
    """All image addresses of a product: selected ones (English, else the first language), then the
    fixed fields, then the generic one. An address counts once, where it comes first."""
    selected = F.transform(
        F.map_entries("selected_images"),
        lambda e: F.struct(
            e["key"].alias("type"),
            F.coalesce(e["value"]["en"], F.map_values(e["value"])[0]).alias("url"),
            F.concat(F.lit("selected."), e["key"]).alias("source"),
        ),
    )
    fixed = [F.struct(F.lit(f).alias("type"), F.col(f"image_{f}_url").alias("url"), F.lit(f"image_{f}_url").alias("source")) for f in FIXED_IMAGE_FIELDS]
    generic = F.struct(F.lit("unknown").alias("type"), F.col("image_url").alias("url"), F.lit("image_url").alias("source"))
    every = F.filter(F.concat(selected, F.array(*fixed, generic)), lambda e: F.coalesce(e["url"] != "", F.lit(False)))
    rows = products.withColumn("every", every)
    first = F.filter("every", lambda e, i: ~F.exists(F.slice("every", 1, i), lambda p: p["url"] == e["url"]))
    return rows.select("product_id", F.posexplode(first).alias("place", "e")).select("product_id", "place", "e.*")


# ---- sinks -----------------------------------------------------------------------------------
def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_split_folders(items: DataFrame, path: str) -> None:
    """One folder per split; rows are spread by hash inside it so that a large split has many files."""
    items.write.mode("overwrite").partitionBy("folder").parquet(path)


def write_label_text(lines: DataFrame, path: str) -> None:
    """One text line per row."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_daily(events: DataFrame, path: str) -> None:
    """Telemetry by day, so that expiry drops whole folders."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def drop_expired(stored: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Days still inside the retention; the filter prunes partitions."""
    return stored.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))
