"""Image names, views, categories and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.operators.annotations import DONE, HUMAN
from labelwright.operators.ranking import numbered
from labelwright.session import materialize

# ---- Fixed values --------------------------------------------------------------------------
VIEW_WORDS = {
    "front": ["front"],
    "back": ["back"],
    "declaration": ["declaration", "legal", "label"],
}
CATEGORY_NAMES = [
    "food", "beverage", "snack", "spice", "staples", "dairy", "personal_care", "oral_care", "household", "cleaning", "cosmetic",
    "pharmaceutical", "electronics", "agricultural", "other", "unknown",
]
CATEGORY_WORDS = {
    "staples": ["staple", "staples", "rice", "atta", "aata", "flour", "wheat", "gram", "dal", "lentil", "pulses"],
    "spice": ["spice", "spices", "masala", "turmeric", "cumin", "chilli", "chili", "curry", "coriander"],
    "dairy": ["dairy", "milk", "paneer", "butter", "ghee", "curd", "yogurt", "yoghurt", "cheese"],
    "beverage": ["beverage", "beverages", "drink", "juice", "cola", "soda", "softdrink", "water"],
    "snack": ["snack", "snacks", "chips", "biscuit", "biscuits", "cookie", "cookies", "namkeen", "namkin", "wafers"],
    "personal_care": [
        "personal_care", "personalcare", "soap", "shampoo", "lotion", "bodywash", "body_wash", "deodorant", "conditioner", "facewash",
    ],
    "oral_care": ["oral_care", "oralcare", "toothpaste", "toothbrush", "mouthwash", "dental"],
    "cosmetic": ["cosmetic", "cosmetics", "makeup", "lipstick", "foundation", "kajal", "cream", "lotion_bar"],
    "household": ["household", "homecare", "home_care", "home"],
    "cleaning": ["cleaning", "detergent", "dishwash", "cleaner", "floor_cleaner", "wipe", "bleach"],
    "pharmaceutical": [
        "pharmaceutical", "pharma", "medicine", "tablet", "syrup", "capsule", "ointment", "ayurvedic", "ayurveda",
    ],
    "electronics": ["electronics", "electronic", "battery", "bulb", "charger", "cable"],
    "agricultural": ["agricultural", "agriculture", "fertilizer", "fertiliser", "pesticide", "insecticide", "seed"],
    "food": ["food", "edible", "noodle", "noodles", "pasta", "sauce", "pickle", "honey", "jam", "soup", "oat"],
}
KIND_POINTS = {"back": 5, "ingredients": 5, "nutrition": 5, "packaging": 4, "front": 3}
LARGE_AREA = 300_000
# ----------------------------------------------------------------------------------------------


def _tokens(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def view_of(path: Column) -> Column:
    """View named by the file; none or more than one gives unknown."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"(?i)\.[a-z0-9]+$", "")
    token = _tokens(name)
    found = F.array_compact(F.array(*[F.when(token.rlike(rf"(^|_)({'|'.join(words)})($|_)"), F.lit(view)) for view, words in VIEW_WORDS.items()]))
    return F.when(F.size(found) == 1, found[0]).otherwise(F.lit("unknown"))


def infer_category(folders: DataFrame) -> DataFrame:
    """Category with most keyword hits in folder and file; a tie stays unknown. A given value wins."""
    rows = folders.select("*", _tokens(F.col("folder")).alias("a"), _tokens(F.col("file")).alias("b"))

    def hits(column: str, words: list[str]) -> Column:
        return sum((F.when(F.col(column).rlike(f"(^|_){w}($|_)"), 1).otherwise(0) for w in words), F.lit(0))

    table = F.array(*[
        F.struct(F.lit(name).alias("category"), hits("a", words).alias("folder"), hits("b", words).alias("file")) for name, words in CATEGORY_WORDS.items()
    ])
    total = lambda h: h["folder"] + h["file"]
    rows = rows.withColumn("hits", F.filter(table, lambda h: total(h) > 0)).withColumn("top", F.array_max(F.transform("hits", total)))
    rows = rows.withColumn("best", F.filter("hits", lambda h: total(h) == F.col("top")))
    one, given = F.size("best") == 1, F.col("override")
    b = F.col("best")[0]
    known = given.isin(CATEGORY_NAMES)
    category = F.when(given.isNotNull(), F.when(known, given)).when(one, b["category"])
    source = F.when(given.isNotNull(), F.when(known, F.lit("explicit_metadata"))).when(one, F.when(b["folder"] >= b["file"], F.lit("directory")).otherwise(F.lit("filename")))
    confidence = F.when(given.isNotNull(), F.when(known, F.lit(1.0))).when(one & (b["folder"] > 0) & (b["file"] == 0), F.lit(0.85)).when(one & (b["file"] > 0) & (b["folder"] == 0), F.lit(0.6))
    unknown = F.lit("unknown")
    return rows.select("product_id", F.coalesce(category, unknown).alias("category"), F.coalesce(source, unknown).alias("source"), confidence.alias("confidence"))


def annotation_manifest(images: DataFrame) -> DataFrame:
    """Standard file names, everything pending, with the number of images of each view."""
    # written first: Spark then knows that it is a row per view and leaves the images where they are
    counts = materialize(images.groupBy("view").agg(F.count("*").alias("in_view")), "views")
    ext = F.lower(F.regexp_extract("path", r"\.[a-zA-Z]+$", 0))
    return images.join(counts, "view").select(
        "image_id", "product_id", "view", F.concat(F.concat_ws("_", "product_id", "view"), ext).alias("file_name"), F.lit("pending").alias("status"), "in_view"
    )


def annotation_profile(annotations: DataFrame) -> DataFrame:
    n = F.count_if
    status, human = F.col("verification_status"), F.col("provenance").isin(HUMAN)
    return annotations.agg(
        F.count("*").alias("annotations"),
        n(F.col("provenance") == "weak_candidate").alias("weak"),
        *[n(status == s).alias(s.lower()) for s in ("PENDING", "ACCEPTED", "CORRECTED", "REJECTED")],
        n(human).alias("human_verified"),
        *[n(human & (F.col("class_id") == i)).alias(f"class_{i}") for i in range(3)],
        n("training_eligible").alias("training_eligible"),
    )


def best_candidates(images: DataFrame, limit: int) -> DataFrame:
    """The images most worth fetching (top-k report), by kind, language, size and company."""
    views = images.groupBy("product_id").agg(F.count("*").alias("views"))
    kind = sum((F.when(F.col("kind") == k, p).otherwise(0) for k, p in KIND_POINTS.items()), F.lit(0))
    two = lambda test: F.when(test, 2).otherwise(0)
    score = kind + two(F.coalesce(F.col("category") == "en", F.lit(False))) + two(F.col("width") * F.col("height") > LARGE_AREA) + two(F.col("views") > 1)
    top = images.join(views, "product_id").select("image_id", score.alias("score")).orderBy(F.desc("score"), "image_id").limit(limit)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "image_id"))).alias("rows"))  # at most ``limit`` entries
    return listed.select(F.posexplode("rows").alias("i", "r")).select("r.image_id", (-F.col("r.minus")).alias("score"), (F.col("i") + 1).alias("position"))


def split_listing(images: DataFrame) -> DataFrame:
    """Every image with its place in the list of its split and product.

    Rows instead of arrays: a product with a third of all images is spread over tasks.
    """
    rows = materialize(numbered(images.select("split", "product_id", "image_id"), ["split", "product_id", "image_id"], "_n"), "listing")
    begin = rows.groupBy("split", "product_id").agg(F.min("_n").alias("_begin"))
    return rows.join(begin, ["split", "product_id"]).select(
        "split", "product_id", "image_id", (F.col("_n") - F.col("_begin") + 1).alias("place")
    )


def product_images(products: DataFrame, images: DataFrame) -> DataFrame:
    """Images of known products with the number of images of their product."""
    counts = images.groupBy("product_id").agg(F.count("*").alias("images"))
    known = products.select("product_id").distinct().join(counts, "product_id")
    return images.join(known, "product_id").select("product_id", "image_id", "view", "images")


def holdout_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    holdout = images.filter(F.col("split").isin("validation", "test")).select("image_id")
    verified = annotations.filter(F.col("provenance").isin(HUMAN) & F.col("verification_status").isin(DONE))
    return verified.join(holdout, "image_id", "left_semi")


def exportable(images: DataFrame) -> DataFrame:
    """Finished images with the folder they go to."""
    folder = F.when(F.col("split") == "train", F.lit("train")).otherwise(F.lit("val"))
    return images.filter(F.col("status").isin("annotated", "validated")).select("image_id", "path", folder.alias("folder"))
