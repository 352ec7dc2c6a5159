"""Annotations: label files, validity, reviews, the verification queue, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.literals import map_of
from labelwright.operators.audit import one_row

# ---- Fixed values --------------------------------------------------------------------------
CLASS_IDS = [0, 1, 2]
DONE = ["ACCEPTED", "CORRECTED"]
HUMAN = ["human_verified", "human_corrected"]
TINY_AREA, HUGE_AREA = 0.001, 0.95
MILESTONES = [("MILESTONE_D", 100, 200), ("MILESTONE_C", 75, 150), ("MILESTONE_B", 50, 100), ("MILESTONE_A", 25, 50)]
# ----------------------------------------------------------------------------------------------


def parse_label_line(line: Column) -> Column:
    """struct(class_id, x, y, w, h) of ``class x y w h``; null unless there are five fields."""
    parts = F.split(F.trim(line), r"\s+")
    number = lambda i: parts[i].try_cast("double").alias("xywh"[i - 1])
    fields = F.struct(parts[0].try_cast("int").alias("class_id"), *[number(i) for i in range(1, 5)])
    return F.when(F.size(parts) == 5, fields)


def label_line(class_id: Column, *box: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, *box)


def label_errors(parsed: Column) -> Column:
    """Names of what is wrong with a parsed line."""
    p = lambda n: parsed[n]
    numeric = p("x").isNotNull() & p("y").isNotNull() & p("w").isNotNull() & p("h").isNotNull()
    fits = p("x").between(0, 1) & p("y").between(0, 1) & (p("w") > 0) & (p("w") <= 1) & (p("h") > 0) & (p("h") <= 1)
    return F.array_compact(
        F.array(
            F.when(parsed.isNull(), F.lit("malformed")),
            F.when(parsed.isNotNull() & ~F.coalesce(p("class_id").isin(CLASS_IDS), F.lit(False)), F.lit("class")),
            F.when(parsed.isNotNull() & ~numeric, F.lit("number")),
            F.when(numeric & ~fits, F.lit("geometry")),
        )
    )


def validate_labels(lines: DataFrame) -> DataFrame:
    """Per image: error and warning counts and the status that follows."""
    rows = lines.withColumn("p", parse_label_line(F.col("line"))).withColumn("e", label_errors(F.col("p")))
    area = F.col("p.w") * F.col("p.h")
    agg = rows.groupBy("image_id").agg(
        F.count("*").alias("lines"),
        F.sum(F.size("e")).cast("bigint").alias("errors"),
        F.count_if((area < TINY_AREA) | (area > HUGE_AREA)).alias("warnings"),
    )
    return agg.withColumn("status", F.when(F.col("errors") > 0, F.lit("rejected")).otherwise(F.lit("annotated")))


def import_new(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming boxes whose (image, class, centre to four places) is neither stored nor repeated."""
    key = F.concat_ws("_", "image_id", "class_id", F.format_string("%.4f", "x_center"), F.format_string("%.4f", "y_center"))
    fresh = incoming.withColumn("k", key).join(stored.select(key.alias("k")).distinct(), "k", "left_anti")
    first = fresh.groupBy("k").agg(F.min("annotation_id").alias("annotation_id"))
    return first.join(incoming, "annotation_id").drop("k")


def eligibility(class_ids=CLASS_IDS, approved=("proprietary",)) -> Column:
    """Reasons against using an annotation for training; none means eligible."""
    c = F.col
    inside = c("x_center").between(0, 1) & c("y_center").between(0, 1) & (c("width") > 0) & (c("width") <= 1) & (c("height") > 0) & (c("height") <= 1)
    return F.array_compact(
        F.array(
            F.when(~inside, F.lit("box")),
            F.when(~c("class_id").isin(list(class_ids)), F.lit("class")),
            F.when(~c("provenance").isin(HUMAN), F.lit("provenance")),
            F.when(~c("verification_status").isin(DONE), F.lit("status")),
            F.when(~c("source_license").isin(list(approved)), F.lit("license")),
        )
    )


BOX = ["x_center", "y_center", "width", "height"]


def apply_reviews(annotations: DataFrame, reviews: DataFrame, as_of=None) -> DataFrame:
    """Latest review action per annotation applied, of those up to ``as_of`` if given.

    A correction replaces class and box where the review has them; every reviewed record keeps the
    class, box and provenance it had (``original_...``), and who reviewed it when. A corrected box
    needs all four numbers, else the old one stays.
    """
    if as_of is not None:
        reviews = reviews.filter(F.col("reviewed_at") <= as_of)
    given = [c for c in ("new_class", *[f"new_{c}" for c in BOX], "reviewer") if c in reviews.columns]
    last = reviews.groupBy("annotation_id").agg(F.max(F.struct("reviewed_at", "seq", "action", *given)).alias("r"))
    action = F.col("r.action")
    rows = annotations.join(last, "annotation_id", "left")
    decided = F.coalesce(action.isin("ACCEPT", "CORRECT"), F.lit(False))
    corrected = F.coalesce(action == "CORRECT", F.lit(False))
    new = lambda name: F.col(f"r.{name}") if name in given else F.lit(None)
    boxed = corrected & F.lit(all(f"new_{c}" in given for c in BOX))
    for c in BOX:
        boxed = boxed & new(f"new_{c}").isNotNull()
    rows = rows.withColumns({
        "original_class": F.when(corrected, F.col("class_id")),
        **{f"original_{c}": F.when(decided, F.col(c)) for c in BOX},
        "original_provenance": F.when(decided, F.col("provenance")),
        "reviewed_at": F.when(decided | (action == "REJECT"), F.col("r.reviewed_at")),
        "reviewer": F.when(decided | (action == "REJECT"), new("reviewer")),
        "box_corrected": boxed,
    })
    rows = rows.withColumns({
        "class_id": F.when(corrected, F.coalesce(new("new_class"), "class_id")).otherwise(F.col("class_id")),
        **{c: F.when(F.col("box_corrected"), new(f"new_{c}")).otherwise(F.col(c)) for c in BOX},
        "verification_status": F.when(action == "ACCEPT", F.lit("ACCEPTED")).when(corrected, F.lit("CORRECTED")).when(action == "REJECT", F.lit("REJECTED")).otherwise(F.col("verification_status")),
        "provenance": F.when(action == "ACCEPT", F.lit("human_verified")).when(corrected, F.lit("human_corrected")).otherwise(F.col("provenance")),
    })
    return rows.withColumn("reasons", eligibility()).withColumn("training_eligible", F.size("reasons") == 0).drop("r")


def contaminated(final_set: DataFrame) -> DataFrame:
    """Weak candidates in a final set; must be empty."""
    return final_set.filter(F.col("provenance") == "weak_candidate")


# ---- verification queue ----------------------------------------------------------------------
def approved_licenses(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("approval_status") == "APPROVED").select(F.lower("license").alias("license")).distinct()


def by_license(images: DataFrame, registry: DataFrame, how: str) -> DataFrame:
    """Images under an approved licence (``left_semi``) or not (``left_anti``), ignoring case."""
    keyed = images.withColumn("license", F.lower(F.coalesce("source_license", F.lit(""))))
    return keyed.join(approved_licenses(registry), "license", how).drop("license")


def last_annotations(annotations: DataFrame) -> DataFrame:
    """The last annotation of each image."""
    last = F.max(F.struct("annotation_id", "class_id", "verification_status", "provenance")).alias("a")
    return annotations.groupBy("image_id").agg(last)


# Why an image has its priority.
PRIORITY_REASONS = {
    1: "declaration_panel candidate",
    2: "back-panel view",
    3: "underrepresented category",
    4: "product lacks verified annotation",
    5: "remaining unannotated candidate",
}


def queue(images: DataFrame, annotations: DataFrame, registry: DataFrame, open_statuses=("PENDING",)) -> DataFrame:
    """Every image with the reason it is left out, or its priority in the queue.

    Category and product counts are grouped on their own and joined back; a category with
    a third of all images is one row of the counts, and AQE splits its side of the join.
    """
    cat = F.coalesce("category", F.lit("unknown"))
    rows = images.withColumn("category", cat).withColumn("license", F.lower(F.coalesce("source_license", F.lit(""))))
    ok = approved_licenses(registry).withColumn("licensed", F.lit(True))
    categories = rows.groupBy("category").agg(F.count("*").alias("in_category"))
    products = rows.groupBy("product_id").agg(F.count("*").alias("in_product"))
    verified = annotations.filter(F.col("verification_status").isin(DONE)).select("product_id").distinct().withColumn("verified", F.lit(True))
    rows = (
        rows.join(ok, "license", "left")
        .join(last_annotations(annotations), "image_id", "left")
        .join(categories, "category")
        .join(products, "product_id")
        .join(verified, "product_id", "left")
    )
    status, dup = F.col("a.verification_status"), F.col("duplicate_status")
    excluded = (
        F.when(F.col("licensed").isNull(), F.lit("licenseBlocked"))
        .when(dup == "exact_duplicate", F.lit("exactDuplicates"))
        .when(dup == "malformed", F.lit("malformed"))
        .when(status.isin(DONE), F.lit("humanVerified"))
        .when(status == "REJECTED", F.lit("rejected"))
        .when(status.isNotNull() & ~status.isin(list(open_statuses)), F.lit("closed"))
    )
    declared = (F.col("view") == "declaration") | F.coalesce(F.col("a.class_id") == 2, F.lit(False))
    lacks = F.col("verified").isNull() | (F.col("in_product") <= 1)
    priority = F.when(declared, 1).when(F.col("view") == "back", 2).when(F.col("in_category") <= 1, 3).when(lacks, 4).otherwise(5)
    due = excluded.isNull()
    reasons = F.concat_ws(
        "; ",
        F.when(due, map_of(PRIORITY_REASONS)[priority]),
        F.when(due & (priority == 1) & (F.col("view") == "declaration"), F.lit("declaration view")),
        F.when(due & dup.isin("near_duplicate", "review"), F.lit("flagged for perceptual duplicate review")),
    )
    return rows.select(
        "image_id", "product_id", "path", "view", "category", excluded.alias("excluded"),
        F.when(excluded.isNull(), priority).alias("priority"),
        reasons.alias("reasons"),
        dup.isin("near_duplicate", "review").alias("duplicate_review"),
        F.coalesce(status, F.lit("NO_ANNOTATION")).alias("annotation_status"),
        F.coalesce("a.provenance", F.lit("none")).alias("provenance"),
    )


# ---- readiness -------------------------------------------------------------------------------
def milestone(products: Column, verified: Column) -> Column:
    out = None
    for name, p, v in MILESTONES:
        test = (products >= p) & (verified >= v)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("PRE_MILESTONE"))


def readiness(products: Column, verified: Column) -> Column:
    return (
        F.when((products < 50) | (verified < 100), F.lit("NOT_READY"))
        .when((products >= 100) & (verified >= 200), F.lit("READY_FOR_TRAINING"))
        .otherwise(F.lit("READY_FOR_SMALL_EXPERIMENT"))
    )


def strict_readiness(products: Column, verified: Column) -> Column:
    """struct(status, blockers) by the stricter gate."""
    blockers = F.array_compact(
        F.array(F.when(verified < 100, F.lit("annotations")), F.when(products < 50, F.lit("products")))
    )
    status = (
        F.when(F.size(blockers) > 0, F.lit("NOT_READY"))
        .when((verified >= 1000) & (products >= 200), F.lit("READY_FOR_MODEL"))
        .otherwise(F.lit("READY_FOR_EXPERIMENT"))
    )
    return F.struct(status.alias("status"), F.array_join(blockers, ",").alias("blockers"))


def dataset_counts(images: DataFrame, annotations: DataFrame, keys=()) -> DataFrame:
    """Products and human-verified annotations, per key of the images when given."""
    human = F.col("provenance").isin(HUMAN) & F.col("verification_status").isin(DONE)
    per_image = annotations.groupBy("image_id").agg(F.count_if(human).alias("verified"))
    joined = images.join(per_image, "image_id", "left")
    return joined.groupBy(*keys).agg(
        F.count_distinct("product_id").alias("products"), F.coalesce(F.sum("verified"), F.lit(0)).cast("bigint").alias("verified")
    )


def preflight(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Reason codes against training, as one row."""
    bad_box = ~(F.col("x_center").between(0, 1) & F.col("y_center").between(0, 1) & (F.col("width") > 0) & (F.col("height") > 0))
    human = F.col("provenance").isin(HUMAN) & F.col("verification_status").isin(DONE)
    a = annotations.agg(F.count_if(human).alias("verified"), F.coalesce(F.bool_or(human & bad_box), F.lit(False)).alias("bad"))
    per_product = images.groupBy("product_id").agg(
        F.count_distinct("split").alias("splits"), F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") == "validation").alias("validation"),
        F.bool_or(F.col("source_license") == "BLOCKED").alias("blocked"), F.bool_or(F.col("consent") == "DENIED").alias("denied"),
    )
    any_of = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    i = per_product.agg(
        F.count("*").alias("products"), any_of(F.col("splits") > 1).alias("leak"), any_of(F.col("train")).alias("train"),
        any_of(F.col("validation")).alias("validation"), any_of(F.col("blocked")).alias("blocked"), any_of(F.col("denied")).alias("denied"),
    )
    c = F.col
    code = lambda test, name: F.when(test, F.lit(name))
    reasons = F.array_compact(F.array(
        code(c("products") < 50, "INSUFFICIENT_PRODUCTS"), code(c("bad"), "INVALID_LABEL"), code(c("verified") < 100, "INSUFFICIENT_VERIFIED_ANNOTATIONS"),
        code((c("products") > 0) & ~c("train"), "MISSING_TRAIN_SPLIT"), code((c("products") > 0) & ~c("validation"), "MISSING_VALIDATION_SPLIT"),
        code(c("leak"), "PRODUCT_SPLIT_LEAKAGE"), code(c("blocked"), "LICENSE_GATE_FAILED"), code(c("denied"), "PRIVACY_GATE_FAILED"),
    ))
    return one_row(i, a).select("products", "verified", F.array_join(reasons, ",").alias("reasons"))


# ---- samples ---------------------------------------------------------------------------------
# Both vocabularies of consent, the stored one and the tested one.
CONSENT_WORDS = {"inference_only": "inference_only", "DENIED": "denied", "denied": "denied", "none": "none",
                 "allowed_for_training": "training", "training_allowed": "training"}
CANDIDATE_AT = 30


def learning_score(samples: DataFrame) -> DataFrame:
    c = F.col
    missing = lambda name: F.coalesce(c(name), F.lit("MISSING")).isin("MISSING", "")
    signals = [
        (F.coalesce(c("confidence") < 0.6, F.lit(False)), 30, "LOW_OCR_CONFIDENCE"),
        (missing("mrp"), 20, "MRP_NOT_FOUND"),
        (missing("net_quantity"), 20, "QUANTITY_NOT_FOUND"),
        (c("compliance_status") == "REVIEW", 25, "COMPLIANCE_REVIEW"),
        (c("compliance_status") == "FAIL", 10, "COMPLIANCE_FAIL"),
        (F.lower("category") == "unknown", 15, "CATEGORY_UNKNOWN"),
        (c("user_corrected"), 50, "USER_CORRECTED"),
    ]
    score = sum((F.when(test, F.lit(points)).otherwise(F.lit(0)) for test, points, _ in signals), F.lit(0))
    reasons = F.concat_ws(", ", *[F.when(test, F.lit(name)) for test, _, name in signals])
    blocked = F.when(c("consent") == "inference_only", F.lit("Consent limited to inference")).when(
        (c("source_type") == "user_upload") & ~c("consent").isin("allowed_for_training", "training_allowed"), F.lit("Upload without training consent")
    )
    rows = samples.withColumn("blocked", blocked).withColumn("points", score).withColumn("why", reasons)
    total = F.when(c("blocked").isNull(), c("points")).otherwise(F.lit(0))
    return rows.select(
        "sample_id", total.alias("score"), (c("blocked").isNull() & (c("points") >= CANDIDATE_AT)).alias("candidate"),
        F.coalesce("blocked", F.when(c("why") == "", F.lit("No critical learning signals")).otherwise(c("why"))).alias("reason"),
    )


def sample_gates(samples: DataFrame) -> DataFrame:
    c = F.col
    reason = (
        F.when(
            (c("license_status") != "APPROVED") & ~c("source_type").isin("user_upload", "proprietary"), F.lit("license_blocked")
        )
        .when(c("consent").isin("DENIED", "denied", "inference_only"), F.lit("consent_denied"))
        .when(c("quality") == "FAIL", F.lit("image_quality_failed"))
        .when(c("duplicate_status") == "exact_duplicate", F.lit("exact_duplicate"))
        .otherwise(F.lit("verified_permissioned_sample"))
    )
    return samples.withColumn("reason", reason).select(
        "sample_id", "reason", (c("reason") == "verified_permissioned_sample").alias("eligible"),
        F.when(c("reason") == "verified_permissioned_sample", F.lit("TRAINING_ELIGIBLE")).otherwise(F.lit("VERIFIED")).alias("candidate_status"),
    )


def merge_feedback(samples: DataFrame, feedback: DataFrame) -> DataFrame:
    """Corrections joined to samples; the first prediction is kept, the score rises by 50 each."""
    last = feedback.groupBy("sample_id").agg(F.max(F.struct("given_at", "seq", "corrected")).alias("f"), F.count("*").alias("n"))
    rows = samples.join(last, "sample_id", "left")
    has = F.col("f").isNotNull()
    return rows.select(
        "sample_id", F.when(has, F.col("mrp")).alias("original"), F.col("f.corrected").alias("corrected"),
        F.when(has, F.lit("NEEDS_REVIEW")).otherwise(F.col("candidate_status")).alias("candidate_status"),
        (F.col("learning_score") + F.coalesce("n", F.lit(0)) * 50).alias("learning_score"),
    )


VALID_LICENSES = ["proprietary", "cc-by-sa", "wiki"]
MIN_PIXELS = 300


def acquisition(images: DataFrame) -> DataFrame:
    """State each acquired image ends in. The first image of a hash (among those that passed the
    gates before) is the one that counts; the others are duplicates."""
    c = F.col
    licensed = F.coalesce(F.lower("source_license").isin(VALID_LICENSES), F.lit(False))
    sized = (c("width") >= MIN_PIXELS) & (c("height") >= MIN_PIXELS)
    first = images.filter(licensed & sized).groupBy("sha256").agg(F.min("image_id").alias("first"))
    rows = images.join(first, "sha256", "left")
    reason = (
        F.when(~licensed, F.lit("license"))
        .when(~sized, F.lit("quality"))
        .when(c("image_id") != c("first"), F.lit("duplicate"))
        .when(c("source_url").isNull() | c("acquired_at").isNull(), F.lit("provenance"))
    )
    state = F.when(reason.isNotNull(), F.lit("REJECTED")).when(c("human_verified"), F.lit("TRAINING_ELIGIBLE")).otherwise(F.lit("ANNOTATION_PENDING"))
    return rows.select("image_id", state.alias("state"), reason.alias("rejection"))


RESTRICTED = ["research_only", "non_commercial", "proprietary"]


def external_import(rows: DataFrame, class_map: dict, normalize_box) -> DataFrame:
    """External boxes with a usable licence and a class mapping that is not of low confidence.

    ``normalize_box`` gives the four normalised columns of a dataset's own box format.
    """
    from labelwright.functions.literals import map_of

    target = map_of({k: v for k, (v, confidence) in class_map.items() if confidence != "low"})[F.col("source_class")]
    usable = rows.filter(~F.col("license").isin(RESTRICTED)).withColumn("class_id", target.cast("int")).filter(F.col("class_id").isNotNull())
    return usable.select("annotation_id", "class_id", *normalize_box(), F.lit("external_dataset").alias("provenance"), F.col("source_class").alias("original_class"))
