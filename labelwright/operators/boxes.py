"""Operators over detected text boxes: lines, neighbourhoods, fusion, panels.

Input rows are ``image_id, det_id, text, confidence, x0, y0, x1, y1``; ``det_id`` gives
the reading order. Neighbour searches join on (image, horizontal band), so two boxes
meet only when they are close; an image with very many boxes never forms all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions import geometry as G
from labelwright.functions import patterns as P
from labelwright.functions import text as T
from labelwright.functions.plan import settle, spread
from labelwright.functions.rounding import half_up
from labelwright.session import materialize

BAND = 64.0
#: Bands of a neighbour search are wider than common reaches, so that an anchor is sent once or twice.
WIDE = 256.0
NEAR = 6.0


def _cy() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


# ---- lines ----------------------------------------------------------------------------
def reconstruct_lines(detections: DataFrame) -> DataFrame:
    """Text lines: a box starts a new one when its centre is at least half the mean height
    of it and the box above away from that box. The window stays within one image."""
    down = W.partitionBy("image_id").orderBy("cy", "det_id")
    boxes = detections.withColumn("cy", _cy()).withColumn("h", F.col("y1") - F.col("y0"))
    gap = F.abs(F.col("cy") - F.lag("cy").over(down))
    limit = (F.col("h") + F.lag("h").over(down)) / 2 * 0.5
    numbered = boxes.withColumn("starts", F.when(gap < limit, 0).otherwise(1)).withColumn(
        "line_no", F.sum("starts").over(down.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")
    )
    order = F.struct("x0", "cy", "det_id", "text")
    return numbered.groupBy("image_id", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda b: b["text"]), " ").alias("text"),
        half_up(F.avg("confidence"), 6).alias("confidence"),
        F.max("h").alias("height"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )


def prominence(detections: DataFrame) -> DataFrame:
    """Font and height of each box against the image's medians (lower one for fonts, upper one for heights)."""
    boxes = detections.select("image_id", "det_id", G.font_size(G.box()).alias("font"), G.height(G.box()).alias("h"))
    medians = boxes.groupBy("image_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY font)").alias("font_median"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN h > 0 THEN h END DESC)").alias("height_median"),
    )
    return boxes.join(medians.hint("merge"), "image_id").select(
        "image_id", "det_id", "font", "font_median", "height_median",
        (F.col("font") > F.col("font_median") * 1.2).alias("larger"),
        (F.col("font") > F.col("font_median") * 1.5).alias("much_larger"),
        F.coalesce(F.col("h") > F.col("height_median") * 1.5, F.lit(False)).alias("prominent"),
    )


# ---- neighbourhoods ---------------------------------------------------------------------
def neighbours(anchors: DataFrame, detections: DataFrame, radius: Column, extra=()) -> DataFrame:
    """Boxes of the same image closer to an anchor than ``radius`` (and not on top of it).

    Anchors carry a struct ``a``; the result adds the struct ``b`` (with ``extra`` columns of
    the detections, so that tests on a text run once per box, not once per pair) and the distance.

    The tables come from few small files and grow in many columns and rows on the way, so a size estimated
    from the files would send them through the driver: the join is a merge.
    """
    reach = anchors.withColumn("radius", radius).withColumn(
        "band",
        F.explode(
            F.sequence(
                F.floor((_mid("a") - F.col("radius")) / WIDE), F.floor((_mid("a") + F.col("radius")) / WIDE)
            )
        ),
    )
    others = as_boxes(detections, "b", extra).withColumn("band", F.floor(_mid("b") / WIDE))
    gap = G.distance(F.col("a"), F.col("b"))
    return (
        reach.join(others.hint("merge"), ["image_id", "band"])
        .filter(F.col("a.det_id") != F.col("b.det_id"))
        .withColumn("dist", gap)
        .filter((F.col("dist") > 0) & (F.col("dist") < F.col("radius")))
        .drop("band", "radius")
    )


def _mid(name: str) -> Column:
    return (F.col(f"{name}.y0") + F.col(f"{name}.y1")) / 2


def as_boxes(detections: DataFrame, name: str, extra=()) -> DataFrame:
    return detections.select(
        "image_id", F.struct("det_id", "text", "confidence", "x0", "y0", "x1", "y1", *extra).alias(name)
    )


def nearby_text(anchors: DataFrame, detections: DataFrame, factor: float = NEAR) -> DataFrame:
    """Texts around each anchor, nearest first."""
    near = neighbours(as_boxes(anchors, "a"), detections, G.font_size(F.col("a")) * factor)
    ordered = F.sort_array(F.collect_list(F.struct("dist", "b.det_id", "b.text")))
    return near.groupBy("image_id", F.col("a.det_id").alias("det_id")).agg(
        F.transform(ordered, lambda b: b["text"]).alias("nearby"), F.count("*").alias("n")
    )


FIELDS = {
    "mrp": P.MRP_LABEL,
    "netQuantity": P.NET_QTY_LABEL,
    "batchLotNumber": P.BATCH_LABEL,
    "consumerCareDetails": P.CONSUMER_CARE,
    **P.DATE_LABELS,
}


def _read(field: Column, value: Column, whole: Column, wanted) -> Column:
    """Value of a field in a text, by the field's own reader; null when it has none."""
    date = F.when(T.hits(value, P.SEE_ELSEWHERE) | T.hits(whole, P.SEE_ELSEWHERE), F.lit("REVIEW")).otherwise(
        F.coalesce(T.extract_date(value), T.extract_date(whole))
    )
    contact = F.concat_ws(
        " ", F.coalesce(T.email(value), T.email(whole)), F.coalesce(T.phone(value), T.phone(whole))
    )
    readers = {
        "mrp": lambda: T.labelled_price(value),
        "netQuantity": lambda: T.labelled_quantity(value),
        "batchLotNumber": lambda: T.labelled_batch(value, whole),
        "consumerCareDetails": lambda: F.when(contact != "", contact),
    }
    out = None
    for name in wanted:
        read = readers.get(name, lambda: date)()
        out = F.when(field == name, read) if out is None else out.when(field == name, read)
    return out


def labelled_values(detections: DataFrame, wanted=tuple(FIELDS)) -> DataFrame:
    """Best value per image and field: in the label's own box, else in the nearest box, else in
    that box joined with the one nearest to it.

    Only boxes that hit a label pattern take part as anchors; they and the boxes near them
    are the only intermediate tables. The best candidate is a
    ``min`` over structs, which combines before the shuffle.
    """
    detections = spread(detections, "image_id")
    label_hit = F.filter(
        F.array(*[F.when(T.hits(F.col("text"), FIELDS[f]), F.lit(f)) for f in wanted]), lambda f: f.isNotNull()
    )
    rest = None
    for f in wanted:
        tail = T.after(F.col("a.text"), FIELDS[f])
        rest = F.when(F.col("field") == f, tail) if rest is None else rest.when(F.col("field") == f, tail)
    anchors = (
        detections.withColumn("fields", label_hit)
        .filter(F.size("fields") > 0)
        .select(
            "image_id",
            F.struct("det_id", "text", "confidence", "x0", "y0", "x1", "y1").alias("a"),
            F.explode("fields").alias("field"),
        )
        .withColumn("size", G.font_size(F.col("a")))
    )
    anchors = settle(anchors, "rest", rest)
    anchors = settle(anchors, "own", _read(F.col("field"), F.col("rest"), F.col("a.text"), wanted))
    # Label boxes are few; both branches below start from them, so they are written once.
    anchors = materialize(anchors, "anchors")
    none = F.lit(None).cast("bigint")
    same_box = anchors.filter(F.col("own").isNotNull()).select(
        "image_id", "field", F.lit(0.0).alias("dist"), F.col("a.det_id").alias("anchor"), none.alias("first"),
        none.alias("second"), F.lit(0.0).alias("hop"), F.col("own").alias("value"), F.col("a.confidence").alias("confidence"),
    )
    # a value in a label's own box has distance zero: no other label of that image and field can win
    settled = same_box.select("image_id", "field").distinct()
    place = F.struct(*[f"a.{k}" for k in ("det_id", "confidence", "x0", "y0", "x1", "y1")]).alias("a")
    open_ = anchors.filter(F.col("own").isNull()).select("image_id", "field", "size", place).join(settled.hint("merge"), ["image_id", "field"], "left_anti")
    near = neighbours(open_, detections, F.col("size") * NEAR)
    near = settle(near, "direct", _read(F.col("field"), F.col("b.text"), F.col("b.text"), wanted)).select(
        "image_id", "field", "size", "dist", F.col("a.det_id").alias("anchor"), F.col("a.confidence").alias("sure"), "b", "direct"
    )
    near = materialize(near, "near")
    one_hop = near.filter(F.col("direct").isNotNull()).select(
        "image_id", "field", "dist", "anchor", F.col("b.det_id").alias("first"), none.alias("second"),
        F.lit(0.0).alias("hop"), F.col("direct").alias("value"),
        ((F.col("sure") + F.col("b.confidence")) / 2).alias("confidence"),
    )
    # the first hop orders the results: boxes farther than the nearest one with a value start no second hop
    nearest = near.filter(F.col("direct").isNotNull()).groupBy("image_id", "field").agg(F.min("dist").alias("best"))
    outer = near.filter(F.col("direct").isNull()).join(nearest.hint("merge"), ["image_id", "field"], "left")
    outer = outer.filter(F.col("best").isNull() | (F.col("dist") <= F.col("best"))).select(
        "image_id", "field", "size", F.col("dist").alias("first_dist"), "anchor", "sure", F.col("b").alias("a")
    )
    pairs = neighbours(outer, detections, F.col("size") * 8).filter(F.col("b.det_id") != F.col("anchor"))
    pairs = settle(pairs, "joined", F.concat_ws(" ", "a.text", "b.text"))
    two_hop = (
        settle(pairs, "value", _read(F.col("field"), F.col("joined"), F.col("joined"), wanted))
        .filter(F.col("value").isNotNull())
        .select(
            "image_id", "field", F.col("first_dist").alias("dist"), "anchor",
            F.col("a.det_id").alias("first"), F.col("b.det_id").alias("second"), F.col("dist").alias("hop"), "value",
            ((F.col("sure") + F.col("a.confidence") + F.col("b.confidence")) / 3).alias("confidence"),
        )
    )
    best = F.min(F.struct("dist", "anchor", F.coalesce("first", F.lit(-1)).alias("first"), "hop", "second", "value", "confidence"))
    return (
        same_box.unionByName(one_hop)
        .unionByName(two_hop)
        .groupBy("image_id", "field")
        .agg(best.alias("m"))
        .select(
            "image_id",
            "field",
            F.col("m.value").alias("value"),
            F.col("m.anchor").alias("anchor_det"),
            half_up(F.col("m.dist"), 6).alias("dist"),
            half_up(F.col("m.confidence"), 6).alias("confidence"),
            F.when(F.col("m.dist") == 0, F.lit("EXPLICIT_LABEL")).otherwise(F.lit("SPATIAL_ASSOCIATION")).alias("source_type"),
        )
    )


def rejoin_tokens(anchors: DataFrame, detections: DataFrame, pattern: str) -> DataFrame:
    """An anchor joined with its nearest box, in either order, such that the pattern matches."""
    near = neighbours(as_boxes(anchors, "a"), detections, G.font_size(F.col("a")) * NEAR)
    forward, backward = F.concat_ws(" ", "a.text", "b.text"), F.concat_ws(" ", "b.text", "a.text")
    hit = F.when(T.hits(forward, pattern), forward).when(T.hits(backward, pattern), backward)
    best = F.min(F.struct("dist", F.col("b.det_id").alias("other"), F.col("joined")))
    return (
        settle(near, "joined", hit)
        .filter(F.col("joined").isNotNull())
        .groupBy("image_id", F.col("a.det_id").alias("det_id"))
        .agg(best.alias("m"))
        .select("image_id", "det_id", F.col("m.other").alias("other_det"), F.col("m.joined").alias("text"))
    )


# ---- fusion of a whole-image reading with readings of regions --------------------------
def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def same_letters(x: Column, y: Column) -> Column:
    """1 for equal letters and digits, 0.8 when one contains the other, else 0."""
    return (
        F.when((x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(x.contains(y) | y.contains(x), F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def fuse(full: DataFrame, regions: DataFrame, margin: float = 5.0) -> DataFrame:
    """Region readings plus the whole-image readings that do not repeat one of them.

    A whole-image box meets the region boxes whose band range covers its centre.
    """
    wide = settle(spread(regions, "image_id"), "r_letters", _letters(F.col("text"))).select(
        "image_id",
        "r_letters",
        *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.explode(
            F.sequence(F.floor((F.col("y0") - margin) / BAND), F.floor((F.col("y1") + margin) / BAND))
        ).alias("band"),
    )
    cx, cy = G.center(G.box())
    located = settle(spread(full, "image_id"), "letters", _letters(F.col("text")))
    located = located.withColumn("cx", cx).withColumn("cy", cy).withColumn("band", F.floor(cy / BAND))
    repeats = (
        (located["image_id"] == wide["image_id"])
        & (located["band"] == wide["band"])
        & F.col("cx").between(F.col("r_x0") - margin, F.col("r_x1") + margin)
        & F.col("cy").between(F.col("r_y0") - margin, F.col("r_y1") + margin)
        & (same_letters(F.col("letters"), F.col("r_letters")) > 0.6)
    )
    kept = located.join(wide, repeats, "left_anti").drop("cx", "cy", "band", "letters")
    return regions.withColumn("source", F.lit("roi")).unionByName(kept.withColumn("source", F.lit("full")))


def select_regions(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions worth reading by view; an image without any is read as a whole."""
    wanted = F.when(F.col("view") == "front", F.lit("principal_display_panel")).otherwise(F.lit("declaration_panel"))
    chosen = images.join(regions, "image_id").filter(F.col("class_name") == wanted)
    whole = images.join(chosen.select("image_id").distinct(), "image_id", "left_anti")
    return chosen.select("image_id", "view", "class_name", "region_id").unionByName(
        whole.select(
            "image_id", "view", F.lit("full_image").alias("class_name"), F.lit(None).cast("bigint").alias("region_id")
        )
    )


# ---- finding a value's box by its text ------------------------------------------------------
def first_box_with(values: DataFrame, detections: DataFrame, needle: Column) -> DataFrame:
    """For each value the first box of its image whose text contains ``needle`` (ignoring case).

    ``min`` over (det_id, box) keeps one candidate per value and task before the shuffle.
    """
    wanted = values.withColumn("needle", F.lower(needle)).filter(F.col("needle") != "")
    boxes = as_boxes(detections, "b")
    found = wanted.join(boxes, "image_id").filter(F.contains(F.lower(F.col("b.text")), F.col("needle")))
    return found.groupBy("image_id", "field").agg(F.min("b").alias("hit"))


def panel_relation(values: DataFrame, panels: DataFrame, detections: DataFrame) -> DataFrame:
    """Where each value lies relative to the display panel: by its own box, else by the first
    box that holds its evidence text, else by the first that holds the value."""
    missing = values.filter(F.col("x0").isNull())
    by_evidence = first_box_with(missing, detections, F.col("evidence")).withColumnRenamed("hit", "e")
    by_value = first_box_with(missing, detections, F.col("value")).withColumnRenamed("hit", "v")
    box = lambda n: F.struct(*[F.col(f"{n}.{c}") for c in ("x0", "y0", "x1", "y1")])
    located = (
        values.join(by_evidence, ["image_id", "field"], "left")
        .join(by_value, ["image_id", "field"], "left")
        .withColumn(
            "fbox",
            F.when(F.col("x0").isNotNull(), G.box())
            .when(F.col("e").isNotNull(), box("e"))
            .when(F.col("v").isNotNull(), box("v")),
        )
    )
    p = panels.select("image_id", G.box().alias("pbox"), F.col("confidence").alias("panel_confidence"))
    relation = F.when(F.col("pbox").isNull() | F.col("fbox").isNull(), F.lit("UNKNOWN")).otherwise(
        G.relation(F.col("fbox"), F.col("pbox"))
    )
    return located.join(p, "image_id", "left").select(
        "image_id", "field", relation.alias("relation"), half_up(G.overlap_ratio(F.col("fbox"), F.col("pbox")), 6).alias("overlap")
    )


# Fixed values of measurement.
MAX_RELATIVE_UNCERTAINTY = 0.5
LENGTH_UNITS = ["mm", "cm", "m", "inch", "in"]


def measurements(values: DataFrame, detections: DataFrame, calibrations: DataFrame, trusted=()) -> DataFrame:
    """Pixel and, under a sound calibration, physical height of each value's box."""
    hit = first_box_with(values, detections, F.col("value"))
    c = F.col
    sound = (
        (c("known_size") > 0) & (c("pixel_size") > 0) & (c("uncertainty") >= 0)
        & c("known_unit").isin(LENGTH_UNITS) & c("calibration_confidence").between(0, 1)
    )
    status = (
        F.when(c("method").isNull() | (c("method") == "NONE"), F.lit("UNCALIBRATED"))
        .when(~F.coalesce(sound, F.lit(False)), F.lit("UNCERTAIN"))
        .when(c("uncertainty") / c("known_size") >= MAX_RELATIVE_UNCERTAINTY, F.lit("UNCERTAIN"))
        .otherwise(F.lit("CALIBRATED"))
    )
    trust = (
        F.when(c("method").isNull() | (c("method") == "NONE"), F.lit("UNKNOWN"))
        .when(c("calibration_source").isin(list(trusted)) if trusted else F.lit(False), F.lit("TRUSTED"))
        .otherwise(F.lit("UNTRUSTED"))
    )
    box = c("hit")
    measured = (
        hit.join(calibrations, "image_id", "left")
        .withColumn("status", F.when(F.coalesce(c("rotated"), F.lit(False)), F.lit("UNCERTAIN")).otherwise(status))
        .withColumn("pixel_height", G.height(box))
        .withColumn("pixel_width", G.width(box))
        .withColumn("scale", F.when(c("status") == "CALIBRATED", c("known_size") / c("pixel_size")))
    )
    return measured.select(
        "image_id",
        "field",
        "pixel_width",
        "pixel_height",
        half_up(c("pixel_height") * c("scale"), 6).alias("physical_height"),
        half_up(c("pixel_width") * c("scale"), 6).alias("physical_width"),
        half_up(c("pixel_height") * c("scale") * c("uncertainty") / c("known_size"), 6).alias("uncertainty"),
        F.when(c("scale").isNotNull(), c("known_unit")).otherwise(F.lit("NONE")).alias("unit"),
        "status",
        trust.alias("calibration_trust"),
    )


# ---- per-image summaries ---------------------------------------------------------------
def union_boxes(detections: DataFrame) -> DataFrame:
    return detections.groupBy("image_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        half_up(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("confidence"),
    )


def image_sizes(detections: DataFrame) -> DataFrame:
    """Size guess from the boxes: a tenth beyond the farthest corner."""
    size = lambda c: F.ceil(F.greatest(F.max(c), F.lit(0.0)) * 1.1)
    return detections.groupBy("image_id").agg(size("x1").cast("double").alias("img_w"), size("y1").cast("double").alias("img_h"))


def region_flags(detections: DataFrame) -> DataFrame:
    """Whether a box starts in the lowest 35 percent of its image."""
    return detections.join(image_sizes(detections), "image_id").select(
        "image_id", "det_id", "img_h", (F.col("y0") >= F.col("img_h") * 0.65).alias("declaration_region")
    )


def weak_candidates(detections: DataFrame) -> DataFrame:
    """One normalised box per image around all boxes that carry a legal keyword, five percent wider."""
    sizes = image_sizes(detections)
    keyword = F.upper("text").rlike("|".join(P.LEGAL_KEYWORDS))
    hits = detections.filter(keyword).groupBy("image_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg(F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, F.lit(0.8)).otherwise(F.col("confidence"))).alias("confidence"),
        F.count("*").alias("hits"),
    )
    w, h = F.col("img_w"), F.col("img_h")
    padded = F.struct(
        (F.col("x0") - w * 0.05).alias("x0"), (F.col("y0") - h * 0.05).alias("y0"),
        (F.col("x1") + w * 0.05).alias("x1"), (F.col("y1") + h * 0.05).alias("y1"),
    )
    r = lambda n: half_up(F.col(f"n.{n}"), 6).alias(n)
    return (
        hits.join(sizes, "image_id")
        .withColumn("n", G.normalized(padded, w, h))
        .filter(F.col("n").isNotNull())
        .select("image_id", r("cx"), r("cy"), r("w"), r("h"), half_up(F.col("confidence"), 6).alias("confidence"), "hits")
    )
