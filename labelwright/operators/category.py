"""Product category from label text, name and unit by weighted word signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.literals import map_of, structs_of
from labelwright.functions.plan import settle, spread
from labelwright.functions.rounding import half_up

# ---- Fixed values: order of categories, layers with weights, whole-word signals ---------------
CATEGORIES = [
    "food", "beverage", "cosmetic", "personal_care", "household", "electronics", "pharmaceutical", "agricultural",
]
WEIGHTS = {"EXPLICIT": 10, "PACKAGING": 6, "NAME": 5, "CONTEXT": 2, "UNIT": 1, "NEGATIVE": -15}
SIGNALS = {
    "EXPLICIT": {
        "food": ["fssai", "food safety", "dietary supplement", "proprietary food", "health supplement"],
        "beverage": ["fssai", "packaged drinking water", "sweetened beverage", "carbonated water"],
        "cosmetic": ["cosmetic product", "toiletries", "for cosmetic use"],
        "pharmaceutical": ["ayurvedic medicine", "prescription drug", "schedule h", "pharmacopoeia", "rx only"],
    },
    "PACKAGING": {
        "food": [
            "nutritional information", "nutrition facts", "calories", "protein", "carbohydrate", "fat", "ingredients", "best before",
            "use by", "trans fat",
        ],
        "beverage": ["nutritional information", "nutrition facts", "calories", "added sugar"],
        "cosmetic": [
            "for external use only", "avoid contact with eyes", "directions for use", "patch test", "dermatologically tested",
        ],
        "personal_care": ["for external use only", "avoid contact with eyes", "directions for use", "patch test"],
        "pharmaceutical": [
            "for external use only", "dosage", "physician", "keep out of reach of children", "store in a cool dry place",
        ],
        "household": [
            "keep out of reach of children", "for external use only", "harmful if swallowed", "corrosive", "caution:",
        ],
        "electronics": ["input 100-240v", "ac adapter", "power consumption", "wattage", "voltage", "hz", "warranty"],
    },
    "NAME": {
        "food": [
            "biscuits?", "chips", "snack", "masala", "atta", "noodles", "pasta", "flour", "rice", "dal", "spice", "cereal", "bread",
        ],
        "beverage": ["juice", "drink", "water", "soda", "tea", "coffee"],
        "cosmetic": [
            "shampoo", "lotion", "cream", "lipstick", "makeup", "moisturizer", "foundation", "sunscreen", "conditioner",
        ],
        "personal_care": [
            "toothbrush", "toothpaste", "soap", "deodorant", "perfume", "razor", "sanitary", "body wash", "hair oil",
        ],
        "household": [
            "surface cleaner", "floor cleaner", "household cleaner", "detergent", "cleaner", "dishwash", "laundry", "disinfectant",
            "phenyl",
        ],
        "electronics": [
            "charger", "adapter", "earphones", "headphones", "speaker", "laptop", "smartphone", "battery", "power bank",
        ],
        "pharmaceutical": ["tablet", "capsule", "medicine", "syrup", "ointment"],
        "agricultural": ["seed", "fertilizer", "pesticide", "insecticide", "herbicide"],
    },
    "CONTEXT": {
        "food": ["food", "eat", "delicious", "taste", "snack", "nutrition", "biscuits?", "chips", "masala", "spice"],
        "beverage": ["drink", "thirst", "refreshing", "liquid", "juice", "water", "soda", "tea", "coffee"],
        "cosmetic": ["skin", "hair", "beauty", "glow", "shine", "complexion", "shampoo", "lotion", "cream"],
        "personal_care": ["hygiene", "soap", "toothpaste"],
        "household": ["clean", "wash", "stain", "dirt", "floor", "surface", "home", "laundry", "detergent", "cleaner"],
        "electronics": ["device", "power", "charge", "electronic", "adapter", "charger"],
        "pharmaceutical": ["health", "relief", "pain", "cure", "doctor", "tablets?", "capsules?", "syrup"],
        "agricultural": ["crop", "farm", "yield", "plant", "seed", "fertilizer"],
    },
    "NEGATIVE": {
        "food": ["not for human consumption", "for external use only", "poison", "do not swallow"],
        "beverage": ["not for human consumption", "for external use only", "poison", "do not swallow"],
        "cosmetic": ["not for human consumption", "poison", "do not apply on skin"],
    },
}
UNIT_SIGNALS = {
    "food": ["g", "kg"],
    "beverage": ["ml", "l"],
    "cosmetic": ["ml", "g"],
    "household": ["ml", "l", "kg", "g"],
    "electronics": ["units", "n", "u"],
    "pharmaceutical": ["mg", "ml"],
}
# -----------------------------------------------------------------------------------------------


def word_pattern(signal: str) -> str:
    return rf"\b{signal}\b"


def _points(text: Column, layer: str, category: str) -> Column:
    """Matched signals of a layer times its weight; each signal counts once."""
    signals = SIGNALS[layer].get(category)
    if not signals:
        return F.lit(0)
    found = [F.when(text.rlike("(?i)" + word_pattern(s)), 1).otherwise(0) for s in signals]
    return reduce(lambda a, b: a + b, found) * WEIGHTS[layer]


def scores(products: DataFrame) -> DataFrame:
    """Score and contributing layers per product and category, as one array per product."""
    ocr, name, unit = F.coalesce("ocr_text", F.lit("")), F.lower(F.coalesce("name", F.lit(""))), F.lower("unit")

    def entry(category: str) -> Column:
        parts = {layer: _points(name if layer == "NAME" else ocr, layer, category) for layer in SIGNALS}
        units = UNIT_SIGNALS.get(category, [])
        parts["UNIT"] = F.coalesce(F.when(unit.isin(units), 1), F.lit(0)) if units else F.lit(0)
        return F.struct(
            F.lit(category).alias("category"),
            *[parts[layer].alias(layer) for layer in WEIGHTS],
        )

    return settle(spread(products), "points", F.array(*[entry(c) for c in CATEGORIES]))


def _winning(category: Column) -> Column:
    """What was matched for a category, as layer:text in the order of the tables.

    Only the patterns of the winning category are read again.
    """
    rows = [(c, layer, f"(?i){word_pattern(s)}") for layer, table in SIGNALS.items() for c, signals in table.items() for s in signals]
    own = F.filter(structs_of({"category": "string", "layer": "string", "pattern": "string"}, rows), lambda r: r["category"] == category)
    text = lambda r: F.when(r["layer"] == "NAME", F.coalesce("name", F.lit(""))).otherwise(F.coalesce("ocr_text", F.lit("")))
    hits = F.transform(own, lambda r: F.struct(r["layer"].alias("layer"), F.call_function("regexp_extract", text(r), r["pattern"], F.lit(0)).alias("found")))
    named = F.transform(F.filter(hits, lambda h: h["found"] != ""), lambda h: F.concat(h["layer"], F.lit(":"), F.lower(h["found"])))
    units = map_of(UNIT_SIGNALS)[category]
    unit = F.when(F.coalesce(F.array_contains(units, F.lower("unit")), F.lit(False)), F.array(F.concat(F.lit("UNIT:"), F.lower("unit")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(named, unit), ",")


def detect(products: DataFrame) -> DataFrame:
    """Best category per product with status, confidence and the layers that spoke for it.

    A product's eight scores stay in its own row; nothing is shuffled.
    """
    total = lambda p: reduce(lambda a, b: a + b, [p[layer] for layer in WEIGHTS])
    ranked = F.sort_array(
        F.transform(F.col("points"), lambda p, i: F.struct(total(p).alias("score"), (-i).alias("order"), p.alias("p"))), asc=False
    )
    best = settle(scores(products), "ranked", ranked).select(
        "product_id", "ocr_text", "name", "unit", F.col("ranked")[0].alias("top"), F.col("ranked")[1]["score"].alias("second")
    )
    score = F.col("top.score")
    clear = (score >= F.col("second") * 1.5) | (score - F.col("second") >= 8)
    status = F.when((score >= 8) & clear, F.lit("DETECTED")).when(score >= 4, F.lit("REVIEW")).otherwise(F.lit("UNKNOWN"))
    confidence = (
        F.when(F.col("status") == "DETECTED", F.least(F.lit(0.8) + score / 50, F.lit(0.99)))
        .when(F.col("status") == "REVIEW", F.least(F.lit(0.4) + score / 30, F.lit(0.79)))
        .otherwise(F.lit(0.0))
    )
    known = F.col("status") != "UNKNOWN"
    layers = F.array_compact(F.array(*[F.when(F.col(f"top.p.{layer}") != 0, F.lit(layer)) for layer in WEIGHTS]))
    return best.withColumn("status", status).select(
        "product_id",
        F.when(known, F.col("top.p.category")).otherwise(F.lit("unknown")).alias("category"),
        "status",
        half_up(confidence, 2).alias("confidence"),
        F.when(known, F.array_join(layers, ",")).otherwise(F.lit("")).alias("evidence"),
        F.when(known, _winning(F.col("top.p.category"))).otherwise(F.lit("")).alias("signals"),
        score.cast("bigint").alias("score"),
    )
