"""Stand-in views: the domain tables expressed over the driver's parquet tables.

Each view is one SELECT that Spark and DuckDB both read. ``@name`` refers to another
view or to a parquet table; ``«a¦b»`` gives the Spark and the DuckDB spelling where the
two differ. The views only shape input; every operator is written separately for Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

_TOKEN = re.compile(r"@(\w+)")
_CHOICE = re.compile(r"«([^¦»]*)¦([^»]*)»")


def define(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _expand(sql: str, table_ref, side: int) -> str:
    def token(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return "(" + _expand(VIEWS[name], table_ref, side) + ")"
        return table_ref(name) if name in TABLES else match.group(0)

    return _TOKEN.sub(token, _CHOICE.sub(lambda m: m.group(side), sql))


def duck_sql(sql: str) -> str:
    return _expand(sql, lambda name: name, 2)


def _dealt(table: str, key: str) -> str:
    """A narrow table dealt by key in Spark before costly work on its rows.

    A million rows of it fit few files and splits. Adaptive execution chooses how many partitions the
    shuffled bytes are worth, a core each at least where they are more than a megabyte a core.
    """
    return f"«(SELECT /*+ REPARTITION({key}) */ * FROM {table})¦{table}»"


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view or raw table as a DataFrame."""
    # The tables hold UTC times without a zone; day and window bounds are meant in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ref = lambda table: f"parquet.`{sf_dir}/{table}.parquet`"
    return spark.sql(_expand(f"SELECT * FROM @{name}", ref, 1))


# ---- inspections: one per order --------------------------------------------------------
define("inspections", """
SELECT o_orderkey AS product_id, o_custkey % 50 AS user_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'COMPLIANT'
            WHEN o_orderstatus = 'F' THEN 'NON_COMPLIANT' ELSE 'REVIEW' END AS compliance_status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'food' WHEN '2-HIGH' THEN 'beverage'
            WHEN '3-MEDIUM' THEN 'cosmetic' WHEN '5-LOW' THEN 'household' ELSE 'unknown' END AS category,
       CASE WHEN o_orderkey % 13 = 0 THEN 'FAILED' WHEN o_orderkey % 17 = 0 THEN 'PROCESSING'
            ELSE 'COMPLETED' END AS analysis_status,
       cast(o_orderdate AS timestamp) AS created_at, o_totalprice AS mrp,
       'BATCH-' || cast(o_orderkey AS string) AS batch_lot_number,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 8 + (o_custkey % 97) * cast(0.021 AS double) END AS latitude,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 72 + (o_custkey % 89) * cast(0.023 AS double) END AS longitude,
       o_custkey AS customer_key
FROM @orders""")

define("inspections_named", """
SELECT i.*, c.c_mktsegment || ' pack' AS product_name, 'Brand ' || c.c_mktsegment AS brand_name,
       c.c_name AS manufacturer_name, c.c_nationkey AS nation_key
FROM @inspections i JOIN @customer c ON i.customer_key = c.c_custkey""")


# ---- product facts: declarations and context of one packaged good per part ---------------
define("product_facts", """
SELECT p_partkey AS product_id, p_partkey % 20 AS user_id,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN 'UNKNOWN' ELSE p_brand || ' Foods' END AS manufacturer_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'Plot ' || cast(p_partkey AS string) END AS manufacturer_address,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'India' END AS country_of_origin,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS common_generic_name,
  CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN cast(0 AS double)
       WHEN p_partkey % 31 = 0 THEN cast(-2 AS double) WHEN p_partkey % 3 = 0 THEN cast(p_size AS double)
       WHEN p_partkey % 3 = 1 THEN cast(p_size * 25 AS double) ELSE cast(p_size AS double) / 4 END AS net_value,
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE CASE p_partkey % 9 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'Litre'
       WHEN 4 THEN 'pcs' WHEN 5 THEN 'cm' WHEN 6 THEN 'xyz' WHEN 7 THEN 'KGS' ELSE 'm' END END AS net_unit,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE date '2024-01-01' + cast(p_partkey % 300 AS int) END AS date_of_manufacture,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE date '2024-01-03' + cast(p_partkey % 300 AS int) END AS date_of_packing,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE date '2023-12-27' + cast(p_partkey % 300 + p_partkey % 41 AS int) END AS expiry_date,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN cast(0 AS double) ELSE p_retailprice END AS mrp,
  CASE WHEN p_partkey % 2 = 0 THEN '1800-123-4567' END AS care_phone,
  CASE WHEN p_partkey % 5 = 0 THEN 'care(at)brand.example' END AS care_email,
  CASE WHEN p_partkey % 9 = 0 THEN '10 x 20 cm' END AS dimensions,
  CASE WHEN p_partkey % 10 = 0 THEN '1.25' END AS unit_sale_price,
  CASE p_partkey % 13 WHEN 0 THEN 'INDUSTRIAL' WHEN 1 THEN 'INSTITUTIONAL' WHEN 2 THEN NULL WHEN 3 THEN 'OTHER' ELSE 'RETAIL' END AS consumer_type,
  CASE p_partkey % 3 WHEN 0 THEN 'IMPORTED' WHEN 1 THEN 'DOMESTIC' END AS import_status,
  CASE p_partkey % 8 WHEN 0 THEN 'COMBINATION' WHEN 1 THEN 'GROUP' WHEN 2 THEN 'MULTI_PIECE' WHEN 3 THEN NULL ELSE 'SINGLE' END AS package_type,
  CASE p_partkey % 5 WHEN 0 THEN 'medical_device' WHEN 1 THEN 'food' WHEN 2 THEN 'cosmetic' WHEN 3 THEN 'household' END AS domain,
  CASE WHEN p_partkey % 4 <> 0 THEN lower(p_type) END AS commodity_type,
  CASE WHEN p_partkey % 6 = 0 THEN '10x10' END AS package_dimensions,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS expiry_required,
  CASE (p_partkey + 1) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS dimensions_applicable,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS usp_applicable,
  CASE p_partkey % 9 WHEN 1 THEN 'manufacturerName,mrp' WHEN 2 THEN 'netQuantity,expiryOrUseByDate'
       WHEN 3 THEN 'legibility,numeralLetterHeight' WHEN 4 THEN 'consumerCareDetails,dimensions,unitSalePrice' ELSE '' END AS confirmed_absent,
  CASE WHEN p_partkey % 12 = 5 THEN 'confirmed' END AS visual_evidence,
  CASE WHEN p_partkey % 14 = 3 THEN 'confirmed' END AS size_evidence,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN cast(p_size AS double) ELSE cast(p_size * 25 - 5 AS double) END AS observed_value,
  CASE p_partkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'cm' ELSE 'bad' END AS observed_unit,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'UNCALIBRATED' WHEN 3 THEN 'UNCERTAIN' ELSE 'CALIBRATED' END AS measurement_status,
  CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE cast(p_size % 10 AS double) / 2 END AS physical_height,
  cast(0.5 AS double) AS height_uncertainty,
  CASE WHEN p_partkey % 22 = 4 THEN 'UNCERTAIN' ELSE 'MEASURED' END AS height_status,
  CASE WHEN p_partkey % 4 = 1 THEN 'ruler' ELSE 'reference_card' END AS calibration_source,
  CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'UNAVAILABLE_MODEL_MISSING' ELSE 'SUCCESS' END AS visual_status,
  p_partkey % 10 <> 2 AS panel_found,
  cast(p_partkey % 100 AS double) / 50 AS panel_confidence,
  CASE p_partkey % 16 WHEN 0 THEN 'OUTSIDE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN NULL ELSE 'INSIDE' END AS mrp_relation,
  CASE WHEN p_partkey % 20 = 3 THEN cast(0.7 AS double) ELSE cast(0.9 AS double) END AS mrp_field_confidence,
  CASE WHEN p_partkey % 18 = 5 THEN NULL WHEN p_partkey % 18 = 6 THEN 'OUTSIDE' ELSE 'INSIDE' END AS quantity_relation,
  date '2022-01-01' + cast(p_partkey % 2500 AS int) AS as_of,
  CASE WHEN p_partkey % 15 <> 0 THEN p_brand END AS brand_name, CASE WHEN p_partkey % 16 <> 0 THEN lower(p_type) END AS category,
  CASE WHEN p_partkey % 4 <> 3 THEN 'B' || cast(p_partkey * 7 AS string) END AS batch_lot_number
FROM """ + _dealt("@part", "p_partkey"))


# ---- label text boxes: ten rows per part, one box per document line -----------------------
_PRICE = "printf('%.2f', p_retailprice)"
_LEFT = f"""«array¦list_value»(p_name || CASE WHEN p_partkey % 5 = 0 THEN ' biscuits' ELSE '' END,
 CASE p_partkey % 8 WHEN 0 THEN 'MRP' WHEN 4 THEN 'M.R.P.' WHEN 1 THEN 'MRP Rs. ' || {_PRICE} || ' incl. of all taxes' WHEN 5 THEN 'MRP: 1,2' || cast(p_partkey % 90 + 10 AS string) || '/-'
  WHEN 2 THEN 'Maximum Retail Price ₹' || {_PRICE} WHEN 6 THEN 'MRP 2024' WHEN 3 THEN 'Rs. ' || {_PRICE} ELSE cast(p_size AS string) || '0/-' END,
 CASE p_partkey % 7 WHEN 0 THEN 'Net Quantity' WHEN 1 THEN 'Net Qty ' || cast(p_size AS string) || ' g' WHEN 2 THEN 'Net Wt: ' || cast(p_size AS string) || '.5 kg'
  WHEN 3 THEN cast(p_size * 10 AS string) || ' ml' WHEN 4 THEN 'Contents 2 L' WHEN 5 THEN 'Net Vol. 750ml' ELSE '12 pcs' END,
 CASE p_partkey % 6 WHEN 0 THEN 'Batch No' WHEN 1 THEN 'Batch No. B' || cast(p_partkey AS string) WHEN 2 THEN 'LOT: 33-01-2025' WHEN 3 THEN 'Batch No. see top of pack' WHEN 4 THEN 'Lot # 24' ELSE NULL END,
 CASE p_partkey % 5 WHEN 0 THEN 'Mfg date 05/08/2024' WHEN 1 THEN 'Date of manufacture: 12 JAN 2024' WHEN 2 THEN '08/2024' WHEN 3 THEN 'Packed on 31.02.2024 1.3.24' ELSE 'Manufacturing date' END,
 CASE p_partkey % 4 WHEN 0 THEN 'Best before 12/2026' WHEN 1 THEN 'Use By: 01-2025' WHEN 2 THEN 'Exp. Date' ELSE 'Expiry 15-Mar-2026' END,
 CASE p_partkey % 5 WHEN 0 THEN 'Made in India.' WHEN 1 THEN 'Country of Origin' WHEN 2 THEN 'Origin: Viet Nam' ELSE NULL END,
 CASE p_partkey % 3 WHEN 0 THEN 'Manufactured by ' || p_brand || ' Foods' WHEN 1 THEN 'Mfd. by: ' || p_brand || ' Industries.' ELSE 'Nepal' END,
 CASE p_partkey % 4 WHEN 0 THEN 'Customer care: help@brand' || cast(p_partkey AS string) || '.in 1800-123-4567' WHEN 1 THEN 'Helpline' WHEN 2 THEN 'Toll free +91 98765 43210' ELSE 'Pin 560001' END,
 CASE p_partkey % 6 WHEN 0 THEN '8901234567890' WHEN 1 THEN 'Shake well 50% extra' WHEN 2 THEN '20 x 30 cm' WHEN 3 THEN 'S/N AB1234' WHEN 4 THEN '560001' ELSE 'Rs. 99' END)"""
_RIGHT = f"""«array¦list_value»(CASE WHEN p_partkey % 9 = 0 THEN p_brand || '®' END,
 CASE p_partkey % 8 WHEN 0 THEN 'Rs. ' || {_PRICE} WHEN 4 THEN cast(p_size + 10 AS string) END,
 CASE p_partkey % 7 WHEN 0 THEN '500 g' END, CASE p_partkey % 6 WHEN 0 THEN 'AB' || cast(p_partkey AS string) END,
 CASE p_partkey % 5 WHEN 4 THEN '14.11.2023' END, CASE p_partkey % 4 WHEN 2 THEN '31.12.2026' END,
 NULL, NULL, CASE p_partkey % 4 WHEN 1 THEN '9876543210' END, NULL)"""


def _nested(sql: str, side: int) -> str:
    """Resolve the spelling choices of a fragment that is placed inside another choice."""
    return _CHOICE.sub(lambda m: m.group(side), sql)


def _exploded(array_sql: str, key: str, table: str) -> str:
    spark = f"(SELECT {key}, {_nested(array_sql, 1)} AS lines FROM {_nested(_dealt(table, key), 1)}) LATERAL VIEW posexplode(lines) t AS pos, text"
    duck = (
        f"(SELECT {key}, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS pos "
        f"FROM (SELECT {key}, {_nested(array_sql, 2)} AS lines FROM {table}))"
    )
    return f"SELECT {key} AS k, pos, text FROM «{spark}¦{duck}»"


define("text_lines", _exploded("«split(text, '\n')¦string_split(text, chr(10))»", "doc_id", "@documents"))
define("label_left", _exploded(_LEFT, "p_partkey", "@part"))
define("label_right", _exploded(_RIGHT, "p_partkey", "@part"))

_CONF = "cast((k * 7 + pos * 13) % 50 + 50 AS double) / 100"
define("label_boxes", f"""
SELECT 'p' || cast(k AS string) AS image_id, cast(pos AS bigint) AS det_id, text, {_CONF} AS confidence, cast(0 AS double) AS x0,
  cast(CASE WHEN pos = 0 THEN 0 ELSE 20 * pos + 20 END AS double) AS y0, cast(100 AS double) AS x1,
  cast(CASE WHEN pos > 0 THEN 20 * pos + 35 WHEN k % 3 = 0 THEN 30 ELSE 15 END AS double) AS y1
FROM @label_left WHERE text IS NOT NULL
UNION ALL
SELECT 'p' || cast(k AS string), cast(pos + 100 AS bigint), text, {_CONF}, cast(60 AS double), cast(20 * pos + 20 AS double),
  cast(160 AS double), cast(20 * pos + 36 AS double)
FROM @label_right WHERE text IS NOT NULL""")
define("detections", f"""
SELECT * FROM @label_boxes
UNION ALL
SELECT 'd' || cast(k AS string), cast(pos AS bigint), text, {_CONF}, cast(0 AS double), cast(20 * pos AS double),
  cast(100 AS double), cast(20 * pos + 15 AS double)
FROM @text_lines WHERE text <> ''""")


# ---- product texts and nutrition ------------------------------------------------------------
define("product_texts", """
SELECT p_partkey AS product_id,
 lower(p_name) || CASE p_partkey % 9 WHEN 0 THEN ' biscuits' WHEN 1 THEN ' shampoo' WHEN 2 THEN ' floor cleaner' WHEN 3 THEN ' cream' WHEN 4 THEN ' juice' WHEN 5 THEN ' seed' ELSE '' END AS name,
 CASE p_partkey % 11 WHEN 0 THEN 'Nutrition Facts: calories, protein and fat. Ingredients: flour' WHEN 1 THEN 'For external use only. Patch test.' WHEN 2 THEN 'FSSAI lic. Packaged drinking water'
  WHEN 3 THEN 'Voltage 220, warranty one year' WHEN 4 THEN 'Ayurvedic medicine. Dosage as advised by physician' WHEN 5 THEN 'Keep out of reach of children. Corrosive' WHEN 6 THEN 'Soft skin and hair' WHEN 7 THEN 'food not for human consumption'
  ELSE 'Plain text' END || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'Delicious snack with great taste' WHEN 1 THEN 'Refreshing drink' WHEN 2 THEN 'chocolate, milk. biscuit cookie' ELSE 'health and relief' END AS ocr_text,
 CASE p_partkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'kg' WHEN 3 THEN 'N' END AS unit FROM """ + _dealt("@part", "p_partkey"))

_NUTRITION_LINES = """«array¦list_value»('NUTRITION per 100 g', CASE p_partkey % 4 WHEN 0 THEN 'ENERGY' WHEN 1 THEN 'Energy: ' || cast(p_size * 9 AS string) || ' kcal' WHEN 2 THEN 'Calories ' || cast(p_size AS string) || ',5 kJ' ELSE 'no info' END,
 CASE p_partkey % 4 WHEN 0 THEN cast(p_size * 8 AS string) || ' kcal' ELSE 'Protein 5.5g' END, CASE p_partkey % 3 WHEN 0 THEN 'Total Fat ' || cast(p_size AS string) || ' g' WHEN 1 THEN 'fat: 3' ELSE 'Saturated Fat 1.2 g' END,
 CASE p_partkey % 5 WHEN 0 THEN 'Carbohydrate' WHEN 1 THEN 'Sugars 12 g' WHEN 2 THEN 'Total sugars' ELSE 'sodium 300 mg' END, CASE p_partkey % 5 WHEN 0 THEN '55.5 g' WHEN 2 THEN 'na 40' ELSE 'Dietary Fibre 2g, added sugar 1 g' END,
 CASE p_partkey % 6 WHEN 0 THEN 'Serving size 30 g' WHEN 1 THEN 'Servings per pack: 5' ELSE 'Trans Fat 0 g' END)"""
define("nutrition_lines", _exploded(_NUTRITION_LINES, "p_partkey", "@part"))

define("nutrition_products", """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_name END AS name,
 CASE p_type WHEN 'ECONOMY' THEN 'biscuits' WHEN 'STANDARD' THEN 'snacks' WHEN 'PROMO' THEN 'beverages' WHEN 'MEDIUM' THEN 'milk_dairy' WHEN 'LARGE' THEN 'bakery_bread' ELSE 'unspecified' END AS category,
 CASE WHEN p_partkey % 5 <> 0 THEN cast(100 + p_partkey % 400 AS double) END AS energy_kcal_g, CASE WHEN p_partkey % 3 = 0 THEN cast(900 + p_partkey % 700 AS double) END AS energy_kj_g,
 CASE WHEN p_partkey % 7 = 0 THEN cast(50 + p_partkey % 40 AS double) END AS energy_kcal_ml, CASE WHEN p_partkey % 4 <> 1 THEN cast(p_partkey % 30 AS double) / 2 END AS proteins_g,
 CASE WHEN p_partkey % 6 <> 2 THEN cast(p_partkey % 41 AS double) END AS fat_g, CASE WHEN p_partkey % 9 <> 4 THEN cast(p_partkey % 17 AS double) END AS saturated_g,
 CASE WHEN p_partkey % 8 <> 3 THEN cast(p_partkey % 53 AS double) END AS sugars_g, CASE WHEN p_partkey % 8 = 3 THEN cast(p_partkey % 13 AS double) END AS sugars_ml,
 CASE WHEN p_partkey % 10 <> 5 THEN cast(p_partkey % 11 AS double) END AS fiber_g, CASE WHEN p_partkey % 2 = 0 THEN cast(p_partkey % 700 AS double) END AS sodium_g,
 CASE WHEN p_partkey % 3 <> 1 THEN cast(p_partkey % 25 AS double) / 10 END AS salt_g, p_retailprice AS popularity FROM @part""")

define("nutrients_a", """
SELECT p_partkey AS pair_id, n.name, cast((p_partkey * n.step) % 50 AS double) AS value, 'g' AS unit FROM @part «LATERAL VIEW explode(array(named_struct('name', 'Energy', 'step', 3), named_struct('name', 'Protein', 'step', 5), named_struct('name', 'Sodium', 'step', 7), named_struct('name', 'Total Fat', 'step', 11))) t AS n¦CROSS JOIN unnest([{'name': 'Energy', 'step': 3}, {'name': 'Protein', 'step': 5}, {'name': 'Sodium', 'step': 7}, {'name': 'Total Fat', 'step': 11}]) t(n)» WHERE (p_partkey + n.step) % 4 <> 0""")
define("nutrients_b", """
SELECT p_partkey AS pair_id, n.name, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE cast((p_partkey * n.step) % 47 AS double) END AS value, 'g' AS unit FROM @part «LATERAL VIEW explode(array(named_struct('name', 'Energy', 'step', 3), named_struct('name', 'Protein', 'step', 5), named_struct('name', 'Dietary Fibre', 'step', 7), named_struct('name', 'Total Fat', 'step', 11))) t AS n¦CROSS JOIN unnest([{'name': 'Energy', 'step': 3}, {'name': 'Protein', 'step': 5}, {'name': 'Dietary Fibre', 'step': 7}, {'name': 'Total Fat', 'step': 11}]) t(n)» WHERE (p_partkey + n.step) % 3 <> 0""")


# ---- complaints ---------------------------------------------------------------------------
define("complaints", """
SELECT o_orderkey AS complaint_id, CASE WHEN o_orderkey % 11 = 0 THEN (o_custkey + 1) % 50 ELSE o_custkey % 50 END AS user_id,
 CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 1000000000000 ELSE o_orderkey END AS product_id,
 CASE o_orderkey % 13 WHEN 0 THEN 'Missing mandatory declaration' WHEN 1 THEN 'Incorrect MRP declaration' WHEN 2 THEN 'Expired product on sale' WHEN 3 THEN 'Incorrect net quantity'
  WHEN 4 THEN 'Missing manufacturer information' WHEN 5 THEN 'Missing country of origin' WHEN 6 THEN 'Missing batch/lot number' WHEN 7 THEN 'Missing date of manufacture/expiry'
  WHEN 8 THEN 'Non-compliant labelling' WHEN 9 THEN 'Misleading consumer information' WHEN 10 THEN 'Other compliance concern' WHEN 11 THEN 'bad smell' END AS reason,
 CASE WHEN o_orderkey % 14 = 0 THEN 'too short' WHEN o_orderkey % 29 = 1 THEN repeat('This label is wrong. ', 300) ELSE 'The label of order ' || cast(o_orderkey AS string) || ' is wrong' END AS description,
 CASE WHEN o_orderkey % 31 = 2 THEN repeat('See the photo. ', 200) WHEN o_orderkey % 31 = 3 THEN 'See the photo.' END AS additional_info,
 CASE o_orderkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'URGENT' WHEN 3 THEN 'MEDIUM' END AS priority,
 CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'UNDER_REVIEW' ELSE 'SUBMITTED' END AS status, cast(o_orderdate AS timestamp) AS submitted_at FROM @orders""")
define("complaint_events", """
SELECT l_orderkey AS complaint_id, cast(l_linenumber AS bigint) * 1000000000000 + l_partkey * 10000 + l_suppkey AS seq, cast(l_shipdate AS timestamp) AS changed_at,
 CASE (l_linenumber + l_suppkey) % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'SUBMITTED' WHEN 2 THEN 'UNDER_REVIEW' ELSE 'REJECTED' END AS status, l_suppkey AS changed_by FROM @lineitem""")
define("inspection_images", """
SELECT i.*, CASE product_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || cast(product_id AS string) WHEN 2 THEN 'a' || cast(product_id AS string) || '|b' || cast(product_id AS string)
 ELSE 'a|b|c' || cast(product_id AS string) END AS image_list FROM @inspections i""")
define("raw_locations", """
SELECT o_orderkey AS product_id, CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '91.5' WHEN 2 THEN NULL ELSE cast(o_custkey % 90 AS string) || '.25' END AS latitude,
 CASE o_orderkey % 7 WHEN 0 THEN '-181' ELSE cast(o_custkey % 180 AS string) END AS longitude, CASE o_orderkey % 5 WHEN 0 THEN 'GPS' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'WIFI' WHEN 3 THEN 'GPS' END AS source,
 CASE o_orderkey % 4 WHEN 0 THEN '-5' WHEN 1 THEN '12.5' WHEN 2 THEN 'n/a' END AS accuracy FROM @orders""")
define("raw_products", """
SELECT o_orderkey AS product_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey % 50 END AS user_id, CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE 'Pack ' || cast(o_orderkey AS string) END AS product_name,
 CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 12 = 1 THEN -1.5 ELSE o_totalprice END AS mrp, CASE WHEN o_orderkey % 8 = 0 THEN -3.0 ELSE 4.0 END AS net_value, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE 'g' END AS net_unit,
 CASE WHEN o_orderkey % 6 = 0 THEN 'PASS' ELSE 'COMPLIANT' END AS compliance_status, CASE WHEN o_orderkey % 20 = 3 THEN 'DONE' ELSE 'COMPLETED' END AS analysis_status, CASE WHEN o_orderkey % 21 = 4 THEN 'toys' ELSE 'food' END AS category,
 CASE WHEN o_orderkey % 22 = 5 THEN 1.5 ELSE 0.5 END AS category_confidence, CASE WHEN o_orderkey % 23 = 6 THEN -95.0 ELSE 12.0 END AS latitude,
 CASE WHEN o_orderkey % 25 = 7 THEN 181.5 WHEN o_orderkey % 25 = 8 THEN -200.0 ELSE 77.0 END AS longitude, CASE WHEN o_orderkey % 26 = 9 THEN -1.0 WHEN o_orderkey % 26 = 10 THEN NULL ELSE 5.0 END AS location_accuracy,
 CASE WHEN o_orderkey % 27 = 11 THEN 'WIFI' WHEN o_orderkey % 27 = 12 THEN NULL ELSE 'GPS' END AS location_source, CASE WHEN o_orderkey % 28 = 13 THEN 'SURE' ELSE 'REVIEW' END AS category_detection_status FROM @orders""")
define("raw_detections", """
SELECT l_orderkey AS batch_id, l_linenumber AS det_id, CASE WHEN l_partkey % 211 = 0 THEN '' ELSE 'text' END AS text, CASE WHEN l_partkey % 199 = 1 THEN NULL ELSE l_discount * 10 END AS confidence,
 CASE WHEN l_partkey % 97 = 2 THEN 3 ELSE 4 END AS points, CASE WHEN l_partkey % 89 = 3 THEN NULL ELSE l_quantity END AS coord FROM @lineitem""")


# ---- image manifest, annotations, fingerprints ------------------------------------------------
define("images", """
SELECT doc_id AS image_id, 'product_' || cast(cast(floor(doc_id / 2) AS bigint) AS string) AS product_id, CASE doc_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'declaration' END AS view,
 'product_' || cast(cast(floor(doc_id / 2) AS bigint) AS string) || '/' || CASE doc_id % 5 WHEN 0 THEN 'IMG-front_' WHEN 1 THEN 'back view ' WHEN 2 THEN 'legal_panel_' WHEN 3 THEN 'front_back_' ELSE 'x' END || cast(doc_id AS string)
  || CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.webp' ELSE '.jpg' END AS path,
 «sha2(text, 256)¦sha256(text)» AS sha256, CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'Proprietary' WHEN right(source, 1) IN ('4', '5') THEN 'cc-by-sa' WHEN right(source, 1) = '6' THEN 'BLOCKED' WHEN right(source, 1) = '7' THEN 'wiki' ELSE NULL END AS source_license,
 200 + n_chars % 1900 AS width, 150 + doc_id * 7 % 1700 AS height, n_chars * 10 AS bytes, cast(doc_id % 61 AS double) AS sigma, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS category,
 CASE doc_id % 17 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'near_duplicate' WHEN 2 THEN 'review' WHEN 3 THEN 'malformed' ELSE 'unique' END AS duplicate_status,
 CASE WHEN doc_id % 31 = 0 THEN 'test' WHEN doc_id % 9 < 6 THEN 'train' ELSE 'validation' END AS split, CASE WHEN doc_id % 29 = 0 THEN 'DENIED' ELSE 'allowed_for_training' END AS consent,
 CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END AS extension, CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN NULL ELSE 'jpg' END AS magic,
 CASE doc_id % 4 WHEN 0 THEN 'annotated' WHEN 1 THEN 'validated' WHEN 2 THEN 'pending' ELSE 'rejected' END AS status FROM @documents""")
define("source_registry", """
SELECT 'proprietary' AS license, 'APPROVED' AS approval_status UNION ALL SELECT 'CC-BY-SA', 'APPROVED' UNION ALL SELECT 'wiki', 'APPROVED' UNION ALL SELECT 'forum', 'PENDING' UNION ALL SELECT 'news', 'APPROVED' UNION ALL SELECT 'blocked', 'REJECTED'""")
define("annotations", """
SELECT doc_id * 2 AS annotation_id, doc_id AS image_id, 'product_' || cast(cast(floor(doc_id / 2) AS bigint) AS string) AS product_id, cast(doc_id % 5 AS int) AS class_id,
 cast(doc_id % 110 AS double) / 100 AS x_center, cast(doc_id % 90 AS double) / 100 AS y_center, cast(doc_id % 21 AS double) / 20 AS width, cast(doc_id % 13 AS double) / 12 AS height,
 CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'human_corrected' ELSE 'human_verified' END ELSE 'weak_candidate' END AS provenance,
 CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 0 THEN 'PENDING' WHEN doc_id % 3 = 0 THEN 'CORRECTED' WHEN doc_id % 3 = 1 THEN 'ACCEPTED' ELSE 'PENDING' END AS verification_status,
 CASE WHEN doc_id % 8 = 0 THEN 'cc-by' ELSE 'proprietary' END AS source_license, doc_id % 6 = 1 AS training_eligible FROM @labels
UNION ALL
SELECT doc_id * 2 + 1, doc_id, 'product_' || cast(cast(floor(doc_id / 2) AS bigint) AS string), 2, 0.5, 0.5, 0.3, 0.3, 'human_verified', CASE WHEN toxic = 1 THEN 'ACCEPTED' ELSE 'PENDING' END, 'proprietary', false FROM @labels WHERE quality = 0""")
_FP = """«aggregate(transform(sequence(0, 62), i -> CASE WHEN embedding[i] > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, x) -> a + x)¦list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END))::BIGINT»"""
define("fingerprints", f"""
SELECT vec_id * 3 AS image_id, fp FROM (SELECT vec_id, {_FP} AS fp FROM @embeddings)
UNION ALL SELECT vec_id * 3 + 1, «fp ^ (shiftleft(1L, cast(vec_id % 24 AS int)) - 1L)¦xor(fp, (1::BIGINT << (vec_id % 24)::INT) - 1)» FROM (SELECT vec_id, {_FP} AS fp FROM @embeddings)
UNION ALL SELECT vec_id * 3 + 2, fp FROM (SELECT vec_id, {_FP} AS fp FROM @embeddings)""")
define("samples", """
SELECT event_id AS sample_id, 'product_' || cast(user_id AS string) AS product_id, CASE event_id % 6 WHEN 0 THEN 'inference_only' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'none' ELSE 'allowed_for_training' END AS consent,
 CASE event_id % 4 WHEN 0 THEN 'user_upload' WHEN 1 THEN 'proprietary' ELSE 'open_data' END AS source_type, CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN NULL ELSE 'APPROVED' END AS license_status,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(event_id % 100 AS double) / 100 END AS confidence, CASE event_id % 8 WHEN 0 THEN 'MISSING' WHEN 1 THEN NULL ELSE '250' END AS mrp,
 CASE event_id % 9 WHEN 0 THEN 'MISSING' ELSE '500 g' END AS net_quantity, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'REVIEW' ELSE 'PASS' END AS compliance_status,
 CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 'food' END AS category, event_id % 11 = 0 AS user_corrected, CASE WHEN event_id % 12 = 0 THEN 'FAIL' ELSE 'OK' END AS quality,
 CASE WHEN event_id % 13 = 0 THEN 'exact_duplicate' ELSE 'unique' END AS duplicate_status, CASE event_id % 3 WHEN 0 THEN 'TRAINING_ELIGIBLE' WHEN 1 THEN 'USED_IN_DATASET' ELSE 'CANDIDATE' END AS candidate_status, cast(value AS double) AS learning_score FROM @events""")


# ---- telemetry -------------------------------------------------------------------------------
TELEMETRY_COLUMNS = """event_id, cast(ts AS timestamp) AS ts, 'd' || cast(user_id % 5 AS string) AS deployment_id, 'm' || cast(user_id % 2 AS string) AS model_version, cast(value AS double) * 10 AS latency_ms,
 CASE WHEN event_type = 'error' AND value > 20 THEN 'FAILURE' WHEN event_type = 'signup' AND value > 100 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS inference_status,
 cast(regexp_extract(props, '[0-9]+', 0) AS int) % 9 AS prediction_count, 'c' || cast(event_id AS string) AS correlation_id"""
define("telemetry", f"SELECT {TELEMETRY_COLUMNS} FROM @events")
define("stage_reports", """
SELECT 'x' || cast(user_id % 40 AS string) AS deployment_id, cast(ts AS date) AS day, count(*) * 15 AS samples,
 cast(count(*) FILTER (WHERE event_type = 'error' AND value > 190) AS double) / count(*) AS error_rate FROM @events GROUP BY 1, 2""")
define("deployments", """
SELECT 'model-' || cast(min(event_id) AS string) AS candidate, cast(cast(ts AS date) AS timestamp) + INTERVAL '6' HOUR AS start_at, cast(cast(ts AS date) AS timestamp) + INTERVAL '30' HOUR AS end_at,
 CASE (min(event_id) % 5) WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 25 WHEN 3 THEN 50 ELSE 0 END AS traffic FROM @events GROUP BY cast(ts AS date)""")
