"""Image manifest, duplicates, splits, annotations, gates and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import hashing
from labelwright.functions.rounding import half_up
from labelwright.operators import annotations as ann
from labelwright.operators import audit, dedup, gates, images, splits
from labelwright.plans.catalog import query
from labelwright.sources.standins import define, spark_view


def _v(spark, sf, name):
    return spark_view(spark, sf, name)


# ---- profiles --------------------------------------------------------------------------------
@query("dataset_profile", """
SELECT count(*) AS images, count(*) FILTER (WHERE view = 'front') AS front, count(*) FILTER (WHERE view = 'back') AS back, count(*) FILTER (WHERE view = 'declaration') AS declaration,
 count(*) FILTER (WHERE coalesce(category, 'unknown') = 'unknown') AS unknown_category, floor(avg(width) * 10 + 0.5) / 10 AS avg_width, floor(avg(height) * 10 + 0.5) / 10 AS avg_height,
 median(width)::DOUBLE AS median_width, median(height)::DOUBLE AS median_height, count(DISTINCT product_id) AS products, count(DISTINCT product_id) FILTER (WHERE view = 'declaration') AS with_declaration,
 count(DISTINCT product_id) - count(DISTINCT product_id) FILTER (WHERE view = 'declaration') AS missing_declaration FROM @images""")
def dataset_profile(spark, sf):
    return audit.image_profile(_v(spark, sf, "images"))


_MP = "(width * height / 1000000.0::DOUBLE)"
_N = lambda test: f"count(*) FILTER (WHERE {test})"
_POOR, _GOOD = f"({_MP} < 0.3 OR sigma < 15)", f"(NOT ({_MP} < 0.3 OR sigma < 15) AND {_MP} > 1.0 AND sigma > 40)"
_USE = f"(width <= height AND sigma > 20 AND {_MP} > 0.3)"


@query("image_audit", f"""
SELECT count(*) AS images, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, min(bytes) AS min_bytes, max(bytes) AS max_bytes,
 floor(avg({_MP}) * 1e4 + 0.5) / 1e4 AS avg_mp, floor(avg(bytes) * 100 + 0.5) / 100 AS avg_bytes, {_N(f'{_MP} < 0.3')} AS mp_tiny, {_N(f'{_MP} >= 0.3 AND {_MP} < 0.75')} AS mp_small,
 {_N(f'{_MP} >= 0.75 AND {_MP} < 1.5')} AS mp_medium, {_N(f'{_MP} >= 1.5 AND {_MP} < 3')} AS mp_large, {_N(f'{_MP} >= 3')} AS mp_huge, {_N('width > height')} AS landscape, {_N('width < height')} AS portrait,
 {_N('width = height')} AS square, {_N(_POOR)} AS readability_poor, {_N(_GOOD)} AS readability_good, {_N(f'NOT {_POOR} AND NOT {_GOOD}')} AS readability_moderate, {_N(_USE)} AS panel_useful,
 {_N(f'NOT {_USE} AND width > height AND {_MP} < 0.3')} AS panel_poor, {_N(f'NOT {_USE} AND NOT (width > height AND {_MP} < 0.3)')} AS panel_uncertain, {_N('sigma > 10')} AS packaging_useful,
 {_N('magic <> extension')} AS format_mismatches FROM @images""")
def image_audit(spark, sf):
    return audit.image_audit(_v(spark, sf, "images"))


@query("dup_stats", """
WITH g AS (SELECT count(*) AS n FROM @images GROUP BY sha256)
SELECT count(*) AS unique_hashes, count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_files, printf('%.1f', floor(sum(n - 1) * 100.0::DOUBLE / sum(n) * 10 + 0.5) / 10) || '%' AS duplicate_pct FROM g""")
def dup_stats(spark, sf):
    return audit.duplicate_stats(_v(spark, sf, "images"))


define("readings", "SELECT image_id, confidence, CASE WHEN det_id % 2 = 0 THEN 'front' ELSE 'back' END AS view FROM @detections")


@query("ocr_baseline", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY confidence) AS rn, count(*) OVER (PARTITION BY view) AS n FROM @readings)
SELECT view, count(DISTINCT image_id) AS attempts, count(*) AS detections, floor(avg(confidence) * 1e6 + 0.5) / 1e6 AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
 max(confidence) FILTER (WHERE rn = n // 2 + 1) AS median_confidence FROM r GROUP BY 1""")
def ocr_baseline(spark, sf):
    return audit.ocr_baseline(_v(spark, sf, "readings"))


define("field_values", """
SELECT product_id, product_id % 9 = 4 AS failed, cast(mrp AS string) AS mrp, manufacturer_name, country_of_origin, care_phone, cast(expiry_date AS string) AS expiry FROM @product_facts""")
_FIELDS = ["mrp", "manufacturer_name", "country_of_origin", "care_phone", "expiry"]


@query("field_coverage", "SELECT field, count(*) FILTER (WHERE seen) AS detected, count(*) FILTER (WHERE NOT seen AND NOT failed) AS missing, count(*) FILTER (WHERE NOT seen AND failed) AS uncertain, floor(count(*) FILTER (WHERE seen) * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS detected_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, failed, coalesce({f} <> '', false) AS seen FROM @field_values" for f in _FIELDS) + ") GROUP BY 1")
def field_coverage(spark, sf):
    return audit.field_coverage(_v(spark, sf, "field_values"), _FIELDS)


define("ocr_runs", """
SELECT event_id, cast(value AS double) / 10 AS seconds, CASE user_id % 2 WHEN 0 THEN 'front' ELSE 'back' END AS view, event_type <> 'error' AS success, cast(value AS double) AS latency_ms,
 CASE event_id % 3 WHEN 0 THEN 'result is missing field "text"' WHEN 1 THEN 'Request Timeout' ELSE NULL END AS error, CASE event_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'clahe' WHEN 2 THEN 'sharpen' ELSE 'upscale' END AS variant,
 cast(event_id % 100 AS double) / 100 AS confidence, event_id % 6 AS fields FROM @events""")


@query("latency_stats", """
WITH r AS (SELECT view, seconds, row_number() OVER (PARTITION BY view ORDER BY seconds) AS rn, count(*) OVER (PARTITION BY view) AS n FROM @ocr_runs WHERE success),
 q AS (SELECT *, greatest(1, least((n * 19 + 19) // 20, n - 1)) AS j, n * 19 + 19 - greatest(1, least((n * 19 + 19) // 20, n - 1)) * 20 AS d FROM r)
SELECT view, count(*) AS n, floor(avg(seconds) * 1e6 + 0.5) / 1e6 AS mean, floor(median(seconds) * 1e6 + 0.5) / 1e6 AS median, min(seconds) AS min, max(seconds) AS max,
 floor((max(seconds) FILTER (WHERE rn = j) * (20 - max(d)) + max(seconds) FILTER (WHERE rn = j + 1) * max(d)) / 20 * 1e6 + 0.5) / 1e6 AS p95 FROM q GROUP BY 1""")
def latency_stats(spark, sf):
    return audit.latency_stats(_v(spark, sf, "ocr_runs").filter("success"), ["view"])


@query("failure_classes", """
SELECT CASE WHEN error LIKE '%missing field%' THEN 'FULL_OCR_FAILURE' WHEN lower(error) LIKE '%timeout%' THEN 'TIMEOUT' ELSE 'FULL_OCR_FAILURE' END AS failure, count(*) AS n FROM @ocr_runs WHERE NOT success GROUP BY 1""")
def failure_classes(spark, sf):
    return audit.failure_classes(_v(spark, sf, "ocr_runs"))


@query("variant_score", """
WITH s AS (SELECT variant, count(*) FILTER (WHERE success) AS successes, sum(fields)::BIGINT AS fields, avg(confidence) AS c, avg(latency_ms) FILTER (WHERE success) AS l FROM @ocr_runs GROUP BY 1),
 k AS (SELECT *, floor((fields * 100 + c * 10 - l / 1000) * 1e6 + 0.5) / 1e6 AS score FROM s)
SELECT variant, successes, fields, floor(c * 1e6 + 0.5) / 1e6 AS avg_confidence, floor(l * 1e6 + 0.5) / 1e6 AS avg_latency_ms, score, score = max(score) OVER () AS best FROM k""")
def variant_score(spark, sf):
    return audit.variant_scores(_v(spark, sf, "ocr_runs"))


@query("product_completeness", "SELECT product_id, count(*) AS images, bool_or(view = 'front') AND bool_or(view = 'back') AS complete FROM @images GROUP BY 1")
def product_completeness(spark, sf):
    return audit.completeness(_v(spark, sf, "images"))


_HUMAN = "provenance IN ('human_verified', 'human_corrected')"
_DONE = "verification_status IN ('ACCEPTED', 'CORRECTED')"


@query("annotation_profile", f"""
SELECT count(*) AS annotations, {_N("provenance = 'weak_candidate'")} AS weak, {_N("verification_status = 'PENDING'")} AS pending, {_N("verification_status = 'ACCEPTED'")} AS accepted,
 {_N("verification_status = 'CORRECTED'")} AS corrected, {_N("verification_status = 'REJECTED'")} AS rejected, {_N(_HUMAN)} AS human_verified, {_N(_HUMAN + ' AND class_id = 0')} AS class_0,
 {_N(_HUMAN + ' AND class_id = 1')} AS class_1, {_N(_HUMAN + ' AND class_id = 2')} AS class_2, {_N('training_eligible')} AS training_eligible FROM @annotations""")
def annotation_profile(spark, sf):
    return images.annotation_profile(_v(spark, sf, "annotations"))


@query("image_candidate_score", """
SELECT image_id, score, position FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, image_id) AS INT) AS position FROM (
 SELECT image_id, CASE view WHEN 'back' THEN 5 WHEN 'front' THEN 3 ELSE 4 END + CASE WHEN category = 'en' THEN 2 ELSE 0 END + CASE WHEN width * height > 300000 THEN 2 ELSE 0 END
  + CASE WHEN count(*) OVER (PARTITION BY product_id) > 1 THEN 2 ELSE 0 END AS score FROM @images)) WHERE position <= 100""")
def image_candidate_score(spark, sf):
    rows = _v(spark, sf, "images").withColumn("kind", F.when(F.col("view") == "declaration", F.lit("packaging")).otherwise(F.col("view")))
    return images.best_candidates(rows, 100)


# ---- names, categories, ids --------------------------------------------------------------------
_BASE = "regexp_replace(regexp_replace(lower(regexp_replace(split_part(path, '/', -1), '\\.[a-zA-Z0-9]+$', '')), '[^a-z0-9]+', '_', 'g'), '', '')"


@query("infer_view", f"""
WITH b AS (SELECT image_id, {_BASE} AS n FROM @images),
 m AS (SELECT image_id, regexp_matches(n, '(^|_)front($|_)') AS f, regexp_matches(n, '(^|_)back($|_)') AS k, regexp_matches(n, '(^|_)(declaration|legal|label)($|_)') AS d FROM b)
SELECT image_id, CASE WHEN f::INT + k::INT + d::INT <> 1 THEN 'unknown' WHEN f THEN 'front' WHEN k THEN 'back' ELSE 'declaration' END AS view FROM m""")
def infer_view(spark, sf):
    return _v(spark, sf, "images").select("image_id", images.view_of(F.col("path")).alias("view"))


define("product_folders", """
SELECT p_partkey AS product_id, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Spice-Turmeric' WHEN 1 THEN '_rice' WHEN 2 THEN ' soap' WHEN 3 THEN ' milk juice' WHEN 4 THEN ' tablet' ELSE '' END AS folder,
 CASE p_partkey % 5 WHEN 0 THEN 'masala_front.jpg' WHEN 1 THEN 'front.jpg' WHEN 2 THEN 'chips-back.png' WHEN 3 THEN 'shampoo.jpg' ELSE 'honey.jpg' END AS file,
 CASE p_partkey % 20 WHEN 7 THEN 'dairy' WHEN 8 THEN 'toys' END AS override FROM @part""")
_TOK = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"
_HITS = lambda c, words: " + ".join(f"CAST(regexp_matches({c}, '(^|_){w}($|_)') AS INT)" for w in words)
_CATS = " UNION ALL ".join(f"SELECT product_id, '{k}' AS category, {_HITS('a', ws)} AS fh, {_HITS('b', ws)} AS gh FROM t" for k, ws in images.CATEGORY_WORDS.items())


@query("infer_category", f"""
WITH t AS (SELECT product_id, {_TOK('folder')} AS a, {_TOK('file')} AS b FROM @product_folders), h AS (SELECT *, fh + gh AS total FROM ({_CATS}) WHERE fh + gh > 0),
 m AS (SELECT product_id, max(total) AS top FROM h GROUP BY 1), w AS (SELECT h.product_id, count(*) AS n, min(category) AS category, min(fh) AS fh, min(gh) AS gh FROM h JOIN m ON h.product_id = m.product_id AND total = top GROUP BY 1)
SELECT p.product_id, CASE WHEN override IS NOT NULL THEN CASE WHEN override IN ({', '.join(f"'{c}'" for c in images.CATEGORY_NAMES)}) THEN override ELSE 'unknown' END WHEN n = 1 THEN category ELSE 'unknown' END AS category,
 CASE WHEN override IS NOT NULL THEN CASE WHEN override IN ({', '.join(f"'{c}'" for c in images.CATEGORY_NAMES)}) THEN 'explicit_metadata' ELSE 'unknown' END WHEN n = 1 THEN CASE WHEN fh >= gh THEN 'directory' ELSE 'filename' END ELSE 'unknown' END AS source,
 CASE WHEN override IS NOT NULL THEN CASE WHEN override IN ({', '.join(f"'{c}'" for c in images.CATEGORY_NAMES)}) THEN 1.0::DOUBLE END WHEN n = 1 AND fh > 0 AND gh = 0 THEN 0.85::DOUBLE WHEN n = 1 AND gh > 0 AND fh = 0 THEN 0.6::DOUBLE END AS confidence
FROM @product_folders p LEFT JOIN w ON w.product_id = p.product_id""")
def infer_category(spark, sf):
    return images.infer_category(_v(spark, sf, "product_folders"))


@query("image_ids", """
SELECT image_id, path, product_id || '_' || view || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS registered_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, view ORDER BY path) AS n FROM @images)""")
def image_ids(spark, sf):
    return dedup.image_ids(_v(spark, sf, "images"))


@query("annotation_manifest", """
SELECT image_id, product_id, view, product_id || '_' || view || lower(regexp_extract(path, '\\.[a-zA-Z]+$')) AS file_name, 'pending' AS status, count(*) OVER (PARTITION BY view) AS in_view FROM @images""")
def annotation_manifest(spark, sf):
    return images.annotation_manifest(_v(spark, sf, "images"))


# ---- duplicates ------------------------------------------------------------------------------
_EXACT = """SELECT image_id, path, CASE WHEN path = f THEN 'registered' ELSE 'exact_duplicate' END AS status, CASE WHEN path <> f THEN f END AS duplicate_of
 FROM (SELECT *, min(path) OVER (PARTITION BY sha256) AS f FROM @images)"""


@query("dedup_first", "SELECT sha256, min(path) AS first_path, count(*) AS copies FROM @images GROUP BY 1")
def dedup_first(spark, sf):
    return _v(spark, sf, "images").groupBy("sha256").agg(F.min("path").alias("first_path"), F.count("*").alias("copies"))


@query("dedup_exact", _EXACT)
def dedup_exact(spark, sf):
    return dedup.exact(_v(spark, sf, "images"))


define("registered_images", "SELECT path, sha256 FROM @images WHERE split <> 'train'")


@query("dedup_incremental", """
SELECT i.image_id, i.path, CASE WHEN i.path IN (SELECT path FROM @registered_images) THEN 'update' WHEN i.sha256 IN (SELECT sha256 FROM @registered_images) OR i.path <> min(i.path) OVER (PARTITION BY i.sha256) THEN 'exact_duplicate'
 ELSE 'new' END AS outcome FROM @images i""")
def dedup_incremental(spark, sf):
    return dedup.ingest(_v(spark, sf, "images"), _v(spark, sf, "registered_images"))


@query("hamming", """SELECT a.image_id, bit_count(xor(a.fp, b.fp))::INT AS distance FROM @fingerprints a JOIN @fingerprints b ON b.image_id = a.image_id + 1""")
def hamming(spark, sf):
    """Distance of each image to its successor."""
    f = _v(spark, sf, "fingerprints")
    other = f.select((F.col("image_id") - 1).alias("image_id"), F.col("fp").alias("other"))
    return f.join(other, "image_id").select("image_id", dedup.hamming(F.col("fp"), F.col("other")).alias("distance"))


_NEAR = """
WITH p AS (SELECT b.image_id, a.image_id AS other, bit_count(xor(a.fp, b.fp))::INT AS d FROM @fingerprints b JOIN @fingerprints a ON a.image_id < b.image_id),
 n AS (SELECT image_id, min(d) AS d, arg_min(other, (d, other)) AS other FROM p WHERE d <= {0} GROUP BY 1)
SELECT f.image_id, CASE WHEN d <= 10 THEN 'near_duplicate' WHEN d <= 18 THEN 'review' ELSE 'unique' END AS status, other AS duplicate_of, d AS distance FROM @fingerprints f LEFT JOIN n USING (image_id)"""


@query("near_dup_class", _NEAR.format(18))
def near_dup_class(spark, sf):
    """Near duplicates, images to review and unique ones."""
    return dedup.near_duplicates(_v(spark, sf, "fingerprints"))


@query("near_dup_review", f"SELECT * FROM ({_NEAR.format(18)}) WHERE status = 'review'")
def near_dup_review(spark, sf):
    """What a person has to look at: the nearest image is eleven to eighteen bits away."""
    return dedup.near_duplicates(_v(spark, sf, "fingerprints")).filter(F.col("status") == "review")


@query("dup_groups", """
WITH RECURSIVE e AS (SELECT DISTINCT a.image_id AS a, b.image_id AS b FROM @fingerprints a JOIN @fingerprints b ON bit_count(xor(a.fp, b.fp)) <= 9),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS image_id, min(b) AS group_id FROM r GROUP BY 1""")
def dup_groups(spark, sf):
    return dedup.duplicate_groups(_v(spark, sf, "fingerprints"))


# ---- splits -------------------------------------------------------------------------------------
_MD5 = "(('0x' || substr(md5(product_id), 1, 8))::UBIGINT % 10)"
define("image_products", "SELECT DISTINCT product_id FROM @images")


@query("split_md5", f"SELECT product_id, CASE WHEN {_MD5} < 7 THEN 'train' WHEN {_MD5} < 9 THEN 'validation' ELSE 'test' END AS split FROM @image_products")
def split_md5(spark, sf):
    return _v(spark, sf, "image_products").select("product_id", splits.md5_split(F.col("product_id")).alias("split"))


_POLY = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(product_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
_ABS = f"abs(CASE WHEN {_POLY} >= 2147483648 THEN {_POLY} - 4294967296 ELSE {_POLY} END)"
_POLY_SPLIT = f"CASE WHEN {_ABS} % 10 < 2 THEN 'validation' WHEN {_ABS} % 10 < 3 THEN 'test' ELSE 'train' END"


@query("split_poly", f"SELECT product_id, {_ABS} AS hash, {_POLY_SPLIT} AS split FROM @image_products")
def split_poly(spark, sf):
    p = F.col("product_id")
    return _v(spark, sf, "image_products").select("product_id", hashing.polynomial(p).alias("hash"), splits.polynomial_split(p).alias("split"))


@query("split_80_20", """
SELECT product_id, CASE WHEN row_number() OVER (ORDER BY md5('seed-1' || product_id), product_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM @image_products""")
def split_80_20(spark, sf):
    return splits.seeded_split(_v(spark, sf, "image_products"), "seed-1")


@query("split_leakage", """SELECT product_id, count(DISTINCT split) AS splits, min(split) AS first, max(split) AS last FROM @images GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage(spark, sf):
    return splits.leaking_products(_v(spark, sf, "images"))


@query("split_mismatch", f"SELECT image_id, product_id, split, assigned FROM (SELECT *, CASE WHEN {_MD5} < 7 THEN 'train' WHEN {_MD5} < 9 THEN 'validation' ELSE 'test' END AS assigned FROM @images) WHERE split <> assigned")
def split_mismatch(spark, sf):
    products = _v(spark, sf, "image_products").select("product_id", splits.md5_split(F.col("product_id")).alias("split"))
    return splits.mismatched_images(_v(spark, sf, "images"), products)


@query("leak_intersect", "SELECT product_id FROM @images WHERE split = 'train' INTERSECT SELECT product_id FROM @images WHERE split IN ('validation', 'test')")
def leak_intersect(spark, sf):
    i = _v(spark, sf, "images")
    pick = lambda *names: i.filter(F.col("split").isin(*names)).select("product_id")
    return pick("train").intersect(pick("validation", "test"))


@query("missing_declaration", "SELECT product_id FROM @images EXCEPT SELECT product_id FROM @images WHERE view = 'declaration'")
def missing_declaration(spark, sf):
    i = _v(spark, sf, "images")
    return i.select("product_id").subtract(i.filter(F.col("view") == "declaration").select("product_id"))


@query("sticky_split", """
SELECT i.product_id, coalesce(max(s.split), arg_min(i.split, i.image_id)) AS split FROM @images i LEFT JOIN (SELECT product_id, min(split) AS split FROM @images WHERE status = 'validated' GROUP BY 1) s ON s.product_id = i.product_id GROUP BY 1""")
def sticky_split(spark, sf):
    i = _v(spark, sf, "images")
    stored = i.filter(F.col("status") == "validated").groupBy("product_id").agg(F.min("split").alias("split"))
    return splits.sticky(i.select("product_id", F.col("image_id").alias("seq"), "split"), stored)


@query("split_listing", "SELECT split, product_id, image_id, row_number() OVER (PARTITION BY split, product_id ORDER BY image_id) AS place FROM @images")
def split_listing(spark, sf):
    return images.split_listing(_v(spark, sf, "images"))


@query("product_images", """SELECT product_id, image_id, view, count(*) OVER (PARTITION BY product_id) AS images FROM @images JOIN (SELECT DISTINCT 'product_' || (p_partkey)::VARCHAR AS product_id FROM part) p USING (product_id)""")
def product_images(spark, sf):
    products = _v(spark, sf, "part").select(F.concat(F.lit("product_"), F.col("p_partkey").cast("string")).alias("product_id"))
    return images.product_images(products, _v(spark, sf, "images"))


define("replay_samples", "SELECT sample_id, product_id, candidate_status, 1 AS version FROM @samples WHERE candidate_status = 'USED_IN_DATASET' OR quality = 'FAIL'")
define("current_samples", "SELECT sample_id, product_id, candidate_status, 2 AS version FROM @samples WHERE candidate_status <> 'CANDIDATE'")
_MERGED = "SELECT sample_id, arg_max(product_id, version) AS product_id, arg_max(candidate_status, version) AS candidate_status, max(version) AS version FROM (SELECT * FROM @replay_samples UNION ALL SELECT * FROM @current_samples) GROUP BY 1"


@query("replay_merge", f"SELECT sample_id, product_id, candidate_status, version FROM ({_MERGED})")
def replay_merge(spark, sf):
    return splits.merge_last(_v(spark, sf, "replay_samples"), _v(spark, sf, "current_samples")).drop("turn")


_VERSION = f"""SELECT sample_id, product_id, {_POLY_SPLIT} AS split, CASE WHEN candidate_status NOT IN ('TRAINING_ELIGIBLE', 'USED_IN_DATASET') THEN 'NOT_ELIGIBLE' END AS refused,
 CASE WHEN candidate_status IN ('TRAINING_ELIGIBLE', 'USED_IN_DATASET') THEN 'v7' END AS dataset_version,
 CASE WHEN candidate_status IN ('TRAINING_ELIGIBLE', 'USED_IN_DATASET') THEN 'USED_IN_DATASET' ELSE candidate_status END AS candidate_status FROM ({_MERGED})"""


@query("dataset_version", _VERSION)
def dataset_version(spark, sf):
    merged = splits.merge_last(_v(spark, sf, "replay_samples"), _v(spark, sf, "current_samples"))
    return splits.dataset_version(merged, "v7")


_AUDIT = """SELECT '{0}' AS version, count(DISTINCT product_id) AS products, count(*) AS samples, count(refused) AS refused,
 (SELECT count(*) FROM (SELECT product_id FROM v WHERE {1} GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaking,
 count(DISTINCT product_id) FILTER (WHERE split = 'train') AS train_products, count(DISTINCT product_id) FILTER (WHERE split = 'validation') AS validation_products, count(DISTINCT product_id) FILTER (WHERE split = 'test') AS test_products,
 bit_xor(('0x' || substr(md5(sample_id::VARCHAR || ':' || split), 1, 15))::BIGINT) AS fingerprint, CASE WHEN count(refused) > 0 THEN 'REFUSED_NOT_ELIGIBLE' ELSE 'PUBLISHED' END AS status FROM v WHERE {1}"""


@query("dataset_manifest", f"WITH v AS ({_VERSION}) {_AUDIT.format('v7', 'true')} UNION ALL {_AUDIT.format('v7-eligible', 'refused IS NULL')}")
def dataset_manifest(spark, sf):
    """What the audit of a version says: one of all samples, which is refused, and one of those that may enter."""
    merged = splits.merge_last(_v(spark, sf, "replay_samples"), _v(spark, sf, "current_samples"))
    version = splits.dataset_version(merged, "v7")
    return splits.version_audit(version, "v7").unionByName(splits.version_audit(version.where("refused IS NULL"), "v7-eligible"))


# ---- annotations --------------------------------------------------------------------------------
define("label_lines", """
SELECT image_id, CASE annotation_id % 9 WHEN 0 THEN cast(class_id AS string) || ' 0.5 0.5 0.2' WHEN 1 THEN 'x 0.5 0.5 abc 0.1' WHEN 2 THEN '  ' || cast(class_id AS string) || '   0.02 0.03 0.01  0.01 '
 ELSE cast(class_id AS string) || ' ' || cast(x_center AS string) || ' ' || cast(y_center AS string) || ' ' || cast(width AS string) || ' 0.5' END AS line FROM @annotations""")
_PARTS = "string_split_regex(trim(line), '\\s+')"
_PARSED = f"SELECT *, len({_PARTS}) AS k, try_cast({_PARTS}[1] AS INT) AS class_id, try_cast({_PARTS}[2] AS DOUBLE) AS x, try_cast({_PARTS}[3] AS DOUBLE) AS y, try_cast({_PARTS}[4] AS DOUBLE) AS w, try_cast({_PARTS}[5] AS DOUBLE) AS h FROM @label_lines"


@query("label_parse", f"SELECT image_id, class_id, x, y, w, h FROM ({_PARSED}) WHERE k = 5")
def label_parse(spark, sf):
    rows = _v(spark, sf, "label_lines").select("image_id", ann.parse_label_line(F.col("line")).alias("p"))
    return rows.filter(F.col("p").isNotNull()).select("image_id", "p.*")


@query("label_validation", f"""
WITH e AS (SELECT image_id, CASE WHEN k <> 5 THEN 1 ELSE (class_id IS NULL OR class_id NOT IN (0, 1, 2))::INT + (x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL)::INT
  + coalesce(NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1) AND w IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND h IS NOT NULL, false)::INT END AS errs,
  k = 5 AND (w * h < 0.001 OR w * h > 0.95) AS warn FROM ({_PARSED}))
SELECT image_id, count(*) AS lines, sum(errs)::BIGINT AS errors, count(*) FILTER (WHERE warn) AS warnings, CASE WHEN sum(errs) > 0 THEN 'rejected' ELSE 'annotated' END AS status FROM e GROUP BY 1""")
def label_validation(spark, sf):
    return ann.validate_labels(_v(spark, sf, "label_lines"))


@query("label_format", "SELECT annotation_id, printf('%d %.6f %.6f %.6f %.6f', class_id, x_center, y_center, width, height) AS line FROM @annotations")
def label_format(spark, sf):
    c = F.col
    return _v(spark, sf, "annotations").select("annotation_id", ann.label_line(c("class_id"), c("x_center"), c("y_center"), c("width"), c("height")).alias("line"))


_AKEY = "image_id || '_' || class_id || '_' || printf('%.4f', x_center) || '_' || printf('%.4f', y_center)"
define("stored_annotations", "SELECT * FROM @annotations WHERE provenance <> 'weak_candidate'")


@query("idempotent_import", f"""
WITH n AS (SELECT *, {_AKEY} AS k FROM @annotations) SELECT annotation_id, image_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY annotation_id) AS rn FROM n
 WHERE k NOT IN (SELECT {_AKEY} FROM @stored_annotations)) WHERE rn = 1""")
def idempotent_import(spark, sf):
    return ann.import_new(_v(spark, sf, "annotations"), _v(spark, sf, "stored_annotations")).select("annotation_id", "image_id", "class_id")


_REASONS = """concat_ws(',', CASE WHEN NOT (x_center BETWEEN 0 AND 1 AND y_center BETWEEN 0 AND 1 AND width > 0 AND width <= 1 AND height > 0 AND height <= 1) THEN 'box' END,
 CASE WHEN class_id NOT IN (0, 1, 2) THEN 'class' END, CASE WHEN provenance NOT IN ('human_verified', 'human_corrected') THEN 'provenance' END,
 CASE WHEN verification_status NOT IN ('ACCEPTED', 'CORRECTED') THEN 'status' END, CASE WHEN source_license <> 'proprietary' THEN 'license' END)"""


@query("annotation_eligibility", f"SELECT annotation_id, {_REASONS} AS reasons, {_REASONS} = '' AS eligible FROM @annotations")
def annotation_eligibility(spark, sf):
    rows = _v(spark, sf, "annotations").withColumn("r", ann.eligibility())
    return rows.select("annotation_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("eligible"))


define("review_actions", """
SELECT doc_id * 2 AS annotation_id, doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'REJECT' ELSE 'SKIP' END AS action, CASE WHEN doc_id % 8 = 1 THEN cast(1 AS int) END AS new_class, quality AS reviewed_at,
 cast(doc_id % 7 AS double) / 8 AS new_x_center, cast(doc_id % 5 AS double) / 8 AS new_y_center, CASE WHEN doc_id % 3 <> 0 THEN cast(0.25 AS double) END AS new_width, cast(doc_id % 4 + 1 AS double) / 8 AS new_height,
 'reviewer-' || cast(doc_id % 4 AS string) AS reviewer FROM @labels
UNION ALL SELECT doc_id * 2, doc_id + 1, 'ACCEPT', NULL, toxic * 2, NULL, NULL, NULL, NULL, 'reviewer-9' FROM @labels WHERE toxic = 1""")


@query("apply_reviews", f"""
WITH l AS (SELECT annotation_id, arg_max({{'a': action, 'c': new_class}}, (reviewed_at, seq)) AS r FROM @review_actions GROUP BY 1),
 j AS (SELECT a.* EXCLUDE (class_id, provenance, verification_status, training_eligible), CASE WHEN r.a = 'CORRECT' THEN a.class_id END AS original_class, CASE WHEN r.a = 'CORRECT' THEN coalesce(r.c, a.class_id) ELSE a.class_id END AS class_id,
  CASE r.a WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'CORRECT' THEN 'CORRECTED' WHEN 'REJECT' THEN 'REJECTED' ELSE verification_status END AS verification_status,
  CASE r.a WHEN 'ACCEPT' THEN 'human_verified' WHEN 'CORRECT' THEN 'human_corrected' ELSE provenance END AS provenance FROM @annotations a LEFT JOIN l USING (annotation_id))
SELECT annotation_id, class_id, original_class, verification_status, provenance, {_REASONS} = '' AS training_eligible FROM j""")
def apply_reviews(spark, sf):
    """Corrected classes; the reviews' boxes are left out here."""
    reviews = _v(spark, sf, "review_actions").select("annotation_id", "seq", "action", "new_class", "reviewed_at")
    rows = ann.apply_reviews(_v(spark, sf, "annotations"), reviews)
    return rows.select("annotation_id", "class_id", "original_class", "verification_status", "provenance", "training_eligible")


_BOX_OF = lambda c: f"CASE WHEN boxed THEN r.new_{c} ELSE {c} END AS {c}"


@query("reviewed_boxes", f"""
WITH l AS (SELECT annotation_id, arg_max(r, (r.reviewed_at, r.seq)) AS r FROM @review_actions r WHERE reviewed_at <= 1 GROUP BY 1),
 k AS (SELECT a.*, r, coalesce(r.action IN ('ACCEPT', 'CORRECT'), false) AS decided,
  coalesce(r.action = 'CORRECT' AND r.new_x_center IS NOT NULL AND r.new_y_center IS NOT NULL AND r.new_width IS NOT NULL AND r.new_height IS NOT NULL, false) AS boxed FROM @annotations a LEFT JOIN l USING (annotation_id)),
 j AS (SELECT annotation_id, source_license, boxed AS box_corrected, {', '.join(_BOX_OF(c) for c in ann.BOX)}, {', '.join(f"CASE WHEN decided THEN {c} END AS original_{c}" for c in ann.BOX)},
  CASE WHEN decided THEN provenance END AS original_provenance, CASE WHEN decided OR r.action = 'REJECT' THEN r.reviewed_at END AS reviewed_at, CASE WHEN decided OR r.action = 'REJECT' THEN r.reviewer END AS reviewer,
  CASE WHEN r.action = 'CORRECT' THEN coalesce(r.new_class, class_id) ELSE class_id END AS class_id,
  CASE r.action WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'CORRECT' THEN 'CORRECTED' WHEN 'REJECT' THEN 'REJECTED' ELSE verification_status END AS verification_status,
  CASE r.action WHEN 'ACCEPT' THEN 'human_verified' WHEN 'CORRECT' THEN 'human_corrected' ELSE provenance END AS provenance FROM k)
SELECT annotation_id, {', '.join(ann.BOX)}, {', '.join(f'original_{c}' for c in ann.BOX)}, box_corrected, provenance, original_provenance, reviewed_at, reviewer, {_REASONS} = '' AS training_eligible FROM j""")
def reviewed_boxes(spark, sf):
    """Boxes as reviewed up to day 1, with the box and provenance before, and who decided when."""
    rows = ann.apply_reviews(_v(spark, sf, "annotations"), _v(spark, sf, "review_actions"), as_of=1)
    return rows.select("annotation_id", *ann.BOX, *[f"original_{c}" for c in ann.BOX], "box_corrected", "provenance", "original_provenance", "reviewed_at", "reviewer", "training_eligible")


@query("weak_guard", "SELECT annotation_id, image_id FROM @annotations WHERE provenance = 'weak_candidate'")
def weak_guard(spark, sf):
    """Rows that would contaminate a final set if it were taken from all annotations."""
    return ann.contaminated(_v(spark, sf, "annotations")).select("annotation_id", "image_id")


@query("vq_join", """
SELECT i.image_id, i.view, a.verification_status, a.provenance FROM @images i LEFT JOIN (SELECT image_id, arg_max(verification_status, annotation_id) AS verification_status, arg_max(provenance, annotation_id) AS provenance FROM @annotations GROUP BY 1) a
 ON a.image_id = i.image_id""")
def vq_join(spark, sf):
    last = ann.last_annotations(_v(spark, sf, "annotations"))
    return _v(spark, sf, "images").join(last, "image_id", "left").select("image_id", "view", "a.verification_status", "a.provenance")


_APPROVED = "(SELECT lower(license) FROM @source_registry WHERE approval_status = 'APPROVED')"


@query("license_semi", f"SELECT image_id, source_license FROM @images WHERE lower(coalesce(source_license, '')) IN {_APPROVED}")
def license_semi(spark, sf):
    return ann.by_license(_v(spark, sf, "images"), _v(spark, sf, "source_registry"), "left_semi").select("image_id", "source_license")


@query("license_anti", f"SELECT image_id, source_license FROM @images WHERE lower(coalesce(source_license, '')) NOT IN {_APPROVED}")
def license_anti(spark, sf):
    return ann.by_license(_v(spark, sf, "images"), _v(spark, sf, "source_registry"), "left_anti").select("image_id", "source_license")


_VQ = f"""
WITH last AS (SELECT image_id, arg_max({{'c': class_id, 's': verification_status, 'p': provenance}}, annotation_id) AS a FROM @annotations GROUP BY 1),
 i AS (SELECT * REPLACE (coalesce(category, 'unknown') AS category), count(*) OVER (PARTITION BY coalesce(category, 'unknown')) AS nc, count(*) OVER (PARTITION BY product_id) AS np FROM @images),
 j AS (SELECT i.*, a, product_id IN (SELECT product_id FROM @annotations WHERE {_DONE}) AS ver FROM i LEFT JOIN last ON last.image_id = i.image_id),
 x AS (SELECT *, CASE WHEN lower(coalesce(source_license, '')) NOT IN {_APPROVED} THEN 'licenseBlocked' WHEN duplicate_status = 'exact_duplicate' THEN 'exactDuplicates' WHEN duplicate_status = 'malformed' THEN 'malformed'
  WHEN a.s IN ('ACCEPTED', 'CORRECTED') THEN 'humanVerified' WHEN a.s = 'REJECTED' THEN 'rejected' WHEN a.s <> 'PENDING' THEN 'closed' END AS excluded FROM j),
 q AS (SELECT image_id, product_id, path, view, category, excluded, CASE WHEN excluded IS NOT NULL THEN NULL WHEN view = 'declaration' OR coalesce(a.c = 2, false) THEN 1 WHEN view = 'back' THEN 2 WHEN nc <= 1 THEN 3 WHEN NOT ver OR np <= 1 THEN 4 ELSE 5 END AS priority,
  duplicate_status IN ('near_duplicate', 'review') AS duplicate_review, coalesce(a.s, 'NO_ANNOTATION') AS annotation_status, coalesce(a.p, 'none') AS provenance FROM x)"""


def _queue(spark, sf):
    return ann.queue(_v(spark, sf, "images"), _v(spark, sf, "annotations"), _v(spark, sf, "source_registry"))


_WHY = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ann.PRIORITY_REASONS.items())


@query("verification_queue", f"{_VQ} SELECT * EXCLUDE (excluded), concat_ws('; ', CASE priority {_WHY} END, CASE WHEN priority = 1 AND view = 'declaration' THEN 'declaration view' END, CASE WHEN duplicate_review THEN 'flagged for perceptual duplicate review' END) AS reasons FROM q WHERE excluded IS NULL")
def verification_queue(spark, sf):
    return _queue(spark, sf).filter(F.col("excluded").isNull()).drop("excluded").orderBy("priority", "product_id", "image_id", "path")


@query("vq_counts", f"{_VQ} SELECT CASE WHEN excluded IS NULL THEN 'priority' ELSE 'excluded' END AS kind, coalesce(excluded, priority::VARCHAR) AS name, count(*) AS n FROM q GROUP BY 1, 2")
def vq_counts(spark, sf):
    q = _queue(spark, sf)
    kind = F.when(F.col("excluded").isNull(), F.lit("priority")).otherwise(F.lit("excluded"))
    return q.groupBy(kind.alias("kind"), F.coalesce("excluded", F.col("priority").cast("string")).alias("name")).agg(F.count("*").alias("n"))


@query("holdout_verified", f"SELECT annotation_id, image_id FROM @annotations WHERE {_HUMAN} AND {_DONE} AND image_id IN (SELECT image_id FROM @images WHERE split IN ('validation', 'test'))")
def holdout_verified(spark, sf):
    return images.holdout_annotations(_v(spark, sf, "annotations"), _v(spark, sf, "images")).select("annotation_id", "image_id")


@query("split_export", "SELECT image_id, path, CASE WHEN split = 'train' THEN 'train' ELSE 'val' END AS folder FROM @images WHERE status IN ('annotated', 'validated')")
def split_export(spark, sf):
    return images.exportable(_v(spark, sf, "images"))


# ---- samples and gates --------------------------------------------------------------------------
@query("learning_score", """
WITH s AS (SELECT *, CASE WHEN consent = 'inference_only' THEN 'Consent limited to inference' WHEN source_type = 'user_upload' AND consent <> 'allowed_for_training' THEN 'Upload without training consent' END AS blocked,
 coalesce(confidence < 0.6, false) AS a, coalesce(mrp, 'MISSING') = 'MISSING' AS b, coalesce(net_quantity, 'MISSING') = 'MISSING' AS c, compliance_status = 'REVIEW' AS d, compliance_status = 'FAIL' AS e, category = 'unknown' AS f FROM @samples),
 p AS (SELECT *, a::INT * 30 + b::INT * 20 + c::INT * 20 + d::INT * 25 + e::INT * 10 + f::INT * 15 + user_corrected::INT * 50 AS pts, concat_ws(', ', CASE WHEN a THEN 'LOW_OCR_CONFIDENCE' END, CASE WHEN b THEN 'MRP_NOT_FOUND' END,
  CASE WHEN c THEN 'QUANTITY_NOT_FOUND' END, CASE WHEN d THEN 'COMPLIANCE_REVIEW' END, CASE WHEN e THEN 'COMPLIANCE_FAIL' END, CASE WHEN f THEN 'CATEGORY_UNKNOWN' END, CASE WHEN user_corrected THEN 'USER_CORRECTED' END) AS why FROM s)
SELECT sample_id, CASE WHEN blocked IS NULL THEN pts ELSE 0 END AS score, blocked IS NULL AND pts >= 30 AS candidate, coalesce(blocked, CASE WHEN why = '' THEN 'No critical learning signals' ELSE why END) AS reason FROM p""")
def learning_score(spark, sf):
    return ann.learning_score(_v(spark, sf, "samples"))


@query("sample_gates", """
WITH g AS (SELECT sample_id, CASE WHEN license_status <> 'APPROVED' AND source_type NOT IN ('user_upload', 'proprietary') THEN 'license_blocked' WHEN consent IN ('DENIED', 'inference_only') THEN 'consent_denied'
 WHEN quality = 'FAIL' THEN 'image_quality_failed' WHEN duplicate_status = 'exact_duplicate' THEN 'exact_duplicate' ELSE 'verified_permissioned_sample' END AS reason FROM @samples)
SELECT sample_id, reason, reason = 'verified_permissioned_sample' AS eligible, CASE WHEN reason = 'verified_permissioned_sample' THEN 'TRAINING_ELIGIBLE' ELSE 'VERIFIED' END AS candidate_status FROM g""")
def sample_gates(spark, sf):
    return ann.sample_gates(_v(spark, sf, "samples"))


define("feedback", "SELECT cast(floor(event_id / 2) AS bigint) AS sample_id, event_id AS seq, ts AS given_at, 'corrected ' || cast(event_id AS string) AS corrected FROM @events")


@query("feedback_merge", """
SELECT s.sample_id, CASE WHEN f.n > 0 THEN mrp END AS original, f.corrected, CASE WHEN f.n > 0 THEN 'NEEDS_REVIEW' ELSE candidate_status END AS candidate_status, learning_score + coalesce(n, 0) * 50 AS learning_score
FROM @samples s LEFT JOIN (SELECT sample_id, count(*) AS n, arg_max(corrected, (given_at, seq)) AS corrected FROM @feedback GROUP BY 1) f ON f.sample_id = s.sample_id""")
def feedback_merge(spark, sf):
    return ann.merge_feedback(_v(spark, sf, "samples"), _v(spark, sf, "feedback"))


define("acquired", """
SELECT image_id, source_license, width, height, sha256, CASE WHEN image_id % 10 = 3 THEN NULL ELSE path END AS source_url, CASE WHEN image_id % 14 = 5 THEN NULL ELSE '2024-01-01' END AS acquired_at, image_id % 3 = 0 AS human_verified FROM @images""")
_ACQ = """SELECT image_id, CASE WHEN rejection IS NOT NULL THEN 'REJECTED' WHEN human_verified THEN 'TRAINING_ELIGIBLE' ELSE 'ANNOTATION_PENDING' END AS state, rejection FROM (
 SELECT *, CASE WHEN NOT lic THEN 'license' WHEN NOT sized THEN 'quality' WHEN image_id <> min(image_id) FILTER (WHERE lic AND sized) OVER (PARTITION BY sha256) THEN 'duplicate' WHEN source_url IS NULL OR acquired_at IS NULL THEN 'provenance' END AS rejection
 FROM (SELECT *, coalesce(lower(source_license) IN ('proprietary', 'cc-by-sa', 'wiki'), false) AS lic, width >= 300 AND height >= 300 AS sized FROM @acquired))"""


@query("acquisition_states", _ACQ)
def acquisition_states(spark, sf):
    return ann.acquisition(_v(spark, sf, "acquired"))


@query("acquisition_funnel", f"SELECT state, coalesce(rejection, '') AS rejection, count(*) AS n FROM ({_ACQ}) GROUP BY 1, 2")
def acquisition_funnel(spark, sf):
    return ann.acquisition(_v(spark, sf, "acquired")).groupBy("state", F.coalesce("rejection", F.lit("")).alias("rejection")).agg(F.count("*").alias("n"))


define("external_boxes", """
SELECT annotation_id, CASE annotation_id % 4 WHEN 0 THEN 'bottle' WHEN 1 THEN 'text' WHEN 2 THEN 'label' ELSE 'dog' END AS source_class, CASE annotation_id % 5 WHEN 0 THEN 'research_only' WHEN 1 THEN 'proprietary' ELSE 'cc-by' END AS license,
 x_center * 640 AS left_px, y_center * 480 AS top_px, width * 100 AS w_px, height * 100 AS h_px FROM @annotations""")
_CLASSES = {"bottle": (0, "high"), "text": (2, "low"), "label": (2, "high")}


@query("external_import", """
SELECT annotation_id, CASE source_class WHEN 'bottle' THEN 0 ELSE 2 END AS class_id, floor((left_px + w_px / 2) / 640 * 1e6 + 0.5) / 1e6 AS cx, floor((top_px + h_px / 2) / 480 * 1e6 + 0.5) / 1e6 AS cy, floor(w_px / 640 * 1e6 + 0.5) / 1e6 AS w,
 floor(h_px / 480 * 1e6 + 0.5) / 1e6 AS h, 'external_dataset' AS provenance, source_class AS original_class FROM @external_boxes WHERE source_class IN ('bottle', 'label') AND license NOT IN ('research_only', 'proprietary')""")
def external_import(spark, sf):
    c = F.col

    def from_pixels():
        return (
            half_up((c("left_px") + c("w_px") / 2) / 640, 6).alias("cx"), half_up((c("top_px") + c("h_px") / 2) / 480, 6).alias("cy"),
            half_up(c("w_px") / 640, 6).alias("w"), half_up(c("h_px") / 480, 6).alias("h"),
        )

    return ann.external_import(_v(spark, sf, "external_boxes"), _CLASSES, from_pixels)


_COUNTS = f"""SELECT i.{{0}}, count(DISTINCT i.product_id) AS products, coalesce(sum(v), 0)::BIGINT AS verified FROM @images i
 LEFT JOIN (SELECT image_id, count(*) FILTER (WHERE {_HUMAN} AND {_DONE}) AS v FROM @annotations GROUP BY 1) a ON a.image_id = i.image_id GROUP BY 1"""
_BY_LANG = _COUNTS.replace("i.{0}", "coalesce(i.category, 'unknown') AS category")


def _counts(spark, sf):
    rows = _v(spark, sf, "images").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return ann.dataset_counts(rows, _v(spark, sf, "annotations"), ["category"])


@query("milestone", f"""SELECT category, products, verified, CASE WHEN products >= 100 AND verified >= 200 THEN 'MILESTONE_D' WHEN products >= 75 AND verified >= 150 THEN 'MILESTONE_C' WHEN products >= 50 AND verified >= 100 THEN 'MILESTONE_B'
 WHEN products >= 25 AND verified >= 50 THEN 'MILESTONE_A' ELSE 'PRE_MILESTONE' END AS milestone FROM ({_BY_LANG})""")
def milestone(spark, sf):
    return _counts(spark, sf).withColumn("milestone", ann.milestone(F.col("products"), F.col("verified")))


@query("readiness", f"""SELECT category, products, verified, CASE WHEN products < 50 OR verified < 100 THEN 'NOT_READY' WHEN products >= 100 AND verified >= 200 THEN 'READY_FOR_TRAINING' ELSE 'READY_FOR_SMALL_EXPERIMENT' END AS status FROM ({_BY_LANG})""")
def readiness(spark, sf):
    return _counts(spark, sf).withColumn("status", ann.readiness(F.col("products"), F.col("verified")))


@query("readiness_blockers", f"""SELECT category, CASE WHEN verified < 100 OR products < 50 THEN 'NOT_READY' WHEN verified >= 1000 AND products >= 200 THEN 'READY_FOR_MODEL' ELSE 'READY_FOR_EXPERIMENT' END AS status,
 concat_ws(',', CASE WHEN verified < 100 THEN 'annotations' END, CASE WHEN products < 50 THEN 'products' END) AS blockers FROM ({_BY_LANG})""")
def readiness_blockers(spark, sf):
    return _counts(spark, sf).select("category", ann.strict_readiness(F.col("products"), F.col("verified")).alias("r")).select("category", "r.*")


@query("preflight", f"""
WITH i AS (SELECT count(DISTINCT product_id) AS products, bool_or(split = 'train') AS tr, bool_or(split = 'validation') AS va, coalesce(bool_or(source_license = 'BLOCKED'), false) AS bl, bool_or(consent = 'DENIED') AS de FROM @images),
 l AS (SELECT count(*) > 0 AS leak FROM (SELECT product_id FROM @images GROUP BY 1 HAVING count(DISTINCT split) > 1)),
 a AS (SELECT count(*) FILTER (WHERE {_HUMAN} AND {_DONE}) AS verified, coalesce(bool_or({_HUMAN} AND {_DONE} AND NOT (x_center BETWEEN 0 AND 1 AND y_center BETWEEN 0 AND 1 AND width > 0 AND height > 0)), false) AS bad FROM @annotations)
SELECT products, verified, concat_ws(',', CASE WHEN products < 50 THEN 'INSUFFICIENT_PRODUCTS' END, CASE WHEN bad THEN 'INVALID_LABEL' END, CASE WHEN verified < 100 THEN 'INSUFFICIENT_VERIFIED_ANNOTATIONS' END, CASE WHEN NOT tr THEN 'MISSING_TRAIN_SPLIT' END,
 CASE WHEN NOT va THEN 'MISSING_VALIDATION_SPLIT' END, CASE WHEN leak THEN 'PRODUCT_SPLIT_LEAKAGE' END, CASE WHEN bl THEN 'LICENSE_GATE_FAILED' END, CASE WHEN de THEN 'PRIVACY_GATE_FAILED' END) AS reasons FROM i, l, a""")
def preflight(spark, sf):
    return ann.preflight(_v(spark, sf, "images"), _v(spark, sf, "annotations"))


# ---- model gates and registry ---------------------------------------------------------------------
define("model_metrics", """
SELECT user_id AS run_id, floor(avg(value) * 100) / 100 / 100 + 0.25 AS map50, floor(avg(value) * 100) / 100 / 150 + 0.2 AS map50_95, floor(max(value) * 100) / 100 / 600 + 0.3 AS precision, cast(count(*) % 40 AS double) / 100 + 0.6 AS recall FROM @events GROUP BY 1""")


_CHANGES = ", ".join(f"floor(({a} - {b}) * 1e6 + 0.5) / 1e6 AS delta_{m}" for a, b, m in (("a", "ha", "map50"), ("b", "hb", "map50_95"), ("p", "hp", "precision"), ("r", "hr", "recall")))


@query("model_gates", f"""
WITH p AS (SELECT c.run_id, c.map50 AS a, c.map50_95 AS b, c.precision AS p, c.recall AS r, h.map50 AS ha, h.map50_95 AS hb, h.precision AS hp, h.recall AS hr FROM @model_metrics c LEFT JOIN @model_metrics h ON h.run_id = c.run_id - 1),
 q AS (SELECT run_id, concat_ws(',', CASE WHEN a < 0.7 THEN 'FAILED_MIN_MAP50' END, CASE WHEN b < 0.5 THEN 'FAILED_MIN_MAP50_95' END, CASE WHEN p < 0.75 THEN 'FAILED_MIN_PRECISION' END, CASE WHEN r < 0.75 THEN 'FAILED_MIN_RECALL' END,
  CASE WHEN floor((ha - a) * 1e9 + 0.5) / 1e9 > 0.05 THEN 'REGRESSION_MAP50_EXCEEDED' END, CASE WHEN floor((hb - b) * 1e9 + 0.5) / 1e9 > 0.03 THEN 'REGRESSION_MAP50_95_EXCEEDED' END, CASE WHEN floor((hp - p) * 1e9 + 0.5) / 1e9 > 0.05 THEN 'REGRESSION_PRECISION_EXCEEDED' END,
  CASE WHEN floor((hr - r) * 1e9 + 0.5) / 1e9 > 0.05 THEN 'REGRESSION_RECALL_EXCEEDED' END) AS reasons, {_CHANGES} FROM p)
SELECT run_id, CASE WHEN reasons = '' THEN 'PASS' ELSE 'REJECT' END AS decision, reasons, delta_map50, delta_map50_95, delta_precision, delta_recall FROM q""")
def model_gates(spark, sf):
    """Each run against the one before it."""
    m = _v(spark, sf, "model_metrics")
    return gates.evaluate(m, m.withColumn("run_id", F.col("run_id") + 1))


define("promotions", "SELECT 'family_' || cast(user_id % 7 AS string) AS family, 'model_' || cast(event_id AS string) AS model_version, cast(ts AS timestamp) AS promoted_at, event_id AS seq, CASE event_type WHEN 'error' THEN 'ROLLBACK' ELSE 'PROMOTE' END AS action FROM @events WHERE event_type IN ('error', 'signup')")


@query("champion_timeline", """
WITH l AS (SELECT *, lead(promoted_at) OVER w AS until, lead(action) OVER w AS next_action FROM @promotions WINDOW w AS (PARTITION BY family ORDER BY promoted_at, seq))
SELECT family, model_version, strftime(promoted_at, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(until, '%Y-%m-%d %H:%M:%S') AS valid_to, CASE WHEN until IS NULL THEN 'PRODUCTION' WHEN next_action = 'ROLLBACK' THEN 'ROLLED_BACK' ELSE 'SUPERSEDED' END AS status FROM l""")
def champion_timeline(spark, sf):
    return gates.champion_timeline(_v(spark, sf, "promotions"))
