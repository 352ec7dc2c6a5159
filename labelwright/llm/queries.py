"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import bestfit, brown_lm, credential_link, fst_bpe, host_reputation, line_dedup, lsh_forest, phrase_fingerprint, pstable, robust_rules, simplex_clusters, stratified_search, style_tree

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = robust_rules.screen(docs, ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@query
def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = credential_link.scan(docs, ["doc_id"])
    base = F.filter("spans", lambda s: s["place"] < len(credential_link.CERTAIN))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "row.doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(credential_link.written(base), 256).alias("base_sha256"),
        credential_link.written(F.col("spans")).alias("spans"),
    )


@query
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its id; bad means toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return host_reputation.judge(pages, outcomes).select("row.page_id", "host", "path", "rule", "verdict", "n_labelled")


ORACLES["op2_host_reputation"] = host_reputation.SQL


@query
def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return style_tree.extract(pages, ["page_id", "url"]).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return fst_bpe.digests(docs, path, public_tokenizers.PATTERN).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lsh_forest.near_duplicates(docs, ["doc_id"]).select("row.doc_id", "n_shingles", "component_id", "kept")


@query
def op4_pstable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pstable.near_duplicates(vectors, ["vec_id"]).select("row.vec_id", "n_links", "component_id", "kept")


@query
def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return brown_lm.score(docs, ["doc_id"]).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.dedup_lines(docs)
    return out.select("row.doc_id", "dropped", "copy", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"), F.col("row.n_chars").alias("n_chars"))


@query
def op6_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bestfit.packed(docs, ["doc_id"]).select("row.doc_id", "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity")


@query
def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = simplex_clusters.cluster(vectors, ["vec_id"])
    return out.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", simplex_clusters.digest().alias("centroid_sha256"))


ORACLES["op11_simplex_clusters"] = simplex_clusters.sql()


@query
def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return stratified_search.search(docs, items, ["item_id"]).select("row.item_id", "rank", "doc_id", "score")


ORACLES["op12_stratified_search"] = stratified_search.SQL


@query
def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = phrase_fingerprint.fingerprints(docs, ["doc_id"])
    return out.select("row.doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
