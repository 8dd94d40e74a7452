"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import find_leaks

from millrace.llm.mixing import mix

from millrace.llm.secrets import BASE_KINDS, KINDS, find_secrets

from millrace.llm.quality import classify

from millrace.llm.urls import judge, labelled_by_rules

from millrace.llm.repeats import remove_repeats

from millrace.llm.tokens import tokenize

from millrace.llm.html import extract_pages

from millrace.llm.jaccard import near_duplicates

from millrace.llm.embeddings import near_vectors

from millrace.llm.codes import books_hash, compress, with_label_errors

from millrace.llm.spelling import count_words, group_variants

from millrace.llm.neighbours import nearest


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def _joined(spans: str, base_only: bool):
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS)) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(_read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined("spans", True), 256).alias("base_sha256"),
        _joined("spans", False).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return judge(pages, labelled=labelled_by_rules(pages))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(_read(spark, sf_dir, "documents"), passages=True)
    return got.withColumn("repeated", F.col("n_removed") > 0)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_read(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_pages(_read(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(_read(spark, sf_dir, "embeddings"))
    got = with_label_errors(codes)
    return got.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(_read(spark, sf_dir, "documents")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op11_codes": op11_codes,
        "op12_spelling": op12_spelling,
        "op13_neighbours": op13_neighbours,
        "op5_embeddings": op5_embeddings,
        "op6_jaccard": op6_jaccard,
        "op4_html": op4_html,
        "op7_tokens": op7_tokens,
        "op3_repeats": op3_repeats,
        "op9_urls": op9_urls,
        "op8_quality": op8_quality,
        "op1_secrets": op1_secrets,
        "op10_mixing": op10_mixing,
        "op2_decontaminate": op2_decontaminate,
    }
