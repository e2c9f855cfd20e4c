"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlens.llm import (
    bpe, decontaminate, exactdup, filteraudit, licenses, neardup, orchard, pagetext, pitman_yor, quality, secrets, sharding, warc,
)
from paperlens.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def registered() -> dict[str, Query]:
    return dict(QUERIES)


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, folder, "documents", "doc_id", "text"), TOKENIZER)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents", "doc_id", "text"))
    spans = F.col("secrets")
    return found.select(
        "doc_id", *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.span_list(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.span_list(spans).alias("spans"),
    )


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(table(spark, folder, "documents", "doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance",
    )


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.find_matches(documents, table(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"), "longest_match",
    )


@query
def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_classes(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "class_id")


@query
def op6_pagetext(spark: SparkSession, folder: str) -> DataFrame:
    found = pagetext.main_text(table(spark, folder, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents", "doc_id", "text"))
    names = F.transform("licenses", lambda m: m["license"])
    places = F.transform("licenses", lambda m: F.concat_ws(
        ":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"),
        F.array_join(F.array_sort(places), ",").alias("places"),
    )


@query
def op8_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score(table(spark, folder, "documents", "doc_id", "text"))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    archive = warc.write(pages)
    kind = dict(pages.dtypes)["page_id"]
    return warc.read(archive, warc.find(archive, pages)).select(
        F.col("number").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents", "doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_exactdup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return exactdup.exact_classes(documents, keep="largest")


@query
def op12_orchard(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.cluster(table(spark, folder, "embeddings", "vec_id", "embedding")).drop("compared")


@query
def op13_filteraudit(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text", "lang")
    return filteraudit.audit(documents, table(spark, folder, "labels", "doc_id", "quality", "toxic"))
