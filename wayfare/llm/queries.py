"""The operators over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, divergence, media, minhash, mixing, ngram_join, pii, quality, spelling, tokenfile, topk, url_filter, warc
from wayfare.llm.common import new_path, table

#: The vocabulary file; a parameter of the operators.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    media.write(table(spark, sf_dir, "documents"), path)
    payload, wave = F.col("payload"), F.col("media")
    return media.read(spark, path).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length(wave).cast("long").alias("media_bytes"),
        F.sha2(wave, 256).alias("media_sha256"),
        "feature",
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the row of labels with their id: good if its quality is 1 and it isn't toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, VOCABULARY)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mix, op2_bpe, op3_warc, op4_topk, op5_pii, op6_media, op7_minhash, op8_url_templates, op9_token_file, op10_quality, op11_ngram_join, op12_divergence, op13_spelling)}

ORACLES: dict[str, str] = {"op1_source_mix": mixing.SQL, "op3_warc": warc.SQL, "op4_topk": topk.SQL, "op11_ngram_join": ngram_join.SQL, "op12_divergence": divergence.SQL, "op13_spelling": spelling.SQL}
