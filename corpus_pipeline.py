"""From raw documents to token ids: quality, near duplicates, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. Columns that docs has besides
doc_id, text, source and n_chars pass through all stages but the last, whatever
their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, minhash, mixing, pii, quality
from wayfare.llm.common import stored, table
from wayfare.llm.queries import VOCABULARY

#: Ids are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator uses, and where each went."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 at least stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, names = _numbered(docs)
    scored = quality.score(own, model, names["doc_id"], names["text"], keep=tuple(n for c, n in names.items() if c != "doc_id"))
    return scored.where("score >= 0.3").select(*names.values()).toDF(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; of rows that share an id, or a text without an id, one."""
    own, names = _numbered(docs)
    i, text = names["doc_id"], names["text"]
    found, _ = stored(minhash.near_duplicates(own, id_col=i, text_col=text).select("doc_id", "kept"), "kept")
    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = own.join(_small(gone), F.col(i) == F.col("gone"), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        left = left.where(F.col(i).isNull()).unionByName(left.where(F.col(i).isNotNull()).dropDuplicates([i]))
    if found.where("doc_id is null").limit(1).count():
        left = left.where(F.col(i).isNotNull()).unionByName(left.where(F.col(i).isNull()).dropDuplicates([text]))
    return left.toDF(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to [KIND]; n_chars is the new text's."""
    own, names = _numbered(docs)
    done = pii.find(own, names["doc_id"], names["text"], keep=tuple(n for c, n in names.items() if c != "doc_id"), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return done.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; of texts without words there is nothing to take."""
    own, names = _numbered(docs)
    i = names["doc_id"]
    taken = mixing.mix(own, id_col=i, text_col=names["text"], source_col=names["source"]).groupBy(F.col(i).alias("id")).agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("times"))
    taken, _ = stored(taken.select("id", F.coalesce(F.round("times"), F.lit(0)).cast("int").alias("times")).where("times > 0"), "times")
    rows = own.join(_small(taken), F.col(i).eqNullSafe(F.col("id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*names.values()).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, and the digest of the text that they decode to."""
    done = bpe.encode(docs, VOCABULARY)
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("personal data", redact),
    ("source mix", mix),
    ("token ids", encode),
]

#: No stage but the mix can be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
