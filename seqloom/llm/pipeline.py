"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the columns of documents, the last its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import bpe_decode, bpe_encode
from .common import deleted_at_exit, shared_dir
from .langid import identify_languages, learn_languages
from .line_dedup import line_dedup
from .mixing import mix_sources
from .order_minhash import near_duplicates
from .queries import byte_bpe_path

LEAST_SCORE = 0.5  # share of a document's letters in its main language


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one main language: those without a letter, or with less than half of their letters in it, go."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = identify_languages(plain, learn_languages(plain), keep=tuple(plain.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*plain.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document repeats; n_chars is that of the text left."""
    kept = line_dedup(docs)
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates; documents without an id all stay.

    Where ids repeat, each text of an id is a document of its own: different
    texts under one id both stay, and of equal texts under one id, or in one
    class, the first by id, text hash, language, source and length does.
    """
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known, nameless = plain.where("doc_id is not null"), plain.where("doc_id is null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = known.join(near_duplicates(known).where("class_id = doc_id").select("doc_id"), "doc_id", "left_semi")
    else:
        keyed = known.withColumn("own", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
        classes = keyed.select("own", "doc_id").distinct().join(near_duplicates(keyed, "own").distinct(), "own")
        first = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "own")).alias("x")).select("x.own")
        kept = keyed.join(first, "own", "left_semi").groupBy("own").agg(F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("x")).select("x.*")
    return kept.unionByName(nameless).select(*plain.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for, in its order."""
    return mix_sources(docs).select("doc_id", "text", "lang", "source", "n_chars")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed), their number, and the digest of the text decoded from them."""
    ids = bpe_encode(docs, byte_bpe_path(), keep=("doc_id", "lang", "source"))
    counted = ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("ids").alias("packed"))
    text = bpe_decode(counted, byte_bpe_path(), ids_col="packed", keep=("doc_id", "lang", "source", "n_tokens", "ids"))
    return text.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

ORACLE_SQL = None  # language ID, near duplicates and BPE are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/seqloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        deleted_at_exit(spark, f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
