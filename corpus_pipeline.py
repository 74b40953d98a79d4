"""From raw documents to packed training sequences, in stages that each read what the stage before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import line_dedup, near_dedup, packing, registry, secret_scan, toxicity
from anchorline.llm.common import prepared, table, text_of
from anchorline.session import stable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3


def _measured(docs: DataFrame, changed: str) -> DataFrame:
    """The columns of documents; `n_chars` is renewed where the text has changed."""
    size = F.when(F.expr(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", size).select(COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit; trained on the documents given and on labels not held out."""
    prepared(spark)
    model = registry.toxic_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < TOXIC_FROM).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those of which no line is left go."""
    done = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    return _measured(done.where("not (deleted > 0 and left = 0)"), "deleted > 0")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepared(spark)
    docs = docs.select(COLUMNS)
    found = near_dedup.near_duplicates(docs).where("kept").select(
        F.col("id").alias("__id"), F.col("text_key").alias("__key"), "repeats"
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5(text_of()) == F.col("__key"))
    kept = stable(docs.join(found, same))
    once = kept.where("repeats = 1").select(COLUMNS)
    return once.unionAll(kept.where("repeats > 1").dropDuplicates(["doc_id", "__key"]).select(COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    found = secret_scan.find_spans(docs.select(COLUMNS))
    return _measured(secret_scan.redact(found), "size(spans) > 0")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: Stages train, hash and tokenise, which SQL cannot express; tests compare them with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
