"""A training-data pipeline over ``documents``: classify, drop near copies, cut repeats, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``.  ``run`` writes each stage as Parquet to the shared folder and rereads it.
Nulls: a null text scores as an empty one, and only a score under the threshold rejects a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm import config_lp_packing, entropy_secrets, quality_cnn, suffix_dedup, tensored_minhash
from lexatlas.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recounted(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; the others go."""
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.classify(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    found = tensored_minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has in a string of 50 bytes (whole characters only)."""
    return _recounted(suffix_dedup.kept_text(docs, "lang", "source"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by ``[SECRET]``."""
    return _recounted(entropy_secrets.redact(docs, "lang", "source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be found."""
    return config_lp_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("secret_redaction", secret_redaction), ("packing", packing)]

#: SQL can express neither a trained network nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
