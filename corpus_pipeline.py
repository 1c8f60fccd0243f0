"""From raw documents to token ids: five stages, each over all that the one before it kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns,
and but for the last return the columns they got. Rows with a null text count as empty: they score like the
empty text, have no lines and no benchmark item, are copies of each other, and give no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasift.llm import bpe, decontaminate, linededup, nearcopies, quality
from parasift.llm.common import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more. Equal texts have equal scores, so repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    scored = quality.quality_scores(docs, labels, keep=tuple(c for c in columns if c != "doc_id"))
    return scored.where("score >= 0.5").select(columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines. Only a document that such lines leave without any word goes: each of
    its lines has its template in an earlier document. Rows without an id pass as they are; repeated rows lose
    the same lines. Copies are left to the next stage."""
    kept = linededup.dedup_lines(docs)
    changed = F.col("lines_dropped") > 0
    kept = kept.where(~changed | F.coalesce(F.col("text").rlike(r"\S"), F.lit(True)))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of texts linked at a five-word similarity of 0.8; of rows with
    one id the text of the least hash, a missing id last. Repeated rows become one."""
    return nearcopies.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; a row for each row."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_decode(docs, path, pattern, keep=("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the fingerprints. Tests hold the line and near-dedup stages against brute
#: force, the others' operators, and the whole on a small folder of odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each keeps is written in the shared folder and read
    again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
