"""From raw documents to token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of `documents`, so a stage can be left out or run alone. `run` writes the result of each as Parquet in the shared
folder and hands the table read from there to the next, so a lost executor costs at most a stage's own tasks.

Columns that a table has besides those of `documents` are not carried along. Null texts, empty tables and repeated rows
have the results that the operators define: a null text has no language and goes with the first stage, an empty
table stays empty through all stages, and of repeated rows one stays after the near duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.language_id import UNKNOWN, identify, learn
from fleetlens.llm.line_dedup import without_repeated_lines
from fleetlens.llm.mixing import mix
from fleetlens.llm.near_dedup import near_duplicates
from fleetlens.llm.sentencepiece_fst import encode_decode
from fleetlens.llm.storage import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = "piece_bpe_32k.model"
#: Of the sources in order of code point, going round.
WEIGHTS = (5, 2, 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; a missing label is filled with the language found."""
    docs = docs.select(*COLUMNS)
    judged = identify(docs, learn(docs)).where(F.col("lang_pred") != UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one equals but for an edit go, and documents that have no others."""
    return without_repeated_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(docs.select(*COLUMNS), WEIGHTS).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece numbers of each document, and the text that they decode to."""
    return encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL)).drop("text")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("mix_sources", mixed), ("sentencepiece", tokens)]

#: Language identification, near duplicates by sketches and tokenizers are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
