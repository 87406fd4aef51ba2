"""A training-data pipeline over the documents table.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame that works on all rows of its predecessor:

1. language ID: documents go that have no letter or that no language claims;
2. line dedup: lines go that an earlier document (or place) has, exactly or but for one edit; a document of which nothing is left goes;
3. MinHash near-dedup: the first document of each class stays;
4. secret scans: secrets in the text are replaced by [SECRET], the documents stay;
5. packing: sequences of pieces of the documents.

Stages 1 to 4 return the columns of documents; n_chars keeps telling the length of the text.  Empty inputs give empty outputs; null texts count as
empty and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import op1_minhash, op4_packing, op6_lines, op7_language, op8_secrets
from sheetloom.llm.common import store

#: Below this pooled probability no language claims a document; with four languages chance is 0.25.
LEAST_SCORE = 0.35


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op7_language.fit(docs)
    known = op7_language.identify(docs, model)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op6_lines.drop_lines(docs)
    return _counted(out.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_minhash.keep_first(docs).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(op8_secrets.redact_secrets(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: Networks, sketches and tokenizers can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
