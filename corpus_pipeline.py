"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: quality classification drops
rejected documents; the near-duplicate join leaves one document of each class; the secret scan replaces secrets in
the texts; mixing keeps documents by the rates that meet the domain targets; encoding returns token ids.

Defined results: a null text is empty: it has the score of the label share, is no near duplicate, keeps no secret and
encodes to the end id alone; rows that are equal in all columns count as one document; rows with null ids are kept or
dropped like others; nulls in lang, source and n_chars stay; extra columns are left out; an empty table gives an empty
table. A stage's tables in the shared folder go once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import op4_near_duplicates, op5_mixing, op8_secrets, op9_sentencepiece, op10_quality
from vicinity.llm._common import documents, drop_tables, tables_so_far, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the neighbours vote down."""
    model = op10_quality.train(docs, _labels(spark, sf_dir))
    return op10_quality.score_texts(docs.select(*COLUMNS), model, name="_score").where(F.col("_score") >= op10_quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each class of near duplicates."""
    return op4_near_duplicates.one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a placeholder in the place of every secret; no document goes."""
    clean = op8_secrets.redacted(op8_secrets.scan_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents by their rates under the domain targets."""
    return op5_mixing.mixed_documents(docs.select(*COLUMNS), _labels(spark, sf_dir))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return op9_sentencepiece.encode_texts(docs.select("doc_id", "lang", "source", F.col("text").alias("_of")), "_of").drop("_of")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]
#: The stages learn models and encode with a vocabulary file, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents; what earlier stages wrote is deleted as soon as the next one has read it."""
    docs, since = documents(spark, sf_dir), tables_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
            drop_tables(spark, since, keep=1)
    return docs
