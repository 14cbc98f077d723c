"""The corpus pipeline: quality rules, language, near-duplicates, secrets, packing.

``STAGES`` lists (name, function). Each function takes the session, the documents that the stage
before has kept, and the folder of the input tables; all but the last return the columns of
``documents``. ``run`` applies them to the whole table, each stage on the stored rows of the one
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm import language, near_dedup, quality, secrets
from flightline.llm.queries import packed
from flightline.llm.text import read_table
from flightline.plans.durable import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    judged = quality.judge_quality(docs, labels, keep=COLUMNS)
    return judged.filter("kept").select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes the language found."""
    learned = language.train(docs)
    named = {"lang_pred": "_lang", "score": "_score", "rejected": "_rejected"}
    found = language.identify(docs.select(*COLUMNS), learned, names=named)
    return found.filter(~F.col("_rejected")).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the one with the smallest id.

    Rows with the same id are one document: the one with the smallest text stays. Rows with a null
    id are in no group and stay.
    """
    groups = near_dedup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    once = (
        docs.join(durable(groups), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct(*rest)).alias("_first"))
        .select("doc_id", "_first.*")
    )
    unnamed = docs.filter(F.col("doc_id").isNull())
    return once.select(*COLUMNS).union(unnamed.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text."""
    clean = secrets.scan(docs, keep=("doc_id", "lang", "source"))
    return clean.select(
        "doc_id",
        F.col("redacted").alias("text"),
        "lang",
        "source",
        F.length("redacted").cast(docs.schema["n_chars"].dataType).alias("n_chars"),
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training windows."""
    return packed(docs)


STAGES = [
    ("quality rules", keep_good),
    ("language ID", keep_identified),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Models trained by numpy and a compressor decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
