"""The corpus pipeline: toxicity, line dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. run()
writes each stage's result as Parquet in the shared folder and gives it to the next, so a lost executor repeats no
earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import linededup, neardup, packing, secrets, toxicity
from eventlens.llm.common import forget, keep, scratch, table, unused


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model is fitted on the labelled rows of sf_dir."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = unused(docs, "__toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across three documents or more."""
    return linededup.dedup_lines(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of 5-word shingles, similarity 0.8."""
    return neardup.keep_one(docs, k=5, percent=80)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced."""
    return secrets.redact(docs, secrets.train_forest(secrets.labelled_findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("minhash_neardup", near_copies_out),
    ("secret_scan", secrets_out),
    ("best_fit_packing", packed),
]
#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as spare:  # a stage's own tables go once its result is written, and so does the one before it
            docs = keep(stage(spark, before, sf_dir), name)
            spare(docs)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
