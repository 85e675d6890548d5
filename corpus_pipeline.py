"""A training corpus from the documents: filters, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and gives a table; :func:`run` writes it as Parquet and reads it again for the
next stage. All stages but the last return the columns of ``docs``, whatever these are besides doc_id and text.

In all stages a null text is one without words, a text of any length is taken whole, rows with equal or null doc_id are
judged each by its own text, equal rows equally, and an empty table gives no rows. What else is defined stands with
each stage, and in full with its operator. Stages hand texts to Python in batches that are bounded in bytes, a setting of
the session that they leave behind: executors hold these beside what earlier stages left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from identity_spark.llm import decontamination, jaccard, pieces, queries, secrets
from identity_spark.llm import toxicity as tox
from identity_spark.llm.common import small_batches, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below one half; the model is fitted on the labels of the folder.

    Null and empty texts stay unless a folder has toxic labels only; without labels all rows stay."""
    small_batches(spark)
    model = tox.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return tox.toxicity(docs, model, out="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four fifths of their shingles of five words.

    That of the least doc_id stays, a null one only if there is no other; of rows that are equal in doc_id and text any
    one. All rows without words stay."""
    small_batches(spark)
    return jaccard.without_near_copies(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of a benchmark item; an empty benchmark lets all stay."""
    small_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret replaced by its kind; n_chars, if there is such a column, follows the text, null stays null."""
    clean = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number for all rows; a null or empty text has none."""
    small_batches(spark)
    # what executors hold from earlier stages counts too, so this one remembers less than by itself
    path = queries.vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(docs.select("doc_id", "text"), path, keep_text=False, remembered=100_000, rows_at_once=128)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", secret_spans),
    ("SentencePiece encoding", token_ids),
]

#: SQL can express neither the first stage's model nor the last one's segmentation; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return written(STAGES[-1][1](spark, docs, sf_dir), "corpus")
