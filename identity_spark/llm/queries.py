"""The registered queries of this folder, and the SQL of those that SQL can express.

A query reads its whole tables, calls the operator with production parameters and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, jaccard, labelled_pages, language_model, licences, main_text, oracles, pieces, resampling, secrets, sharding, token_files, topk
from . import toxicity as tox
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of the documents by a Feistel permutation of row numbers."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents, and whether decoding them gives the text back."""
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, path, back="decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.BLANK, " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), same.alias("round_trip"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the documents, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = tox.trained(docs, table(spark, sf_dir, "labels"))
    scored = tox.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", tox.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the documents with benchmark items, by spaced seeds."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "first_item", "shared_words")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the folder isn't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents, written as Parquet and read back."""
    read = token_files.token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.with_checksums(read.withColumnRenamed("doc_id", "key")).withColumnRenamed("key", "doc_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the pages, by a model fitted on the labelled pages of this folder."""
    found = main_text.extract(table(spark, sf_dir, "pages"), main_text.fit(labelled_pages.pages()))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose text or notice a document, a paragraph or a line is."""
    found = licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))
    return found.select("doc_id", "whole_licence", F.array_join("licences", ",").alias("licences"), "n_places")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by 4-word shingles at a similarity of 0.85."""
    found = jaccard.similar_sets(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in the documents: the three kinds of the contract, and those of further rules."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["order"] < len(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = topk.top_k(rows.filter(F.col("id") % 100 == 0), rows, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_yinyang_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of the embeddings after three rounds."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents, drawn by how much they look like the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the documents' probabilities by deleted interpolation of one to three words."""
    return language_model.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_main_text": op6_main_text,
    "op7_licence_scans": op7_licence_scans,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_secret_scans": op9_secret_scans,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_yinyang_clustering": op11_yinyang_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": oracles.sharding_sql(24),
    "op4_decontamination": oracles.decontamination_sql(),
    "op8_jaccard_join": oracles.JACCARD,
    "op9_secret_scans": oracles.secrets_sql(),
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_yinyang_clustering": oracles.clustering_sql(16, 3, 64),
}
