"""Training-text pipeline: five stages over ``documents``, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All stages but the last return
the columns of ``documents``. Repeated rows, nulls and empty tables pass through
by the rules of the operators; a document is rejected only where a rule below
says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import language_crf, piece_codec, pivot_simhash, secret_automata, token_mix
from tagloom.llm.common import materialize, read_table
from tagloom.llm.queries import quality_weights

#: A text that fits the learned languages less is in none of them, nor in a mix of them.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that fit no language; how many languages a text mixes does not matter."""
    model = language_crf.learn(docs, ~language_crf.held_out())
    found = language_crf.predict(docs, model, keep=docs.columns, lang_out="_tl_lang", score_out="_tl_score", words_out="_tl_words", fit_out="_tl_fit")
    return found.where((F.col("_tl_lang") != language_crf.UNKNOWN) & (F.col("_tl_fit") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of linked fingerprints."""
    return pivot_simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; its secrets are replaced by a mask."""
    return secret_automata.redact(docs, secret_automata.learn(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that every source comes near its target."""
    return token_mix.apply_mix(docs, weights=quality_weights(spark, sf_dir))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    out = piece_codec.encode(docs.withColumn("_tl_digest", F.xxhash64(F.coalesce("text", F.lit("")))), keep=["doc_id", "lang", "source", "_tl_digest"], ids_col="ids", decoded_col="decoded")
    exact = F.xxhash64("decoded") == F.col("_tl_digest")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("source_mix", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Fingerprints, the automata, the field and the piece model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
