"""From raw documents to packed sequences: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, packing, pii, simhash
from strandline.storage import drop_path, materialize, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this posterior no language is credible.
LEAST_SCORE = 0.5
_log = logging.getLogger(__name__)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a credible language, which replaces the given one; the rest go.

    Predicting beside the row, not joining back by doc_id, keeps repeated rows as they
    are. Where no document tells a language, nothing can be learned or rejected on
    that ground: documents with a letter stay as they are, and a warning says so.
    """
    own = docs.select(*COLUMNS)
    model = langid.train(own)
    if model is None:
        _log.warning("no document has a language: none is rejected for its language")
        return own.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.tag(own, model)
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest doc_id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become format-preserving pseudonyms; n_chars follows the text.

    The key is the session's: set spark.strandline.pii.secret to link values across
    runs. Unset, a random key that no code holds lasts as long as the session.
    """
    return pii.pseudonyms(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts towards the sources' target weights, in random order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mixture), ("packing", pack)]

#: Fingerprints and tokens have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables, and its input once read, are dropped before the next one starts."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as kept:
            path = scratch_path(spark, f"pipeline-{name}")
            kept.add(path)
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
