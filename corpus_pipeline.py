"""The corpus pipeline: five stages over ``documents``, each by one of the operators in ``vigil.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the previous
one kept, and returns a DataFrame: documents' columns, or for the last stage
the pieces and their places in the packed sequences. Extra columns of the input
pass through. Null texts and texts without letters are rejected by the first
stage; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import lang_id, ngram_join, packing, pii_boost
from vigil.llm.common import small_batches, staged
from vigil.llm.decontaminate import decontaminate
from vigil.sources.tables import read_table

#: Share of the score that the best language must have; below it a document is no text of a known language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language: without letters, or with no language clearly ahead."""
    small_batches(spark)
    model = lang_id.fit(docs)
    kept = lang_id.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id (null last, then by text hash) of each group linked by word 5-gram
    Jaccard of 0.8 or more."""
    small_batches(spark)
    first = ngram_join.join(docs).where("first").select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash")).distinct()
    kept = docs.withColumn("_text", F.xxhash64("text"))
    kept = kept.join(first, kept["doc_id"].eqNullSafe(first["_kept"]) & (kept["_text"] == first["_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)  # repeated rows


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which at least a twentieth are words of benchmark windows."""
    small_batches(spark)
    d = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return d.where(~F.col("contaminated")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind; n_chars follows."""
    small_batches(spark)
    d = pii_boost.detect(docs, pii_boost.fit(docs))
    new = {"text": F.col("redacted_text"), "n_chars": F.char_length("redacted_text").cast(docs.schema["n_chars"].dataType)}
    return d.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids into sequences of 1024."""
    small_batches(spark)
    return packing.best_fit(docs, digests={"ids_crc32": F.crc32("ids")}).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_copies),
          ("benchmark_decontamination", drop_contaminated), ("pii", redact), ("best_fit_packing", pack)]

#: No SQL: the model-based stages and the tokeniser cannot be expressed; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
