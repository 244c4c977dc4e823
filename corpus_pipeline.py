"""A corpus pipeline of five operators; each stage's result is written and read as the next stage's documents.

Language ID drops texts that it rejects; of each group of near duplicates one document stays; documents with a
benchmark passage go; personal data are replaced by their kind in brackets; sources are mixed to target weights.
All stages but the last return the columns of documents.  A null or empty table passes all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.llm import language_id, pii, source_mix
from hornlake.llm.decontaminate import contamination
from hornlake.llm.minhash import near_duplicates
from hornlake.llm.shared import settled, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learns from the labelled ones that are not held out."""
    small_batches(spark)
    dictionaries = language_id.fit_dictionaries(docs, ~language_id.held_out())
    return language_id.identify(docs, dictionaries).filter(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; rows are told apart by id and text, so of rows that share an id each is judged by its own text.

    Rows without an id stay; of rows equal in id and text one does.
    """
    small_batches(spark)
    found = near_duplicates(docs, percent=80).filter("kept and doc_id is not null")
    kept = found.select("doc_id", F.col("text_hash").alias("kept_hash")).distinct()
    same = (docs["doc_id"] == kept["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["kept_hash"])
    named = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    small_batches(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    small_batches(spark)
    clean = pii.find_pii(docs, pii.fit(docs), redact=True).drop("spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return source_mix.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
]

#: Four of the stages have no SQL equivalent; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
