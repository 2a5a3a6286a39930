"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of
``documents``; the last gives the packed pieces. ``run`` writes each stage's result to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import line_rules, near_copies, neighbour_vote, packing, suffixes
from keyloom.plans.shared import materialise


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with ``n_chars`` after what the text has become."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call good; no other document stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = neighbour_vote.fit(docs, labels)
    scored = neighbour_vote.score(docs, model, docs.columns)
    return scored.filter(F.col("score") >= neighbour_vote.THRESHOLD).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the boilerplate lines of their source."""
    return _counted(line_rules.clean(docs), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 0.8 of their shingles of five words in common."""
    return near_copies.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once."""
    others = [c for c in docs.columns if c != "text"]
    cut = suffixes.remove(docs, others, as_text=True)
    return _counted(cut.withColumnRenamed("kept", "text"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack_sequences),
]

# No stage but the rules can be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
