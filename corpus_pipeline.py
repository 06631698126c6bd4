"""A cleaning pipeline over `documents`: toxicity, exact dedup, near-dedup, benchmark decontamination, then BPE tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four return the rows that
stay, with all their columns; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

Defined results: a row is told by its id and text, so rows of one id with different texts are different documents, with
or without an id. Null and empty texts are equal texts, contain no benchmark item and have no tokens. After either dedup
rows of one id and text are one row (one with a text before one without, then the one whose JSON has the least hash);
of a group of near copies in which several rows have its smallest id, one stays. An empty table passes through all stages;
other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, exact, near, toxicity
from tidemark.llm.common import written


#: Percent of shared shingles from which documents count as near copies of each other.
SIMILARITY = 80


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def _key(text: Column) -> Column:
    """What tells a row: its id and its text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), exact.sha256_text(F.coalesce(text, F.lit(""))))


def _staying(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the keys, one of each; rows travel as one column, so no name of theirs can clash."""
    rows = docs.select(_key(F.col("text")).alias("key"), F.struct("*").alias("row"))
    stay = rows.join(keys.select("key"), "key", "left_semi")
    first = F.struct(F.col("row.text").isNull(), F.xxhash64(F.to_json("row")))
    return stay.groupBy("key").agg(F.min_by("row", first).alias("row")).select("row.*")


def exact_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact.stream_dedup(docs).where("kept")
    return _staying(docs, kept.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "text_sha256").alias("key")))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near.near_dedup(docs, percent=SIMILARITY, ref=_key(F.col("text"))).where("kept")
    group = F.when(F.col("component").isNull(), F.col("ref")).otherwise(F.col("component").cast("string"))
    return _staying(docs, found.groupBy(group.alias("group")).agg(F.min("ref").alias("key")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, bpe.vocabulary_path(), tokens=False)


STAGES = [
    ("toxicity", non_toxic),
    ("exact dedup", exact_distinct),
    ("near dedup", near_distinct),
    ("decontamination", decontaminated),
    ("bpe", tokenized),
]
#: SQL expresses neither the score nor the tokens; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
