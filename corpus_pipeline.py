"""A training-data pipeline over ``documents``: rules, near duplicates, repeated strings, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next
one's documents. All but the last return the columns they got. Empty tables pass through; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import byte_bpe, mixing, ngram_join, quality_rules, suffix_dedup
from proofline.session import cut, ship


def _held(docs: DataFrame) -> Column:
    """A document's columns as one, so that no name an operator gives can meet theirs."""
    return F.struct(*docs.columns).alias("_held")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    bare = quality_rules.ledger(docs.select(_held(docs), "text"))
    return quality_rules.apply_policy(bare).where("kept").select("_held.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: the first by id, then by text. Ids may be null and may repeat."""
    ship(spark)
    # the row numbers are written, since they would differ from one reading to the next
    rows = cut(docs.select(_held(docs), F.monotonically_increasing_id().alias("_row")), "pipeline-rows")
    texts = rows.select("_row", F.col("_held.doc_id").alias("doc_id"), F.col("_held.text").alias("text"))
    found = cut(ngram_join.similar(texts.select("_row", "text"), "_row"), "pipeline-components").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    others = found.where("_row != _component")
    members = others.union(others.select(F.col("_component").alias("_row"), "_component").distinct())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text", "_row")
    first = texts.join(members, "_row").groupBy("_component").agg(F.min(order).alias("_first"))
    left_out = members.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_anti").select("_row")
    return rows.join(left_out, "_row", "left_anti").select("_held.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings they repeat; a character that a cut would split goes whole."""
    ship(spark)
    rest = [c for c in docs.columns if c != "text"]
    kept = suffix_dedup.dedup(docs.select(F.struct(*rest).alias("_rest"), F.col("text").isNull().alias("_none"), "doc_id", "text"), characters=True)
    text = F.when(~F.col("_none"), F.when(F.col("n_removed") == 0, F.col("kept")).otherwise(F.col("whole")).cast("string"))
    columns = {c: F.col("_rest")[c] for c in rest} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast("long")
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    bare = docs.select(_held(docs), F.col("doc_id").alias("_key"), F.col("source").alias("_queue"), mixing.n_words(F.col("text")).alias("_words"))
    mixed = mixing.mix(bare, source="_queue", size="_words", key="_key").where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_held.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    ship(spark)
    return byte_bpe.digest(docs, byte_bpe.vocabulary(), ids=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]

#: The stages are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
