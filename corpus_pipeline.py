"""The corpus pipeline: quality rules, near-duplicate join, PII surrogates, source mixing, BPE round trip.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents` and may have others, and returns a DataFrame; all but the last
return docs' columns. run() writes each stage's result to the shared folder and reads it back as the next one's docs, and then deletes what led to it.

In all stages a null text counts as empty, other columns pass through whatever their names, and an empty table gives an empty one. Rows without a
doc_id are judged, rewritten, mixed and encoded like others, and are nobody's duplicate. Rows that repeat a doc_id and a text are one document, of
which one row stays (the least in order of its columns' hash, should they differ); rows of one doc_id and several texts stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import op1_surrogates, op3_mixing, op6_decisions, op9_jaccard, op10_bpe
from thicket.llm.common import Tables, table, unused

#: Near duplicates share five-word shingles to this per cent.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return op6_decisions.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays, in one row for each of its texts; rows without a doc_id stay."""
    tables, columns = Tables(spark), docs.columns
    gone, own = unused("gone_id", columns), F.col("doc_id").cast("bigint")
    away = op9_jaccard.join(docs, WORDS, PERCENT, tables=tables).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    away = tables.cut(away)
    again = tables.cut(docs.groupBy(own.alias(gone)).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(gone).isNotNull()).select(gone))
    tables.free(away, again)
    left = docs.join(away, own == F.col(gone), "left_anti")
    if again.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    twice = left.join(again, own == F.col(gone), "left_semi").select(row.alias("r")).groupBy(F.col("r.doc_id"), F.col("r.text")).agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return left.join(again, own == F.col(gone), "left_anti").unionByName(twice.select(*(F.col(f"r.`{c}`") for c in columns)))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates."""
    df, _ = op1_surrogates.replace(docs)
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's epochs take them."""
    return op3_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return op10_bpe.round_trip(docs, op10_bpe.vocabulary())


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII surrogates", surrogates), ("source mixing", mixing), ("BPE encoding", tokens)]
#: A learned list, keyed surrogates and merges are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir))
        tables.free(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
