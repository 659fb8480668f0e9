"""Readers: 0/1 matrices, FASTA, FASTQ, labels, id lists, blacklists. All paths are read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_tsv(spark: SparkSession, path: str) -> DataFrame:
    """example_id, feature of the ones of a matrix with a `kmers` column and a column for each example."""
    df = spark.read.csv(path, sep="\t", header=True)
    if df.columns[0] != "kmers":
        raise ValueError("the first column is kmers")
    return unpivot(df, "kmers")


def unpivot(wide: DataFrame, feature: str) -> DataFrame:
    """example_id, feature where a cell of the wide 0/1 table is 1."""
    return wide.unpivot([feature], [c for c in wide.columns if c != feature], "example_id", "x").where("x = 1").selectExpr("example_id", f"`{feature}` as feature")


def paths(spark: SparkSession, listing: str) -> DataFrame:
    """example_id, path; the last line of a repeated id counts."""
    df = spark.read.text(listing).selectExpr("monotonically_increasing_id() as line", "split(trim(value), '\\\\s+') as x").where("size(x) = 2")
    return df.groupBy(F.expr("x[0]").alias("example_id")).agg(F.expr("max_by(x[1], line)").alias("path"))


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, name, seq (upper case) of every record. Records are lines that end before the next `>`, so a large file is read in parts."""
    record = spark.read.text(path, lineSep="\n>").withColumn("path", F.input_file_name()).selectExpr("path", "trim(LEADING '>' FROM value) as r")
    df = record.selectExpr("path", "trim(BOTH ' \r' FROM substring_index(r, '\n', 1)) as name", "upper(regexp_replace(substring(r, length(substring_index(r, '\n', 1)) + 1), '\\\\s', '')) as seq")
    return df.where("name <> '' or seq <> ''")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq of records of four lines, from plain files, which are read in parts, or gzip ones, which are not.

    A record ends before the next line that begins with `@`. Where that is a line of qualities, what follows has no third line with a `+`, and is none.
    """
    record = spark.read.text(path, lineSep="\n@").withColumn("path", F.input_file_name()).selectExpr("path", "split(value, '\n') as l")
    return record.where("size(l) >= 3 and startswith(l[2], '+')").selectExpr("path", "upper(trim(BOTH ' \r' FROM l[1])) as seq")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """example_id, tag from lines of two fields."""
    return spark.read.text(path).where("trim(value) <> ''").selectExpr("split(trim(value), '\\\\s+') as x").selectExpr("x[0] as example_id", "if(size(x) = 2, x[1], raise_error('two fields a line')) as tag")


def encode(tags: DataFrame) -> DataFrame:
    """example_id, tag, label: labels count the distinct tags in order; there are from 2 to 255."""
    own = tags.select("tag").distinct().selectExpr("tag", "cast(dense_rank() over (order by tag) - 1 as int) as label")
    n = own.count()
    if not 2 <= n <= 255:
        raise ValueError(f"there are {n} classes; from 2 to 255 can be learnt")
    return tags.join(F.broadcast(own), "tag")


def ids(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).selectExpr("trim(value) as value").where("value <> ''").collect()]


def blacklist(spark: SparkSession, path: str, k: int) -> DataFrame:
    """feature: k-mers to leave out, from FASTA or one a line; another alphabet or length is an error."""
    df = fasta(spark, path).select("seq") if path.endswith((".fasta", ".fa", ".fas", ".fna")) else spark.read.text(path).selectExpr("upper(trim(value)) as seq").where("seq <> ''")
    return df.selectExpr(f"if(seq rlike '^[ACGT]{{{k}}}$', seq, raise_error(concat('no {k}-mer: ', seq))) as feature").distinct()
