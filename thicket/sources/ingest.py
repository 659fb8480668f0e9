"""From files to a stored dataset. k-mer counting is distributed; the examples, which are few, are ordered by label and id."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers
from .dataset import Dataset
from .formats import encode, fasta, fastq, labels, matrix_tsv, paths

log = logging.getLogger(__name__)
#: Bases of the longest k-mer.
LONGEST = 128


def matched(ids: DataFrame, given: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples with their metadata; those of one side alone go."""
    return ids.select(key).join(given, key)


def unmatched(a: DataFrame, b: DataFrame, key: str = "example_id") -> DataFrame:
    """Ids of a that b lacks."""
    return a.select(key).join(b.select(key), key, "left_anti")


def examples(ids: DataFrame, metadata: str | None) -> tuple[DataFrame, DataFrame | None]:
    """examples(gi, example_id, label) and tags(label, tag). Ids without a label and labels without an example are named in a warning and left out; without metadata labels are null."""
    spark = ids.sparkSession
    tags = None
    if metadata is None:
        known = ids.selectExpr("example_id", "cast(null as int) as label")
    else:
        given = labels(spark, metadata)
        repeated = given.groupBy("example_id").count().where("count > 1").select("example_id").collect()
        if repeated:
            raise ValueError(f"labelled twice: {', '.join(sorted(r.example_id for r in repeated))}")
        for a, b, what in ((ids, given, "without a label"), (given, ids, "without data")):
            lost = sorted(r.example_id for r in unmatched(a, b).collect())
            if lost:
                log.warning("left out, %s: %s", what, ", ".join(lost))
        own = encode(given)  # all labels count, those without data too
        known, tags = matched(ids, own).select("example_id", "label"), own.select("label", "tag").distinct()
    return known.selectExpr("cast(row_number() over (order by label, example_id) - 1 as int) as gi", "example_id", "label"), tags


def located(listing: DataFrame) -> dict[str, list[str]]:
    """The listed paths as Spark's readers name them, each with its examples; the listing has a line an example."""
    spark, out = listing.sparkSession, {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in listing.collect():
        p = jvm.org.apache.hadoop.fs.Path(r.path)
        out.setdefault(p.getFileSystem(conf).makeQualified(p).toUri().toString(), []).append(r.example_id)
    return out


def sequences(records: DataFrame, where: dict[str, list[str]], parent: bool) -> DataFrame:
    """example_id, seq of records(path, seq), by file or by folder."""
    spark = records.sparkSession
    known = spark.createDataFrame([(p, e) for p, es in where.items() for e in es], "at string, example_id string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    at = plain("path")
    own = records.select((F.regexp_replace(at, "/[^/]*$", "") if parent else at).alias("at"), "seq")
    return own.join(known.select(plain("at").alias("at"), "example_id"), "at").select("example_id", "seq")


def counted(seqs: DataFrame, k: int, at_least: int, filter_singleton: bool) -> DataFrame:
    """example_id, feature: canonical k-mers seen at_least times in an example, and in two examples if single ones go."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k is from 1 to {LONGEST}")
    own = kmers.enumerate_kmers(seqs.withColumnRenamed("example_id", "gi"), k).selectExpr("gi", f"{kmers.canonical('kmer')} as kmer")
    edges = kmers.presence(own, at_least)
    return (kmers.shared(edges) if filter_singleton else edges).withColumnRenamed("gi", "example_id")


def stored(path: str, ids: DataFrame, edges: DataFrame, metadata: str | None, **meta: str) -> Dataset:
    ex, tags = examples(ids, metadata)
    ex = ex.persist()
    made = Dataset.create(path, ex, edges.join(ex.select("example_id", "gi"), "example_id").select("feature", "gi"), tags, **meta)
    ex.unpersist()
    return made


def from_tsv(spark: SparkSession, path: str, tsv: str, metadata: str | None = None, **meta: str) -> Dataset:
    names = spark.read.csv(tsv, sep="\t", header=True).columns[1:]
    if len(set(names)) < len(names):
        raise ValueError("an example occurs twice")
    ids = spark.createDataFrame([(x,) for x in names], "example_id string")
    return stored(path, ids, matrix_tsv(spark, tsv), metadata, source="tsv", filter="nothing", **meta)


def from_contigs(spark: SparkSession, path: str, listing: str, metadata: str | None = None, k: int = 31, filter_singleton: bool = False, **meta: str) -> Dataset:
    """listing: lines of an id and the path of its FASTA file."""
    files = paths(spark, listing)
    where = located(files)
    seqs = sequences(fasta(spark, list(where)), where, False)
    return stored(path, files.select("example_id"), counted(seqs, k, 1, filter_singleton), metadata, source="contigs", k=str(k), filter="singleton" if filter_singleton else "nothing", **meta)


def from_reads(spark: SparkSession, path: str, listing: str, metadata: str | None = None, k: int = 31, abundance_min: int = 1, filter_singleton: bool = False, **meta: str) -> Dataset:
    """listing: lines of an id and a folder; all its .fastq and .fastq.gz files are that example."""
    files = paths(spark, listing)
    where = located(files)
    seqs = sequences(fastq(spark, [f"{p}/*.{{fastq,fastq.gz}}" for p in where]), where, True)
    return stored(path, files.select("example_id"), counted(seqs, k, abundance_min, filter_singleton), metadata, source="reads", k=str(k), abundance_min=str(abundance_min), filter="singleton" if filter_singleton else "nothing", **meta)
