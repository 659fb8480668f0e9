"""k-mers of sequences. Letters are ordered A < C < T < G, which decides what a canonical k-mer is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Letters of a piece of sequence, and of the prefixes by which k-mers are numbered.
PIECE, PREFIX = 1 << 20, 8


def pieces(sequences: DataFrame, k: int, size: int = PIECE) -> DataFrame:
    """Sequences longer than size in pieces that overlap by k - 1 letters, so that each window is in one piece. Bytes are cut, as letters are ASCII and a place in bytes is found at once."""
    keep = [c for c in sequences.columns if c != "seq"]
    cut = f"transform(sequence(0, (length(b) - 1) div {size}), i -> cast(substring(b, i * {size} + 1, {size + k - 1}) as string))"
    return sequences.withColumn("b", F.expr("cast(seq as binary)")).where("length(b) > 0").select(*keep, F.explode(F.expr(f"if(length(b) <= {size}, array(seq), {cut})")).alias("seq"))


def enumerate_kmers(sequences: DataFrame, k: int, alphabet: str = "ACGT") -> DataFrame:
    """The other columns and kmer, one row for each window of k letters of the alphabet; a lookahead keeps it linear in the sequence, pieces keep a row's windows few."""
    keep = [c for c in sequences.columns if c != "seq"]
    return pieces(sequences, k).select(*keep, F.explode(F.expr(f"regexp_extract_all(seq, '(?=([{alphabet}]{{{k}}}))', 1)")).alias("kmer"))


def numbered(features: DataFrame) -> DataFrame:
    """features with kmer_id, their rank in order of letters: the rank within a prefix of PREFIX letters, which is spread over tasks, and the number of those before it."""
    part = features.withColumn("part", F.expr(f"substring(feature, 1, {PREFIX})"))
    before = part.groupBy("part").count().selectExpr("part", "sum(count) over (order by part) - count as before")  # a row a prefix, 65,536 of four letters
    rank = part.withColumn("i", F.expr("row_number() over (partition by part order by feature)"))
    return rank.join(F.broadcast(before), "part").withColumn("kmer_id", F.expr("before + i - 1")).drop("part", "before", "i")


def canonical(kmer: str) -> str:
    """SQL for the lesser of a k-mer and its reverse complement."""
    code = lambda x: f"translate({x}, 'ACTG', '0123')"
    return f"translate(least({code(kmer)}, {code(f"translate(reverse({kmer}), 'ACGT', 'TGCA')")}), '0123', 'ACTG')"


def presence(kmers: DataFrame, at_least: int = 1) -> DataFrame:
    """gi, feature: k-mers seen at_least times in an example."""
    return kmers.groupBy("gi", "kmer").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).selectExpr("gi", "kmer as feature")


def shared(edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Edges of features that enough examples have."""
    often = edges.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("feature")
    return edges.join(often, "feature")
