"""Bit-packed presence: example gi is bit 63 - gi % 64 of word gi // 64.

A feature's words are an array of (at, bits) in order of at, without empty words: a feature of few examples stays small however many there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask(rows: Iterable[int], n: int) -> list[int]:
    """Signed words, empty ones too, with the bits of rows set."""
    words = [0] * (-(-n // 64))
    for gi in rows:
        words[gi // 64] |= 1 << (63 - gi % 64)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def members(words: Iterable[tuple[int, int]]) -> list[int]:
    """The examples of a feature's words."""
    return [64 * at + b for at, w in words for b in range(64) if w >> (63 - b) & 1]


def counted(words: Column | str, of: Column) -> Column:
    """How many examples a feature shares with a mask, which may be a literal or a column."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["bits"].bitwiseAND(F.get(of, x["at"]))))


def literal(of: list[int]) -> Column:
    """A mask as a column."""
    return F.expr(f"array({', '.join(f'{w}L' for w in of)})")


def masked_count(words: Column | str, of: list[int]) -> Column:
    """How many examples of the mask have the feature."""
    return counted(words, literal(of)) if any(of) else F.lit(0).cast("long")


def has(words: Column | str, gi: Column) -> Column:
    return F.exists(words, lambda x: (x["at"] == F.floor(gi / 64)) & (F.getbit(x["bits"], (63 - gi % 64).cast("int")) == 1))


def pack(edges: DataFrame, least: int = 1, of: list[int] | None = None) -> DataFrame:
    """feature, words from feature, gi (edges may repeat), for features of at least so many examples (of a mask, if given): one combined shuffle by feature and word, one by feature."""
    part = edges.groupBy("feature", F.expr("cast(gi div 64 as int) as at")).agg(F.expr("bit_or(shiftleft(1L, cast(63 - gi % 64 as int))) as bits"))
    own = "bits" if of is None else F.col("bits").bitwiseAND(F.get(literal(of), F.col("at")))
    whole = part.groupBy("feature").agg(F.expr("array_sort(collect_list(struct(at, bits))) as words"), F.sum(F.bit_count(own)).alias("n"))
    return whole.where(F.col("n") >= least).select("feature", "words")


def unpack(packed: DataFrame) -> DataFrame:
    """feature, gi of every set bit."""
    df = packed.select("feature", F.explode("words").alias("w"))
    return df.selectExpr("feature", "w.at", "explode(filter(sequence(0, 63), b -> getbit(w.bits, 63 - b) = 1)) as b").selectExpr("feature", "cast(64 * at + b as int) as gi")
