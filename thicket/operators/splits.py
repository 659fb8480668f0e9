"""Train, test and fold assignment; few examples, so the driver deals them out. What is looked up or counted is joined and grouped."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_proportion(n: int, train: float, seed: int, folds: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Train and test rows (sorted) and the fold of each train row; one legacy random stream, shuffled first for the split, then for the folds."""
    rng = np.random.RandomState(seed)
    order = np.arange(n)
    rng.shuffle(order)
    k = math.ceil(train * n)
    return with_folds(list(map(int, order[:k])), list(map(int, order[k:])), folds, rng)


def with_folds(train: list[int], test: list[int], folds: int, rng: np.random.RandomState) -> tuple[list[int], list[int], list[int]]:
    validate(train, test, folds)
    fold = np.arange(len(train)) % folds if folds else np.zeros(len(train), dtype=int)
    if folds:
        rng.shuffle(fold)
    pairs = sorted(zip(train, map(int, fold), strict=True))
    return [i for i, _ in pairs], sorted(test), [f for _, f in pairs]


def by_ids(known: dict[str, int], train: list[str], test: list[str], seed: int, folds: int = 0) -> tuple[list[int], list[int], list[int]]:
    missing = [x for x in [*train, *test] if x not in known]
    if missing:
        raise ValueError(f"not in the dataset: {', '.join(missing)}")
    return with_folds([known[x] for x in train], [known[x] for x in test], folds, np.random.RandomState(seed))


def validate(train: list[int], test: list[int], folds: int) -> None:
    if folds == 1 or folds < 0 or folds > len(train):
        raise ValueError("folds are 0, or from 2 to the number of train examples")
    if len(set(train)) < len(train) or len(set(test)) < len(test):
        raise ValueError("an example occurs twice")
    if set(train) & set(test):
        raise ValueError("train and test share examples")


def located(examples: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The examples (gi, example_id) that a list of ids names, and the ids that no example has."""
    own = ids.select("example_id").distinct()
    return examples.join(own, "example_id").select("gi", "example_id"), own.join(examples.select("example_id"), "example_id", "left_anti")


def table(spark: SparkSession, train: list[int], test: list[int], folds: list[int]) -> DataFrame:
    """gi, role, fold of a split."""
    rows = [(i, "train", f) for i, f in zip(train, folds, strict=True)] + [(i, "test", None) for i in test]
    return spark.createDataFrame(rows, "gi int, role string, fold int")


def summary(split: DataFrame, examples: DataFrame) -> DataFrame:
    """role, n, positives."""
    return split.join(examples.select("gi", "label"), "gi").groupBy("role").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


def overlap(train: DataFrame, test: DataFrame, key: str = "example_id") -> DataFrame:
    """n, own: all ids of both sides, and the different ones; the sides are disjoint and without repeats if these are equal."""
    return train.select(key).unionAll(test.select(key)).agg(F.count("*").alias("n"), F.countDistinct(key).alias("own"))
