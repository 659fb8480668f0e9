"""A stored dataset: a folder of Parquet tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Problem, of_features, problem, rule_risks


@dataclass
class Dataset:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, path: str, examples: DataFrame, edges: DataFrame, tags: DataFrame | None = None, compression: str = "zstd", **meta: str) -> Dataset:
        """examples(gi, example_id, label), edges(feature, gi)."""
        spark = examples.sparkSession
        p = problem(examples, edges)
        examples.write.parquet(f"{path}/examples", compression=compression)
        p.features.repartitionByRange("feature").sortWithinPartitions("feature").write.parquet(f"{path}/features", compression=compression)
        if tags is not None:
            tags.write.parquet(f"{path}/tags")
        if tags is not None:
            classes = tags.count()
        else:
            classes = examples.where("label is not null").select("label").distinct().count()
        kind = "binary" if classes == 2 else "multiclass" if classes > 2 else "none"
        own = {"uuid": uuid.uuid4().hex, "created": str(int(time.time())), "compression": compression, "kind": "labelled" if classes else "unlabelled", "classification_type": kind} | meta
        spark.createDataFrame(list(own.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/meta")
        p.close()
        return cls(spark, path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").collect()}

    def info(self) -> dict[str, str]:
        return self.meta() | {"examples": str(self.read("examples").count()), "features": str(self.read("features").count())}

    @property
    def classification_type(self) -> str:
        return self.meta()["classification_type"]

    @property
    def kmer_length(self) -> int | None:
        """Letters of a feature; all k-mers of a dataset have as many."""
        row = self.read("features").selectExpr("length(feature) as k").first()
        return row.k if row else None

    @property
    def kmer_filter(self) -> str:
        return self.meta().get("filter", "nothing")

    def labels(self) -> list[int | None]:
        return [r.label for r in self.read("examples").orderBy("gi").select("label").collect()]

    def problem(self) -> Problem:
        return of_features(self.labels(), self.read("features"))

    def examples(self) -> list[str]:
        """Ids in the order of gi; examples are the small side."""
        return [r.example_id for r in self.read("examples").orderBy("gi").collect()]

    def tags(self) -> list[str]:
        return [r.tag for r in self.read("tags").orderBy("label").collect()]

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def splits(self) -> list[str]:
        return sorted(r.split for r in self.read("split_stats").select("split").collect()) if self.has("split_stats") else []

    def save_split(self, name: str, train: list[int], test: list[int], folds: list[int], seed: int | None = None) -> None:
        """Rows and folds, what they were dealt by, and, for two classes, each rule's risk and its rank on the training rows of the split and of its folds."""
        rows = [(name, i, "train", f) for i, f in zip(train, folds, strict=True)] + [(name, i, "test", None) for i in test]
        self.spark.createDataFrame(rows, "split string, gi int, role string, fold int").coalesce(1).write.mode("append").partitionBy("split").parquet(f"{self.path}/splits")
        n, labels = len(train) + len(test), self.labels()
        if set(labels) <= {0, 1}:
            parts = {None: train} | {f: [i for i, g in zip(train, folds, strict=True) if g != f] for f in sorted(set(folds)) if len(set(folds)) > 1}
            sides = {f: ([i for i in own if labels[i] == 1], [i for i in own if labels[i] == 0]) for f, own in parts.items()}
            risks = rule_risks(self.read("features"), sides, len(labels)).select(F.lit(name).alias("split"), "*")
            risks.write.mode("append").partitionBy("split").parquet(f"{self.path}/rule_risks")
        stats = [(name, seed, len(train) / max(n, 1), len(test) / max(n, 1), len(set(folds)) if len(set(folds)) > 1 else 0, len(train), len(test))]
        self.spark.createDataFrame(stats, "split string, random_seed long, train_proportion double, test_proportion double, n_folds int, n_train int, n_test int").coalesce(1).write.mode("append").parquet(f"{self.path}/split_stats")

    def split_stats(self, name: str) -> dict:
        return self.read("split_stats").where(F.col("split") == name).first().asDict()

    def split_text(self, name: str) -> str:
        s = self.split_stats(name)
        folds = f", {s['n_folds']} folds" if s["n_folds"] else ""
        return f"{name}: {s['n_train']} train ({s['train_proportion']:.3f}), {s['n_test']} test ({s['test_proportion']:.3f}){folds}, random seed {s['random_seed']}"

    def rule_risks(self, name: str) -> DataFrame:
        return self.read("rule_risks").where(F.col("split") == name)

    def split(self, name: str) -> tuple[list[int], list[int], list[int]]:
        rows = sorted((r.gi, r.role, r.fold) for r in self.read("splits").where(F.col("split") == name).collect())
        return [i for i, r, _ in rows if r == "train"], [i for i, r, _ in rows if r == "test"], [f for _, r, f in rows if r == "train"]
