"""Readers, k-mers, metrics, the stored dataset, streams."""

import gzip

import pytest

from thicket.functions import kmers, metrics
from thicket.operators import cart, matrix, reports, scm
from thicket.sources import formats
from thicket.sources.dataset import Dataset
from thicket.streaming import predict_stream


def test_kmers(spark):
    seqs = spark.createDataFrame([("A", "ACGTAC"), ("B", "ACGNAC"), ("C", "ACG"), ("C", "GTA")], "gi string, seq string")
    k = kmers.enumerate_kmers(seqs, 3)
    n = {r.feature: r.n for r in kmers.shared(kmers.presence(k)).groupBy("feature").agg({"gi": "count"}).toDF("feature", "n").collect()}
    assert n == {"ACG": 3, "GTA": 2}
    c = k.selectExpr("gi", f"{kmers.canonical('kmer')} as kmer")
    n = {r.feature: r.n for r in kmers.shared(kmers.presence(c)).groupBy("feature").agg({"gi": "count"}).toDF("feature", "n").collect()}
    assert n == {"ACG": 3, "TAC": 2}


def test_metrics(spark):
    m = metrics.binary(spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 0, 1, 1], strict=True)), "pred int, label int")).first()
    assert (m.risk, m.tp, m.fp, m.tn, m.fn, m.specificity) == (0.4, 2, 1, 1, 1, 0.5) and m.f1 == pytest.approx(2 / 3)
    m = metrics.binary(spark.createDataFrame([(0, 0)], "pred int, label int")).first()
    assert m.precision == m.recall == m.f1 == float("-inf") and m.specificity == 1


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("kmers\tg1\tg2\nAA\t1\t0\nAC\t1\t1\n")
    assert sorted(tuple(r) for r in formats.matrix_tsv(spark, str(tmp_path / "m.tsv")).collect()) == [("g1", "AA"), ("g1", "AC"), ("g2", "AC")]
    (tmp_path / "s.fasta").write_text(">one x\nacg\nT\n>two\nGG\n")
    assert [(r.name, r.seq) for r in formats.fasta(spark, str(tmp_path / "s.fasta")).collect()] == [("one x", "ACGT"), ("two", "GG")]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@a\nACG\n+\nIII\n@b\nTTT\n+\nIII\n")
    assert [r.seq for r in formats.fastq(spark, str(tmp_path / "r.fastq.gz")).collect()] == ["ACG", "TTT"]
    (tmp_path / "l.txt").write_text("g1 b\ng2 a\n\n")
    got = {r.example_id: r.label for r in formats.encode(formats.labels(spark, str(tmp_path / "l.txt"))).collect()}
    assert got == {"g1": 1, "g2": 0}
    (tmp_path / "i.txt").write_text("g1\n\n g2 \n")
    assert formats.ids(spark, str(tmp_path / "i.txt")) == ["g1", "g2"]
    (tmp_path / "b.txt").write_text("acg\nACG\n")
    assert [r.feature for r in formats.blacklist(spark, str(tmp_path / "b.txt"), 3).collect()] == ["ACG"]


def test_dataset_and_reports(spark, tmp_path):
    examples = spark.createDataFrame([(i, f"g{i}", int(i > 2)) for i in range(6)], "gi int, example_id string, label int")
    edges = spark.createDataFrame([("AAA", 3), ("AAA", 4), ("AAA", 5), ("AAC", 0), ("AAC", 1)], "feature string, gi int")
    d = Dataset.create(str(tmp_path / "ds"), examples, edges, source="test")
    assert d.info()["examples"] == "6" and d.info()["features"] == "2"
    d.save_split("s", [0, 3, 4], [1, 5], [0, 1, 0])
    assert d.split("s") == ([0, 3, 4], [1, 5], [0, 1, 0])
    model = scm.fit(d.problem(), "conjunction", 1.0)
    assert "Presence(AAA)" in reports.scm_text(model, {}, {}) and reports.fasta(model).startswith(">rule-1")
    root, priors = cart.grow(d.problem())
    assert "AAA?" in reports.tree_text(root, priors)
    have = spark.createDataFrame([(["AAA"],), (["AAC"],)], "have array<string>")
    assert [r.prediction for r in predict_stream(have, cart.case_sql(root, priors)).collect()] == [1, 0]


def test_partition_counts(spark):
    examples = spark.createDataFrame([(i, str(i), i % 2) for i in range(20)], "gi int, example_id string, label int")
    edges = spark.createDataFrame([(f"f{k}", i) for k in range(9) for i in range(20) if (i * 7 + k * 5) % (k + 2) < 2], "feature string, gi int")
    models = [str(scm.fit(matrix.problem(examples, edges.repartition(n)), "conjunction", 1.0, 3)) for n in (1, 8)]
    assert models[0] == models[1]
