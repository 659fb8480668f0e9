"""From files to reports, as a user would."""

import gzip
import json

import pytest

from thicket.__main__ import importance_grid, main
from thicket.operators import cart, matrix, reports, scm
from thicket.sources import ingest


def genomes(tmp_path, n=8):
    seqs = ["ACGGATTACA" if i % 2 else "ACGCCTTGCA" for i in range(n)]
    (tmp_path / "meta.txt").write_text("".join(f"g{i} {'res' if i % 2 else 'sus'}\n" for i in range(n)) + "other res\n")
    return seqs


def edges(d):
    x = d.read("features").join(d.read("examples").select("example_id", "gi"), matrix.has("words", matrix.F.col("gi")))
    return sorted((r.example_id, r.feature) for r in x.collect())


def canonical(s):
    code = str.maketrans("ACTG", "0123")
    return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")), key=lambda k: k.translate(code))


def test_contigs_reads_and_learners(spark, tmp_path):
    seqs, k = genomes(tmp_path), 5
    for i, s in enumerate(seqs):
        (tmp_path / f"g{i}.fasta").write_text(f">c1\n{s[:6].lower()}\n{s[6:]}\n")
        (tmp_path / f"r{i}").mkdir()
        with gzip.open(tmp_path / f"r{i}" / "a.fastq.gz", "wt") as f:
            f.write(f"@x\n{s}\n+\nI\n")
        (tmp_path / f"r{i}" / "b.fastq").write_text(f"@x\n{s[:7]}\n+\nI\n")
    (tmp_path / "contigs.tsv").write_text("".join(f"g{i}\t{tmp_path}/g{i}.fasta\n" for i in range(len(seqs))))
    (tmp_path / "reads.tsv").write_text("".join(f"g{i}\t{tmp_path}/r{i}\n" for i in range(len(seqs))))
    meta, own = str(tmp_path / "meta.txt"), f"{tmp_path}/ds"
    run = lambda *a: main(list(map(str, a)), spark)
    run("dataset", "create", "from-contigs", "--genomic-data", tmp_path / "contigs.tsv", "--phenotype-metadata", meta, "--kmer-size", k, "--output", own)
    want = sorted({(f"g{i}", canonical(s[j : j + k])) for i, s in enumerate(seqs) for j in range(len(s) - k + 1)})
    assert edges(ingest.Dataset(spark, own)) == want
    twice = ingest.from_reads(spark, f"{tmp_path}/ds2", str(tmp_path / "reads.tsv"), meta, k, 2)
    assert edges(twice) == sorted({(f"g{i}", canonical(s[j : j + k])) for i, s in enumerate(seqs) for j in range(3)})
    run("dataset", "split", "--dataset", own, "--id", "s", "--train-size", 0.75, "--folds", 2, "--random-seed", 1)
    with pytest.raises(ValueError):
        run("dataset", "split", "--dataset", own, "--id", "s")
    run("learn", "scm", "--dataset", own, "--split", "s", "--p", 1, "--max-rules", 2, "--hp-choice", "cv", "--output-dir", tmp_path / "scm")
    got = json.loads((tmp_path / "scm" / "results.json").read_text())
    assert got["metrics"]["test"]["risk"] == 0 and len(got["rules"]) == 1 and got["classifications"]["test"]["errors"] == []
    assert (tmp_path / "scm" / "model_rule_1_equiv.fasta").read_text().count(">") == got["rules"][0]["equivalent"] > 1
    run("learn", "tree", "--dataset", own, "--split", "s", "--max-depth", 2, "--class-importance", 1, "--output-dir", tmp_path / "tree")
    got = json.loads((tmp_path / "tree" / "results.json").read_text())
    assert got["metrics"]["train"]["confusion"][0][1] == 0 and got["classes"] == ["res", "sus"]
    assert "Model" in (tmp_path / "tree" / "report.txt").read_text()


def test_tsv_and_info(spark, tmp_path, capsys):
    (tmp_path / "m.tsv").write_text("kmers\tg1\tg2\tg0\nAA\t1\t0\t1\nAC\t1\t1\t0\nCC\t0\t0\t0\n")
    (tmp_path / "l.txt").write_text("g1 b\ng2 a\nlost b\n")
    main(["dataset", "create", "from-tsv", "--genomic-data", str(tmp_path / "m.tsv"), "--phenotype-metadata", str(tmp_path / "l.txt"), "--output", f"{tmp_path}/ds"], spark)
    d = ingest.Dataset(spark, f"{tmp_path}/ds")
    assert d.examples() == ["g2", "g1"] and d.tags() == ["a", "b"] and edges(d) == [("g1", "AA"), ("g1", "AC"), ("g2", "AC")]
    main(["dataset", "info", "--dataset", f"{tmp_path}/ds", "--all"], spark)
    said = capsys.readouterr().out
    assert "examples: 2" in said and ">k1\nAA\n>k2\nAC" in said
    bare = ingest.from_tsv(spark, f"{tmp_path}/bare", str(tmp_path / "m.tsv"))
    assert bare.examples() == ["g0", "g1", "g2"] and bare.info()["kind"] == "unlabelled"


def test_equivalents(spark):
    rows = {"a": "000111", "b": "000111", "c": "111000", "d": "010101"}
    examples = spark.createDataFrame([(i, str(i), int(i > 2)) for i in range(6)], "gi int, example_id string, label int")
    p = matrix.problem(examples, spark.createDataFrame([(f, i) for f, bits in rows.items() for i, b in enumerate(bits) if b == "1"], "feature string, gi int"))
    model = scm.fit(p, "conjunction", 1.0, most=10)
    assert [[str(r) for r in e] for e in model.equivalent] == [["Presence(a)", "Presence(b)", "Absence(c)"]]
    dual = scm.fit(p, "disjunction", 1.0, most=10)
    assert set(dual.equivalent[0]) == set(model.equivalent[0])
    assert len(scm.fit(p, "conjunction", 1.0, most=2, seed=5).equivalent[0]) == 2
    root, priors = cart.grow(p)
    assert cart.equivalents(p, root, priors, "gini", list(range(6))) == [["a", "b", "c"]]
    black = spark.createDataFrame([("a",), ("b",)], "feature string")
    root, priors, _ = cart.learn_tree(p, list(range(6)), selection="bound", blacklist=black)
    assert root.feature == "c" and cart.equivalents(p, root, priors, "gini", list(range(6)), blacklist=black) == [["c"]]


def test_grid_and_metrics():
    assert importance_grid(["1", "2"], ["a", "b"]) == [[1, 1], [1, 2], [2, 1], [2, 2]]
    assert importance_grid(["a:", "1", "b:", "2", "3"], ["a", "b"]) == [[1, 2], [1, 3]] and importance_grid(None, ["a"]) == [None]
    for wrong in (["a:", "1"], ["a:", "b:", "1"], ["a:", "1", "c:", "1"]):
        with pytest.raises(ValueError):
            importance_grid(wrong, ["a", "b"])
    m = reports.predicted_metrics({0: 0, 1: 1, 2: 1}, [0, 1, 0], [0, 1, 2], 2)
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 0) and m["f1"] == pytest.approx(2 / 3)
    assert reports.predicted_metrics({}, [], [], 2)["risk"] == float("-inf")
    assert reports.confusion_text([[10, 1], [0, 2]], ["a", "b"]) == "    a  b\na  10  1\nb   0  2\n"
