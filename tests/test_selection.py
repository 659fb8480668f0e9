"""Selection by folds and by bound beside a naive twin; models as objects and expressions; splits, labels and readers in full."""

import gzip
import math
import random

import pytest

from thicket.__main__ import main
from thicket.functions import kmers
from thicket.operators import cart, matrix, scm, splits
from thicket.sources import formats, ingest
from thicket.sources.dataset import Dataset
from thicket.streaming import predict_stream

from test_learning import naive, problem


def drawn(seed, n=60, classes=2, features=14):
    r = random.Random(seed)
    rows = {f"f{k:02d}": "".join(r.choice("001") for _ in range(n)) for k in range(features)}
    rows = {f: b for f, b in rows.items() if "1" in b}
    return rows, [i % classes for i in range(classes)] + [r.randrange(classes) for _ in range(n - classes)]


def said(bits, rules, type, i):
    got = [(bits[f][i] == "1") != off for f, off in rules]
    return int(all(got) if type == "conjunction" else any(got))


@pytest.mark.parametrize("seed", range(3))
def test_bound_selection(spark, seed):
    rows, labels = drawn(seed)
    p = problem(spark, rows, labels)
    train, size = [i for i in range(60) if i % 4], len(rows)
    tried = []
    for type in ("conjunction", "disjunction"):
        for cost in (0.5, 1.0, 10.0):
            rules = naive({f: "".join(b[i] for i in train) for f, b in rows.items()}, [labels[i] for i in train], type, cost, 4)
            options = []
            for k in range(len(rules) + 1):
                cols, left, z = [rows[f] for f, _ in rules[:k]], None, []
                left = [c for c in cols if any(c[i] == "1" for i in train)]
                while left:
                    best = max(train, key=lambda i: (sum(c[i] == "1" for c in left), -i))  # noqa: B023
                    z.append(best)
                    left = [c for c in left if c[best] != "1"]
                r = sum(said(rows, rules[:k], type, i) != labels[i] for i in train if i not in z)
                m, h, zn = len(train), k, len(z)
                if h == 0:
                    b = math.log(math.comb(m, zn)) + math.log(math.comb(m - zn, r))
                else:
                    b = (h * math.log(2 * zn * size) if zn else 0) + math.log(math.pi**6 * (h + 1) ** 2 * (r + 1) ** 2 * (zn + 1) ** 2 / (216 * 0.05))
                options.append((1 - math.exp(-b / (m - zn - r)), k))
            score, k = min(options)
            tried.append((score, k, abs(1 - cost), len(tried), type, cost, rules[:k]))
    want = min(tried)
    model, how = scm.learn_scm(p, train, costs=(0.5, 1.0, 10.0), max_rules=4, selection="bound")
    assert (how["type"], how["p"], how["max_rules"]) == (want[4], want[5], want[1]) and how["score"] == pytest.approx(want[0])
    assert [(r.feature, r.kind != "presence") for r in model] == want[6]


class Twin:
    """A tree grown, pruned and asked the long way."""

    def __init__(self, rows, labels, train, classes, depth, split, weights):
        self.rows, self.labels, self.classes, self.depth, self.split = rows, labels, classes, depth, split
        n = [sum(labels[i] == c for i in train) for c in range(classes)]
        share = [(weights or [1] * classes)[c] * n[c] / len(train) for c in range(classes)]
        self.per = [share[c] / sum(share) / n[c] if n[c] else 0 for c in range(classes)]
        self.train = train
        self.root = self.grow(train, 0)

    def joint(self, own):
        return [self.per[c] * sum(self.labels[i] == c for i in own) for c in range(self.classes)]

    def weighed(self, own):
        j = self.joint(own)
        return sum(j) - sum(x * x for x in j) / sum(j) if sum(j) else 0

    def grow(self, own, depth):
        if depth < self.depth and len(own) >= self.split and len({self.labels[i] for i in own}) > 1:
            found = []
            for f, b in sorted(self.rows.items()):
                l, r = [i for i in own if b[i] == "1"], [i for i in own if b[i] != "1"]
                if l and r:
                    found.append((round(self.weighed(l) + self.weighed(r), 12), -sum(b[i] == "1" for i in self.train), f, l, r))
            if found:
                _, _, f, l, r = min(found, key=lambda x: x[:3])
                return [own, f, self.grow(l, depth + 1), self.grow(r, depth + 1)]
        return [own]

    def risk(self, x):
        j = self.joint(x[0])
        return sum(j) - max(j)

    def leaves(self, x):
        return [x] if len(x) == 1 else self.leaves(x[2]) + self.leaves(x[3])

    def inner(self, x):
        return [] if len(x) == 1 else [x] + self.inner(x[2]) + self.inner(x[3])

    def close(self, a, b):
        return abs(a - b) <= max(1e-5 * max(abs(a), abs(b)), 1e-8)

    def cut(self, x, gone):
        if len(x) == 1 or any(x is g for g in gone):
            return [x[0]]
        return [x[0], x[1], self.cut(x[2], gone), self.cut(x[3], gone)]

    def sequence(self):
        tree = self.root
        while gone := [x for x in self.inner(tree) if len(x[2]) == len(x[3]) == 1 and self.close(self.risk(x), self.risk(x[2]) + self.risk(x[3]))]:
            tree = self.cut(tree, gone)
        out = {0.0: tree}
        while len(tree) > 1:
            g = [(x, (self.risk(x) - sum(map(self.risk, self.leaves(x)))) / (len(self.leaves(x)) - 1)) for x in self.inner(tree)]
            least = min(v for _, v in g)
            tree = self.cut(tree, [x for x, v in g if self.close(v, least)])
            out[least] = tree
        return sorted(out.items(), key=lambda x: x[0])

    def ask(self, x, i):
        while len(x) > 1:
            x = x[2] if self.rows[x[1]][i] == "1" else x[3]
        j = self.joint(x[0])
        return j.index(max(j))

    def shape(self, x):
        return None if len(x) == 1 else (x[1], self.shape(x[2]), self.shape(x[3]))


def shape(x):
    return None if x.leaf else (x.feature, shape(x.left), shape(x.right))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("selection", ["cv", "bound"])
def test_tree_selection(spark, seed, selection):
    classes = 2 + seed % 2
    rows, labels = drawn(seed + 20, 70, classes, 9)
    p = problem(spark, rows, labels)
    train, _, folds = splits.by_proportion(70, 0.8, seed, 3)
    weights, tried = (None, [1.0, 3.0, 2.0][:classes]), []
    for depth in (2, 6):
        for split in (2, 9):
            for w in weights:
                master, scores = Twin(rows, labels, train, classes, depth, split, w), []
                seq = master.sequence()
                if selection == "cv":
                    parts = []
                    for f in range(3):
                        inside, outside = ([i for i, g in zip(train, folds, strict=True) if (g != f) == side] for side in (True, False))
                        twin = Twin(rows, labels, inside, classes, depth, split, w)
                        parts.append([(a, sum(twin.ask(t, i) != labels[i] for i in outside) / len(outside)) for a, t in twin.sequence()])
                    for k, (a, _) in enumerate(seq):
                        mid = math.sqrt(a * seq[k + 1][0]) if k + 1 < len(seq) else math.inf
                        scores.append(sum([r for x, r in s if x <= mid][-1] for s in parts) / 3)
                else:
                    for _, t in seq:
                        cols, z = [rows[f] for f in sorted({x[1] for x in master.inner(t)})], []
                        while cols:
                            best = max(train, key=lambda i: (sum(c[i] == "1" for c in cols), -i))  # noqa: B023
                            z.append(best)
                            cols = [c for c in cols if c[best] != "1"]
                        r, n, m, zn = sum(master.ask(t, i) != labels[i] for i in train if i not in z), len(master.inner(t)), len(train), len(z)
                        b = math.log(math.comb(m, zn)) + math.log(math.comb(m - zn, r)) + (n * math.log(zn * len(rows)) if n else 0) + (n + 1) * math.log(classes) + math.log(math.comb(2 * n + 1, n))
                        scores.append(1 - math.exp(-(b + math.log(math.pi**6 * (n + 1) ** 2 * (r + 1) ** 2 * (zn + 1) ** 2 / (216 * 0.05))) / (m - zn - r)))
                k = max(range(len(seq)), key=lambda k: (-scores[k], k))
                mean = sum(w or [1]) / len(w or [1])
                tried.append((scores[k], 2 * len(master.inner(seq[k][1])) + 1, sum((x - mean) ** 2 for x in w or []) / len(w or [1]), len(tried), master.shape(seq[k][1])))
    best = tried[0]
    for x in tried[1:]:
        if x[0] < best[0] or (abs(x[0] - best[0]) <= 1e-8 + 1e-5 * abs(best[0]) and x[1:4] < best[1:4]):
            best = x
    root, _, how = cart.learn_tree(p, train, folds, depths=(2, 6), min_splits=(2, 9), weights=weights, selection=selection)
    assert how["score"] == pytest.approx(best[0]) and shape(root) == best[4]


def test_close_scores_are_ties():
    assert scm.least([(0.4, 3, 0, 0), (0.4 + 1e-12, 2, 0, 1)], True) == (0.4 + 1e-12, 2, 0, 1)
    assert scm.least([(0.4, 3, 0, 0), (0.4 + 1e-12, 2, 0, 1)], False) == (0.4, 3, 0, 0)
    assert scm.least([(0.4, 2, 0, 0), (0.4 - 1e-12, 3, 0, 1)], True) == (0.4, 2, 0, 0)
    assert scm.least([(0.4, 2, 0, 0), (0.4 - 1e-12, 3, 0, 1)], True, True) == (0.4 - 1e-12, 3, 0, 1)


def test_jobs_do_not_grow_with_the_grid(spark):
    rows, labels = drawn(5)
    p = problem(spark, rows, labels)
    p.patterns.count()
    train, _, folds = splits.by_proportion(60, 0.8, 1, 3)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for costs in ((1.0,), scm.P_GRID):
        spark.sparkContext.setJobGroup(f"grid{len(costs)}", "")
        scm.learn_scm(p, train, folds, ("conjunction",), costs, 2)
        counts.append(len(tracker.getJobIdsForGroup(f"grid{len(costs)}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 6


def test_expressions_and_objects(spark):
    odd = ["it's", 'a"b\\c', "x') or true --"]
    rows = dict(zip(odd, ("000111", "110000", "101010"), strict=True))
    p = problem(spark, rows, [0, 0, 0, 1, 1, 1])
    learner = scm.SetCoveringMachine("disjunction", 1.0, 3)
    with pytest.raises(RuntimeError):
        learner.predict(p)
    tree = cart.DecisionTree(max_depth=3)
    with pytest.raises(RuntimeError):
        tree.predict_proba(p)
    model = learner.fit(p).model
    assert learner.predict(p) == [0, 0, 0, 1, 1, 1] and learner.predict_proba(p)[0] == (1.0, 0.0)
    got = sorted(tuple(r) for r in p.having(model.features()).select("gi", model.expression(), model.probabilities()).collect())
    assert [r[1] for r in got] == learner.predict(p) and [tuple(r[2]) for r in got] == learner.predict_proba(p)
    assert scm.Model("conjunction").predict({}, 2) == [1, 1] and scm.Model("disjunction").predict({}, 2) == [0, 0]
    both = scm.Model("conjunction", [scm.Rule(odd[0], "presence"), scm.Rule(odd[1], "absence")])
    both.add(scm.Rule(odd[2], "presence"))
    both.remove(2)
    assert len(both) == 2 and [r.feature for r in both] == odd[:2]
    tree.fit(p)
    root, priors = tree.tree
    have = p.having(cart.tree_features(root))
    assert {r.gi: r.c for r in have.select("gi", cart.expression(root, priors).alias("c")).collect()} == dict(enumerate(tree.predict(p)))
    assert {r.gi: r.c for r in have.select("gi", cart.probabilities(root, priors).alias("c")).collect()} == dict(enumerate(tree.predict_proba(p)))
    assert {r.gi: r.prediction for r in predict_stream(have, cart.case_sql(root, priors)).collect()} == dict(enumerate(tree.predict(p)))
    assert tree.predict(p, ["a", "b"])[0] == "a" and tree.depth == 1 and len(tree) == 1 and tree.rule_importances == {"it's": 1.0}
    told = []
    cart.grow(p, on_split=lambda x: told.append(x.feature), on_level=lambda depth, nodes: told.append((depth, len(nodes))))
    assert told == ["it's", (1, 2)]
    seen = []
    last = lambda ties, conjunction: ties.orderBy(matrix.F.desc("feature")).select("feature", "kind", "words", "risk").first()
    scm.fit(p, "conjunction", 1.0, tiebreaker=lambda ties, c: seen.append(ties.count()) or last(ties, c))
    assert seen


def test_progress(spark):
    rows, labels = drawn(4)
    p = problem(spark, rows, labels)
    train, _, folds = splits.by_proportion(60, 0.8, 1, 2)
    for learn, options in ((scm.learn_scm, {"costs": (1.0,), "max_rules": 3}), (cart.learn_tree, {"depths": (2, 4)})):
        told = []
        learn(p, train, folds, progress=told.append, **options)
        assert told == sorted(told) and told[-1] == 1.0 and len(told) > 2


def test_models_on_a_stream(spark, tmp_path):
    rows, labels = drawn(6)
    p = problem(spark, rows, labels)
    model, (root, priors) = scm.fit(p, "conjunction", 1.0, 3), cart.grow(p, max_depth=3)
    have = p.having(sorted(rows))
    have.select("gi", "have").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("gi int, have array<string>").parquet(f"{tmp_path}/in")
    for name, made in (("rules", model.expression()), ("tree", cart.expression(root, priors)), ("text", cart.case_sql(root, priors))):
        predict_stream(stream, made).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination(120)
        want = have.select("gi", (matrix.F.expr(made) if isinstance(made, str) else made).alias("c")).collect()
        assert {r.gi: r.prediction for r in spark.table(name).collect()} == {r.gi: r.c for r in want}
        spark.catalog.dropTempView(name)


def test_labels_without_data_count(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("kmers\tg1\tg2\nAA\t1\t0\nAC\t1\t1\n")
    (tmp_path / "l.txt").write_text("g1 c\ng2 a\nlost b\n")
    d = ingest.from_tsv(spark, f"{tmp_path}/ds", str(tmp_path / "m.tsv"), str(tmp_path / "l.txt"))
    assert d.tags() == ["a", "b", "c"] and d.labels() == [0, 2] and d.classification_type == "multiclass" and d.kmer_length == 2
    (tmp_path / "one.txt").write_text("g1 a\ng2 a\n")
    with pytest.raises(ValueError):
        ingest.from_tsv(spark, f"{tmp_path}/no", str(tmp_path / "m.tsv"), str(tmp_path / "one.txt"))


def test_stored_splits(spark, tmp_path, capsys):
    rows, labels = drawn(2, 20, 2, 6)
    names = [f"g{i:02d}" for i in range(20)]
    order = sorted(range(20), key=lambda i: (labels[i], names[i]))
    (tmp_path / "m.tsv").write_text("kmers\t" + "\t".join(names) + "\n" + "".join(f"{k * 'A'}{f[1:]}\t" + "\t".join(b) + "\n" for k, (f, b) in enumerate(rows.items())))
    (tmp_path / "l.txt").write_text("".join(f"{n} {'xy'[y]}\n" for n, y in zip(names, labels, strict=True)))
    d = ingest.from_tsv(spark, f"{tmp_path}/ds", str(tmp_path / "m.tsv"), str(tmp_path / "l.txt"))
    main(["dataset", "split", "--dataset", d.path, "--id", "it's", "--train-size", "0.7", "--folds", "3", "--random-seed", "9"], spark)
    train, test, folds = d.split("it's")
    s = d.split_stats("it's")
    assert (s["random_seed"], s["n_folds"], s["n_train"], s["n_test"], s["train_proportion"]) == (9, 3, 14, 6, 0.7) and d.splits() == ["it's"]
    bits = {f"{k * 'A'}{f[1:]}": "".join(b[i] for i in order) for k, (f, b) in enumerate(rows.items())}
    y, got = sorted(labels), {}
    for r in d.rule_risks("it's").collect():
        got.setdefault(r.fold, []).append(r)
    assert set(got) == {None, 0, 1, 2}
    for fold, own in got.items():
        inside = [i for i, g in zip(train, folds, strict=True) if g != fold]
        risk = {f: round(sum((b[i] == "1") != y[i] for i in inside) / len(inside), 5) for f, b in bits.items()}
        assert {r.feature: r.risk for r in own} == pytest.approx(risk) and all(r.anti_risk == pytest.approx(1 - r.risk) for r in own)
        line = sorted({x for r in own for x in (r.risk, r.anti_risk)})
        assert all((line.index(r.risk), line.index(r.anti_risk)) == (r.rank, r.anti_rank) for r in own)
    main(["dataset", "info", "--dataset", d.path, "--splits", "--genome-count", "--classification-type", "--phenotype-tags"], spark)
    out = capsys.readouterr().out
    assert "random seed 9" in out and "examples: 20" in out and "classification type: binary" in out and "x, y" in out and ">k1" not in out
    with pytest.raises(SystemExit):
        main(["--version"], spark)
    assert "thicket 0" in capsys.readouterr().out
    ids = tmp_path / "ids.txt"
    ids.write_text("g00\nnobody\n")
    with pytest.raises(ValueError, match="nobody"):
        main(["dataset", "split", "--dataset", d.path, "--id", "t", "--train-ids", str(ids), "--test-ids", str(ids)], spark)


def test_long_contigs_and_reads_in_parts(spark, tmp_path):
    r = random.Random(3)
    long = "".join(r.choice("ACGT") for _ in range(30_000)) + "NN" + "ACGTA" * 3
    seqs = spark.createDataFrame([("a", long), ("b", "ACG"), ("c", "")], "gi string, seq string")
    want = sorted(long[i : i + 7] for i in range(len(long) - 6) if "N" not in long[i : i + 7])
    for size in (100, 7, 1, 50_000):
        cut = kmers.pieces(seqs, 7, size)
        got = sorted(x.kmer for x in cut.select("gi", matrix.F.explode(matrix.F.expr("regexp_extract_all(seq, '(?=([ACGT]{7}))', 1)")).alias("kmer")).collect())
        assert got == want
    (tmp_path / "big.fasta").write_text("".join(f">c{i} note\r\n{long[i * 60 : i * 60 + 40]}\r\n{long[i * 60 + 40 : i * 60 + 60].lower()}\r\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = formats.fasta(spark, str(tmp_path / "big.fasta"))
        assert df.rdd.getNumPartitions() > 3 and sorted((x.name, x.seq) for x in df.collect()) == sorted((f"c{i} note", long[i * 60 : i * 60 + 60]) for i in range(500))
        quals = ["@III", "IIII", "+III", "@@@@", "I@+@"]
        text = "".join(f"@r{i}\n{long[i : i + 4]}\n+{'r' if i % 3 else ''}\n{quals[i % 5]}\n" for i in range(2000))
        (tmp_path / "big.fastq").write_text(text)
        with gzip.open(tmp_path / "big.fastq.gz", "wt") as f:
            f.write(text)
        want = sorted(long[i : i + 4] for i in range(2000))
        df = formats.fastq(spark, str(tmp_path / "big.fastq"))
        assert df.rdd.getNumPartitions() > 3 and sorted(x.seq for x in df.collect()) == want
        assert sorted(x.seq for x in formats.fastq(spark, str(tmp_path / "big.fastq.gz")).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbered_kmers(spark):
    r = random.Random(1)
    own = sorted({"".join(r.choice("ACGT") for _ in range(r.choice([3, 9, 12]))) for _ in range(3000)} | {"A" * 12, "AAAAAAAAAC"})
    got = kmers.numbered(spark.createDataFrame([(x,) for x in own], "feature string").repartition(7)).collect()
    assert sorted((x.kmer_id, x.feature) for x in got) == list(enumerate(own))


def test_steps(spark):
    steps = [(0.0, 1.0), (0.5, 2.0), (2.0, 3.0)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.49, 0.5, 1.9, 2.0, 9.0)], "a double")
    got = {r.a: r.v for r in cart.looked_up(df, "a", steps, "v").collect()}
    assert got == {a: cart.step_value(steps, a) for a in (0.0, 0.49, 0.5, 1.9, 2.0, 9.0)}


def test_views_leave_the_session_alone(spark, tmp_path):
    spark.createDataFrame([(7,)], "x int").createOrReplaceTempView("events")
    spark.createDataFrame([(1, 1, "a", 2.0)], "event_id long, user_id long, event_type string, value double").selectExpr("*", "current_timestamp() as ts", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    from thicket.sources.views import ordered

    assert ordered(spark, str(tmp_path), "user").count() == 1 and spark.table("events").columns == ["x"]
    spark.catalog.dropTempView("events")


def test_dataset_without_labels(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("kmers\tg1\tg2\nAA\t1\t0\n")
    d = ingest.from_tsv(spark, f"{tmp_path}/ds", str(tmp_path / "m.tsv"))
    assert d.classification_type == "none" and d.splits() == [] and isinstance(d, Dataset)
