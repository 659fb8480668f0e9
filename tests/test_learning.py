"""Hand-checked fixtures of the learners, and a naive twin."""

import os
import random

import pytest

from thicket.functions.bits import mask, members
from thicket.operators import cart, matrix, scm, splits
from thicket.plans import learning

F1 = {"AAA": "000111", "AAC": "110000", "AAG": "001000", "AAT": "111111", "ACA": "000110"}


def problem(spark, rows, labels):
    examples = spark.createDataFrame([(i, str(i), y) for i, y in enumerate(labels)], "gi int, example_id string, label int")
    edges = spark.createDataFrame([(f, i) for f, bits in rows.items() for i, b in enumerate(bits) if b == "1"] or [("none", 0)], "feature string, gi int")
    return matrix.problem(examples, edges)


def test_masks():
    m = mask([0, 63, 64], 66)
    assert m[0] == -(2**63) + 1 and m[1] == -(2**63)
    assert members(enumerate(x % 2**64 for x in m)) == [0, 63, 64]


def test_one_rule_and_bounds(spark):
    p = problem(spark, F1, [0, 0, 0, 1, 1, 1])
    model = scm.fit(p, "conjunction", 1.0)
    assert str(model) == "Presence(AAA)" and model.importances == [1.0]
    assert scm.model_bound(p, model, list(range(6)), 5) == pytest.approx(0.852334, abs=1e-6)
    assert scm.model_bound(p, model, list(range(6)), 5, compat=False) == pytest.approx(0.896807, abs=1e-6)
    assert scm.model_bound(p, scm.Model("conjunction"), list(range(6)), 5) == pytest.approx(0.631597, abs=1e-6)
    r = {x.feature: (x.risk, x.anti_risk) for x in matrix.risks(p.features, p.mask([3, 4, 5]), p.mask([0, 1, 2]), 3, 3).collect()}
    assert r == {"AAA": (0.0, 1.0), "AAC": (0.83333, 0.16667), "AAG": (0.66667, 0.33333), "AAT": (0.5, 0.5), "ACA": (0.16667, 0.83333)}


def test_two_rules_and_duality(spark):
    black = spark.createDataFrame([("AAA",), ("ACA",)], "feature string")
    model = scm.fit(problem(spark, F1, [0, 0, 0, 1, 1, 1]), "conjunction", 1.0, blacklist=black)
    assert str(model) == "Absence(AAC) and Absence(AAG)" and model.importances == pytest.approx([2 / 3, 1 / 3])
    dual = scm.fit(problem(spark, F1, [1, 1, 1, 0, 0, 0]), "disjunction", 1.0, blacklist=black)
    assert str(dual) == "Presence(AAC) or Presence(AAG)"


def test_tree(spark):
    p = problem(spark, {"k1": "110000", "k2": "001100", "k3": "101010"}, [0, 0, 1, 1, 2, 2])
    root, priors = cart.grow(p)
    assert root.feature == "k1" and root.right.feature == "k2" and root.left.leaf
    assert cart.importances(root, priors, "gini") == pytest.approx({"k1": 0.5, "k2": 0.5})
    seq = cart.prune_sequence(root, priors)
    assert [len(t.walk()) for _, t in seq] == [5, 1] and seq[1][0] == pytest.approx(1 / 3)
    assert cart.tree_bound(6, 2, 0, 2, 3, 3) == pytest.approx(0.994446, abs=1e-6)


def test_uncoverable_features_end():
    assert scm.compression_set([0b100, 0], [0, 1], 3) == [0]


def test_splits():
    train, test, folds = splits.by_proportion(20, 0.55, 3, 3)
    assert len(train) == 11 and sorted(train + test) == list(range(20)) and sorted(map(folds.count, (0, 1, 2))) == [3, 4, 4]
    with pytest.raises(ValueError):
        splits.validate([1, 2], [2], 0)
    with pytest.raises(ValueError):
        splits.by_ids({"a": 0}, ["a"], ["b"], 1)


def naive(rows, labels, type, cost, steps):
    n = len(labels)
    pos, neg = [i for i in range(n) if labels[i]], [i for i in range(n) if not labels[i]]
    m, tp, tn = n, list(pos), list(neg)
    if type == "disjunction":
        pos, neg = neg, pos
    out = []
    while neg and len(out) < steps:
        scored = []
        for f, b in rows.items():
            for kind in ("presence", "absence"):
                ok = lambda i, b=b, k=kind: (b[i] == "1") == (k == "presence")
                risk = round((len(tp) - sum(b[i] == "1" for i in tp) + sum(b[i] == "1" for i in tn)) / m, 5)
                cover, err = sum(not ok(i) for i in neg), sum(not ok(i) for i in pos)
                scored.append((cover - cost * err, risk if kind == "presence" else round(1 - risk, 5), kind != "presence", f, cover, err, ok))
        top = max(s[0] for s in scored)
        ties = [s for s in scored if abs(s[0] - top) <= 1e-8 + 1e-5 * abs(top) and (s[4] or s[5])]
        if not ties:
            break
        b = min(ties, key=lambda s: (s[1] if type == "conjunction" else -s[1], s[2], s[3]))
        pos, neg = [i for i in pos if b[6](i)], [i for i in neg if b[6](i)]
        out.append((b[3], b[2] if type == "conjunction" else not b[2]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_naive_twin(spark, seed):
    r = random.Random(seed)
    n = r.choice([9, 30, 70])
    rows = {f"f{k:02d}": "".join(r.choice("01") for _ in range(n)) for k in range(12)}
    rows = {f: b for f, b in rows.items() if "1" in b}
    labels = [0, 1] + [r.randint(0, 1) for _ in range(n - 2)]
    p = problem(spark, rows, labels)
    for type in ("conjunction", "disjunction"):
        got = [(x.feature, x.kind != "presence") for x in scm.fit(p, type, 1.0, 3).rules]
        assert got == naive(rows, labels, type, 1.0, 3)


@pytest.mark.parametrize("blacklist", [None, [("f01",), ("f07",)]])
def test_searches_in_common_scans(spark, blacklist):
    r = random.Random(8)
    rows = {f"f{k:02d}": "".join(r.choice("001") for _ in range(70)) for k in range(15)}
    p = problem(spark, rows, [r.randint(0, 1) for _ in range(70)])
    black = None if blacklist is None else spark.createDataFrame(blacklist, "feature string")
    jobs = [(t, c, [i for i in range(70) if i % 3 != f]) for t in ("conjunction", "disjunction") for c in (0.1, 1.0, 999999.0) for f in (0, 1)]
    models, _ = scm.fit_all(p, jobs, 10, black)
    assert models == [scm.fit(p, *job[:2], 10, job[2], black) for job in jobs]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_selection_searches_the_whole_grid(spark, monkeypatch):
    """The registered queries choose as a naive search of all costs, 10 rules and depth 10 does."""
    d = "/root/testdata/sf0.01"
    p, train, _, folds = learning.learnt(spark, d)
    bits = {f: f"{x:0{p.n}b}" for f, x in scm.columns(p, [r.feature for r in p.features.select("feature").collect()]).items()}
    tried = []
    for t in ("conjunction", "disjunction"):
        for c in (0.1, 0.316, 0.562, 1.0, 1.778, 3.162, 10.0, 999999.0):
            means = [0.0] * 11
            for f in range(3):
                inside, outside = ([i for i, g in zip(train, folds, strict=True) if (g == f) == side] for side in (False, True))
                rules = naive({k: "".join(b[i] for i in inside) for k, b in bits.items()}, [p.labels[i] for i in inside], t, c, 10)
                for k in range(11):
                    said = lambda i, k=k: (all if t == "conjunction" else any)((bits[f][i] == "1") != off for f, off in rules[:k])  # noqa: B023, E731
                    means[k] += sum(said(i) != p.labels[i] for i in outside) / len(outside) / 3
            tried.append((round(min(means), 12), [round(m, 12) for m in means].index(round(min(means), 12)), abs(1 - c), len(tried), t, c))
    got = learning.scm_cv_selection(spark, d).first()
    assert (got.type, got.p) == min(tried)[-2:] and got.score == pytest.approx(min(tried)[0])

    seen, learn_tree = [], cart.learn_tree
    monkeypatch.setattr(scm, "fit_all", lambda p, jobs, most, *a, f=scm.fit_all: seen.append((len(jobs), most)) or f(p, jobs, most, *a))
    monkeypatch.setattr(cart, "learn_tree", lambda *a, **b: seen.append((out := learn_tree(*a, **b))[2]["max_depth"]) or out)
    for query in (learning.scm_bound_selection, learning.cart_cv_selection, learning.cart_bound_selection):
        query(spark, d).collect()
    assert seen == [(16, 10), 10, 10]
