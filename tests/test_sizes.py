"""What has to hold at sizes that small data do not show."""

import random
import time

import duckdb
import pytest

from thicket import registry
from thicket.operators import cart, matrix, scm


def problem(spark, rows, labels):
    examples = spark.createDataFrame([(i, str(i), y) for i, y in enumerate(labels)], "gi int, example_id string, label int")
    return matrix.problem(examples, spark.createDataFrame([(f, i) for f, own in rows.items() for i in own], "feature string, gi int"))


def test_columns_are_dealt_out(spark):
    """All examples, those of empty words too, and not in the one task that a limit ends in."""
    rows = {"a": [0, 63, 64, 129], "b": [1], "c": [200]}
    p = problem(spark, rows, [0, 1] * 100 + [1])
    got = matrix.get_columns(p, p.features.orderBy("feature").limit(2))
    assert sorted(map(tuple, got.collect())) == [(f, i, int(i in rows[f]), int(i not in rows[f])) for f in "ab" for i in range(201)]
    assert got.rdd.getNumPartitions() > 1


def greedy(cols, rows, n):
    out, left = [], [c for c in cols if any(c >> (n - 1 - i) & 1 for i in rows)]
    while left:
        out.append(max(rows, key=lambda i: sum(c >> (n - 1 - i) & 1 for c in left)))
        left = [c for c in left if not c >> (n - 1 - out[-1]) & 1]
    return out


@pytest.mark.parametrize("n", [1, 63, 70, 128])
def test_compression_set_is_the_greedy_cover(n):
    r = random.Random(n)
    cols = [r.getrandbits(n) & r.getrandbits(n) for _ in range(30)] + [0]
    rows = r.sample(range(n), -(-n * 2 // 3))
    assert scm.compression_set(cols, rows, n) == greedy(cols, rows, n)
    assert scm.compression_set(cols, [], n) == []


def test_compression_set_of_many_examples():
    """Forty seconds by a look at each example and feature; a fraction of one by columns."""
    r, n = random.Random(0), 60_000
    cols, began = [r.getrandbits(n) for _ in range(400)], time.time()
    got = scm.compression_set(cols, list(range(n)), n)
    assert time.time() - began < 10
    assert all(any(c >> (n - 1 - i) & 1 for i in got) for c in cols)


def test_bounds_of_pruned_trees_take_no_pass_over_the_examples(spark, monkeypatch):
    """The errors of a pruned tree are those of its leaves' rows; they and the score are what a pass finds."""
    r = random.Random(3)
    rows = {f"f{k}": [i for i in range(150) if r.random() < 0.4] for k in range(12)}
    p = problem(spark, rows, [r.randint(0, 2) for _ in range(150)])
    train = [i for i in range(150) if i % 3]
    passes, predict = [], cart.predict
    monkeypatch.setattr(cart, "predict", lambda *a: passes.append(1) or predict(*a))
    root, priors, how = cart.learn_tree(p, train, selection="bound", depths=(5,))
    assert not passes
    full, priors = cart.grow(p, train, max_depth=5)
    cols, bounds = scm.columns(p, [f"f{k}" for k in range(12)]), []
    for _, t in cart.prune_sequence(full, priors):
        z = greedy([cols[f] for f in cart.tree_features(t)], train, p.n)
        wrong = {i for i in train if priors.predicted(cart.leaf_of(t, cols, p.n, i)) != p.labels[i]} - set(z)
        bounds.append(cart.tree_bound(len(train), len(z), len(wrong), sum(not x.leaf for x in t.walk()), 12, 3))
        assert cart.predict(t, priors, cols, p.n, train) == {i: priors.predicted(cart.leaf_of(t, cols, p.n, i)) for i in train}
    assert len(bounds) > 2 and how["score"] == min(bounds)


def beside_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL over small tables, given as their SQL."""
    c = duckdb.connect()
    for t, text in tables.items():
        c.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in want.description]
    return sorted(map(tuple, registry.queries()[name](spark, str(folder)).select(cols).collect()), key=str), sorted(want.fetchall(), key=str)


ODD = {
    "no words": ["a b", "b a", "12 34"],
    "no text": ["a b", "b a", None],
    "words of its own": ["a b", "b a", "c d"],
    "no feature": ["a", "b"],
    "a dotted capital": ["İstanbul", "istanbul", "stanbul i"],
}


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("twice", [False, True])
def test_info_counts_what_sql_counts(spark, tmp_path, odd, twice):
    """Examples are those with a feature; an id that is labelled twice is two examples, but counts once for how often a feature is."""
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, {'NULL' if x is None else repr(x)}::VARCHAR AS text" for i, x in enumerate(ODD[odd]))
    labels = f"SELECT doc_id, (doc_id % 2)::INT AS quality FROM ({rows})" + (" UNION ALL SELECT 0, 0 UNION ALL SELECT 2, 1" if twice else "")
    got, want = beside_sql(spark, tmp_path, "dataset_info", documents=rows, labels=labels)
    assert got == want


def events(rows):
    """user, value, hour and type of a few events."""
    say = lambda x: "NULL" if x is None else repr(x)
    return " UNION ALL ".join(f"SELECT {k}::BIGINT AS event_id, TIMESTAMP '2024-01-01 0{h}:00:00' AS ts, {say(u)}::BIGINT AS user_id, {say(t)}::VARCHAR AS event_type, {say(v)}::DOUBLE AS value" for k, (u, v, h, t) in enumerate(rows))


FEW = [(u, 9.0 if u < 4 else 1.0, h, t) for u in range(8) for h, t in [(1, "a" if u < 4 else "b"), (2, "c")]]


@pytest.mark.parametrize("rows", [FEW, FEW[:-1], [*FEW, (None, 1.0, 2, "c"), (2, 8.0, 3, None), (5, 1.0, 3, None)], [*FEW, (9, None, 1, "a"), (8, None, 2, "b"), (7, 1.0, 1, "a")]], ids=["one rule", "a rare absence", "null users and types", "null values"])
def test_predictions_of_fewer_rules_are_those_of_sql(spark, tmp_path, rows):
    """The first rule tells all examples apart, so there is no second: what it does not settle is null."""
    got, want = beside_sql(spark, tmp_path, "predict_disj", events=events(rows))
    assert got == want


def test_one_rule_leaves_unknown_classes(spark, tmp_path):
    got, _ = beside_sql(spark, tmp_path, "predict_disj", events=events(FEW))
    assert [x[2] for x in got] == [None] * 4 + [1] * 4


@pytest.mark.parametrize("name", ["predict_conj", "classified_correct", "classified_errors"])
def test_conjunctions_of_fewer_rules_are_those_of_sql(spark, tmp_path, name):
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, '{'good' if i % 2 else 'bad'} text' AS text" for i in range(6))
    got, want = beside_sql(spark, tmp_path, name, documents=rows, labels="SELECT i AS doc_id, (i % 2)::INT AS quality FROM range(6) t(i)")
    assert got == want
