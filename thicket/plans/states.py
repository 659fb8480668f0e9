"""Queries on what learners hold (masks, partitions, columns, probabilities) and on what datasets store; each with its SQL."""

from __future__ import annotations

from statistics import pvariance

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import cart, matrix, scm, splits
from ..sources.dataset import Dataset
from ..sources.views import duck, load, scratch
from .basics import WORD, query
from .learning import SIDE, cart_sql, fitted, grown, holds, scm_sql

DOC, CUST, USER = duck("doc"), duck("cust"), duck("user")


@query(DOC + f" SELECT (gi // 64)::INT AS word, {WORD} AS bits FROM ex WHERE label = 1 GROUP BY 1")
def mask_words(spark, d):
    """The mask of a class, as learners send it."""
    p = matrix.of_view(spark, d, "doc")
    return spark.createDataFrame([(i, w) for i, w in enumerate(p.mask(p.rows(1))) if w], "word int, bits long")


@query(CUST + " SELECT label, gi FROM ex")
def class_partition(spark, d):
    p = matrix.of_view(spark, d, "cust")
    return spark.createDataFrame([(c, i) for c in range(5) for i in p.rows(c)], "label int, gi int")


@query(scm_sql(USER, 2) + " SELECT f AS feature, gi FROM e WHERE f IN (SELECT f FROM b1 UNION SELECT f FROM b2)")
def model_columns(spark, d):
    """Of all features, only a model's own leave the executors."""
    p, model = fitted(spark, d, "conjunction", 2, view="user")
    cols = scm.columns(p, model.features())
    return spark.createDataFrame([(f, i) for f, x in cols.items() for i in range(p.n) if x >> (p.n - 1 - i) & 1], "feature string, gi int")


@query(scm_sql(USER, 2) + f" SELECT gi, label, ({holds(1)})::INT AS first, ({holds(2)})::INT AS second, (({holds(1)}) AND ({holds(2)}))::INT AS both FROM ex")
def rules_on_examples(spark, d):
    """What each rule of a model and all of them say of every example."""
    p, model = fitted(spark, d, "conjunction", 2, view="user")
    one = lambda k: scm.Model("conjunction", [model.rules[k]]).expression()
    return p.having(model.features()).select("gi", "label", one(0).alias("first"), one(1).alias("second"), model.expression().alias("both"))


@query(scm_sql(USER, 1, 1.0, True, "gi % 5 <> 0") + f""", pr AS (SELECT label, 1 AS p0, ({holds(1)})::INT AS p1 FROM ex WHERE gi % 5 = 0), r AS (SELECT avg((p0 <> label)::INT)::DOUBLE AS r0, avg((p1 <> label)::INT)::DOUBLE AS r1 FROM pr)
SELECT i::INT AS length, CASE WHEN i = 0 THEN r0 ELSE r1 END AS risk FROM r, range(5) t(i)""")
def cv_padded_lengths(spark, d):
    """A model of one rule scored at up to four: the last risk stands for the lengths that were not reached."""
    p, model = fitted(spark, d, "conjunction", 1, view="user", train=lambda i: i % 5)
    return spark.createDataFrame(list(enumerate(scm.prefix_risks(p, model, [i for i in range(p.n) if i % 5 == 0], 4))), "length int, risk double")


@query(cart_sql(1) + SIDE + ", al AS (SELECT DISTINCT label AS c FROM ex) SELECT s.gi, al.c::INT AS label, round(coalesce(sc.n, 0)::DOUBLE / sm.n, 9) AS p FROM s JOIN sm USING (has) CROSS JOIN al LEFT JOIN sc ON sc.has = s.has AND sc.label = al.c")
def tree_probabilities(spark, d):
    p, root, priors = grown(spark, d, 1)
    shares = p.having(cart.tree_features(root)).select("gi", F.posexplode(cart.probabilities(root, priors)).alias("label", "p"))
    return shares.select("gi", "label", F.round("p", 9).alias("p"))


@query(scm_sql(USER, 2) + f", pr AS (SELECT gi, (({holds(1)}) AND ({holds(2)}))::INT AS pred FROM ex) SELECT gi, 0::INT AS label, (1 - pred)::DOUBLE AS p FROM pr UNION ALL SELECT gi, 1, pred FROM pr")
def scm_probabilities(spark, d):
    p, model = fitted(spark, d, "conjunction", 2, view="user")
    return p.having(model.features()).select("gi", F.posexplode(model.probabilities()).alias("label", "p"))


@query("SELECT i::INT AS position, round(var_pop(w), 9) AS variance FROM (SELECT i, unnest([1::DOUBLE, i, i * i, 2]) AS w FROM range(6) t(i)) GROUP BY i")
def importance_variance(spark, d):
    """The variance of class importances, by which trees of one score and size are told apart."""
    return spark.createDataFrame([(i, round(pvariance([1.0, float(i), float(i * i), 2.0]), 9)) for i in range(6)], "position int, variance double")


@query(DOC + ", n AS (SELECT count(*) AS n FROM ex) SELECT 'train' AS role, ceil(0.7::DOUBLE * n)::BIGINT AS n FROM n UNION ALL SELECT 'test', n - ceil(0.7::DOUBLE * n)::BIGINT FROM n")
def split_proportion(spark, d):
    """Sizes follow from the proportion, whatever the seed deals."""
    n = load(spark, d, "doc")[0].count()
    return splits.table(spark, *splits.by_proportion(n, 0.7, 42, 5)).groupBy("role").agg(F.count("*").alias("n"))


@query(DOC + " SELECT gi, CASE WHEN example_id % 5 = 0 THEN 'test' ELSE 'train' END AS role, (row_number() OVER (PARTITION BY example_id % 5 = 0 ORDER BY gi) - 1)::INT AS place FROM ex")
def split_rows(spark, d):
    """Rows of an id split, sorted on each side."""
    known = {r.example_id: r.gi for r in load(spark, d, "doc")[0].collect()}
    train, test, _ = splits.by_ids(known, [x for x in known if x % 5], [x for x in known if x % 5 == 0], 7)
    return spark.createDataFrame([(i, role, k) for role, rows in (("train", train), ("test", test)) for k, i in enumerate(rows)], "gi int, role string, place int")


def user_dataset(spark, d) -> Dataset:
    """A view written to a dataset of its own and opened again."""
    examples, edges = load(spark, d, "user")
    return Dataset.create(f"{scratch(spark)}/dataset", examples, edges, source="user")


@query(USER + " SELECT f AS feature, e.gi, example_id::VARCHAR AS example_id, label FROM e JOIN ex USING (gi)")
def dataset_roundtrip(spark, d):
    own = user_dataset(spark, d)
    return bits.unpack(own.read("features")).join(own.read("examples"), "gi").selectExpr("feature", "gi", "cast(example_id as string) as example_id", "label")


@query(USER + """, part AS (SELECT NULL::INT AS fold, gi, label FROM ex WHERE gi % 4 <> 0 UNION ALL SELECT f.i::INT, gi, label FROM ex, range(3) f(i) WHERE gi % 4 <> 0 AND gi % 3 <> f.i),
t AS (SELECT fold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM part GROUP BY 1),
h AS (SELECT fold, f, count(*) FILTER (label = 1) AS hp, count(*) FILTER (label = 0) AS hn FROM e JOIN part USING (gi) GROUP BY 1, 2),
r AS (SELECT t.fold, fs.f, round_even((p - coalesce(hp, 0) + coalesce(hn, 0))::DOUBLE / (p + n), 5) AS risk FROM fs CROSS JOIN t LEFT JOIN h ON h.f = fs.f AND h.fold IS NOT DISTINCT FROM t.fold),
rr AS (SELECT *, round_even(1::DOUBLE - risk, 5) AS anti_risk FROM r),
k AS (SELECT fold, risk, (row_number() OVER (PARTITION BY fold ORDER BY risk) - 1)::INT AS rank FROM (SELECT fold, risk FROM rr UNION SELECT fold, anti_risk FROM rr))
SELECT rr.fold, f AS feature, rr.risk, anti_risk, a.rank, b.rank AS anti_rank FROM rr JOIN k a ON a.fold IS NOT DISTINCT FROM rr.fold AND a.risk = rr.risk JOIN k b ON b.fold IS NOT DISTINCT FROM rr.fold AND b.risk = anti_risk""")
def split_risks(spark, d):
    """A split stored with its folds, and each rule's risk and rank there."""
    own = user_dataset(spark, d)
    rows = range(len(own.labels()))
    train = [i for i in rows if i % 4]
    own.save_split("s", train, [i for i in rows if i % 4 == 0], [i % 3 for i in train], seed=1)
    return own.rule_risks("s").drop("split")


@query(USER + " SELECT 'examples' AS key, count(*)::VARCHAR AS value FROM ex UNION ALL SELECT 'features', count(*)::VARCHAR FROM fs UNION ALL SELECT 'classification_type', 'binary' UNION ALL SELECT 'kind', 'labelled' UNION ALL SELECT 'source', 'user' UNION ALL SELECT 'compression', 'zstd'")
def dataset_meta(spark, d):
    own = {k: v for k, v in user_dataset(spark, d).info().items() if k not in ("uuid", "created")}
    return spark.createDataFrame(sorted(own.items()), "key string, value string")
