"""Queries on ingest, counting, splits and metrics; each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import bits, kmers, metrics
from ..operators import cart, matrix, scm, splits
from ..sources import ingest
from ..sources.formats import encode, unpivot
from ..sources.views import duck, load, read, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


DOC = duck("doc")


@query(duck("emb") + " SELECT f AS feature, example_id::VARCHAR AS example_id FROM e JOIN ex USING (gi)")
def src_matrix_unpivot(spark, d):
    wide = read(spark, d, "embeddings").selectExpr("vec_id", *(f"cast(embedding[{i}] > 0 as int) as `d{i:02d}`" for i in range(64)))
    return unpivot(wide, "vec_id").selectExpr("example_id as feature", "cast(feature as string) as example_id")


SEQ = "upper(regexp_replace(lower(text), '[^acgt]', '', 'g'))"
KMER = f"WITH s AS (SELECT doc_id AS gi, {SEQ} AS s FROM documents), k AS (SELECT gi, substring(s, i, 9) AS kmer FROM (SELECT gi, s, unnest(range(1, length(s) - 7)) AS i FROM s))"


def sequences(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text")).selectExpr("doc_id as gi", "upper(regexp_replace(lower(text), '[^acgt]', '')) as seq")


@query(KMER + " SELECT gi, kmer, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def kmer_extract(spark, d):
    return kmers.enumerate_kmers(sequences(spark, d), 9).groupBy("gi", "kmer").agg(F.count("*").alias("n"))


@query(KMER + " SELECT gi, kmer AS feature FROM k GROUP BY ALL HAVING count(*) >= 2")
def kmer_abundance(spark, d):
    return kmers.presence(kmers.enumerate_kmers(sequences(spark, d), 9), 2)


@query(KMER + ", p AS (SELECT DISTINCT gi, kmer FROM k) SELECT kmer AS feature, count(*)::BIGINT AS n FROM p GROUP BY 1 HAVING count(*) >= 2")
def kmer_singleton_filter(spark, d):
    return kmers.shared(kmers.presence(kmers.enumerate_kmers(sequences(spark, d), 9))).groupBy("feature").agg(F.count("*").alias("n"))


@query(KMER + """, c AS (SELECT gi, translate(least(translate(kmer, 'ACTG', '0123'), translate(translate(reverse(kmer), 'ACGT', 'TGCA'), 'ACTG', '0123')), '0123', 'ACTG') AS kmer FROM k)
SELECT kmer, count(DISTINCT gi)::BIGINT AS n FROM c GROUP BY 1""")
def kmer_canonical(spark, d):
    return kmers.enumerate_kmers(sequences(spark, d), 9).selectExpr("gi", f"{kmers.canonical('kmer')} as kmer").distinct().groupBy("kmer").agg(F.count("*").alias("n"))


@query(KMER + " SELECT f AS feature, dense_rank() OVER (ORDER BY f)::BIGINT - 1 AS kmer_id, n FROM (SELECT kmer AS f, count(DISTINCT gi)::BIGINT AS n FROM k GROUP BY 1)")
def kmer_matrix(spark, d):
    own = kmers.presence(kmers.enumerate_kmers(sequences(spark, d), 9)).groupBy("feature").agg(F.count("*").alias("n"))
    return kmers.numbered(own).select("feature", "kmer_id", "n")


@query("SELECT c_custkey AS example_id, c_mktsegment AS tag, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label FROM customer")
def label_encode(spark, d):
    return encode(read(spark, d, "customer").selectExpr("c_custkey as example_id", "c_mktsegment as tag")).select("example_id", "tag", "label")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
def metadata_inner(spark, d):
    return ingest.matched(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def metadata_missing_anti(spark, d):
    return ingest.unmatched(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY quality, doc_id) - 1)::INT AS gi FROM labels JOIN documents USING (doc_id)")
def genome_order(spark, d):
    return load(spark, d, "doc")[0].selectExpr("example_id as doc_id", "gi")


@query(DOC + " SELECT count(DISTINCT gi)::BIGINT AS examples, count(DISTINCT f)::BIGINT AS features, count(*)::BIGINT AS edges FROM e")
def dataset_info(spark, d):
    return matrix.info(matrix.of_view(spark, d, "doc"))


@query(DOC + " SELECT label, count(*)::BIGINT AS n FROM ex GROUP BY 1")
def class_counts(spark, d):
    return load(spark, d, "doc")[0].groupBy("label").agg(F.count("*").alias("n"))


TOTAL = "(SELECT count(*) FROM ex WHERE gi % 5 <> 0)"


@query(DOC + f""", h AS (SELECT f, count(*) FILTER (gi % 5 <> 0)::BIGINT AS c FROM e GROUP BY 1)
SELECT f AS feature, 'presence' AS kind, c AS hits FROM h UNION ALL SELECT f, 'absence', {TOTAL} - c FROM h""")
def sum_rows(spark, d):
    p = matrix.of_view(spark, d, "doc")
    rows = [i for i in range(p.n) if i % 5]
    return matrix.sum_rows(p.features, p.mask(rows), len(rows))


WORD = "sum(CASE WHEN gi % 64 = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (63 - gi % 64)) END)::BIGINT"


@query(DOC + f" SELECT f AS feature, (gi // 64)::INT AS word, {WORD} AS bits FROM e GROUP BY 1, 2")
def pack_bits(spark, d):
    return matrix.of_view(spark, d, "doc").features.select("feature", F.explode("words").alias("w")).selectExpr("feature", "w.at as word", "w.bits")


@query(DOC + " SELECT f AS feature, gi FROM e")
def unpack_bits(spark, d):
    return bits.unpack(matrix.of_view(spark, d, "doc").features)


@query(DOC + " SELECT f AS feature, (gi // 64)::INT AS word, count(*)::INT AS n FROM e WHERE gi % 2 = 0 GROUP BY 1, 2")
def popcount(spark, d):
    p = matrix.of_view(spark, d, "doc")
    m = F.array(*map(F.lit, p.mask([i for i in range(p.n) if i % 2 == 0])))
    df = p.features.select("feature", F.explode("words").alias("w")).select("feature", F.col("w.at").alias("word"), F.bit_count(F.col("w.bits").bitwiseAND(F.get(m, F.col("w.at")))).alias("n"))
    return df.where("n > 0")


RISK = """, h AS (SELECT f, count(*) FILTER (label = 1) AS hp, count(*) FILTER (label = 0) AS hn FROM e JOIN ex USING (gi) GROUP BY 1),
t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ex),
k AS (SELECT f, round_even((p - hp + hn)::DOUBLE / (p + n), 5) AS risk FROM h, t), kk AS (SELECT *, round_even(1::DOUBLE - risk, 5) AS anti_risk FROM k)"""


def doc_risks(spark, d):
    p = matrix.of_view(spark, d, "doc")
    pos, neg = p.rows(1), p.rows(0)
    return matrix.risks(p.features, p.mask(pos), p.mask(neg), len(pos), len(neg))


@query(DOC + RISK + " SELECT f AS feature, risk, anti_risk FROM kk")
def rule_risk(spark, d):
    return doc_risks(spark, d)


@query(DOC + RISK + " SELECT risk, (row_number() OVER (ORDER BY risk) - 1)::INT AS rank FROM (SELECT risk FROM kk UNION SELECT anti_risk FROM kk)")
def risk_dense_rank(spark, d):
    return matrix.dense_ranks(doc_risks(spark, d))


@query(DOC + ", f5 AS (SELECT f FROM fs ORDER BY f LIMIT 5) SELECT f AS feature, gi, (e.gi IS NOT NULL)::INT AS presence, (e.gi IS NULL)::INT AS absence FROM f5 CROSS JOIN ex LEFT JOIN e USING (f, gi)")
def get_columns(spark, d):
    p = matrix.of_view(spark, d, "doc")
    return matrix.get_columns(p, p.features.orderBy("feature").limit(5))  # the query's own list of columns


@query(DOC + " SELECT f AS feature, count(*)::BIGINT AS present, count(*) FILTER (gi % 3 = 0)::BIGINT AS in_third, count(*) FILTER (gi % 3 <> 0)::BIGINT AS left_over FROM e GROUP BY 1")
def remove_rows(spark, d):
    p = matrix.of_view(spark, d, "doc")
    c = lambda f: bits.masked_count(F.col("words"), p.mask([i for i in range(p.n) if f(i)]))
    return p.features.select("feature", c(lambda i: True).alias("present"), c(lambda i: i % 3 == 0).alias("in_third"), c(lambda i: i % 3).alias("left_over"))


@query(DOC + " SELECT gi, (EXISTS (SELECT 1 FROM e WHERE e.gi = ex.gi AND f = 'the'))::INT AS presence, (NOT EXISTS (SELECT 1 FROM e WHERE e.gi = ex.gi AND f = 'the'))::INT AS absence FROM ex")
def rule_classify(spark, d):
    have = matrix.of_view(spark, d, "doc").having(["the"])
    said = [scm.Model("conjunction", [scm.Rule("the", k)]).expression().alias(k) for k in ("presence", "absence")]
    return have.select("gi", *said)


@query(DOC + " SELECT 'Presence(' || f || ')' AS rule FROM fs UNION ALL SELECT 'Absence(' || f || ')' FROM fs")
def rule_string(spark, d):
    return matrix.rules(matrix.of_view(spark, d, "doc").features).selectExpr(f"{matrix.rule_text()} as rule")


@query(DOC + " SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'presence' AS kind FROM fs UNION ALL SELECT 'absence' FROM fs) GROUP BY 1")
def rules_union(spark, d):
    return matrix.rules(matrix.of_view(spark, d, "doc").features).groupBy("kind").agg(F.count("*").alias("n"))


@query(DOC + ", h AS (SELECT f, count(*)::BIGINT AS n FROM e GROUP BY 1) SELECT f AS feature, n FROM h WHERE f NOT IN (SELECT f FROM h WHERE n >= 100)")
def blacklist_antijoin(spark, d):
    p = matrix.of_view(spark, d, "doc")
    n = bits.masked_count("words", p.mask(range(p.n))).alias("n")
    return p.without(p.features.select("feature", n).where("n >= 100"))[0].select("feature", n)


@query("SELECT t.type, p.p FROM (VALUES ('conjunction'), ('disjunction')) t(type) CROSS JOIN (VALUES (0.1::DOUBLE), (0.316::DOUBLE), (0.562::DOUBLE), (1::DOUBLE), (1.778::DOUBLE), (3.162::DOUBLE), (10::DOUBLE), (999999::DOUBLE)) p(p)")
def hp_grid(spark, d):
    return spark.createDataFrame([(t, c) for t in ("conjunction", "disjunction") for c in scm.P_GRID], "type string, p double")


ROLE = "CASE WHEN example_id % 5 = 0 THEN 'test' ELSE 'train' END"


@query(DOC + f" SELECT {ROLE} AS role, count(*)::BIGINT AS n, sum(label)::BIGINT AS positives FROM ex GROUP BY 1")
def split_stats(spark, d):
    examples = load(spark, d, "doc")[0]
    known = {r.example_id: r.gi for r in examples.collect()}
    made = splits.by_ids(known, [x for x in known if x % 5], [x for x in known if x % 5 == 0], 42)
    return splits.summary(splits.table(spark, *made), examples)


@query(DOC + ", t AS (SELECT (row_number() OVER (ORDER BY gi) - 1) % 5 AS fold FROM ex WHERE example_id % 5 <> 0) SELECT fold::INT AS fold, count(*)::BIGINT AS n FROM t GROUP BY 1")
def fold_sizes(spark, d):
    """Sizes follow from the number of train examples alone, whatever the shuffle."""
    ids = [r.gi for r in load(spark, d, "doc")[0].where("example_id % 5 <> 0").select("gi").collect()]
    folds = splits.with_folds(ids, [], 5, np.random.RandomState(42))[2]
    return spark.createDataFrame([(f,) for f in folds], "fold int").groupBy("fold").agg(F.count("*").alias("n"))


@query(DOC + " SELECT gi, example_id FROM ex WHERE example_id IN (SELECT item_id FROM benchmark)")
def split_ids(spark, d):
    return splits.located(load(spark, d, "doc")[0], read(spark, d, "benchmark").select(F.col("item_id").alias("example_id")))[0]


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS own FROM (SELECT doc_id FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 5 <> 0)")
def split_overlap_check(spark, d):
    x = read(spark, d, "labels")
    return splits.overlap(x.where("doc_id % 5 = 0"), x.where("doc_id % 5 <> 0"), "doc_id")


PRED = "SELECT quality AS label, toxic AS pred FROM labels"


@query(f"""WITH c AS (SELECT count(*) FILTER (pred = 1 AND label = 1)::BIGINT AS tp, count(*) FILTER (pred = 1 AND label = 0)::BIGINT AS fp, count(*) FILTER (pred = 0 AND label = 0)::BIGINT AS tn,
count(*) FILTER (pred = 0 AND label = 1)::BIGINT AS fn FROM ({PRED})), r AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c)
SELECT tp, fp, tn, fn, (fp + fn)::DOUBLE / (tp + fp + tn + fn) AS risk, precision, recall AS sensitivity, recall, tn::DOUBLE / (tn + fp) AS specificity, 2::DOUBLE * precision * recall / (precision + recall) AS f1 FROM r""")
def binary_metrics(spark, d):
    return metrics.binary(read(spark, d, "labels").selectExpr("quality as label", "toxic as pred"))


@query("SELECT a.i::INT AS label, b.i::INT AS pred, count(x.label)::BIGINT AS n FROM range(10) a(i) CROSS JOIN range(10) b(i) LEFT JOIN (SELECT label, (vec_id % 10)::INT AS pred FROM embeddings) x ON x.label = a.i AND x.pred = b.i GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(read(spark, d, "embeddings").selectExpr("label", "cast(vec_id % 10 as int) as pred"), 10)


@query("WITH s AS (SELECT k, k * 0.25::DOUBLE AS lo, CASE WHEN k = 7 THEN 'Infinity'::DOUBLE ELSE (k + 1) * 0.25::DOUBLE END AS hi FROM range(8) t(k)) SELECT event_id, s.k::BIGINT AS step FROM events JOIN s ON abs(value) / 20::DOUBLE >= lo AND abs(value) / 20::DOUBLE < hi")
def alpha_range_join(spark, d):
    """Half-open steps of a few alphas."""
    events = read(spark, d, "events").selectExpr("event_id", "abs(value) / 20D as a")
    return cart.looked_up(events, "a", [(k * 0.25, k) for k in range(8)], "step", "long").select("event_id", "step")