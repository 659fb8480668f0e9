"""Examples and features over the driver's tables: examples(gi, example_id, label), edges(feature, gi)."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    examples: str  # SQL: example_id, label
    edges: str  # SQL over Spark: example_id, feature; rows may repeat
    duck: str  # the same for the oracle


# Spark alone would lower-case İ to two characters, i and a dot that ends a word.
TOKENS = "SELECT doc_id AS example_id, {} AS feature FROM documents JOIN labels USING (doc_id)"
VIEWS = {
    "doc": View("SELECT doc_id AS example_id, quality AS label FROM labels JOIN documents USING (doc_id)", TOKENS.format("explode(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[a-z]+', 0))"), TOKENS.format("unnest(regexp_extract_all(lower(text), '[a-z]+'))")),
    "tox": View("SELECT doc_id AS example_id, toxic AS label FROM labels JOIN documents USING (doc_id)", TOKENS.format("explode(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[a-z]+', 0))"), TOKENS.format("unnest(regexp_extract_all(lower(text), '[a-z]+'))")),
    "cust": View(
        "SELECT c_custkey AS example_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)",
        *["SELECT o_custkey AS example_id, p_brand || '/' || p_type AS feature FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"] * 2),
    "user": View("SELECT user_id AS example_id, CAST(avg(value) > (SELECT avg(value) FROM events) AS INT) AS label FROM events GROUP BY user_id", *["SELECT user_id AS example_id, event_type || '@' || hour(ts) AS feature FROM events"] * 2),
    "emb": View("SELECT vec_id AS example_id, label FROM embeddings", "SELECT vec_id AS example_id, concat('d', lpad(i, 2, '0')) AS feature FROM (SELECT vec_id, posexplode(embedding) AS (i, x) FROM embeddings) WHERE x > 0", "SELECT vec_id AS example_id, 'd' || lpad((i - 1)::VARCHAR, 2, '0') AS feature FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE x > 0"),
    "kmer": View("SELECT doc_id AS example_id, quality AS label FROM labels JOIN documents USING (doc_id)", TOKENS.format("explode(regexp_extract_all(regexp_replace(lower(text), '[^a-z]', ''), '(?=([a-z]{5}))', 1))"), "SELECT example_id, substring(s, i, 5) AS feature FROM (SELECT example_id, s, unnest(range(1, length(s) - 3)) AS i FROM (SELECT doc_id AS example_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM documents JOIN labels USING (doc_id)))"),
}


NAMES = re.compile(r"\b(documents|labels|customer|orders|lineitem|part|events|embeddings)\b")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores is dealt to all of them, so that what is done to its rows is shared; larger ones come in parts already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which a cluster shares; a local session without one gets a local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a dataset needs a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/thicket"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables of a folder; they are registered under names of this library's own, so no view of the caller's is replaced."""
    own = f"thicket_{zlib.crc32(sf_dir.encode()):08x}_"
    for t in set(NAMES.findall(text)):
        df = read(spark, sf_dir, t)
        (spread(df) if t == "documents" else df).createOrReplaceTempView(own + t)
    return spark.sql(NAMES.sub(own + r"\1", text))


def ordered(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """examples; gi follows label, then id, nulls last. Examples are the small side: they are numbered in one task."""
    return sql(spark, sf_dir, f"SELECT CAST(row_number() OVER (ORDER BY label NULLS LAST, example_id NULLS LAST) - 1 AS INT) AS gi, example_id, CAST(label AS INT) AS label FROM ({VIEWS[view].examples})")


def load(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, DataFrame]:
    """examples and edges; features count from two examples on."""
    examples, edges = ordered(spark, sf_dir, view), sql(spark, sf_dir, VIEWS[view].edges).distinct()
    often = edges.groupBy("feature").agg(F.count("*").alias("n")).where("n >= 2").select("feature")
    return examples, edges.join(often, "feature").join(examples.select("gi", "example_id"), "example_id").select("feature", "gi")


def sightings(spark: SparkSession, sf_dir: str, view: str) -> tuple[list[int], DataFrame, list[int] | None]:
    """Labels by gi; feature, gi of every sighting, repeats and rare features included: packing folds and drops them without a join of edges; and, if ids repeat,
    the first example of each: an id counts once for how often a feature is.

    Examples are ordered once; the join with them works on a local table of their ids.
    """
    own = ordered(spark, sf_dir, view).orderBy("gi").toArrow()
    first: dict = {}
    for gi, x in enumerate(own["example_id"].to_pylist()):
        first.setdefault(x, gi)
    edges = sql(spark, sf_dir, VIEWS[view].edges).join(spark.createDataFrame(own.select(["gi", "example_id"])), "example_id").where("feature is not null").select("feature", "gi")
    return own["label"].to_pylist(), edges, None if len(first) == own.num_rows else list(first.values())


def duck(view: str) -> str:
    """The oracle's CTEs: ex(gi, example_id, label), e(f, gi), fs(f)."""
    v = VIEWS[view]
    return f"""WITH ex AS (SELECT (row_number() OVER (ORDER BY label, example_id) - 1)::INT AS gi, example_id, label::INT AS label FROM ({v.examples.replace("AS INT)", "AS INTEGER)")})),
raw AS (SELECT DISTINCT * FROM ({v.duck})),
e AS (SELECT feature AS f, gi FROM raw JOIN ex USING (example_id) WHERE feature IN (SELECT feature FROM raw GROUP BY feature HAVING count(*) >= 2)),
fs AS (SELECT DISTINCT f FROM e)"""
