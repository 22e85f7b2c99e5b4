"""Prediction tables over the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a regression with two models: sample_id, y, p_a, p_b, unit, stratum, nation, region, priority, status, split, cohort, fold."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    y, k = F.col("o_totalprice") / 1000, F.col("o_orderkey")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        k.alias("sample_id"), y.alias("y"), (y * (1 + ((k * 37) % 101 - 50) / 500.0)).alias("p_a"), (y * (1 + ((k * 53) % 89 - 40) / 400.0)).alias("p_b"),
        F.col("o_custkey").alias("unit"), F.col("c_mktsegment").alias("stratum"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (k % 2).alias("split"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "reference").otherwise("current").alias("cohort"), (k % 5).alias("fold"),
    )


def eval_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a binary task: sample_id, y, score, unit, ts, period."""
    y = F.col("event_type").isin("purchase", "signup").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sample_id"), y.alias("y"), ((20 + 20 * y + (F.col("event_id") * 31) % 61) / 100.0).alias("score"), F.col("user_id").alias("unit"), "ts", F.date_trunc("week", "ts").cast("date").alias("period"))


def eval_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a three-class task: sample_id, y (index among F, O, P), probs."""
    k = F.col("o_orderkey")
    w = [(1 + (k * m) % d).cast("double") for m, d in ((7, 11), (5, 13), (3, 17))]
    total = w[0] + w[1] + w[2]
    y = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1
    return table(spark, sf_dir, "orders").select(k.alias("sample_id"), y.cast("int").alias("y"), F.array(*(x / total for x in w)).alias("probs"))


def eval_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a binary task: sample_id, y, score, lang, source."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), "lang", "source")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of three partitions: sample_id, entity (text digest), role, source, lang."""
    role = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("entity"), role.alias("role"), "source", "lang")


def near_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in two partitions: vec_id, embedding, role."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, "train").otherwise("test").alias("role"))


REG = """eval_reg AS (SELECT o_orderkey AS sample_id, o_totalprice/1000 AS y,
 (o_totalprice/1000)*(1+((o_orderkey*37)%101-50)/500.0::double) AS p_a, (o_totalprice/1000)*(1+((o_orderkey*53)%89-40)/400.0::double) AS p_b,
 o_custkey AS unit, c_mktsegment AS stratum, n_name AS nation, r_name AS region, o_orderpriority AS priority, o_orderstatus AS status, o_orderkey%2 AS split,
 CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'reference' ELSE 'current' END AS cohort, o_orderkey%5 AS fold
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""
BIN = """eval_bin AS (SELECT event_id AS sample_id, (event_type IN ('purchase','signup'))::int AS y,
 (20+20*(event_type IN ('purchase','signup'))::int+(event_id*31)%61)/100.0::double AS score, user_id AS unit, ts, date_trunc('week',ts)::date AS period FROM events)"""
MULTI = """eval_multi AS (SELECT o_orderkey AS sample_id, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END)::int AS y,
 [w0/(w0+w1+w2), w1/(w0+w1+w2), w2/(w0+w1+w2)] AS probs FROM (SELECT *, (1+(o_orderkey*7)%11)::double AS w0, (1+(o_orderkey*5)%13)::double AS w1, (1+(o_orderkey*3)%17)::double AS w2 FROM orders))"""
DOC = """eval_doc AS (SELECT doc_id AS sample_id, quality::int AS y, n_chars/(n_chars+1000.0::double) AS score, lang, source FROM documents JOIN labels USING (doc_id))"""
AUDIT = """audit_rows AS (SELECT doc_id AS sample_id, md5(text) AS entity, ['train','validation','test'][doc_id%3+1] AS role, source, lang FROM documents)"""
NEAR = """near_rows AS (SELECT vec_id, embedding, CASE WHEN vec_id%2=0 THEN 'train' ELSE 'test' END AS role FROM embeddings)"""
