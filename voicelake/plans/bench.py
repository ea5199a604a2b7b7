"""Queries of benchmark roll-ups and corpus selection."""

from pyspark.sql import functions as F

from voicelake.operators import bench as B
from voicelake.operators.telemetry import nearest_rank
from voicelake.operators.telemetry import rtf as rtf_of
from voicelake.plans.registry import query, table

RANK = "list_sort(list({0}))[round_even((count(*) - 1) * 0.95, 0)::BIGINT + 1]"


@query(f"""WITH r AS (SELECT *, l_extendedprice / l_quantity AS rtf FROM lineitem) SELECT l_returnflag || '/' || l_linestatus AS key, count(*) AS records, round(median(rtf), 6) AS median_rtf, round(median(l_extendedprice), 6) AS median_seconds,
max(l_suppkey) AS max_rss, round(max(l_tax), 6) AS max_load, round({RANK.format('rtf')}, 6) AS p95_rtf, round({RANK.format('l_extendedprice')}, 6) AS p95_seconds FROM r GROUP BY 1""")
def bench_summary(spark, sf_dir):
    records = table(spark, sf_dir, "lineitem").withColumn("rtf", F.try_divide("l_extendedprice", "l_quantity"))
    s = B.bench_summary(records, ["l_returnflag", "l_linestatus"], "rtf", "l_extendedprice", "l_suppkey", "l_tax")
    return s.select("key", "records", "max_rss", *[F.round(c, 6).alias(c) for c in ("median_rtf", "median_seconds", "max_load", "p95_rtf", "p95_seconds")])


@query(f"SELECT l_suppkey, {RANK.format('l_quantity')} AS value FROM lineitem GROUP BY l_suppkey", name="nearest_rank")
def nearest(spark, sf_dir):
    return nearest_rank(table(spark, sf_dir, "lineitem"), "l_quantity", 0.95, ["l_suppkey"])


@query("SELECT l_orderkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity * (1 + l_tax)), 3) AS session_rtf FROM lineitem GROUP BY l_orderkey")
def rtf(spark, sf_dir):
    return rtf_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity") * (1 + F.col("l_tax")))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, round(max(o_totalprice) FILTER (k = 1), 4) AS cold, round(median(o_totalprice) FILTER (k > 1), 4) AS warm_median FROM k GROUP BY o_custkey""")
def warm_vs_cold(spark, sf_dir):
    w = B.warm_vs_cold(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return w.select("o_custkey", F.round("cold", 4).alias("cold"), F.round("warm_median", 4).alias("warm_median"))


@query("SELECT a.l_orderkey, round(b.l_extendedprice - a.l_extendedprice, 4) AS difference, round(b.l_extendedprice / a.l_extendedprice, 6) AS ratio FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2")
def compare_runs(spark, sf_dir):
    c = B.compare_runs(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1, 2, "l_extendedprice")
    return c.select("l_orderkey", F.round("difference", 4).alias("difference"), F.round("ratio", 6).alias("ratio"))


@query("""SELECT o_orderstatus, round(median(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS urgent, round(median(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY o_orderstatus""")
def bench_pivot(spark, sf_dir):
    wide = B.bench_pivot(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"], "o_totalprice")
    return wide.select("o_orderstatus", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"))


@query("""WITH c AS (SELECT doc_id, source, n_chars, CASE WHEN n_chars <= 700 THEN 'short' WHEN n_chars <= 1200 THEN 'medium' END AS category FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'short' THEN n_chars END NULLS FIRST, doc_id) AS k FROM c WHERE category IS NOT NULL)
SELECT doc_id, category, category || '_' || lpad(k::VARCHAR, 2, '0') AS sample_id FROM k WHERE k <= 10""")
def select_corpus(spark, sf_dir):
    return B.select_corpus(table(spark, sf_dir, "documents"), "n_chars", "doc_id", 700, 1200).select("doc_id", "category", "sample_id")


@query("SELECT doc_id, source, total::BIGINT AS total FROM (SELECT *, sum(n_chars + 250) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total - n_chars - 250 < 60000")
def composite_cut(spark, sf_dir):
    return B.composite_cut(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], "doc_id", "n_chars", 250, 60000).select("doc_id", "source", "total")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_runs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return B.union_runs(customers, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))
