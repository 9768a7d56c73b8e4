"""Joins and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.operators import joins as J
from chronopanel.plans import guards
from chronopanel.queries.base import query, table


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_dim(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = J.lookup(J.lookup(table(spark, sf, "customer"), nation, "c_nationkey"), region, "n_regionkey")
    return out.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("""
SELECT user_id, views, errors FROM (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND value > 60 GROUP BY 1)
FULL JOIN (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 90 GROUP BY 1) USING (user_id)""")
def join_full_outer(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'view' AND value > 60").groupBy("user_id").agg(F.count("*").alias("views"))
    b = e.where("event_type = 'error' AND value > 90").groupBy("user_id").agg(F.count("*").alias("errors"))
    return a.join(b, "user_id", "full_outer")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark, sf):
    items = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(items, "p_partkey", "left_anti").select("p_partkey")


_STAYS = """stays AS (SELECT user_id, min(ts) + to_days(7 * k) AS a, min(ts) + to_days(7 * k + 7) AS b, k FROM events, (VALUES (0), (1), (2)) t(k) GROUP BY user_id, k)"""


def _stays(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("t"))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    days = lambda d: F.make_dt_interval(days=d)
    return first.select("user_id", "t", k).select("user_id", (F.col("t") + days(7 * F.col("k"))).alias("a"), (F.col("t") + days(7 * F.col("k") + 7)).alias("b"), "k")


@query(f"WITH {_STAYS} SELECT event_id, k FROM events e JOIN stays s ON e.user_id = s.user_id AND ts BETWEEN a AND b")
def join_interval(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return J.in_interval(e, _stays(spark, sf), ["user_id"], "ts", "a", "b").select("event_id", "k")


@query("""
WITH t AS (SELECT user_id, ts AS t0 FROM events WHERE event_type = 'error' AND value > 80)
SELECT user_id, t0, count(*) AS n, round(max(value), 6) AS worst FROM t JOIN events USING (user_id) WHERE ts > t0 AND ts <= t0 + INTERVAL 6 HOUR GROUP BY 1, 2""")
def join_band(spark, sf):
    e = table(spark, sf, "events")
    t = e.where("event_type = 'error' AND value > 80").select("user_id", F.col("ts").alias("t0"))
    out = J.band(t, e.select("user_id", "ts", "value"), "user_id", F.col("t0"), F.col("t0") + F.expr("INTERVAL 6 HOURS"), "ts")
    return X.rounded(out.groupBy("user_id", "t0").agg(F.count("*").alias("n"), F.max("value").alias("worst")))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_pairs(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("""
SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("""
WITH s AS (SELECT c_mktsegment AS g, list_distinct(list(c_nationkey) FILTER (c_acctbal > 5000)) AS a, list_distinct(list(c_nationkey) FILTER (c_acctbal < 0)) AS b FROM customer GROUP BY 1)
SELECT g, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS similarity FROM s""")
def jaccard_sets(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(
        F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey"))).alias("a"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_nationkey"))).alias("b"))
    return X.rounded(c.select("g", J.jaccard(F.col("a"), F.col("b")).alias("similarity")))


@query("SELECT o_orderkey, o_custkey * 100000 + o_orderkey % 100000 AS window_id FROM orders WHERE o_custkey * 100000 + o_orderkey % 100000 IN (SELECT o_custkey * 100000 + o_orderkey % 100000 FROM orders WHERE o_totalprice < 100000)")
def window_membership(spark, sf):
    wid = (F.col("o_custkey") * 100_000 + F.col("o_orderkey") % 100_000).alias("window_id")
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", wid).join(o.where("o_totalprice < 100000").select(wid), "window_id", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def reindex_align(spark, sf):
    """Prices of the orders that the items name; an order that isn't there raises."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return J.aligned(keys, guards.require_unique(o, ["o_orderkey"]), ["o_orderkey"])


@query("SELECT c_custkey, c_acctbal, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_one_to_one(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.one_to_one(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), counts, ["c_custkey"])


@query("""
SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1)) AS used,
       (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unused, TRUE AS mapped""")
def foreign_key_audit(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    guards.require_mapped(o, c, "o_custkey")
    used = o.agg(F.countDistinct("o_custkey").alias("used"))
    unused = c.join(o, "o_custkey", "left_anti").agg(F.count("*").alias("unused"))
    return used.join(unused).withColumn("mapped", F.lit(True))  # one row on either side
