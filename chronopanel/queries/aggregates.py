"""Aggregations, sorts and limits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.operators import aggregates as A
from chronopanel.operators.quantiles import quantile_columns
from chronopanel.operators.temporal import average_rank
from chronopanel.queries.base import PANEL, PREDICTIONS, events_panel, predictions, query, table
from chronopanel.sources import ingest


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS qty, round(avg(l_extendedprice), 6) AS price, min(l_discount) AS least, max(l_tax) AS most, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_multi(spark, sf):
    items = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return X.rounded(items.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"), F.count("*").alias("n")))


@query("SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS ever, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS valid, sum(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END)::BIGINT AS positive FROM orders GROUP BY 1")
def agg_ever_event(spark, sf):
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("ever"), F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("valid"), F.sum(y).alias("positive"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def agg_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1")
def agg_hist(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("v")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def agg_quantiles(spark, sf):
    return X.rounded(quantile_columns(table(spark, sf, "events"), "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, ["event_type"]))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS quantile FROM lineitem GROUP BY 1")
def agg_hist_quantile(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return X.rounded(A.histogram_quantile(h, ["l_returnflag"], "l_quantity", "n", 0.9))


@query("""
WITH g AS (SELECT s_nationkey, count(s_acctbal) AS n, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS s FROM supplier GROUP BY 1)
SELECT s_nationkey, n, round(m, 6) AS mean, round(coalesce(s, 0), 6) AS sd,
       round(CASE WHEN n > 1 THEN CASE n WHEN 2 THEN 12.706 WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 ELSE 1.96 END::DOUBLE * s / sqrt(n) END, 6) AS half_width FROM g""")
def agg_mean_ci(spark, sf):
    return X.rounded(table(spark, sf, "supplier").groupBy("s_nationkey").agg(*[c.alias(k) for k, c in A.mean_ci("s_acctbal").items()]))


@query("SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS pos FROM orders GROUP BY 1 HAVING count(*) >= 10 AND sum((o_orderstatus = 'F')::INT) >= 2")
def agg_having(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("pos"))
    return g.where("n >= 10 AND pos >= 2")


@query("""SELECT name, round(r, 6) AS r FROM (SELECT corr(l_quantity, l_extendedprice) AS quantity, corr(l_discount, l_extendedprice) AS discount, corr(l_tax, l_extendedprice) AS tax FROM lineitem)
UNPIVOT (r FOR name IN (quantity, discount, tax)) ORDER BY abs(r) DESC LIMIT 2""")
def agg_corr(spark, sf):
    names = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    one = table(spark, sf, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(k) for k, c in names.items()])
    ranked = one.unpivot([], list(names), "name", "r").orderBy(F.abs("r").desc(), "name").limit(2)  # a top-k report
    return X.rounded(ranked)


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "doubled"]
_SCREEN = """
WITH RECURSIVE x AS (SELECT *, l_quantity * 2 + l_tax AS doubled FROM lineitem),
r AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x" for a in ["l_extendedprice", *_NUMERIC] for b in _NUMERIC if a != b) + """),
t AS (SELECT b AS name, r, b IN ('l_tax', 'l_linenumber') AS own, row_number() OVER (PARTITION BY b IN ('l_tax', 'l_linenumber') ORDER BY round(abs(r), 9) DESC, b) AS k FROM r WHERE a = 'l_extendedprice'),
g AS (SELECT 0 AS k, ['l_tax', 'l_linenumber'] AS kept
      UNION ALL SELECT g.k + 1, CASE WHEN len(kept) < 5 AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = t.name AND list_contains(kept, r.b) AND abs(r.r) > 0.9) THEN list_append(kept, t.name) ELSE kept END FROM g JOIN t ON NOT own AND t.k = g.k + 1)
SELECT name, round(r, 6) AS r, list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), name) AS kept FROM t"""


@query(_SCREEN)
def correlation_screening(spark, sf):
    """Which numeric columns of items are kept for a model of the price: two protected ones, then the most correlated, up to
    five, none that repeats another."""
    rows = table(spark, sf, "lineitem").withColumn("doubled", F.col("l_quantity") * 2 + F.col("l_tax"))
    kept = A.screened(rows, "l_extendedprice", _NUMERIC, ["l_tax", "l_linenumber"], 5, 0.9)
    return X.rounded(spark.createDataFrame(kept, "name string, r double, kept boolean"))


@query("""
WITH a AS (SELECT round(l_quantity) AS x, round(l_extendedprice, -3) AS y FROM lineitem),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM a)
SELECT round(corr(rx, ry), 6) AS rho FROM r""")
def agg_spearman(spark, sf):
    a = table(spark, sf, "lineitem").select(F.round("l_quantity").alias("x"), F.round("l_extendedprice", -3).alias("y"))
    return X.rounded(average_rank(average_rank(a, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho")))


@query(PANEL + """
SELECT 'view' AS name, count(*) AS n, count("view") AS observed, round(min("view"), 6) AS least, round(max("view"), 6) AS most FROM panel
UNION ALL SELECT 'err', count(*), count(err), round(min(err), 6), round(max(err), 6) FROM panel UNION ALL SELECT 'buy', count(*), count(buy), round(min(buy), 6), round(max(buy), 6) FROM panel""")
def agg_profile(spark, sf):
    return X.rounded(A.profile(events_panel(spark, sf), ["view", "err", "buy"]))


@query(PANEL + """
SELECT coalesce(k, 'overall') AS split, round(avg(("view" IS NULL)::INT), 6) AS view_missing, round(avg((err IS NULL)::INT), 6) AS err_missing, count(*) AS n
FROM (SELECT *, 'part' || (user_id % 3) AS k FROM panel) GROUP BY GROUPING SETS ((k), ())""")
def agg_missing_grouping_sets(spark, sf):
    p = events_panel(spark, sf).withColumn("k", F.concat(F.lit("part"), (F.col("user_id") % 3).cast("string")))
    g = p.rollup("k").agg(F.avg(F.col("view").isNull().cast("int")).alias("view_missing"), F.avg(F.col("err").isNull().cast("int")).alias("err_missing"), F.count("*").alias("n"))
    return X.rounded(g.select(F.coalesce("k", F.lit("overall")).alias("split"), "view_missing", "err_missing", "n"))


@query("""
SELECT count(*) AS total, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment = 'BUILDING') AS excluded,
       count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'BUILDING') AS kept, count(DISTINCT c_nationkey) FILTER (c_acctbal < 0) AS nations FROM customer""")
def agg_attrition(spark, sf):
    neg, building = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, sf, "customer").agg(F.count("*").alias("total"), count(neg).alias("negative"), count(~neg & building).alias("excluded"), count(~neg & ~building).alias("kept"), F.countDistinct(F.when(neg, F.col("c_nationkey"))).alias("nations"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def agg_first_row(spark, sf):
    return A.first_row(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def agg_argmax(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("SELECT o_orderpriority AS p, round(sum(o_totalprice * (o_custkey % 10)) / sum(o_custkey % 10), 4) AS weighted FROM orders GROUP BY 1")
def agg_weighted(spark, sf):
    return X.rounded(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(A.weighted_mean(F.col("o_totalprice"), F.col("o_custkey") % 10).alias("weighted")), 4)


@query(PREDICTIONS + """,
i AS (SELECT l_orderkey AS id, least(sum(l_extendedprice * (1 - l_discount)) / 600000, 1) AS p FROM lineitem GROUP BY 1),
k AS (SELECT c_custkey AS cluster, least(greatest(c_acctbal / 10000, 0), 1) AS p FROM customer)
SELECT id, y, round((pred.p + i.p + k.p) / 3, 6) AS ensemble FROM pred JOIN i USING (id) JOIN k USING (cluster)""")
def agg_ensemble(spark, sf):
    """The mean of three models' predictions of the same windows: from orders, from their items, from their customers.
    Models that don't cover the same windows raise."""
    one = F.lit(1.0)
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 600000
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.least(net, one).alias("p"))
    rows = predictions(spark, sf).select("id", "y", "cluster", "p").join(items.select("id"), "id", "left_semi")
    balance = table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster"), F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), one).alias("p"))
    members = {"orders": rows.drop("cluster"), "items": rows.select("id", "y").join(items, "id"), "customers": rows.select("id", "y", "cluster").join(balance, "cluster").drop("cluster")}
    each = [m.select("id", "y", F.lit(name).alias("member"), "p") for name, m in members.items()]
    u = each[0].unionByName(each[1]).unionByName(each[2])
    return X.rounded(A.ensemble(u, ["id", "y"], "member", "p", "ensemble"))


@query("""
SELECT name, kind, observed, round(share, 6) AS share, entities, positives FROM (
  SELECT 'view' AS name, 'feature' AS kind, count("view") AS observed, count("view") / count(*) AS share, count(DISTINCT CASE WHEN "view" IS NOT NULL THEN user_id END) AS entities, NULL::BIGINT AS positives FROM panel
  UNION ALL SELECT 'err', 'feature', count(err), count(err) / count(*), count(DISTINCT CASE WHEN err IS NOT NULL THEN user_id END), NULL FROM panel
  UNION ALL SELECT 'high', 'label', count("view"), count("view") / count(*), count(DISTINCT CASE WHEN "view" IS NOT NULL THEN user_id END), sum(("view" > 60)::INT)::BIGINT FROM panel)""".replace("\nSELECT name", PANEL + "\nSELECT name", 1))
def feature_manifest(spark, sf):
    p = events_panel(spark, sf)
    p = p.select("user_id", F.col("view").isNull().cast("int").alias("view_is_missing"), F.col("err").isNull().cast("int").alias("err_is_missing"), (F.col("view") > 60).cast("int").alias("high"))
    return X.rounded(ingest.feature_manifest(p, "user_id", {"view": "view_is_missing", "err": "err_is_missing"}, ["high"]))


@query("""
WITH a AS (SELECT o_orderpriority AS model, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS test_auroc, avg(o_custkey) FILTER (o_orderstatus = 'F') AS test_brier, avg(o_totalprice) AS val_auroc, avg(o_custkey) AS val_brier FROM orders GROUP BY 1),
b AS (SELECT c_mktsegment AS model, avg(c_acctbal) AS val_auroc FROM customer GROUP BY 1)
SELECT 'orders' AS family, model, CASE WHEN model < '3' OR test_auroc IS NULL THEN 'val' ELSE 'test' END AS part, round(CASE WHEN model < '3' OR test_auroc IS NULL THEN val_auroc ELSE test_auroc END, 4) AS auroc,
       round(CASE WHEN model < '3' OR test_auroc IS NULL THEN val_brier ELSE test_brier END, 4) AS brier FROM a
UNION ALL SELECT 'customers', model, 'val', round(val_auroc, 4), NULL FROM b""")
def metric_harvest(spark, sf):
    """Metric tables of two shapes as one: test figures where there are any, else validation figures."""
    o, done = table(spark, sf, "orders"), F.col("o_orderstatus") == "F"
    some = F.col("o_orderpriority") >= "3"
    a = o.groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg(F.when(done & some, F.col("o_totalprice"))).alias("test_auroc"), F.avg(F.when(done & some, F.col("o_custkey"))).alias("test_brier"),
        F.avg("o_totalprice").alias("val_auroc"), F.avg("o_custkey").alias("val_brier"))
    b = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg("c_acctbal").alias("val_auroc"))
    return X.rounded(ingest.harvested({"orders": a, "customers": b}, ["model"], ["auroc", "brier"]), 4)


@query("""
WITH old AS (SELECT o_orderpriority AS model, 1.0::DOUBLE AS value FROM orders GROUP BY 1), fresh AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_orderpriority < '4' GROUP BY 1),
u AS (SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE model NOT IN (SELECT model FROM fresh))
SELECT row_number() OVER (ORDER BY CASE substr(model, 1, 1) WHEN '5' THEN 0 WHEN '2' THEN 1 ELSE 2 END, model) AS place, model, value FROM u""")
def publication_table(spark, sf):
    """Rows replaced by newer ones of the same key, in a given order, the rest by name."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "model")
    old = o.select("model").distinct().withColumn("value", F.lit(1.0))
    fresh = o.where("model < '4'").groupBy("model").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    rank = F.when(F.col("model").startswith("5"), 0).when(F.col("model").startswith("2"), 1).otherwise(2)
    return A.replaced(old, fresh, ["model"]).select(F.row_number().over(Window.orderBy(rank, "model")).cast("long").alias("place"), "model", "value")  # a table to print is small


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def agg_dedup_last(spark, sf):
    return A.first_row(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(o_orderkey || '|' || (o_orderstatus = 'F')::INT), 1, 8))::BIGINT)::BIGINT AS fingerprint, sum((o_orderstatus = 'F')::INT)::BIGINT AS positives FROM orders")
def agg_fingerprint(spark, sf):
    return A.fingerprint(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")), "o_orderkey", "y")


@query("SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id), 6) AS most, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def agg_broadcast_back(spark, sf):
    w = Window.partitionBy("user_id")
    return X.rounded(table(spark, sf, "events").select("event_id", "user_id", F.max("value").over(w).alias("most"), F.count("*").over(w).alias("n")))


@query("""
SELECT 'orders' AS item, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o FROM orders
UNION ALL SELECT 'price', round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4), round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) FROM orders""")
def agg_characteristics(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    long = g.unpivot(["o_orderstatus"], ["orders", "price"], "item", "v")
    return X.rounded(long.groupBy("item").pivot("o_orderstatus", ["F", "O"]).agg(F.first("v")).withColumnsRenamed({"F": "f", "O": "o"}), 4)


@query("SELECT l_suppkey, round(avg(l_tax), 6) AS mean, round(var_samp(l_tax), 6) AS variance, count(*) AS n FROM lineitem WHERE isfinite(l_tax) GROUP BY 1")
def agg_running_moments(spark, sf):
    t = X.finite(F.col("l_tax"))
    return X.rounded(table(spark, sf, "lineitem").where(t.isNotNull()).groupBy("l_suppkey").agg(F.avg("l_tax").alias("mean"), F.var_samp("l_tax").alias("variance"), F.count("*").alias("n")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top_k_per_group(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""
SELECT vec_id, list_max(embedding)::DOUBLE AS top, list_position(embedding, list_max(embedding))::BIGINT AS at, list_sort(embedding, 'DESC')[3]::DOUBLE AS third FROM embeddings""")
def vector_top_k(spark, sf):
    e, top = F.col("embedding"), F.array_max("embedding")
    return table(spark, sf, "embeddings").select("vec_id", top.cast("double").alias("top"), F.array_position(e, top).cast("long").alias("at"), F.sort_array(e, asc=False)[2].cast("double").alias("third"))


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 0 WHEN '1' THEN 1 ELSE 2 END, o_orderpriority) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def category_order(spark, sf):
    rank = F.when(F.col("o_orderpriority").startswith("5"), 0).when(F.col("o_orderpriority").startswith("1"), 1).otherwise(2)
    return table(spark, sf, "orders").select("o_orderpriority").distinct().withColumn("place", F.row_number().over(Window.orderBy(rank, "o_orderpriority")).cast("long"))


@query("""
WITH m AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1)
SELECT p, o_orderkey FROM orders JOIN m ON p = o_orderpriority QUALIFY row_number() OVER (PARTITION BY p ORDER BY abs(o_totalprice - med), o_orderkey) = 1""")
def median_pick(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "p")
    m = quantile_columns(o, "o_totalprice", {"med": 0.5}, ["p"])
    return o.join(m, "p").groupBy("p").agg(F.min_by("o_orderkey", F.struct(F.abs(F.col("o_totalprice") - F.col("med")), "o_orderkey")).alias("o_orderkey"))
