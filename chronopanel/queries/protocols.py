"""Splits, samples, manifests and audits over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.operators import protocol as D
from chronopanel.operators import temporal as T
from chronopanel.plans.guards import audit, json_cuts, json_leaves, require_manifest, require_unique, truncated
from chronopanel.queries.base import FILLED, PREDICTIONS, filled_panel, predictions, query, table

_HASH = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"
_SPLIT = f"""
WITH s AS (SELECT c_custkey, c_mktsegment || '|' || coalesce((c_acctbal > 0)::INT, -1) AS strat FROM customer),
n AS (SELECT strat, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT strat, n, floor(n * 0.7 + 1e-9)::BIGINT AS a, floor(n * 0.15 + 1e-9)::BIGINT AS b FROM n),
r AS (SELECT *, n - a - 2 * b AS rest, n * 0.7::DOUBLE - a AS ra, n * 0.15::DOUBLE - b AS rb FROM f),
z AS (SELECT strat, n, a + (2 * (rb > ra + 1e-9)::INT < rest)::INT AS a, b + (((ra >= rb - 1e-9)::INT) < rest)::INT AS b FROM r),
forced AS (SELECT strat, n, CASE WHEN n >= 3 THEN a - (b = 0)::INT - (n - a - b = 0)::INT ELSE a END AS a, CASE WHEN n >= 3 AND b = 0 THEN 1 ELSE b END AS b FROM z),
ranked AS (SELECT *, row_number() OVER (PARTITION BY strat ORDER BY {_HASH.format(seed=42, key='c_custkey')}, c_custkey) AS rn FROM s JOIN forced USING (strat)),
split AS (SELECT c_custkey, strat, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.concat_ws("|", "c_mktsegment", F.coalesce((F.col("c_acctbal") > 0).cast("int"), F.lit(-1)).cast("string")).alias("strat"))
    return D.split(c, "c_custkey", "strat", ["train", "validation", "test"], [0.7, 0.15, 0.15], 42)


@query(_SPLIT + "SELECT c_custkey, strat, split FROM split")
def split_allocate(spark, sf):
    return _split(spark, sf).select("c_custkey", "strat", "split")


@query(_SPLIT + """SELECT split, count(DISTINCT c_custkey) AS patients, count(o_orderkey) AS stays, round(avg((o_orderstatus = 'F')::INT), 6) AS prevalence
FROM split LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def split_summary(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    j = require_unique(_split(spark, sf), ["c_custkey"]).join(o, "c_custkey", "left")
    return X.rounded(j.groupBy("split").agg(F.countDistinct("c_custkey").alias("patients"), F.count("o_orderkey").alias("stays"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("prevalence")))


_SAMPLE = f"""
WITH o AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y FROM orders),
t AS (SELECT count(*) AS n, sum(y) AS p FROM o),
k AS (SELECT least(1000, n) AS m, least(greatest(round_even(least(1000, n) * p / n, 0), 1), p, least(1000, n) - 1) AS np FROM t)
SELECT o_orderkey, y FROM o, k QUALIFY row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(seed=7, key='o_orderkey')}, o_orderkey) <= CASE WHEN y = 1 THEN np ELSE m - np END"""


@query(_SAMPLE)
def stratified_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return D.stratified_sample(o, "o_orderkey", "y", 1000, 7)


@query(f"SELECT o_orderkey FROM orders ORDER BY {_HASH.format(seed=11, key='o_orderkey')}, o_orderkey LIMIT 500")
def uniform_sample(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy(X.hash_unit(F.lit(11), F.col("o_orderkey")), "o_orderkey").limit(500)  # the sample's size


@query(_SPLIT + """
SELECT split, count(*) AS windows, sum((o_orderstatus = 'F')::INT)::BIGINT AS positives, round(avg((o_orderstatus = 'F')::INT), 6) AS prevalence,
       sum(('0x' || substr(md5(o_orderkey || '|' || (o_orderstatus = 'F')::INT), 1, 8))::BIGINT)::BIGINT AS fingerprint
FROM split JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def cohort_record(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "o_orderkey", "y")), 1, 8), 16, 10).cast("long")
    g = _split(spark, sf).join(o, "c_custkey").groupBy("split")
    return X.rounded(g.agg(F.count("*").alias("windows"), F.sum("y").alias("positives"), F.avg("y").alias("prevalence"), F.sum(h).alias("fingerprint")))


@query(_SPLIT + """
SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM split a JOIN split b ON a.c_custkey = b.c_custkey AND a.split < b.split GROUP BY 1, 2
UNION ALL SELECT 'all', 'all', count(*) - count(DISTINCT c_custkey) FROM split""")
def split_audit(spark, sf):
    s = _split(spark, sf).select("c_custkey", "split")
    a, b = s.alias("a"), s.alias("b")
    shared = a.join(b, (F.col("a.c_custkey") == F.col("b.c_custkey")) & (F.col("a.split") < F.col("b.split")))
    shared = shared.groupBy(F.col("a.split").alias("left_split"), F.col("b.split").alias("right_split")).agg(F.count("*").alias("shared"))
    whole = s.agg((F.count("*") - F.countDistinct("c_custkey")).alias("shared"))
    return shared.union(whole.select(F.lit("all"), F.lit("all"), "shared"))


_MANIFEST = "manifest AS (SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3)"


def _manifest(spark, sf):
    """Orders that have three items or more, from the items' table."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return items.where("n >= 3").select("o_orderkey")


@query(_SPLIT + f", {_MANIFEST} SELECT o_orderkey, o_totalprice, split FROM orders JOIN split ON o_custkey = c_custkey JOIN manifest USING (o_orderkey)")
def protocol_filter(spark, sf):
    """The orders that a manifest names, with their splits: one that it names and that is missing, or without a split, raises."""
    o = D.filter_to(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _manifest(spark, sf), "o_orderkey")
    s = require_manifest(_split(spark, sf).withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "split", ["train", "validation", "test"])
    return D.attach_split(o, s, "o_custkey").select("o_orderkey", "o_totalprice", "split")


@query(_SPLIT + "SELECT split, count(DISTINCT o_custkey) AS n FROM orders JOIN split ON o_custkey = c_custkey GROUP BY 1")
def split_id_sets(spark, sf):
    """How many of the keys at hand each split has; keys without a split and empty splits raise."""
    names = ["train", "validation", "test"]
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    sets = D.split_ids(keys, _split(spark, sf), "c_custkey", names)
    parts = [sets[n].agg(F.lit(n).alias("split"), F.count("*").alias("n")) for n in names]
    return parts[0].union(parts[1]).union(parts[2])


@query(FILLED + """,
saved AS (SELECT user_id, hr, CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= 6 AND v IS NOT NULL THEN (max(v) OVER f - v >= 20)::INT END AS y FROM filled
          WINDOW f AS (PARTITION BY user_id ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
rebuilt AS (SELECT a.user_id, a.hr, (max(b.v) - any_value(a.v) >= 20)::INT AS y FROM filled a JOIN filled b ON a.user_id = b.user_id AND b.hr > a.hr AND b.hr <= a.hr + 6 WHERE a.v IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 6),
j AS (SELECT s.y AS a, r.y AS b, s.user_id IS NOT NULL AS in_a, r.user_id IS NOT NULL AS in_b FROM (SELECT * FROM saved WHERE y IS NOT NULL) s FULL JOIN rebuilt r USING (user_id, hr))
SELECT count(*) AS n, count(*) FILTER (NOT in_b) AS only_saved, count(*) FILTER (NOT in_a) AS only_rebuilt, count(*) FILTER (in_a AND in_b AND a <> b) AS different FROM j""")
def reconstruction_check(spark, sf):
    """Labels by frames over the timeline, and the same rebuilt from a band join: keys and labels must agree. The join merges:
    by the size of the events' file the panel seems small enough to be broadcast, which it isn't."""
    f = filled_panel(spark, sf).select("user_id", "hr", "v")
    saved = f.select("user_id", "hr", T.rise_label("v", "hr", 6, 20.0, "user_id", T.timeline("user_id", "hr")).alias("y")).where("y IS NOT NULL")
    ahead = f.select("user_id", F.explode(F.array(*[F.col("hr") - k for k in range(1, 7)])).alias("hr"), F.col("v").alias("next"))
    rebuilt = f.where("v IS NOT NULL").hint("merge").join(ahead, ["user_id", "hr"]).groupBy("user_id", "hr").agg(F.count(F.lit(1)).alias("n"), (F.max("next") - F.first("v") >= 20).cast("long").alias("y"))
    return D.reconstruction(saved, rebuilt.where("n = 6"), ["user_id", "hr"], "y")


@query("""
SELECT name, expected, found, expected IS NOT DISTINCT FROM found AS ok FROM (
  SELECT 'orders are unique' AS name, (SELECT count(*) FROM orders) AS expected, (SELECT count(DISTINCT o_orderkey) FROM orders) AS found
  UNION ALL SELECT 'items belong to orders', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'customers have nations', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey)
  UNION ALL SELECT 'settings that cut data short', 2, 2)""")
def scope_audit(spark, sf):
    """Assertions about what a result was made from, and a search for settings that cut the data short."""
    o, items, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    kept = items.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    known = c.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")
    cuts = truncated({"data": {"max_rows": 100, "max_stays": None}, "runs": [{"limit": 0}, {"smoke": True}]})

    def check(name, expected, found):
        return expected.agg(F.lit(name).alias("name"), F.count("*").alias("expected")).join(found)  # one row on either side

    checks = check("orders are unique", o, o.agg(F.countDistinct("o_orderkey").alias("found")))
    checks = checks.union(check("items belong to orders", items, kept.agg(F.count("*").alias("found"))))
    checks = checks.union(check("customers have nations", c, known.agg(F.count("*").alias("found"))))
    said = spark.createDataFrame([("settings that cut data short", 2, len(cuts))], "name string, expected long, found long")
    return audit(checks.union(said))


@query(PREDICTIONS + """,
b AS (SELECT l_orderkey AS id, bool_and(l_linestatus = 'F')::BIGINT AS y, round(sum(l_extendedprice) / 600000, 1) AS q FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM pred) AS n, (SELECT count(*) - count(DISTINCT id) FROM pred) AS repeated, (SELECT count(*) FROM pred FULL JOIN b ON pred.id = b.id WHERE b.id IS NULL OR pred.id IS NULL) AS unshared,
       (SELECT count(*) FROM pred JOIN b USING (id) WHERE pred.y <> b.y) AS relabelled, (SELECT regr_slope(y, q) > 0 FROM b) AS rises""")
def shared_window_audit(spark, sf):
    """Whether two models, one scored from orders and one from their items, were scored on the same windows with the same
    labels, and whether the outcome rises with the score."""
    a = predictions(spark, sf).select("id", F.col("y").alias("ya"))
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    b = items.agg(F.bool_and(F.col("l_linestatus") == "F").cast("long").alias("yb"), F.round(F.sum("l_extendedprice") / 600000, 1).alias("q"))
    j = a.join(b, "id", "full_outer")
    shared = j.agg(F.count(F.when(F.col("ya").isNull() | F.col("yb").isNull(), 1)).alias("unshared"), F.count(F.when(F.col("ya") != F.col("yb"), 1)).alias("relabelled"))
    own = a.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("id")).alias("repeated"))
    return own.join(shared).join(b.agg((F.regr_slope(F.col("yb"), F.col("q")) > 0).alias("rises")))  # one row each


@query("""
WITH e AS (SELECT (props->>'$.k') AS k FROM events),
d AS (SELECT text AS t FROM (SELECT json_object('run', json_object('orders', (SELECT count(*) FROM orders), 'limit', NULL, 'splits', [json_object('name', 'train', 'smoke', false), json_object('name', 'test', 'max_rows', 50)])) AS text))
SELECT '$.k' AS path, 'props' AS source, count(k) AS leaves, count(DISTINCT k) AS distinct_values, 0::BIGINT AS cuts FROM e
UNION ALL SELECT path, 'run', 1, (path <> '$.run.limit')::BIGINT, (path = '$.run.splits[1].max_rows')::BIGINT FROM d, (VALUES ('$.run.orders'), ('$.run.limit'), ('$.run.splits[0].name'), ('$.run.splits[0].smoke'), ('$.run.splits[1].name'), ('$.run.splits[1].max_rows')) v(path)""")
def json_scope_audit(spark, sf):
    """Every path of the events' JSON and of a run's record made from the tables: how many leaves, values, and settings that
    cut data short."""
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    split = lambda name, **kw: F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in kw.items()])
    run = F.struct(F.col("n").alias("orders"), F.lit(None).cast("int").alias("limit"))
    text = F.concat(F.lit('{"run": {"limit": null, "splits": ['), F.to_json(split("train", smoke=False)), F.lit(", "), F.to_json(split("test", max_rows=50)), F.lit("], "), F.substring(F.to_json(run), 2, 1000), F.lit("}"))
    texts = table(spark, sf, "events").select(F.lit("props").alias("source"), F.col("props").alias("t")).union(n.select(F.lit("run"), text))
    leaves = json_leaves(texts, "source", "t")
    counted = leaves.groupBy("source", "path").agg(F.count("*").alias("leaves"), F.countDistinct("value").alias("distinct_values"))
    cuts = json_cuts(leaves).groupBy("source", "path").agg(F.count("*").alias("cuts"))
    return counted.join(cuts, ["source", "path"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(0).cast("long")))
