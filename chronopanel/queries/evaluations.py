"""Sensitivity, transfer and comparison analyses composed of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.operators import aggregates as A
from chronopanel.operators import metrics as E
from chronopanel.operators import temporal as T
from chronopanel.operators.ordered import even_buckets, running
from chronopanel.operators.quantiles import settled
from chronopanel.queries.base import FILLED, PREDICTIONS, filled_panel, predictions, query, table

_CUM = PREDICTIONS + """,
curve AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1),
cum AS (SELECT score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, row_number() OVER d - 1 AS i, count(*) OVER () AS n FROM curve WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(_CUM + """, pick AS (SELECT DISTINCT round_even(k * (n - 1) / 19, 0)::BIGINT AS i FROM (SELECT max(n) AS n FROM cum), range(20) t(k))
SELECT i AS point, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cum JOIN pick USING (i)""")
def curve_downsample(spark, sf):
    c = settled(E.curve(predictions(spark, sf)).withColumn("one", F.lit(1).cast("long")))
    k = running(c, "score", even_buckets(c, "score"), {"tp": "pos", "fp": "neg", "nth": "one"}, descending=True).withColumn("point", F.col("nth") - 1)
    n = c.count()  # distinct scores
    points = sorted({round(i * (n - 1) / 19) for i in range(20)})
    return k.where(F.col("point").isin(points)).select("point", "score", "tp", "fp")


def _label_sql(c, rise):
    ahead = f"max({c}) OVER f"
    return f"CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= 6 AND {c} IS NOT NULL AND {ahead} IS NOT NULL THEN ({ahead} - {c} >= {rise})::BIGINT END"


@query(FILLED + f""",
l AS (SELECT {_label_sql('v', 20)} AS a, {_label_sql('e', 20)} AS b, {_label_sql('v', 40)} AS c FROM filled WINDOW f AS (PARTITION BY user_id ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT 'view' AS definition, count(a) AS valid, sum(a)::BIGINT AS positive FROM l UNION ALL SELECT 'error', count(b), sum(b)::BIGINT FROM l UNION ALL SELECT 'steep', count(c), sum(c)::BIGINT FROM l""")
def outcome_sensitivity(spark, sf):
    w = T.timeline("user_id", "hr")
    l = filled_panel(spark, sf).select(*[T.rise_label(c, "hr", 6, r, "user_id", w).alias(n) for n, c, r in (("view", "v", 20.0), ("error", "e", 20.0), ("steep", "v", 40.0))])
    one = l.agg(*[f(n).alias(f"{n}_{k}") for n in l.columns for k, f in (("n", F.count), ("s", F.sum))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(f"{n}_n").alias("valid"), F.col(f"{n}_s").alias("positive")) for n in l.columns])))


@query(FILLED + """,
d AS (SELECT greatest(v - lag(v) OVER w, 0) AS dv, greatest(e - lag(e) OVER w, 0) AS de FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY hr)),
s AS (SELECT sum(dv) AS view, sum(de) AS error FROM d)
SELECT name, round(total, 4) AS total, round(total / sum(total) OVER (), 6) AS share FROM s UNPIVOT (total FOR name IN (view, error))""")
def component_contributions(spark, sf):
    w = T.timeline("user_id", "hr")
    rise = lambda c: F.when(F.lag(c).over(w).isNotNull() & F.col(c).isNotNull(), F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    s = filled_panel(spark, sf).select(rise("v").alias("view"), rise("e").alias("error")).agg(F.sum("view").alias("view"), F.sum("error").alias("error"))
    long = s.unpivot([], ["view", "error"], "name", "total")
    return long.select("name", F.round("total", 4).alias("total"), F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6).alias("share"))


@query(PREDICTIONS + """,
u AS (SELECT cluster % 5 AS seed, 'plain' AS variant, y, p FROM pred UNION ALL SELECT cluster % 5, 'coarse', y, round(p, 1) FROM pred),
c AS (SELECT seed, variant, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seed, variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT seed, variant, (sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE AS auroc FROM b GROUP BY 1, 2),
d AS (SELECT x.seed, x.auroc - y.auroc AS diff FROM a x JOIN a y ON x.seed = y.seed AND x.variant = 'plain' AND y.variant = 'coarse')
SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(coalesce(stddev_samp(diff), 0), 6) AS sd, round(CASE count(*) WHEN 5 THEN 2.776::DOUBLE ELSE 1.96 END * stddev_samp(diff) / sqrt(count(*)), 6) AS half_width FROM d""")
def paired_effects(spark, sf):
    rows = predictions(spark, sf).withColumn("seed", F.col("cluster") % 5)
    u = rows.select("seed", F.lit("plain").alias("variant"), "y", "p").union(rows.select("seed", F.lit("coarse"), "y", F.round("p", 1)))
    a = E.auroc(E.curve(u, by=["seed", "variant"]), ["seed", "variant"])
    d = a.groupBy("seed").pivot("variant", ["plain", "coarse"]).agg(F.first("auroc")).withColumn("diff", F.col("plain") - F.col("coarse"))
    return X.rounded(d.agg(*[c.alias(k) for k, c in A.mean_ci("diff").items()]))


@query(PREDICTIONS + """,
curve AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM pred WHERE id % 2 = 0 GROUP BY 1),
cum AS (SELECT score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(neg) OVER () AS nn FROM curve WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT score AS t FROM cum WHERE 1 - fp / nn >= 0.8 ORDER BY tp DESC, score LIMIT 1)
SELECT count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn, max(t) AS threshold FROM pred, t WHERE id % 2 = 1""")
def model_transfer(spark, sf):
    """A threshold fixed on one half, applied unchanged to the other."""
    rows = predictions(spark, sf)
    t = E.threshold_at_specificity(E.curve(rows.where("id % 2 = 0")), 0.8).first()["threshold"]  # one number
    cells = E.confusion(F.col("y"), F.col("p") >= t)
    return rows.where("id % 2 = 1").agg(*[c.alias(k) for k, c in cells.items()], F.lit(t).alias("threshold"))


@query(PREDICTIONS + "SELECT count(*) AS n, round(max(abs(p - o_totalprice / 600000)), 6) AS worst, max(abs(p - o_totalprice / 600000)) <= 0.0051 AS reproduced FROM pred JOIN orders ON id = o_orderkey")
def reproduction_check(spark, sf):
    again = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 600000).alias("q"))
    worst = F.max(F.abs(F.col("p") - F.col("q")))
    return X.rounded(predictions(spark, sf).join(again, "id").agg(F.count("*").alias("n"), worst.alias("worst"), (worst <= 0.0051).alias("reproduced")))


@query("""
WITH fine AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS metric, 'rows' AS origin FROM orders WHERE o_orderpriority < '4' GROUP BY 1),
legacy AS (SELECT DISTINCT o_orderpriority AS model, 1.0::DOUBLE AS metric, 'legacy' AS origin FROM orders)
SELECT * FROM fine UNION ALL SELECT * FROM legacy WHERE model NOT IN (SELECT model FROM fine)""")
def preferred_rows(spark, sf):
    """Rows computed here take the place of older ones of the same key."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "model")
    fine = o.where("model < '4'").groupBy("model").agg(F.round(F.avg("o_totalprice"), 4).alias("metric")).withColumn("origin", F.lit("rows"))
    legacy = o.select("model").distinct().select("model", F.lit(1.0).alias("metric"), F.lit("legacy").alias("origin"))
    return fine.union(legacy.join(fine, "model", "left_anti"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(sum(l_quantity) OVER w, 6) AS running, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def running_share(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return X.rounded(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.sum("l_quantity").over(w).alias("running"),
        (F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_suppkey"))).alias("share")))
