"""Prediction analytics over orders as predictions, and alarms over the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.operators import aggregates as A
from chronopanel.operators import metrics as E
from chronopanel.operators import joins as J
from chronopanel.operators import temporal as T
from chronopanel.operators.quantiles import quantile_columns, quantile_values, settled
from chronopanel.queries.base import FILLED, PREDICTIONS, events_panel, filled_panel, predictions, query, table

_CURVE = PREDICTIONS + """,
curve AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM curve WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(_CURVE + "SELECT round((sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auroc, round(sum((pos / np) * (tp / (tp + fp)))::DOUBLE, 6) AS average_precision FROM cum")
def auroc_average_precision(spark, sf):
    c = E.curve(predictions(spark, sf))
    return X.rounded(E.auroc(c).join(E.average_precision(c)))  # one row on either side


_CELLS = "count(*) FILTER (y = 1 AND p >= {t}) AS tp, count(*) FILTER (y = 0 AND p >= {t}) AS fp, count(*) FILTER (y = 1 AND p < {t}) AS fn, count(*) FILTER (y = 0 AND p < {t}) AS tn"
_RATES = "round({u} tp / nullif(tp + fn, 0){v}, 6) AS sensitivity, round({u} tn / nullif(tn + fp, 0){v}, 6) AS specificity, round({u} tp / nullif(tp + fp, 0){v}, 6) AS ppv, round({u} tn / nullif(tn + fn, 0){v}, 6) AS npv, round({u} 2 * tp / nullif(2 * tp + fp + fn, 0){v}, 6) AS f1"


@query(PREDICTIONS + f", c AS (SELECT {_CELLS.format(t=0.5)}, avg((p - y) * (p - y)) AS b, -avg(CASE WHEN y = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END) AS l, avg(y) AS v FROM pred) SELECT tp, fp, fn, tn, {_RATES.format(u='coalesce(', v=', 0)')}, round(b, 6) AS brier, round(l, 6) AS log_loss, round(v, 6) AS prevalence FROM c")
def confusion_metrics(spark, sf):
    y, p = F.col("y"), F.col("p")
    cells = predictions(spark, sf).agg(*[c.alias(k) for k, c in E.confusion(y, p >= 0.5).items()], F.avg((p - y) * (p - y)).alias("brier"), E.log_loss(y, p).alias("log_loss"), F.avg("y").alias("prevalence"))
    return X.rounded(cells.withColumns(E.rates(0.0)))


@query(PREDICTIONS + f", c AS (SELECT grp, {_CELLS.format(t=0.82)} FROM pred GROUP BY 1) SELECT grp, tp, fp, fn, tn, {_RATES.format(u='', v='')} FROM c")
def operating_metrics(spark, sf):
    cells = predictions(spark, sf).groupBy("grp").agg(*[c.alias(k) for k, c in E.confusion(F.col("y"), F.col("p") >= 0.82).items()])
    return X.rounded(cells.withColumns(E.rates(None)))


_BIN = "CASE " + " ".join(f"WHEN p >= {e!r} THEN {i}" for i, e in reversed(list(enumerate(E.equal_edges(10)[:-1])))) + " END"


@query(PREDICTIONS + f"SELECT {_BIN} AS bin, count(*)::DOUBLE AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(avg(p) - avg(y)), 6) AS gap FROM pred GROUP BY 1")
def calibration_bins(spark, sf):
    return X.rounded(E.calibration(predictions(spark, sf)))


@query(PREDICTIONS + f", b AS (SELECT segment, {_BIN} AS bin, sum(1 + id % 3) AS n, abs(sum((1 + id % 3) * p) / sum(1 + id % 3) - sum((1 + id % 3) * y) / sum(1 + id % 3)) AS gap FROM pred GROUP BY 1, 2) SELECT segment, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY 1")
def weighted_calibration_error(spark, sf):
    return X.rounded(E.calibration_error(E.calibration(predictions(spark, sf), 10, ["segment"], 1 + F.col("id") % 3), ["segment"]))


@query(PREDICTIONS + """,
q AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM pred),
b AS (SELECT p, y, greatest(len(list_filter(e, lambda x: x < p)), 1) AS bin FROM pred, q)
SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM b GROUP BY 1""")
def quantile_calibration(spark, sf):
    rows = predictions(spark, sf)
    q = quantile_values(rows, "p", [i / 5 for i in range(6)])  # six numbers
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(q))])
    b = F.greatest(F.size(F.filter(edges, lambda x: x < F.col("p"))), F.lit(1)).cast("long")
    return X.rounded(rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")))


@query(_CURVE + "SELECT score AS threshold FROM cum WHERE 1 - fp / nn >= 0.9 ORDER BY tp DESC, score LIMIT 1")
def threshold_at_specificity(spark, sf):
    return E.threshold_at_specificity(E.curve(predictions(spark, sf)), 0.9)


@query(_CURVE + "SELECT score AS threshold, round(round((tp / np - fp / nn)::DOUBLE, 12), 6) AS j FROM cum ORDER BY round((tp / np - fp / nn)::DOUBLE, 12) DESC, score LIMIT 1")
def youden_threshold(spark, sf):
    return X.rounded(E.youden(E.curve(predictions(spark, sf))))


@query(PREDICTIONS + """,
c AS (SELECT p AS score, sum((1 + id % 3) * y) AS pos, sum((1 + id % 3) * (1 - y)) AS neg FROM pred GROUP BY 1),
k AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS np, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round((sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auroc, round(sum((pos / np) * (tp / (tp + fp)))::DOUBLE, 6) AS average_precision FROM k""")
def weighted_metrics(spark, sf):
    c = E.curve(predictions(spark, sf), weight=1 + F.col("id") % 3)
    return X.rounded(E.auroc(c).join(E.average_precision(c)))  # one row on either side


_BOOT = PREDICTIONS + """,
k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i FROM (SELECT DISTINCT cluster FROM pred)),
d AS (SELECT r AS replicate, ('0x' || substr(md5('17|' || r || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS i FROM k, range(200) t(r)),
w AS (SELECT replicate, cluster, count(*) AS weight FROM d JOIN k USING (i) GROUP BY 1, 2),
c AS (SELECT replicate, p AS score, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM pred JOIN w USING (cluster) GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER h AS above, sum(pos + neg) OVER h AS called, sum(pos) OVER (PARTITION BY replicate) AS np
      FROM c WINDOW h AS (PARTITION BY replicate ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
boot AS (SELECT replicate, (sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE AS auroc, sum(pos / np * (above / called))::DOUBLE AS auprc, sum(pos * (1 - score) * (1 - score) + neg * score * score) / sum(pos + neg) AS brier FROM b GROUP BY 1)"""
_FIXED = """,
whole AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1),
cums AS (SELECT score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(neg) OVER () AS nn FROM whole WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
th AS (SELECT (SELECT score FROM cums WHERE 1 - fp / nn >= 0.9 ORDER BY tp DESC, score LIMIT 1) AS t90, (SELECT score FROM cums WHERE 1 - fp / nn >= 0.8 ORDER BY tp DESC, score LIMIT 1) AS t80),
cells AS (SELECT replicate, """ + ", ".join(f"sum(CASE WHEN score >= t{k} THEN pos ELSE 0 END) AS tp{k}, sum(CASE WHEN score >= t{k} THEN neg ELSE 0 END) AS fp{k}, sum(CASE WHEN score < t{k} THEN pos ELSE 0 END) AS fn{k}, sum(CASE WHEN score < t{k} THEN neg ELSE 0 END) AS tn{k}" for k in (90, 80)) + " FROM c, th GROUP BY 1)"
_AT = ", ".join(
    f"round(tp{k} / nullif(tp{k} + fn{k}, 0), 9) AS sensitivity_at{k}, round(tn{k} / nullif(tn{k} + fp{k}, 0), 9) AS specificity_at{k}, round(tp{k} / nullif(tp{k} + fp{k}, 0), 9) AS ppv_at{k},"
    f" round(tn{k} / nullif(tn{k} + fn{k}, 0), 9) AS npv_at{k}, round(2 * tp{k} / nullif(2 * tp{k} + fp{k} + fn{k}, 0), 9) AS f1_at{k}" for k in (90, 80))  # fmt: skip
_BIN_SCORE = "CASE " + " ".join(f"WHEN score >= {e!r} THEN {i}" for i, e in reversed(list(enumerate(E.equal_edges(10)[:-1])))) + " END"
REPLICATES = 200


@query(_BOOT + _FIXED + f""",
bins AS (SELECT replicate, {_BIN_SCORE} AS bin, sum(pos + neg) AS n, abs(sum(score * (pos + neg)) - sum(pos)) AS gap FROM c GROUP BY 1, 2), e AS (SELECT replicate, sum(gap) / sum(n) AS ece FROM bins GROUP BY 1)
SELECT replicate, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(brier, 9) AS brier, round(ece, 9) AS ece, {_AT} FROM boot JOIN e USING (replicate) JOIN cells USING (replicate)""")
def cluster_bootstrap(spark, sf):
    """Thresholds are fixed on all rows at two specificities; each replicate tells what they give."""
    rows = predictions(spark, sf)
    c = E.curve(rows)
    fixed = {f"at{round(100 * s)}": E.threshold_at_specificity(c, s).first()["threshold"] for s in (0.9, 0.8)}  # two numbers
    return X.rounded(E.cluster_bootstrap(rows, "cluster", REPLICATES, 17, fixed), 9)


@query(_BOOT + "SELECT round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high FROM boot")
def bootstrap_interval(spark, sf):
    return X.rounded(E.percentile_ci(E.cluster_bootstrap(predictions(spark, sf), "cluster", REPLICATES, 17), "auroc"))


@query(_BOOT + """,
c2 AS (SELECT replicate, round(p, 1) AS score, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM pred JOIN w USING (cluster) GROUP BY 1, 2),
b2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c2),
other AS (SELECT replicate, (sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE AS auroc FROM b2 GROUP BY 1),
x AS (SELECT round(boot.auroc - other.auroc, 9) AS diff FROM boot JOIN other USING (replicate))
SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high,
       round(least(1, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))), 6) AS p_plain, round(least(1, 2 * least((sum((diff <= 0)::INT) + 1) / (count(*) + 1), (sum((diff >= 0)::INT) + 1) / (count(*) + 1))), 6) AS p_smoothed FROM x""")
def paired_bootstrap(spark, sf):
    """Two models, the fine score and the coarse one, on the same draws: the difference of their areas and both p values."""
    rows = predictions(spark, sf).withColumn("coarse", F.round("p", 1))
    a, b = (E.cluster_bootstrap(rows, "cluster", REPLICATES, 17, p=p).select("replicate", F.col("auroc").alias(p)) for p in ("p", "coarse"))
    x = settled(a.join(b, "replicate").select(F.round(F.col("p") - F.col("coarse"), 9).alias("diff")))
    told = x.agg(F.count("*").alias("n"), E.paired_p("diff", False).alias("p_plain"), E.paired_p("diff", True).alias("p_smoothed"))
    return X.rounded(told.join(E.percentile_ci(x, "diff")))  # one row each


@query(PREDICTIONS + """, t AS (SELECT k / 100.0::DOUBLE AS t FROM range(1, 51) r(k))
SELECT t AS threshold, round(avg(CASE WHEN p >= t THEN y ELSE 0 END) - avg(CASE WHEN p >= t THEN 1 - y ELSE 0 END) * (t / (1 - t)), 6) AS net_benefit, round(avg(y) - (1 - avg(y)) * (t / (1 - t)), 6) AS treat_all FROM pred, t GROUP BY t""")
def decision_curve(spark, sf):
    return X.rounded(E.decision_curve(predictions(spark, sf), [k / 100.0 for k in range(1, 51)]))


@query(PREDICTIONS + f""",
c AS (SELECT grp, {_CELLS.format(t=0.5)} FROM pred GROUP BY 1), b AS (SELECT grp, {_BIN} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM pred GROUP BY 1, 2),
e AS (SELECT grp, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b GROUP BY 1)
SELECT grp, tp, fp, fn, tn, {_RATES.format(u='', v='')}, round(ece, 6) AS ece, round(mce, 6) AS mce FROM c JOIN e USING (grp)""")
def classification_report(spark, sf):
    """Rates that are null where undefined, beside the calibration errors."""
    rows = predictions(spark, sf)
    cells = rows.groupBy("grp").agg(*[c.alias(k) for k, c in E.confusion(F.col("y"), F.col("p") >= 0.5).items()]).withColumns(E.rates(None))
    return X.rounded(cells.join(E.calibration_error(E.calibration(rows, 10, ["grp"]), ["grp"]), "grp"))


@query(PREDICTIONS + """,
x AS (SELECT y, CASE WHEN id % 11 = 0 THEN 'nan'::DOUBLE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'inf'::DOUBLE ELSE p END AS p FROM pred)
SELECT count(*) AS rows_in, count(*) FILTER (p IS NULL OR NOT isfinite(p)) AS dropped, round(avg((p - y) * (p - y)) FILTER (isfinite(p)), 6) AS brier FROM x""")
def evaluated_predictions(spark, sf):
    """Predictions that aren't finite numbers are left out and counted."""
    i = F.col("id")
    p = F.when(i % 11 == 0, F.lit(float("nan"))).when(i % 13 == 0, F.lit(None)).when(i % 17 == 0, F.lit(float("inf"))).otherwise(F.col("p"))
    x = predictions(spark, sf).select("y", X.finite(p).alias("p"))
    return X.rounded(x.agg(F.count("*").alias("rows_in"), F.count(F.when(F.col("p").isNull(), 1)).alias("dropped"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")))


@query(PREDICTIONS + "SELECT id, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS scaled FROM pred")
def minmax_calibrator(spark, sf):
    """What stands in for a calibrator where none can be fitted."""
    return X.rounded(E.scaled(predictions(spark, sf), "p", "scaled").select("id", "scaled"))


@query(PREDICTIONS + """,
u AS (SELECT cluster % 5 AS seed, 'reference' AS variant, y, p FROM pred UNION ALL SELECT cluster % 5, 'tenths', y, round(p, 1) FROM pred UNION ALL SELECT cluster % 5, 'twentieths', y, floor(p * 20) / 20 FROM pred),
c AS (SELECT seed, variant, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seed, variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT seed, variant, (sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE AS auroc FROM b GROUP BY 1, 2),
d AS (SELECT x.variant, x.auroc - y.auroc AS diff FROM a x JOIN a y ON x.seed = y.seed AND x.variant <> 'reference' AND y.variant = 'reference')
SELECT variant, count(*) AS n, round(avg(diff), 6) AS mean, round(coalesce(stddev_samp(diff), 0), 6) AS sd, round(CASE count(*) WHEN 5 THEN 2.776::DOUBLE ELSE 1.96 END * stddev_samp(diff) / sqrt(count(*)), 6) AS half_width FROM d GROUP BY 1""")
def paired_variants(spark, sf):
    """Every variant against the reference, paired by seed."""
    rows = predictions(spark, sf).withColumn("seed", F.col("cluster") % 5)
    scores = {"reference": F.col("p"), "tenths": F.round("p", 1), "twentieths": F.floor(F.col("p") * 20) / 20}
    u = rows.select("seed", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), s.alias("p")) for k, s in scores.items()])).alias("v")).select("seed", "y", "v.*")
    d = E.paired_reference(E.auroc(E.curve(u, by=["seed", "variant"]), ["seed", "variant"]), "seed", "variant", "auroc", "reference")
    return X.rounded(d.groupBy("variant").agg(*[c.alias(k) for k, c in A.mean_ci("diff").items()]))


@query(PREDICTIONS + """,
k AS (SELECT id, p, CASE WHEN y = 1 AND p >= 0.5 THEN 'TP' WHEN y = 0 AND p >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' END AS kind FROM pred), m AS (SELECT kind, quantile_cont(p, 0.5) AS med FROM k WHERE kind IS NOT NULL GROUP BY 1)
SELECT kind, id, p FROM k JOIN m USING (kind) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(abs(p - med), 9), id) = 1""")
def case_pick(spark, sf):
    """Of true positives, false positives and false negatives, the row closest to its class's median."""
    y, hit = F.col("y") == 1, F.col("p") >= 0.5
    k = predictions(spark, sf).select("id", "p", F.when(y & hit, "TP").when(~y & hit, "FP").when(y, "FN").alias("kind")).where("kind IS NOT NULL")
    m = quantile_columns(k, "p", {"med": 0.5}, ["kind"])
    near = F.struct(F.round(F.abs(F.col("p") - F.col("med")), 9).alias("d"), F.col("id"), F.col("p"))
    return k.join(m, "kind").groupBy("kind").agg(F.min(near).alias("b")).select("kind", "b.id", "b.p")


@query(PREDICTIONS + """,
q AS (SELECT quantile_cont(p, 0.5) AS q1, quantile_cont(p, 0.8) AS q2 FROM pred WHERE id % 2 = 0)
SELECT CASE WHEN p <= q1 THEN 'low' WHEN p <= q2 THEN 'mid' ELSE 'high' END AS stratum, count(*) AS n, round(avg(y), 6) AS rate, round(avg(p), 6) AS mean_p FROM pred, q WHERE id % 2 = 1 GROUP BY 1""")
def risk_strata(spark, sf):
    """Cut-offs from the validation half, applied to the test half."""
    rows = predictions(spark, sf)
    q = quantile_values(rows.where("id % 2 = 0"), "p", [0.5, 0.8])  # two numbers
    s = X.right_closed_band(F.col("p"), [float("-inf"), q[0], q[1]], ["low", "mid", "high"])
    return X.rounded(rows.where("id % 2 = 1").groupBy(s.alias("stratum")).agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("p").alias("mean_p")))


@query(_CURVE + "SELECT score, round((tp / np)::DOUBLE, 6) AS tpr, round((fp / nn)::DOUBLE, 6) AS fpr, round((tp / (tp + fp))::DOUBLE, 6) AS precision FROM cum")
def curve_points(spark, sf):
    k = E.cumulative(E.curve(predictions(spark, sf)))
    return X.rounded(k.select("score", (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")))


_BY_GROUP = """
SELECT 'priority' AS factor, grp AS g, y, p FROM pred UNION ALL SELECT 'segment', segment, y, p FROM pred UNION ALL SELECT 'site', site::VARCHAR, y, p FROM pred"""


@query(PREDICTIONS + f""",
u AS ({_BY_GROUP}), c AS (SELECT factor, g, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY factor, g ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT factor, g, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round((sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auroc FROM b GROUP BY 1, 2 HAVING sum(pos) >= 20 AND sum(neg) >= 20""")
def subgroup_performance(spark, sf):
    rows = predictions(spark, sf).select("y", "p", F.col("grp").alias("priority"), "segment", F.col("site").cast("string").alias("site"))
    u = rows.unpivot(["y", "p"], ["priority", "segment", "site"], "factor", "g")
    c = E.curve(u, by=["factor", "g"])
    sizes = c.groupBy("factor", "g").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos >= 20 AND n_neg >= 20")
    return X.rounded(sizes.join(E.auroc(c, ["factor", "g"]), ["factor", "g"]))


@query(PREDICTIONS + """,
c AS (SELECT site, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY site ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT site, (sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE AS auroc FROM b GROUP BY 1)
SELECT count(*) AS sites, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.5), 6) AS median, round(quantile_cont(auroc, 0.25), 6) AS q1, round(quantile_cont(auroc, 0.75), 6) AS q3, round(min(auroc), 6) AS least, round(max(auroc), 6) AS most FROM a""")
def site_heterogeneity(spark, sf):
    a = settled(E.auroc(E.curve(predictions(spark, sf), by=["site"]), ["site"]))
    told = a.agg(F.count("*").alias("sites"), F.avg("auroc").alias("mean"), F.min("auroc").alias("least"), F.max("auroc").alias("most"))
    return X.rounded(told.join(quantile_columns(a, "auroc", {"median": 0.5, "q1": 0.25, "q3": 0.75})))  # one row each


_FIRST = FILLED + """,
start AS (SELECT user_id, min(hr) AS t FROM filled WHERE v > 40 GROUP BY 1),
base AS (SELECT s.user_id, t, v AS score FROM start s JOIN filled f ON s.user_id = f.user_id AND hr = t),
event AS (SELECT b.user_id, t, score, min(hr) AS event_hour FROM base b JOIN filled f ON f.user_id = b.user_id AND hr > t AND hr <= t + 12 AND v >= score + 2 GROUP BY 1, 2, 3)"""


def _first_events(spark, sf):
    """The first hour above 40 of each entity, and the first within twelve hours after it that is 2 above that: both by
    windows over the entity's timeline, no join."""
    w = T.timeline("user_id", "hr")
    whole = Window.partitionBy("user_id")
    f = filled_panel(spark, sf).select("user_id", "hr", "v")
    f = f.withColumn("t", F.min(F.when(F.col("v") > 40, F.col("hr"))).over(whole)).where("hr >= t")
    f = f.withColumn("score", F.first("v").over(w)).where("hr > t AND hr <= t + 12 AND v >= score + 2")
    return f.groupBy("user_id", "t", "score").agg(F.min("hr").alias("event_hour"))


@query(_FIRST + "SELECT user_id, t, round(score, 6) AS score, event_hour FROM event")
def first_events(spark, sf):
    return X.rounded(_first_events(spark, sf))


@query(_FIRST + """,
lead AS (SELECT e.user_id, event_hour, event_hour - min(p.hr) AS lead_time FROM event e LEFT JOIN (SELECT user_id, hr FROM panel WHERE err > 30) p ON p.user_id = e.user_id AND p.hr >= event_hour - 6 AND p.hr < event_hour GROUP BY 1, 2)
SELECT count(*) AS events, count(lead_time) AS detected, round(quantile_cont(lead_time, 0.5), 6) AS median, round(quantile_cont(lead_time, 0.75), 6) AS q3 FROM lead""")
def lead_time(spark, sf):
    e = settled(_first_events(spark, sf).select("user_id", "event_hour"))
    a = events_panel(spark, sf).where("err > 30").select("user_id", "hr")
    near = J.band(e, a, "user_id", F.col("event_hour") - 7, F.col("event_hour") - 1, "hr", 24).groupBy("user_id", "event_hour").agg(F.min("hr").alias("first"))
    lead = settled(e.join(near, ["user_id", "event_hour"], "left").select((F.col("event_hour") - F.col("first")).alias("lead_time")))
    told = lead.agg(F.count("*").alias("events"), F.count("lead_time").alias("detected"))
    return X.rounded(told.join(quantile_columns(lead, "lead_time", {"median": 0.5, "q3": 0.75})))  # one row each


@query(_FIRST.replace("WITH bounds", "WITH RECURSIVE bounds") + """,
watched AS (SELECT p.user_id, p.hr, p.err FROM panel p LEFT JOIN event e USING (user_id) WHERE event_hour IS NULL OR p.hr < event_hour),
alerts AS (SELECT DISTINCT user_id, hr FROM watched WHERE err > 30),
kept AS (SELECT user_id, min(hr) AS hr FROM alerts GROUP BY 1 UNION ALL
         SELECT k.user_id, (SELECT min(a.hr) FROM alerts a WHERE a.user_id = k.user_id AND a.hr >= k.hr + 6) FROM kept k WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.user_id = k.user_id AND a.hr >= k.hr + 6)),
judged AS (SELECT k.user_id, k.hr, event_hour, coalesce(k.hr >= event_hour - 6 AND k.hr < event_hour, FALSE) AS hit FROM kept k LEFT JOIN event USING (user_id)),
lead AS (SELECT e.user_id, e.event_hour - min(j.hr) AS lead FROM event e LEFT JOIN judged j ON j.user_id = e.user_id AND j.hit GROUP BY e.user_id, e.event_hour),
price AS (SELECT count(*) AS alerts, count(*) FILTER (hit) AS hits, count(DISTINCT user_id) FILTER (NOT hit) AS with_false FROM judged),
told AS (SELECT count(*) AS events, count(lead) AS detected, quantile_cont(lead, 0.25) AS q1, quantile_cont(lead, 0.5) AS med, quantile_cont(lead, 0.75) AS q3 FROM lead),
days AS (SELECT count(*) / 24 AS d, count(DISTINCT user_id) AS n FROM watched)
SELECT events, detected, round(detected / nullif(events, 0), 6) AS event_sensitivity, alerts, hits AS true_alerts, round(hits / nullif(alerts, 0), 6) AS ppv, round(100 * alerts / d, 6) AS per_100_days,
       round(100 * (alerts - hits) / d, 6) AS false_per_100_days, with_false, round(with_false / n, 6) AS with_false_share, round(q1, 6) AS lead_q1, round(med, 6) AS lead_median, round(q3, 6) AS lead_q3 FROM price, told, days""")
def alarm_burden(spark, sf):
    """Alerts before first events only: hours from an entity's event on are neither watched nor alarmed."""
    w, whole = T.timeline("user_id", "hr"), Window.partitionBy("user_id")
    first = lambda condition, c: F.min(F.when(condition, F.col(c))).over(whole)
    p = events_panel(spark, sf).select("user_id", "hr", "err", T.locf("view", w).alias("v"))
    p = p.withColumn("t", first(F.col("v") > 40, "hr")).withColumn("score", first(F.col("hr") == F.col("t"), "v"))
    p = p.withColumn("event_hour", first(F.expr("hr > t AND hr <= t + 12 AND v >= score + 2"), "hr"))
    p = p.withColumn("before", F.expr("event_hour IS NULL OR hr < event_hour")).withColumn("watched", F.count(F.when(F.col("before"), 1)).over(whole))
    # The panel is read once: what alarms, and an hour of each entity for its event and how long it was watched.
    few = settled(p.withColumn("alarmed", F.expr("before AND coalesce(err > 30, false)")).where("alarmed OR hr = 0"))
    entities = few.where("hr = 0").select("user_id", "event_hour", "watched")
    kept = T.refractory_alerts(few.where("alarmed"), "user_id", "hr", 6)
    return X.rounded(E.alarms(entities, entities.where("event_hour IS NOT NULL").select("user_id", "event_hour"), kept, "user_id", "hr", 6, F.col("watched")))


@query()
def platt_calibration(spark, sf):
    """Intercept and slope on logit(p), fitted on half of the rows and applied to the rest."""
    rows = predictions(spark, sf)
    a, b = E.platt(rows.where("id % 2 = 0"))
    return X.rounded(rows.where("id % 2 = 1").select("id", "y", "p", X.sigmoid(F.lit(a) + F.lit(b) * X.logit(F.col("p"))).alias("calibrated")))


@query("""
WITH d AS (SELECT doc_id, source, quality AS y, round(least(n_chars, 10000) / 10000, 2) AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round((sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auroc FROM b""")
def label_transfer(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.round(F.least("n_chars", F.lit(10000)) / 10000, 2).alias("p"))
    return X.rounded(E.auroc(E.curve(d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id"))))
