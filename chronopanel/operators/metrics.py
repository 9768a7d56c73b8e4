"""Prediction metrics from one shared relation: the curve of distinct scores with their positives and negatives.

Rows are summed by score before anything is ordered, and running sums go through buckets of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.exprs import hash_unit
from chronopanel.operators.ordered import numbered, running
from chronopanel.operators.quantiles import quantile_columns, settled


def curve(rows: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg), weighted if a weight is given."""
    w = F.lit(1) if weight is None else weight
    return rows.groupBy(*(by or []), F.col(p).alias("score")).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))


def _bucket() -> Column:
    return F.floor(F.col("score") * 1024)


def cumulative(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds tp, fp (at or above the score) and the totals."""
    by = by or []
    out = running(c, "score", _bucket(), {"tp": "pos", "fp": "neg"}, by, descending=True)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.join(totals, by) if by else out.join(totals)  # one row of totals


def auroc(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class only."""
    by = by or []
    below = running(c, "score", _bucket(), {"below": "neg"}, by, exclusive=True)
    return below.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


def average_precision(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision with tied scores taken together."""
    by = by or []
    k = cumulative(c, by)
    return k.groupBy(*by).agg(F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def confusion(y: Column, hit: Column, weight: Column | None = None) -> dict[str, Column]:
    w = F.lit(1) if weight is None else weight
    cell = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    return {"tp": cell((y == 1) & hit), "fp": cell((y == 0) & hit), "fn": cell((y == 1) & ~hit), "tn": cell((y == 0) & ~hit)}


def rates(undefined: float | None, suffix: str = "") -> dict[str, Column]:
    """Rates from the four cells; what has no denominator is ``undefined``: 0, or null."""
    tp, fp, fn, tn = (F.col(f"{c}{suffix}").cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(undefined).cast("double"))
    return {"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def log_loss(y: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def bin_of(p: Column, edges: list[float]) -> Column:
    """Number of the bin [edge, next), the last one closed; counted from 0."""
    out = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        out = F.when(p >= e, F.lit(i)).otherwise(out)
    return F.when((p >= edges[0]) & (p <= edges[-1]), out)


def equal_edges(n: int) -> list[float]:
    """Edges i * (1 / n), which is where a linear grid puts them in binary."""
    return [*(i * (1.0 / n) for i in range(n)), 1.0]


def calibration(rows: DataFrame, n: int = 10, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, bin, n, mean_p, rate, gap); empty bins have no row."""
    w = F.lit(1.0) if weight is None else weight
    b = rows.withColumn("bin", bin_of(F.col("p"), equal_edges(n))).where("bin IS NOT NULL").groupBy(*(by or []), "bin")
    out = b.agg(F.sum(w).alias("n"), (F.sum(w * F.col("p")) / F.sum(w)).alias("mean_p"), (F.sum(w * F.col("y")) / F.sum(w)).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibration_error(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    return bins.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def threshold_at_specificity(c: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """Of the thresholds with the specificity, the least one with the highest sensitivity; infinity if none has it."""
    by = by or []
    k = cumulative(c, by).where(1 - F.col("fp") / F.col("n_neg") >= least)
    best = k.groupBy(*by).agg(F.max(F.struct(F.col("tp"), -F.col("score"))).alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.col2"), F.lit(float("inf"))).alias("threshold"))


def youden(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    k = cumulative(c, by).withColumn("j", F.round(F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg"), 12))
    return k.groupBy(*by).agg(F.max_by("score", F.struct("j", -F.col("score"))).alias("threshold"), F.max("j").alias("j"))


def decision_curve(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Net benefit of the model and of treating all, at each threshold. Distinct scores are summed by how many thresholds
    they reach; of those few sums each threshold takes the ones from its place on."""
    ladder = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    reached = F.size(F.filter(ladder, lambda t: t <= F.col("score")))
    cells = curve(rows).groupBy(reached.alias("b")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    one = cells.agg(F.collect_list(F.struct("b", "pos", "neg")).alias("cells"), F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    at = one.select("*", F.posexplode(ladder).alias("i", "threshold"))
    above = lambda c: F.aggregate(F.filter("cells", lambda x: x["b"] > F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x[c])
    odds, rate = F.col("threshold") / (1 - F.col("threshold")), F.col("pos") / F.col("n")
    net = above("pos") / F.col("n") - above("neg") / F.col("n") * odds
    return at.select("threshold", net.alias("net_benefit"), (rate - (1 - rate) * odds).alias("treat_all"))


def bootstrap_draws(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(key, draws): in which replicates each cluster is drawn and how often, when as many are drawn as there are, with
    replacement; an array of ``replicates`` entries at most.

    Draw i of replicate r is the cluster numbered hash(seed, r, i) mod N: the counts are multinomial, and the same in
    any engine. There are replicates times clusters draws; rows are summed by cluster before they are weighted.
    """
    places = settled(numbered(clusters, key, "__i"))
    n = places.count()
    # The places are few and small, so they'd be read by one task: each becomes many draws.
    spread = places.repartition(int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__i")
    drawn = spread.select(F.col("__i").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = drawn.select("replicate", (hash_unit(F.lit(seed), F.col("replicate"), F.col("i")) % n).alias("__i"))
    counts = drawn.groupBy("__i", "replicate").agg(F.count("*").alias("weight"))
    draws = counts.groupBy("__i").agg(F.collect_list(F.struct("replicate", "weight")).alias("draws"))
    return draws.hint("merge").join(places, "__i").select(key, "draws")


def bootstrap_weights(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight), a row for each cluster that a replicate has drawn."""
    return bootstrap_draws(clusters, key, replicates, seed).select(key, F.inline("draws")).select("replicate", key, "weight")


def bootstrap_curves(rows: DataFrame, cluster: str, replicates: int, seed: int, p: str = "p") -> DataFrame:
    """(replicate, score, pos, neg) of clusters drawn with replacement: rows are summed by cluster and score first, meet
    their cluster's draws once, and are summed by replicate and score before they are shuffled again."""
    cells = rows.groupBy(cluster, p).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    drawn = cells.join(bootstrap_draws(rows, cluster, replicates, seed).hint("merge"), cluster).select(F.col(p).alias("score"), "pos", "neg", F.inline("draws"))
    return drawn.groupBy("replicate", "score").agg(F.sum(F.col("pos") * F.col("weight")).alias("pos"), F.sum(F.col("neg") * F.col("weight")).alias("neg"))


def cluster_bootstrap(rows: DataFrame, cluster: str, replicates: int, seed: int, thresholds: dict[str, float] | None = None, p: str = "p") -> DataFrame:
    """(replicate, auroc, auprc, brier, ece) and at each named threshold sensitivity, specificity, ppv, npv and f1.

    The drawn curves are settled; running sums go by replicate and bucket of scores, so no replicate's curve is one task.
    """
    c = settled(bootstrap_curves(rows, cluster, replicates, seed, p))
    totals = c.groupBy("replicate").agg(F.sum("pos").alias("__np"), F.sum("neg").alias("__nn"))
    c = running(c, "score", _bucket(), {"__pb": "pos", "__nb": "neg"}, ["replicate"], exclusive=True).join(totals, "replicate")
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    above, called = F.col("__np") - F.col("__pb"), F.col("__np") + F.col("__nn") - F.col("__pb") - F.col("__nb")
    n, bins, place = F.sum(pos + neg), 10, bin_of(s, equal_edges(10))
    gaps = [F.abs(F.coalesce(F.sum(F.when(place == i, s * (pos + neg) - pos)), F.lit(0.0))) for i in range(bins)]
    aggs = [
        (F.sum(pos * (F.col("__nb") + neg * 0.5)) / F.nullif(F.sum(pos) * F.sum(neg), F.lit(0))).alias("auroc"), F.sum(pos / F.col("__np") * above / called).alias("auprc"),
        (F.sum(pos * (1 - s) * (1 - s) + neg * s * s) / n).alias("brier"), (sum(gaps[1:], gaps[0]) / n).alias("ece"),
    ]
    for name, t in (thresholds or {}).items():
        for cell, value in (("tp", F.when(s >= t, pos)), ("fp", F.when(s >= t, neg)), ("fn", F.when(s < t, pos)), ("tn", F.when(s < t, neg))):
            aggs.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"{cell}_{name}"))
    out = c.groupBy("replicate").agg(*aggs)
    at = [v.alias(f"{k}_{name}") for name in thresholds or {} for k, v in rates(None, f"_{name}").items()]
    return out.select("replicate", "auroc", "auprc", "brier", "ece", *at)


def alarms(rows: DataFrame, events: DataFrame, alerts: DataFrame, entity: str, hour: str, ahead: int, hours: Column | None = None) -> DataFrame:
    """One row: what alerts, already suppressed, tell of first events, and at what price. ``rows`` are the hours watched,
    none of them after its entity's event, or stand for as many as ``hours`` says; an alert is true within ``ahead`` hours
    before it."""
    near = (F.col(hour) >= F.col("event_hour") - ahead) & (F.col(hour) < F.col("event_hour"))
    judged = settled(alerts.join(events, entity, "left").withColumn("hit", F.coalesce(near, F.lit(False))))
    first = judged.where("hit").groupBy(entity).agg(F.min(hour).alias("first"))
    lead = settled(events.join(first, entity, "left").select((F.col("event_hour") - F.col("first")).alias("lead")))
    told = lead.agg(F.count("*").alias("events"), F.count("lead").alias("detected")).join(quantile_columns(lead, "lead", {"lead_q1": 0.25, "lead_median": 0.5, "lead_q3": 0.75}, settle=None))
    price = judged.agg(F.count("*").alias("alerts"), F.count(F.when(F.col("hit"), 1)).alias("true_alerts"), F.countDistinct(F.when(~F.col("hit"), F.col(entity))).alias("with_false"))
    watched = rows.agg(((F.count("*") if hours is None else F.sum(hours)) / 24).alias("days"), F.countDistinct(entity).alias("entities"))
    out = told.join(price).join(watched)  # one row each
    false = F.col("alerts") - F.col("true_alerts")
    return out.select("events", "detected", (F.col("detected") / F.nullif("events", F.lit(0))).alias("event_sensitivity"), "alerts", "true_alerts", (F.col("true_alerts") / F.nullif("alerts", F.lit(0))).alias("ppv"),
                      (100 * F.col("alerts") / F.col("days")).alias("per_100_days"), (100 * false / F.col("days")).alias("false_per_100_days"), "with_false", (F.col("with_false") / F.col("entities")).alias("with_false_share"),
                      "lead_q1", "lead_median", "lead_q3")


def paired_reference(metrics: DataFrame, seed: str, variant: str, value: str, reference: str) -> DataFrame:
    """(seed, variant, diff): each variant's metric less the reference's of the same seed."""
    base = metrics.where(F.col(variant) == reference).select(seed, F.col(value).alias("__base"))
    return metrics.where(F.col(variant) != reference).join(base, seed).select(seed, variant, (F.col(value) - F.col("__base")).alias("diff"))


def percentile_ci(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    by, rows = by or [], settled(rows.select(*(by or []), value))
    means, ends = rows.groupBy(*by).agg(F.avg(value).alias("mean")), quantile_columns(rows, value, {"low": 0.025, "high": 0.975}, by, settle=None)
    return means.join(ends, by) if by else means.join(ends)  # one row each


def paired_p(difference: str, smoothed: bool) -> Column:
    """Two-sided p of bootstrap differences; smoothed adds one to counts."""
    one, n = F.lit(1 if smoothed else 0), F.count(difference)
    tail = lambda c: (F.sum(c.cast("long")) + one) / (n + one)
    return F.least(F.lit(1.0), 2 * F.least(tail(F.col(difference) <= 0), tail(F.col(difference) >= 0)))


def platt(rows: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of the outcome on logit(p) by Newton steps, each one aggregate over distinct scores."""
    from chronopanel.functions.exprs import logit, sigmoid

    c = curve(rows).select(logit(F.col("score")).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("n")).cache()
    a, b = 0.0, 1.0
    try:
        for _ in range(steps):
            q = sigmoid(F.lit(a) + F.lit(b) * F.col("x"))
            r, v = F.col("pos") - F.col("n") * q, F.col("n") * q * (1 - q)
            g0, g1, h00, h01, h11 = c.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") ** 2)).first()
            det = h00 * h11 - h01 * h01
            if not det:
                break
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        c.unpersist()
    return a, b


def scaled(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A score between its least and greatest as a number from 0 to 1, where nothing can be fitted; 0 if it never varies."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))  # one row
    value = F.coalesce((F.col(column) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.0))
    return rows.join(F.broadcast(ends)).withColumn(name, value).drop("__lo", "__hi")
