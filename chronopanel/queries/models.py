"""Fitted models over orders and panels: trees, boosting, logistic regression, additive terms, rule losses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.operators import fitting as L
from chronopanel.operators import search as S
from chronopanel.operators import trees as M
from chronopanel.operators.rules import Term
from chronopanel.queries.base import filled_panel, query, table
from chronopanel.queries.rules import CROSS, E_TERMS, RISK, V_TERMS

FEATURES = ["price", "balance", "nation", "urgency", "month"]
_ROWS = """
WITH x AS (SELECT o_orderkey AS id, (o_orderstatus = 'F')::BIGINT AS y, o_totalprice AS price, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_nationkey::DOUBLE AS nation,
                  substr(o_orderpriority, 1, 1)::DOUBLE AS urgency, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS month
           FROM orders JOIN customer ON o_custkey = c_custkey)"""


def outcomes(spark, sf):
    """Orders with an outcome and five features, one of which is often null."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    date = F.col("o_orderdate")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("long").alias("y"), F.col("o_totalprice").alias("price"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"), F.substring("o_orderpriority", 1, 1).cast("double").alias("urgency"), (F.year(date) * 12 + F.month(date)).cast("double").alias("month"))


_BINNED = _ROWS + """,
q AS (SELECT """ + ", ".join(f"list_sort(list_distinct(quantile_cont({f}, [{', '.join(f'{i / 8}::DOUBLE' for i in range(1, 8))}]))) AS c{k}" for k, f in enumerate(FEATURES)) + """ FROM x),
b AS (""" + " UNION ALL ".join(f"SELECT id, y, {k} AS feature, CASE WHEN {f} IS NULL THEN 0 ELSE 1 + len(list_filter(c{k}, lambda z: z < {f})) END AS bin FROM x, q" for k, f in enumerate(FEATURES)) + """),
h AS (SELECT feature, bin, sum(-y)::DOUBLE AS g, count(*)::DOUBLE AS w FROM b GROUP BY 1, 2)"""


@query(_BINNED + "SELECT feature::INT AS feature, bin::SMALLINT AS bin, g, w FROM h")
def tree_histograms(spark, sf):
    """Gradients and weights of all rows by feature and bin: what a tree's first level is made from."""
    rows = outcomes(spark, sf)
    b = M.binned(rows, FEATURES, M.cuts_of(rows, FEATURES, 8), (-F.col("y").cast("double")).alias("g"))
    each = b.select(F.lit(0).alias("tree"), F.lit(1).alias("node"), "g", F.lit(1.0).alias("h"), F.lit(1.0).alias("w"), "bins")
    return M.histograms(each).select("feature", "bin", "g", "w")


@query(_BINNED + """,
s AS (SELECT *, sum(g) OVER u AS gl, sum(w) OVER u AS wl, sum(g) OVER a AS ga, sum(w) OVER a AS wa FROM h WINDOW u AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
n AS (SELECT feature, bin, round(gl * gl / wl + (ga - gl) * (ga - gl) / nullif(wa - wl, 0) - ga * ga / wa, 9) AS gain FROM s WHERE wl >= 20 AND wa - wl >= 20)
SELECT round(gain, 6) AS gain, feature::INT AS feature, bin::INT AS bin FROM n ORDER BY n.gain DESC, feature, bin LIMIT 1""")
def tree_root_split(spark, sf):
    """The best first split of a tree: a top-1 report."""
    m = M.decision_tree(outcomes(spark, sf), "y", FEATURES, depth=1, least=20, bins=8)
    root = m.trees[0][1]
    return X.rounded(spark.createDataFrame([(float(root.gain), root.feature, root.bin)], "gain double, feature int, bin int"))


@query()
def decision_tree(spark, sf):
    """A tree of depth three as a relation of its nodes."""
    return X.rounded(M.decision_tree(outcomes(spark, sf), "y", FEATURES, depth=3, least=20).relation(spark))


def _halves(spark, sf):
    """Rows to fit on and rows to score, by whole customers' orders: even and odd keys."""
    rows = outcomes(spark, sf)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


@query()
def boosted_scores(spark, sf):
    """Boosted trees fitted on one half, scores of the other."""
    train, test = _halves(spark, sf)
    m = M.boosted(train, "y", FEATURES, n_trees=8, depth=3)
    return X.rounded(test.select("id", "y", m.probability().alias("p")))


@query()
def forest_scores(spark, sf):
    """A forest fitted on one half, scores of the other."""
    train, test = _halves(spark, sf)
    m = M.forest(train, "id", "y", FEATURES, n_trees=8, depth=4)
    return X.rounded(test.select("id", "y", m.score().alias("p")))


@query()
def tree_attributions(spark, sf):
    """Shapley values of every feature in every scored row, beside the score and the mean that they add up to."""
    train, test = _halves(spark, sf)
    m = M.boosted(train, "y", FEATURES, n_trees=4, depth=3)
    out = M.attributions(test.withColumn("score", m.score()), m)
    return X.rounded(out.select("id", "score", F.lit(M.expected(m)).alias("mean"), *[F.col("phi")[i].alias(f) for i, f in enumerate(FEATURES)]))


@query()
def logistic_scores(spark, sf):
    """Class-balanced logistic regression on five features, fitted on one half, scores of the other."""
    train, test = _halves(spark, sf)
    m = L.logistic(train, "y", FEATURES, penalty=0.5)
    return X.rounded(test.select("id", "y", (m.probability() if m else F.lit(0.5)).alias("p")))


@query()
def additive_scores(spark, sf):
    """An additive model of single features and one pair, fitted on one half: scores of the other and every term's part."""
    train, test = _halves(spark, sf)
    m = M.additive(train, "y", FEATURES, pairs=[("price", "month")], rounds=4)
    return X.rounded(test.select("id", "y", m.score().alias("score"), *[c.alias(f"{n} part") for n, c in m.terms().items()]))


# The rule model of the panel: what its terms were, and what they are.
START = {"v": [Term("low", 20.0, 15.0, 0.2), Term("mid", 50.0, 20.0, 0.5), Term("high", 90.0, 25.0, 1.5)], "e": [Term("calm", 10.0, 20.0, 0.1), Term("alarm", 70.0, 30.0, 1.2)]}
NOW = {"v": V_TERMS, "e": [Term(t.name, t.centre + 2.0, t.sigma, t.weight - 0.3) for t in E_TERMS]}


def _rule_model(terms):
    return L.RuleModel(terms, [({"v": i, "e": j}, w) for i, j, w in CROSS], base=-1.0)


def _labelled_panel(spark, sf):
    """Hours with both features, and whether the first exceeds 60 within the six rows that follow."""
    ahead = Window.partitionBy("user_id").orderBy("hr").rowsBetween(1, 6)
    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    return f.select("user_id", "hr", "v", "e", (F.max("v").over(ahead) > 60).cast("long").alias("y"))


def _losses_sql():
    from chronopanel.queries import rules as Q

    e, p = NOW["e"], L.penalties(_rule_model(NOW), _rule_model(START))
    fires = [f"({Q._norm('v', V_TERMS, i)} * {Q._norm('e', e, j)})" for i, j, _ in CROSS]
    cross = " + ".join(f"{f} / ({' + '.join(fires)} + 1e-8) * {w}" for f, (_, _, w) in zip(fires, CROSS, strict=True))
    w = L.Weights()
    fixed = w.sparsity * p["sparsity"] + w.drift * p["drift"] + w.nonnegative * p["nonnegative"]
    return RISK.split(", risk AS")[0] + f""",
m AS (SELECT user_id, hr, max(v) OVER (PARTITION BY user_id ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) > 60 AS y, {Q._risk('v', V_TERMS)} AS rv, {Q._risk('e', e)} AS re, {cross} AS c FROM filled WHERE v IS NOT NULL AND e IS NOT NULL),
r AS (SELECT *, rv + re + 0.2 * c AS risk, exp(tanh((rv + re + 0.2 * c) * 0.8 - 0.5)) AS a FROM m),
s AS (SELECT *, CASE WHEN count(*) OVER t = 6 THEN -1.0 + sum(a * risk) OVER t / sum(a) OVER t END AS z, hr - lag(hr) OVER w AS gap, risk - lag(risk) OVER w AS dt, rv - lag(rv) OVER w AS dv, re - lag(re) OVER w AS de
      FROM r WINDOW w AS (PARTITION BY user_id ORDER BY hr), t AS (PARTITION BY user_id ORDER BY hr ROWS 5 PRECEDING)),
o AS (SELECT avg(CASE WHEN y IS NOT NULL AND z IS NOT NULL THEN CASE WHEN y THEN 2 * ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END END) AS prediction,
             coalesce(avg(CASE WHEN gap = 1 THEN (greatest(dv, 0) + greatest(de, 0)) * greatest(-dt, 0) / 2 END), 0) AS consistency FROM s)
SELECT round(prediction, 6) AS prediction, round(consistency, 6) AS consistency, round({p['sparsity']!r}::DOUBLE, 6) AS sparsity, round({p['drift']!r}::DOUBLE, 6) AS drift, round({p['nonnegative']!r}::DOUBLE, 6) AS nonnegative,
       round(prediction + {w.consistency} * consistency + {fixed!r}::DOUBLE, 6) AS total FROM o"""


@query(_losses_sql())
def rule_losses(spark, sf):
    """The rule model's losses on the panel: weighted prediction, consistency, sparsity, drift, negative weights, total."""
    return X.rounded(L.losses(_labelled_panel(spark, sf), _rule_model(NOW), _rule_model(START), pos_weight=2.0))


@query()
def rule_fit(spark, sf):
    """The total loss before each of five gradient steps and after them."""
    _, seen = L.fit_rules(_labelled_panel(spark, sf), _rule_model(START), steps=5)
    return X.rounded(spark.createDataFrame(list(enumerate(map(float, seen))), "step int, total double"))


@query()
def parameter_search(spark, sf):
    """A seeded search for the slope and middle of a logistic score of the price: every trial, its losses and whether it was
    pruned."""
    y, x = F.col("y").cast("double"), F.col("price") / 100_000

    def loss(v):
        p = X.sigmoid(F.lit(v["slope"]) * (x - v["middle"]))
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return -(y * F.log(p) + (1 - y) * F.log(1 - p))

    trials = S.search(outcomes(spark, sf), "id", loss, {"slope": S.Range(-2.0, 2.0), "middle": S.Range(0.5, 5.0)}, trials=16, batch=8, seed=11)
    rows = [(t.number, t.values["slope"], t.values["middle"], len(t.losses), float(t.losses[-1]), t.pruned) for t in trials]
    return X.rounded(spark.createDataFrame(rows, "trial int, slope double, middle double, rungs int, loss double, pruned boolean"))
