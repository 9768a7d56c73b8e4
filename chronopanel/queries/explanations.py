"""Rule inventories, firing sensitivity and stability; equal samples; site bootstrap; file discovery."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.operators import fitting as L
from chronopanel.operators import metrics as E
from chronopanel.operators import protocol as D
from chronopanel.operators import rules as R
from chronopanel.operators.quantiles import quantile_columns, settled
from chronopanel.operators.temporal import average_rank
from chronopanel.queries.base import FILLED, PREDICTIONS, filled_panel, predictions, query, table
from chronopanel.queries.protocols import _HASH
from chronopanel.queries.rules import CROSS, E_TERMS, NAMED_CROSS, RISK, TRAINED, V_TERMS, _norm, _risk_panel
from chronopanel.sources import ingest


_INVENTORY = [("feature", f"{f}={t.name}", t.weight, _norm(f, terms, i)) for f, terms in TRAINED.items() for i, t in enumerate(terms)]
_INVENTORY += [("cross", " & ".join(sorted(f"{f}={t}" for f, t in terms)), w, f"({_norm('v', V_TERMS, i)} * {_norm('e', E_TERMS, j)})") for (_, terms, w), (i, j, _) in zip(NAMED_CROSS, CROSS, strict=True)]


@query(FILLED + ", r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{s}' AS signature, {w}::DOUBLE AS importance, avg({m}) AS firing FROM filled WHERE v IS NOT NULL AND e IS NOT NULL" for k, s, w, m in _INVENTORY) + """)
SELECT kind, signature, round(importance, 6) AS importance, round(firing, 6) AS firing, rank() OVER (ORDER BY round(importance * firing, 9) DESC, signature)::BIGINT AS place FROM r""")
def rule_inventory(spark, sf):
    """All rules of the base with a signature that doesn't depend on the order of their antecedents, how strongly they fire
    in the panel, and their place by weight times firing."""
    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    share = {(n, t.name): m for n, terms in TRAINED.items() for t, m in zip(terms, R.normalised(F.col(n), terms), strict=True)}
    rules = [("feature", [(n, t.name)], t.weight) for n, terms in TRAINED.items() for t in terms] + [("cross", list(terms), w) for _, terms, w in NAMED_CROSS]
    one = f.agg(*[F.avg(R.firing([share[t] for t in parts])).alias(f"r{i}") for i, (_, parts, _) in enumerate(rules)])
    rows = [F.struct(F.lit(kind).alias("kind"), F.array_join(F.sort_array(F.array(*[F.lit(f"{n}={t}") for n, t in parts])), " & ").alias("signature"), F.abs(F.lit(w)).alias("importance"), F.col(f"r{i}").alias("firing"))
            for i, (kind, parts, w) in enumerate(rules)]
    out = one.select(F.inline(F.array(*rows)))
    return X.rounded(out.withColumn("place", F.rank().over(Window.orderBy(F.round(F.col("importance") * F.col("firing"), 9).desc(), "signature")).cast("long")))  # a rule base is small


_FIRING = [f"({_norm('v', V_TERMS, i)} * {_norm('e', E_TERMS, j)})" for i, j, _ in CROSS]


@query(FILLED + f""",
f AS (SELECT hr % 2 AS y, {' , '.join(f'{x} AS f{k}' for k, x in enumerate(_FIRING))} FROM filled WHERE v IS NOT NULL AND e IS NOT NULL),
c AS (SELECT y, t, {' + '.join(f'(f{k} >= t)::INT' for k in range(len(CROSS)))} AS active FROM f, (VALUES (0.1::DOUBLE), (0.3), (0.5)) h(t))
SELECT t AS threshold, active::BIGINT AS active, count(*) AS n, sum(y)::BIGINT AS positives FROM c GROUP BY 1, 2""")
def rule_firing_histogram(spark, sf):
    """How many rules fire at each threshold: rows are counted by the number of active rules, thresholds in one pass."""
    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    mv, me = R.normalised(F.col("v"), V_TERMS), R.normalised(F.col("e"), E_TERMS)
    firings = [R.firing([mv[i], me[j]]) for i, j, _ in CROSS]
    active = [F.struct(F.lit(t).alias("threshold"), sum(((x >= t).cast("long") for x in firings), F.lit(0).cast("long")).alias("active")) for t in (0.1, 0.3, 0.5)]
    rows = f.select((F.col("hr") % 2).alias("y"), F.inline(F.array(*active)))
    return rows.groupBy("threshold", "active").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query(RISK + """,
m AS (SELECT (v > 60)::BIGINT AS y, additive, cross_risk FROM risk)
SELECT y, count(*) AS n, round(avg(additive), 6) AS mean, round(stddev_samp(additive), 6) AS sd, round(quantile_cont(additive, 0.5), 6) AS median,
       round(quantile_cont(additive, 0.75) - quantile_cont(additive, 0.25), 6) AS iqr, round(avg(cross_risk), 6) AS cross_mean FROM m GROUP BY 1""")
def activated_rule_summary(spark, sf):
    m = settled(_risk_panel(spark, sf).select((F.col("v") > 60).cast("long").alias("y"), "additive", "cross_risk"))
    means = m.groupBy("y").agg(F.count("*").alias("n"), F.avg("additive").alias("mean"), F.stddev_samp("additive").alias("sd"), F.avg("cross_risk").alias("cross_mean"))
    q = quantile_columns(m, "additive", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["y"], settle=None).withColumnRenamed("y", "__y")
    out = means.join(q, F.col("y").eqNullSafe(F.col("__y"))).select("y", "n", "mean", "sd", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "cross_mean")
    return X.rounded(out)


@query("""
WITH t AS (SELECT l_suppkey % 4 AS seed, l_partkey % 50 AS rule, sum(l_quantity) AS importance FROM lineitem GROUP BY 1, 2),
top AS (SELECT seed, rule FROM t QUALIFY row_number() OVER (PARTITION BY seed ORDER BY importance DESC, rule) <= 15),
n AS (SELECT a.seed AS a, b.seed AS b, count(*) AS shared FROM top a JOIN top b ON a.rule = b.rule AND a.seed < b.seed GROUP BY 1, 2)
SELECT a AS first_seed, b AS second_seed, round(shared / (30 - shared), 6) AS similarity FROM n""")
def rule_stability(spark, sf):
    """Similarity of the top rules between seeds."""
    t = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("seed"), (F.col("l_partkey") % 50).alias("rule")).agg(F.sum("l_quantity").alias("importance"))
    w = Window.partitionBy("seed").orderBy(F.col("importance").desc(), "rule")
    top = t.withColumn("rn", F.row_number().over(w)).where("rn <= 15").select("seed", "rule")
    a, b = top.toDF("first_seed", "rule"), top.toDF("second_seed", "rule")
    n = a.join(b, "rule").where("first_seed < second_seed").groupBy("first_seed", "second_seed").agg(F.count("*").alias("shared"))
    return X.rounded(n.select("first_seed", "second_seed", (F.col("shared") / (30 - F.col("shared"))).alias("similarity")))


@query("""
WITH p AS (SELECT p_brand AS grp, p_retailprice AS trained, 900 + p_partkey % 1000 AS initial FROM part)
SELECT grp, round(sqrt(avg((trained - initial) * (trained - initial))) / (sqrt(avg(initial * initial)) + 1), 6) AS drift FROM p GROUP BY 1""")
def parameter_drift(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("trained"), (900 + F.col("p_partkey") % 1000).cast("double").alias("initial"))
    rms = lambda x: F.sqrt(F.avg(x * x))
    return X.rounded(p.groupBy("grp").agg((rms(F.col("trained") - F.col("initial")) / (rms(F.col("initial")) + 1)).alias("drift")))


def _quota(n, part):
    return f"""o{part} AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y FROM orders WHERE o_custkey % 3 = {part}),
k{part} AS (SELECT least({n}, count(*)) AS m, sum(y) AS p, count(*) AS c FROM o{part}),
s{part} AS (SELECT o_orderkey, y, {part}::BIGINT AS part FROM o{part}, k{part} QUALIFY row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(seed=5, key='o_orderkey')}, o_orderkey)
       <= CASE WHEN y = 1 THEN least(greatest(round_even(m * p / c, 0), 1), p, m - 1) ELSE m - least(greatest(round_even(m * p / c, 0), 1), p, m - 1) END)"""


@query(f"WITH {_quota(400, 0)}, {_quota(200, 1)} SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT o_orderkey, (o_orderstatus = 'F')::INT, 2 FROM orders WHERE o_custkey % 3 = 2")
def equal_sample_manifest(spark, sf):
    """Equal-sized samples of the first two parts with their prevalence; the last part is kept whole."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_custkey") % 3).alias("part"))
    a, b = (D.stratified_sample(o.where(F.col("part") == k), "o_orderkey", "y", n, 5) for k, n in ((0, 400), (1, 200)))
    return a.union(b).union(o.where("part = 2"))


@query(PREDICTIONS + """,
k AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS i FROM (SELECT DISTINCT site FROM pred)),
d AS (SELECT r AS replicate, ('0x' || substr(md5('23|' || r || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS i FROM k, range(500) t(r)),
w AS (SELECT replicate, site, count(*) AS weight FROM d JOIN k USING (i) GROUP BY 1, 2)
SELECT replicate, round(sum(weight * y) / sum(weight), 9) AS prevalence, round(sum(weight * (p - y) * (p - y)) / sum(weight), 9) AS brier FROM pred JOIN w USING (site) GROUP BY 1""")
def site_bootstrap(spark, sf):
    rows = predictions(spark, sf)
    cells = rows.groupBy("site").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum((F.col("p") - F.col("y")) ** 2).alias("err"))
    drawn = cells.join(E.bootstrap_weights(rows, "site", 500, 23), "site")
    w = F.col("weight")
    return X.rounded(drawn.groupBy("replicate").agg((F.sum(w * F.col("pos")) / F.sum(w * F.col("n"))).alias("prevalence"), (F.sum(w * F.col("err")) / F.sum(w * F.col("n"))).alias("brier")), 9)


@query("""
SELECT o_orderpriority AS strategy, count(*) AS n, round(avg((o_totalprice >= 250000)::INT), 6) AS alerts, round(avg((o_orderstatus = 'F')::INT) FILTER (o_totalprice >= 250000), 6) AS ppv,
       round(avg((o_totalprice >= 250000)::INT) FILTER (o_orderstatus = 'F'), 6) AS sensitivity FROM orders GROUP BY 1""")
def score_strategies(spark, sf):
    high, y = F.col("o_totalprice") >= 250_000, F.col("o_orderstatus") == "F"
    one = lambda c: c.cast("int")
    return X.rounded(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count("*").alias("n"), F.avg(one(high)).alias("alerts"), F.avg(F.when(high, one(y))).alias("ppv"), F.avg(F.when(y, one(high))).alias("sensitivity")))


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def discover_files(spark, sf):
    """The tables found below a directory, whatever is there: names come from the paths, contents aren't read."""
    found = ingest.files(spark, sf, "*.parquet").select(F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("name"))
    return found.where("name <> ''").distinct()


@query("""
WITH m AS (SELECT label, i, avg(abs(x)) AS a FROM (SELECT label % 2 AS label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
w AS (SELECT i, round(max(a) FILTER (label = 0), 9) AS x, round(max(a) FILTER (label = 1), 9) AS y FROM m GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM w)
SELECT round(corr(rx, ry), 6) AS rho FROM r""")
def attribution_agreement(spark, sf):
    """How far two datasets rank the same variables as important: rank correlation of mean absolute attributions."""
    e = table(spark, sf, "embeddings").select((F.col("label") % 2).alias("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    w = e.groupBy("i").pivot("label", [0, 1]).agg(F.round(F.avg(F.abs("x")), 9)).withColumnsRenamed({"0": "x", "1": "y"})
    return X.rounded(average_rank(average_rank(w, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho")))


@query()
def score_calibrator(spark, sf):
    """Class-balanced logistic on one score: weights make both classes count alike, and where only one class is there the
    score is scaled instead. An iterative fit, so no SQL."""
    rows = predictions(spark, sf)
    return X.rounded(L.calibrated(rows, "y", "p", "calibrated").select("id", "y", "p", "calibrated"))
