"""Panels, reshaping and temporal operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.operators import panel as P
from chronopanel.operators import temporal as T
from chronopanel.operators.ordered import even_buckets, running
from chronopanel.queries.base import FILLED, PANEL, events_panel, filled_panel, query, table

def by_user():
    return T.timeline("user_id", "hr")

_W = "(PARTITION BY user_id ORDER BY hr"


def _stats_sql(n: int) -> str:
    t = f"OVER {_W} ROWS {n - 1} PRECEDING)"
    change = f"v - lag(v, {n - 1}) OVER {_W})"
    return (
        f"round(avg(v) {t}, 6) AS v_w{n}_mean, min(v) {t} AS v_w{n}_min, max(v) {t} AS v_w{n}_max,"
        f" round(coalesce(stddev_samp(v) {t}, 0), 6) AS v_w{n}_std, round({change}, 6) AS v_w{n}_change,"
        f" round(({change}) / {max(n - 1, 1)}, 6) AS v_w{n}_slope"
    )


def flagship(spark, sf):
    """The feature panel: spine, hourly features, carry-forward, recency, trailing statistics, exposure, label."""
    f = filled_panel(spark, sf)
    bad = X.abnormal(F.col("v"), None, 90.0)
    duration, frequency = T.abnormal_exposure(bad, F.col("seen"), 24, by_user())
    label = T.rise_label("v", "hr", 6, 20.0, "user_id", by_user())
    out = f.select("user_id", "hr", (~F.col("seen")).cast("long").alias("is_missing"), F.col("since").cast("long").alias("since"), "v", "e",
                   *[c.alias(k) for k, c in T.trailing_stats("v", 24, by_user()).items()],
                   duration.alias("abnormal_duration"), frequency.alias("abnormal_frequency"), label.alias("label"))
    return X.rounded(out)


query(FILLED + f"""
SELECT user_id, hr, (NOT seen)::BIGINT AS is_missing, since::BIGINT AS since, round(v, 6) AS v, round(e, 6) AS e, {_stats_sql(24)},
       (sum((coalesce(v > 90, FALSE))::INT) OVER t)::BIGINT AS abnormal_duration,
       round(sum((coalesce(v > 90, FALSE) AND seen)::INT) OVER t / nullif(sum(seen::INT) OVER t, 0), 6) AS abnormal_frequency,
       CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= 6 AND v IS NOT NULL AND max(v) OVER f IS NOT NULL
            THEN (max(v) OVER f - v >= 20)::BIGINT END AS label
FROM filled WINDOW t AS {_W} ROWS 23 PRECEDING), f AS {_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""", "panel_features_flagship")(flagship)


@query(PANEL + "SELECT user_id, hr FROM spine")
def spine_hourly(spark, sf):
    return P.spine(P.bounds(table(spark, sf, "events"), "user_id", "ts")).select("user_id", "hr")


@query(PANEL + 'SELECT user_id, hr, round("view", 6) AS "view", err, click, round(buy, 6) AS buy FROM panel')
def wide_hourly(spark, sf):
    return X.rounded(events_panel(spark, sf))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, o_orderdate AS low, o_orderdate + INTERVAL 12 HOUR AS high,
                  o_orderdate + to_minutes(cast(l_quantity * 15 AS BIGINT)) AS a,
                  o_orderdate + to_minutes(cast(l_quantity * 25 AS BIGINT) - 90) AS b
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT *, greatest(a, low) AS ca, least(b, high) AS cb FROM x),
h AS (SELECT l_orderkey, l_linenumber, ca, cb, floor((epoch_us(ca) - epoch_us(low)) / 3.6e9)::BIGINT AS f,
             floor(greatest(epoch_us(cb) - epoch_us(low) - 1000000, 0) / 3.6e9)::BIGINT AS l FROM c WHERE cb >= ca)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, unnest(range(f, l + 1)) AS hr FROM h WHERE l >= f""")
def interval_expand(spark, sf):
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    minutes = lambda n: F.make_interval(mins=n)
    x = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("o_orderdate").alias("low"),
        (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("high"),
        (F.col("o_orderdate") + minutes((F.col("l_quantity") * 15).cast("int"))).alias("a"),
        (F.col("o_orderdate") + minutes((F.col("l_quantity") * 25).cast("int") - 90)).alias("b"),
    )
    return P.expand_intervals(x, "a", "b", "low", "high").select("l_orderkey", "l_linenumber", "hr")


@query("""
SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 6) AS "view", round(sum(value) FILTER (event_type = 'click'), 6) AS click,
       round(sum(value) FILTER (event_type = 'error'), 6) AS error FROM events GROUP BY user_id""")
def pivot_metrics(spark, sf):
    sums = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s"))
    return X.rounded(P.pivot(sums, ["user_id"], "event_type", ["view", "click", "error"], "s"))


@query(PANEL + """
SELECT user_id, hr, name, round(value, 6) AS value FROM (
  SELECT user_id, hr, 'view' AS name, "view" AS value FROM panel UNION ALL SELECT user_id, hr, 'err', err FROM panel) WHERE value IS NOT NULL""")
def unpivot_metrics(spark, sf):
    out = P.long(events_panel(spark, sf).select("user_id", "hr", "view", "err"), ["user_id", "hr"], ["view", "err"])
    return X.rounded(out.where("value IS NOT NULL"))


@query(FILLED + f"""
SELECT user_id, hr, len(list(since) OVER t)::BIGINT AS n_steps, (list(since) OVER t)[1]::BIGINT AS first_since,
       list_sum(list(since) OVER t)::BIGINT AS total_since
FROM filled WINDOW t AS {_W} ROWS 23 PRECEDING) QUALIFY count(*) OVER t = 24""")
def window_tensor(spark, sf):
    out = P.window_tensor(filled_panel(spark, sf), "user_id", "hr", ["since"], 24)
    steps = F.col("steps.since")
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("user_id", "hr", F.size("steps").cast("long").alias("n_steps"), steps[0].cast("long").alias("first_since"), total.alias("total_since"))


@query(FILLED + """,
cases AS (SELECT user_id, max(hr) AS t FROM filled WHERE seen GROUP BY user_id)
SELECT f.user_id, t, hr, hr - t AS relative_hour, round(v, 6) AS v FROM filled f JOIN cases c ON f.user_id = c.user_id AND hr BETWEEN t - 23 AND t""")
def case_timeline(spark, sf):
    f = filled_panel(spark, sf)
    cases = f.where("seen").groupBy("user_id").agg(F.max("hr").alias("t"))
    out = f.join(cases, "user_id").where("hr BETWEEN t - 23 AND t")
    return X.rounded(out.select("user_id", "t", "hr", (F.col("hr") - F.col("t")).alias("relative_hour"), "v"))


@query(PANEL + "SELECT user_id * 100000 + hr AS window_id, user_id AS entity, hr FROM spine WHERE hr < 100000")
def window_ids(spark, sf):
    ids = P.spine(P.bounds(table(spark, sf, "events"), "user_id", "ts")).select(P.encode_window(F.col("user_id"), F.col("hr")).alias("window_id"))
    entity, hour = P.decode_window(F.col("window_id"))
    return ids.where("window_id IS NOT NULL").select("window_id", entity.alias("entity"), hour.alias("hr"))


@query(FILLED + "SELECT user_id, hr, round(v, 6) AS v, round(e, 6) AS e FROM filled")
def locf(spark, sf):
    return X.rounded(filled_panel(spark, sf).select("user_id", "hr", "v", "e"))


@query(FILLED + "SELECT user_id, hr, (NOT seen)::BIGINT AS is_missing, since::BIGINT AS since FROM filled")
def recency(spark, sf):
    return filled_panel(spark, sf).select("user_id", "hr", (~F.col("seen")).cast("long").alias("is_missing"), F.col("since").cast("long").alias("since"))


def _trailing(n):
    def run(spark, sf):
        stats = [c.alias(k) for k, c in T.trailing_stats("v", n, by_user()).items()]
        return X.rounded(filled_panel(spark, sf).select("user_id", "hr", *stats))

    return run


for _n in (4, 6, 12, 24):
    query(FILLED + f"SELECT user_id, hr, {_stats_sql(_n)} FROM filled", f"trailing_stats_{_n}")(_trailing(_n))


@query(FILLED + f"SELECT user_id, hr, round(v - lag(v) OVER {_W}), 6) AS short_term_change, round(min(v) OVER {_W} ROWS 5 PRECEDING), 6) AS roll_min, round(sum(v) OVER {_W} ROWS 5 PRECEDING), 6) AS roll_sum FROM filled")
def rolling_generic(spark, sf):
    t = T.trailing(by_user(), 6)
    return X.rounded(filled_panel(spark, sf).select("user_id", "hr", (F.col("v") - F.lag("v", 1).over(by_user())).alias("short_term_change"), F.min("v").over(t).alias("roll_min"), F.sum("v").over(t).alias("roll_sum")))


@query(FILLED + f"""
SELECT user_id, hr, (sum((coalesce(v < 10 OR v > 90, FALSE))::INT) OVER t)::BIGINT AS duration,
       round(sum((coalesce(v < 10 OR v > 90, FALSE) AND seen)::INT) OVER t / nullif(sum(seen::INT) OVER t, 0), 6) AS frequency
FROM filled WINDOW t AS {_W} ROWS 11 PRECEDING)""")
def abnormal_exposure(spark, sf):
    duration, frequency = T.abnormal_exposure(X.abnormal(F.col("v"), 10.0, 90.0), F.col("seen"), 12, by_user())
    return X.rounded(filled_panel(spark, sf).select("user_id", "hr", duration.alias("duration"), frequency.alias("frequency")))


def _future(n):
    def run(spark, sf):
        out = filled_panel(spark, sf).select("user_id", "hr", T.future_max("v", n, by_user()).alias("ahead"), T.rise_label("v", "hr", n, 20.0, "user_id", by_user()).alias("label"))
        return X.rounded(out)

    return run


for _n in (6, 12, 24):
    query(FILLED + f"""
SELECT user_id, hr, round(max(v) OVER f, 6) AS ahead,
       CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= {_n} AND v IS NOT NULL AND max(v) OVER f IS NOT NULL
            THEN (max(v) OVER f - v >= 20)::BIGINT END AS label
FROM filled WINDOW f AS {_W} ROWS BETWEEN 1 FOLLOWING AND {_n} FOLLOWING)""", f"future_label_{_n}")(_future(_n))


@query(FILLED + f"""
SELECT user_id, hr, CASE WHEN count(hr) OVER (PARTITION BY user_id) - row_number() OVER {_W}) >= 6 AND max(v) OVER f IS NOT NULL
                         THEN (max(v) OVER f >= 150)::BIGINT END AS label
FROM filled WINDOW f AS {_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""")
def future_rows_label(spark, sf):
    return filled_panel(spark, sf).select("user_id", "hr", T.threshold_label("v", "hr", 6, 150.0, "user_id", by_user()).alias("label"))


def _eligible_sql(observe, history):
    return FILLED + f""",
labelled AS (SELECT *, CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= 6 AND v IS NOT NULL THEN 1 END AS label FROM filled)
SELECT user_id, hr, row_number() OVER {_W}) - 1 AS history FROM labelled
QUALIFY row_number() OVER {_W}) - 1 >= {history - 1} AND label IS NOT NULL
        AND sum((v IS NOT NULL AND e IS NOT NULL)::INT) OVER {_W} ROWS {observe - 1} PRECEDING) = {observe}"""


def _eligible(observe, history):
    def run(spark, sf):
        f = filled_panel(spark, sf).withColumn("label", T.rise_label("v", "hr", 6, 20.0, "user_id", by_user()))
        valid = F.col("v").isNotNull() & F.col("e").isNotNull()
        f = f.select("user_id", "hr", T.history_index(by_user()).alias("history"), T.eligible(valid, F.col("label"), observe, history, by_user()).alias("ok"))
        return f.where("ok").drop("ok")

    return run


query(_eligible_sql(24, 24), "eligible_windows")(_eligible(24, 24))
query(_eligible_sql(6, 24), "obs_vs_eligibility")(_eligible(6, 24))


@query(FILLED + f"SELECT user_id, hr, round(CASE WHEN count(v) OVER t = 24 THEN regr_slope(v, hr) OVER t END, 6) + 0 AS slope FROM filled WINDOW t AS {_W} ROWS 23 PRECEDING)")
def ols_slope_24(spark, sf):
    return X.rounded(filled_panel(spark, sf).select("user_id", "hr", T.ols_slope("v", "hr", 24, by_user()).alias("slope"))).withColumn("slope", F.col("slope") + 0)


_MEASURED = {"v": '"view"', "e": "err", "c": "click"}
_VECTOR = ", ".join(
    f"round({f}, 6) AS last_{f}, {f}_missing AS last_{f}_missing, {f}_since AS last_{f}_since, round(avg({f}) OVER t, 6) AS mean_{f}, round(min({f}) OVER t, 6) AS min_{f}, round(max({f}) OVER t, 6) AS max_{f},"
    f" round(stddev_pop({f}) OVER t, 6) AS std_{f}, round(regr_slope({f}, hr) OVER t, 6) + 0 AS slope_{f}, round({f} - lag({f}) OVER {_W}), 6) AS step_{f}, round({f} - first_value({f}) OVER t, 6) AS span_{f},"
    f" round(avg({f}_missing) OVER t, 6) AS missing_mean_{f}" for f in _MEASURED)  # fmt: skip
_CARRIED = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER w AS {f}, ({c} IS NULL)::INT AS {f}_missing, coalesce(hr - last_value(CASE WHEN {c} IS NOT NULL THEN hr END IGNORE NULLS) OVER w, hr + 1)::BIGINT AS {f}_since"
    for f, c in _MEASURED.items())


@query(PANEL + f""",
carried AS (SELECT user_id, hr, {_CARRIED} FROM panel WINDOW w AS {_W} ROWS UNBOUNDED PRECEDING))
SELECT user_id, hr, {_VECTOR} FROM carried WINDOW t AS {_W} ROWS 23 PRECEDING) QUALIFY count(v) OVER t = 24 AND count(e) OVER t = 24 AND count(c) OVER t = 24""")
def summary_vector(spark, sf):
    """The vector of three features' last day: values, missingness, recency, then statistics of each window."""
    w, names = by_user(), {"v": "view", "e": "err", "c": "click"}
    p = events_panel(spark, sf).select("user_id", "hr", *[x for f, c in names.items() for x in (
        T.locf(c, w).alias(f), F.col(c).isNull().cast("int").alias(f"{f}_missing"), T.recency(c, "hr", w).cast("long").alias(f"{f}_since"))])
    made = T.summary_vector(p, list(names), "hr", 24, w)
    out = X.rounded(made.where("complete").drop("complete", *[c for c in p.columns if c not in ("user_id", "hr")]))
    return out.withColumns({f"slope_{f}": F.col(f"slope_{f}") + 0 for f in names})


_ADJACENT = FILLED + ", seen AS (SELECT user_id, hr, v FROM filled WHERE seen)"


@query(_ADJACENT + f"SELECT user_id, hr, coalesce(hr - lag(hr) OVER {_W}) = 1, FALSE) AS follows FROM seen")
def adjacent_windows(spark, sf):
    return filled_panel(spark, sf).where("seen").select("user_id", "hr", T.adjacent(by_user(), "hr").alias("follows"))


@query(_ADJACENT + f"""
SELECT user_id, count(*) AS n_pairs, round(avg((d > 0)::INT), 6) AS rising, round(sum(abs(d)), 6) AS moved
FROM (SELECT user_id, v - lag(v) OVER {_W}) AS d, hr - lag(hr) OVER {_W}) AS g FROM seen) WHERE g = 1 GROUP BY user_id""")
def hourly_delta(spark, sf):
    s = filled_panel(spark, sf).where("seen").withColumns({"ok": T.adjacent(by_user(), "hr"), "d": F.col("v") - F.lag("v", 1).over(by_user())}).where("ok")
    return X.rounded(s.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.avg((F.col("d") > 0).cast("int")).alias("rising"), F.sum(F.abs("d")).alias("moved")))


@query(PANEL.replace("WITH bounds", "WITH RECURSIVE bounds") + """,
alerts AS (SELECT DISTINCT user_id, hr FROM panel WHERE err > 50),
kept AS (SELECT user_id, min(hr) AS hr FROM alerts GROUP BY user_id
         UNION ALL SELECT k.user_id, (SELECT min(a.hr) FROM alerts a WHERE a.user_id = k.user_id AND a.hr >= k.hr + 6)
         FROM kept k WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.user_id = k.user_id AND a.hr >= k.hr + 6))
SELECT user_id, hr FROM kept""")
def refractory_alerts(spark, sf):
    return T.refractory_alerts(events_panel(spark, sf).where("err > 50"), "user_id", "hr", 6)


@query("""SELECT event_id, round(value, 2) AS value,
       rank() OVER (ORDER BY round(value, 2)) + (count(*) OVER (PARTITION BY round(value, 2)) - 1) / 2 AS rank FROM events""")
def average_rank(spark, sf):
    return T.average_rank(table(spark, sf, "events").select("event_id", F.round("value", 2).alias("value")), "value")


@query("""WITH d AS (SELECT round(value, 0) AS score, count(*) AS n FROM events GROUP BY 1)
SELECT score, n, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS cumulative FROM d""")
def cumulative_counts(spark, sf):
    d = table(spark, sf, "events").groupBy(F.round("value", 0).alias("score")).agg(F.count("*").alias("n"))
    return running(d, "score", even_buckets(d, "score"), {"cumulative": "n"}, descending=True)


@query("""
WITH m AS (SELECT n_nationkey AS item, r_name AS feature, CASE WHEN n_nationkey % 2 = 1 THEN 5.0::DOUBLE / 9 ELSE 1 END AS scale, CASE WHEN n_nationkey % 2 = 1 THEN -32 ELSE 0 END AS shift FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT event_id, user_id, (props->>'$.k')::INT AS item, value FROM events)
SELECT event_id, user_id, feature, round((value + shift) * scale, 6) AS value FROM e JOIN m USING (item)""")
def id_to_feature(spark, sf):
    """Measurements by item id to features: several ids are one feature, some of them in another unit; other ids are left out."""
    odd = F.col("n_nationkey") % 2 == 1
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    mapping = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("item"), F.col("r_name").alias("feature"), F.when(odd, F.lit(5.0) / 9).otherwise(1.0).alias("scale"), F.when(odd, -32.0).otherwise(0.0).alias("shift"))
    e = table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), "value")
    return X.rounded(P.mapped(e, mapping, "item", "value").select("event_id", "user_id", "feature", "value"))
