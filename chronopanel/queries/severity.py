"""Severity scores assembled over the events panel, whose features stand for the measurements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions import exprs as X
from chronopanel.functions import scores as S
from chronopanel.operators import severity as O
from chronopanel.operators import temporal as T
from chronopanel.queries.base import PANEL, SQL, events_panel, query
from chronopanel.queries.expressions import _bands_sql

_RAW = PANEL + """,
raw AS (SELECT user_id, hr, "view" * 3 AS pao2, CASE WHEN click IS NOT NULL THEN 0.21::DOUBLE + (hr % 4) * 0.2::DOUBLE END AS fio2, CASE WHEN err IS NOT NULL THEN (err > 40)::INT END AS vent,
               err * 4 AS platelets, click / 5 AS bilirubin, "view" + 30 AS map, buy / 20 AS creatinine, click * 2 AS urine,
               CASE WHEN "view" IS NOT NULL THEN 1 + hr % 4 END AS eye, CASE WHEN err IS NOT NULL THEN 1 + hr % 5 END AS verbal, CASE WHEN err IS NOT NULL THEN 1 + hr % 6 END AS motor,
               CASE WHEN buy IS NOT NULL THEN 3 + hr % 13 END AS total, CASE WHEN err > 70 THEN err / 5 END AS dopa, CASE WHEN buy < 5 THEN buy END AS dobu,
               CASE WHEN buy > 80 THEN buy / 500 END AS epi, CASE WHEN click < 10 THEN click / 50 END AS nor FROM panel),
f AS (SELECT *, last_value(fio2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hr ROWS UNBOUNDED PRECEDING) AS f2, coalesce(vent, 0) AS v0, coalesce(total, eye + verbal + motor) AS gcs FROM raw),
r AS (SELECT user_id, hr, min(CASE WHEN pao2 IS NOT NULL AND f2 > 0 THEN pao2 / f2 END) OVER t AS ratio, max(v0) OVER t AS vent, min(platelets) OVER t AS plt, max(bilirubin) OVER t AS bili, min(map) OVER t AS map,
             min(gcs) OVER t AS gcs, max(creatinine) OVER t AS creat, max(dopa) OVER t AS dopa, max(dobu) OVER t AS dobu, max(epi) OVER t AS epi, max(nor) OVER t AS nor,
             CASE WHEN hr >= 23 AND max((urine IS NOT NULL)::INT) OVER t = 1 THEN sum(coalesce(urine, 0)) OVER t END AS urine
      FROM f WINDOW t AS (PARTITION BY user_id ORDER BY hr ROWS 23 PRECEDING)),
c AS (SELECT user_id, hr,
  CASE WHEN ratio IS NOT NULL THEN CASE WHEN ratio < 100 AND vent = 1 THEN 4 WHEN ratio < 200 AND vent = 1 THEN 3 WHEN ratio < 300 THEN 2 WHEN ratio < 400 THEN 1 ELSE 0 END END AS respiration,
  CASE WHEN plt IS NOT NULL THEN CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END END AS coagulation,
  CASE WHEN bili IS NOT NULL THEN CASE WHEN bili >= 12 THEN 4 WHEN bili >= 6 THEN 3 WHEN bili >= 2 THEN 2 WHEN bili >= 1.2 THEN 1 ELSE 0 END END AS liver,
  CASE WHEN map IS NOT NULL OR dopa IS NOT NULL OR dobu IS NOT NULL OR epi IS NOT NULL OR nor IS NOT NULL THEN
       CASE WHEN dopa > 15 OR epi > 0.1::DOUBLE OR nor > 0.1::DOUBLE THEN 4 WHEN (dopa > 5 AND dopa <= 15) OR (epi > 0 AND epi <= 0.1::DOUBLE) OR (nor > 0 AND nor <= 0.1::DOUBLE) THEN 3
            WHEN (dopa > 0 AND dopa <= 5) OR dobu > 0 THEN 2 WHEN map < 70 THEN 1 ELSE 0 END END AS cardiovascular,
  CASE WHEN gcs IS NOT NULL THEN CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs < 15 THEN 1 ELSE 0 END END AS cns,
  greatest(CASE WHEN creat IS NOT NULL THEN CASE WHEN creat >= 5 THEN 4 WHEN creat >= 3.5 THEN 3 WHEN creat >= 2 THEN 2 WHEN creat >= 1.2 THEN 1 ELSE 0 END END,
           CASE WHEN urine IS NOT NULL THEN CASE WHEN urine < 200 THEN 4 WHEN urine < 500 THEN 3 ELSE 0 END END) AS renal FROM r),
s AS (SELECT *, (respiration IS NOT NULL)::INT + (coagulation IS NOT NULL)::INT + (liver IS NOT NULL)::INT + (cardiovascular IS NOT NULL)::INT + (cns IS NOT NULL)::INT + (renal IS NOT NULL)::INT AS component_count,
             coalesce(respiration, 0) + coalesce(coagulation, 0) + coalesce(liver, 0) + coalesce(cardiovascular, 0) + coalesce(cns, 0) + coalesce(renal, 0) AS score_assume_normal FROM c),
organs AS (SELECT *, CASE WHEN component_count >= 1 THEN score_assume_normal END AS score_observed, CASE WHEN component_count = 6 THEN score_assume_normal END AS score_complete,
                  CASE WHEN component_count >= 4 THEN score_assume_normal END AS score FROM s)"""


def _measurements(spark, sf):
    view, err, click, buy, hr = (F.col(c) for c in ("view", "err", "click", "buy", "hr"))
    when = F.when
    return events_panel(spark, sf).select(
        "user_id", "hr", (view * 3).alias("pao2"), when(click.isNotNull(), F.lit(0.21) + (hr % 4) * 0.2).alias("fio2"), when(err.isNotNull(), (err > 40).cast("int")).alias("mechanical_vent"),
        (err * 4).alias("platelets"), (click / 5).alias("bilirubin"), (view + 30).alias("map"), (buy / 20).alias("creatinine"), (click * 2).alias("urine_output"),
        when(view.isNotNull(), 1 + hr % 4).alias("gcs_eye"), when(err.isNotNull(), 1 + hr % 5).alias("gcs_verbal"), when(err.isNotNull(), 1 + hr % 6).alias("gcs_motor"),
        when(buy.isNotNull(), 3 + hr % 13).alias("gcs_total"), when(err > 70, err / 5).alias("dopamine"), when(buy < 5, buy).alias("dobutamine"),
        when(buy > 80, buy / 500).alias("epinephrine"), when(click < 10, click / 50).alias("norepinephrine"))


def organs(spark, sf):
    return O.organ_assembly(_measurements(spark, sf), "user_id", "hr")


@query(_RAW + """
SELECT user_id, hr, respiration, coagulation, liver, cardiovascular, cns, renal, component_count, score_observed, score_assume_normal, score_complete, score,
       CASE WHEN max(hr) OVER (PARTITION BY user_id) - hr >= 6 AND score IS NOT NULL AND max(score) OVER f IS NOT NULL THEN (max(score) OVER f - score >= 2)::BIGINT END AS label
FROM organs WINDOW f AS (PARTITION BY user_id ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""")
def organ_assembly(spark, sf):
    """Organ scores of the worst values of a day, their totals, and whether the total rises by two within six hours."""
    out = organs(spark, sf).withColumn("label", T.rise_label("score", "hr", 6, 2.0, "user_id", T.timeline("user_id", "hr")))
    return out.select("user_id", "hr", *O.ORGANS, "component_count", "score_observed", "score_assume_normal", "score_complete", "score", "label")


_PARTS = list(O.ORGANS)
_COMMON = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in _PARTS)
_DELTA = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN b.{c} - a.{c} ELSE 0 END" for c in _PARTS)
_SAME = " AND ".join(f"(a.{c} IS NULL) = (b.{c} IS NULL)" for c in _PARTS)
_NEW = " OR ".join(f"(a.{c} IS NULL AND b.{c} IS NOT NULL)" for c in _PARTS)


@query(_RAW + f""",
p AS (SELECT a.user_id, a.hr, a.score, a.component_count AS n, b.hr AS bh, b.score AS bs, b.component_count AS bn, {_COMMON} AS common, {_DELTA} AS delta, {_SAME} AS same, {_NEW} AS fresh
      FROM organs a JOIN organs b ON a.user_id = b.user_id AND b.hr > a.hr AND b.hr <= a.hr + 6),
g AS (SELECT user_id, hr, any_value(score) AS score, any_value(n) AS n, max(bs) AS top, max(delta) FILTER (common >= 4) AS shared, bool_and(same) AS stable, count(*) AS ahead,
             arg_max(same, bs * 100 - (bh - hr)) FILTER (bs IS NOT NULL) AS same_at_max, arg_max(bn, bs * 100 - (bh - hr)) FILTER (bs IS NOT NULL) AS max_components,
             arg_max(fresh, bs * 100 - (bh - hr)) FILTER (bs IS NOT NULL) AS new_component FROM p GROUP BY 1, 2)
SELECT user_id, hr, (top - score >= 2)::BIGINT AS primary_label, (shared >= 2)::BIGINT AS common_label, CASE WHEN same_at_max THEN (top - score >= 2)::BIGINT END AS same_mask_label,
       CASE WHEN stable THEN (top - score >= 2)::BIGINT END AS stable_mask_label, n AS index_components, max_components, new_component
FROM g WHERE ahead = 6 AND score IS NOT NULL AND top IS NOT NULL""")
def documentation_bias(spark, sf):
    """Rise labels told apart from changes in what is documented: over organs that both hours have (four at least), where
    the organs at the greatest score are the same, and where they stay the same in all six hours ahead.

    The six hours ahead are frames over the dense panel, packed into one struct an hour: no self join.
    """
    w = T.timeline("user_id", "hr")
    packed = F.struct("score", "component_count", *_PARTS)
    x = organs(spark, sf).select("user_id", "hr", "score", "component_count", *_PARTS)
    x = x.withColumn("next", F.collect_list(packed).over(w.rowsBetween(1, 6))).where((F.size("next") == 6) & F.col("score").isNotNull())  # six structs
    here = [F.col(c) for c in _PARTS]

    def common(b):
        return sum(((h.isNotNull() & b[c].isNotNull()).cast("int") for h, c in zip(here, _PARTS, strict=True)), F.lit(0))

    def delta(b):
        return sum((F.coalesce(b[c] - h, F.lit(0)) for h, c in zip(here, _PARTS, strict=True)), F.lit(0))

    def same(b):
        out = F.lit(True)
        for h, c in zip(here, _PARTS, strict=True):
            out = out & (h.isNull() == b[c].isNull())
        return out

    def fresh(b):
        out = F.lit(False)
        for h, c in zip(here, _PARTS, strict=True):
            out = out | (h.isNull() & b[c].isNotNull())
        return out

    shared = F.array_max(F.transform(F.filter("next", lambda b: common(b) >= 4), delta))
    scored = F.filter(F.transform("next", lambda b, i: F.struct(b["score"].alias("score"), (-i).alias("first"), b["component_count"].alias("n"), same(b).alias("same"), fresh(b).alias("fresh"))),
                      lambda s: s["score"].isNotNull())
    x = x.withColumns({"top": F.array_max(scored), "shared": shared, "stable": F.forall("next", same)}).where("top IS NOT NULL")
    label = (F.col("top.score") - F.col("score") >= 2).cast("long")
    return x.select(
        "user_id", "hr", label.alias("primary_label"), (F.col("shared") >= 2).cast("long").alias("common_label"), F.when(F.col("top.same"), label).alias("same_mask_label"),
        F.when(F.col("stable"), label).alias("stable_mask_label"), F.col("component_count").alias("index_components"), F.col("top.n").alias("max_components"), F.col("top.fresh").alias("new_component"))


_AHEAD = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _PARTS)
_AT_MAX = _RAW + f""",
p AS (SELECT a.user_id, a.hr, a.score, b.score AS bs, b.hr AS bh, {_AHEAD}, count(*) OVER (PARTITION BY a.user_id, a.hr) AS ahead FROM organs a JOIN organs b ON a.user_id = b.user_id AND b.hr > a.hr AND b.hr <= a.hr + 6),
top AS (SELECT * FROM p WHERE ahead = 6 AND score IS NOT NULL AND bs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, hr ORDER BY bs DESC, bh) = 1),
pos AS (SELECT * FROM top WHERE bs - score >= 2)"""


@query(_AT_MAX + """,
rises AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS organ, b_{c} - a_{c} AS d FROM pos" for c in _PARTS) + """),
by_organ AS (SELECT organ, count(*) AS windows, count(d) AS comparable, coalesce(sum(greatest(d, 0)), 0)::DOUBLE AS points, count(*) FILTER (d > 0) AS increased FROM rises GROUP BY 1)
SELECT organ, windows, comparable, points, increased, round(points / nullif(sum(points) OVER (), 0), 6) AS share FROM by_organ""")
def organ_contributions(spark, sf):
    """What each organ adds to rises of the total: in windows whose score rises by two, the increases from the hour itself to
    the first hour of the greatest score within six, where both hours have the organ."""
    w = T.timeline("user_id", "hr")
    packed = F.struct("score", *_PARTS)
    x = organs(spark, sf).select("user_id", "hr", "score", *_PARTS)
    x = x.withColumn("next", F.collect_list(packed).over(w.rowsBetween(1, 6))).where((F.size("next") == 6) & F.col("score").isNotNull())  # six structs
    scored = F.filter(F.transform("next", lambda b, i: F.struct(b["score"].alias("score"), (-i).alias("first"), b.alias("at"))), lambda s: s["score"].isNotNull())
    x = x.withColumn("top", F.array_max(scored)).where(F.col("top.score") - F.col("score") >= 2)
    long = x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("organ"), (F.col(f"top.at.{c}") - F.col(c)).alias("d")) for c in _PARTS])))
    s = long.groupBy("organ").agg(
        F.count("*").alias("windows"), F.count("d").alias("comparable"), F.coalesce(F.sum(F.greatest("d", F.lit(0)).cast("double") * F.col("d").isNotNull().cast("int")), F.lit(0.0)).alias("points"),
        F.count(F.when(F.col("d") > 0, 1)).alias("increased"))
    total = F.sum("points").over(Window.partitionBy())  # six rows
    return X.rounded(s.withColumn("share", F.col("points") / F.nullif(total, F.lit(0.0))))


@query(SQL["documentation_bias"].replace("SELECT user_id, hr, (top - score >= 2)::BIGINT AS primary_label", ", labels AS (SELECT user_id, hr, (top - score >= 2)::BIGINT AS primary_label") + """)
SELECT count(*) AS positive, count(*) FILTER (new_component) AS with_new, round(count(*) FILTER (new_component) / greatest(count(*), 1), 6) AS with_new_share,
       count(*) FILTER (max_components > index_components) AS with_more, round(count(*) FILTER (max_components > index_components) / greatest(count(*), 1), 6) AS with_more_share,
       count(*) FILTER (common_label = 1) AS preserved, round(count(*) FILTER (common_label = 1) / greatest(count(*), 1), 6) AS preserved_share
FROM labels WHERE primary_label = 1""")
def documentation_audit(spark, sf):
    """Of windows whose score rises: how many have an organ at the greatest score that they lacked, more organs, and a rise
    over the organs that both hours have."""
    x = documentation_bias(spark, sf).where("primary_label = 1")
    n = lambda c: F.count(F.when(c, 1))
    counts = {"with_new": n(F.col("new_component")), "with_more": n(F.col("max_components") > F.col("index_components")), "preserved": n(F.col("common_label") == 1)}
    one = x.agg(F.count("*").alias("positive"), *[c.alias(k) for k, c in counts.items()])
    return X.rounded(one.withColumns({f"{k}_share": F.col(k) / F.greatest("positive", F.lit(1)) for k in counts}))


_VITALS = ["respiratory_rate", "spo2", "systolic", "heart_rate", "temperature"]
_EWS = " + ".join(_bands_sql(k, S.EARLY_WARNING[k]) for k in _VITALS)
_LOCF = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in [*_VITALS, "fio2", "gcs"])


@query(PANEL + f""",
x AS (SELECT user_id, hr, click / 4 AS respiratory_rate, 100 - err / 8 AS spo2, "view" * 1.2::DOUBLE AS systolic, "view" AS heart_rate, 33 + buy / 40 AS temperature,
             CASE WHEN click / 100 > 0 AND click / 100 <= 1 THEN click / 100 * 100 ELSE click / 100 END AS fio2,
             CASE WHEN "view" IS NOT NULL AND err IS NOT NULL THEN 1 + hr % 4 + 1 + hr % 5 + 6 END AS gcs FROM panel),
l AS (SELECT user_id, hr, {_LOCF} FROM x WINDOW w AS (PARTITION BY user_id ORDER BY hr ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, hr, {_EWS} + CASE WHEN fio2 > 21 THEN 2 ELSE 0 END + CASE WHEN gcs < 15 THEN 3 ELSE 0 END AS score FROM l)
SELECT user_id, hr, score, max(score) OVER f AS ahead, (max(score) OVER f >= 7)::BIGINT AS label FROM s
WINDOW f AS (PARTITION BY user_id ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)
QUALIFY count(hr) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY hr) >= 6""")
def early_warning_label(spark, sf):
    """From measurements to the label: the coma total comes from its parts, as no row has one, then all is carried forward."""
    view, err, click, buy, hr = (F.col(c) for c in ("view", "err", "click", "buy", "hr"))
    x = events_panel(spark, sf).select(
        "user_id", "hr", (click / 4).alias("respiratory_rate"), (100 - err / 8).alias("spo2"), (view * 1.2).alias("systolic"), view.alias("heart_rate"), (33 + buy / 40).alias("temperature"),
        X.fio2_percent(click / 100).alias("fio2"), F.lit(None).cast("long").alias("gcs"), F.when(view.isNotNull(), 1 + hr % 4).alias("eye"), F.when(err.isNotNull(), 1 + hr % 5).alias("verbal"), F.lit(6).alias("motor"))
    x = O.total_or_parts(x, "gcs", ["eye", "verbal", "motor"])
    return O.early_warning_label(x, "user_id", "hr", _VITALS, "fio2", "gcs").select("user_id", "hr", "score", "ahead", "label")


@query(_RAW + "SELECT name, threshold::DOUBLE AS threshold, count(*) AS n, sum((score >= threshold)::INT)::BIGINT AS alerts FROM organs, (VALUES ('organs', 2), ('organs', 6)) t(name, threshold) WHERE score IS NOT NULL GROUP BY 1, 2")
def score_thresholds(spark, sf):
    """Alerts of a score at its listed thresholds, in one pass."""
    listed = {"organs": [2.0, 6.0]}
    rows = organs(spark, sf).where("score IS NOT NULL")
    one = rows.agg(F.count("*").alias("n"), *[F.sum((F.col("score") >= t).cast("long")).alias(f"a{i}") for i, t in enumerate(listed["organs"])])
    return one.select(F.inline(F.array(*[F.struct(F.lit("organs").alias("name"), F.lit(t).alias("threshold"), F.col("n"), F.col(f"a{i}").alias("alerts")) for i, t in enumerate(listed["organs"])])))
