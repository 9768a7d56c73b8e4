"""Projections, normalisations and scores over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.functions import scores as S
from chronopanel.operators.quantiles import quantile_values, quantiles
from chronopanel.queries.base import FILLED, filled_panel, query, table


def _pick(texts, key):
    """One of the given texts by a key's remainder, so that each text and its expected result stand side by side."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(key) % len(texts) + 1).cast("int"))


def _list_sql(values, key):
    said = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{said}])[({key} % {len(values)} + 1)::INT]"


# Ranges as the definition has them, apart from the library's.
_RANGES = """VALUES (0, 'heart_rate', 20, 300), (1, 'respiratory_rate', 1, 80), (2, 'spo2', 50, 100), (3, 'sbp_arterial', 40, 300), (4, 'sbp_noninvasive', 40, 300),
(5, 'dbp_arterial', 20, 200), (6, 'dbp_noninvasive', 20, 200), (7, 'map_arterial', 20, 250), (8, 'map_noninvasive', 20, 250), (9, 'map', 20, 250), (10, 'temperature_c', 25, 45),
(11, 'fio2', 0.21, 1), (12, 'gcs_eye', 1, 4), (13, 'gcs_verbal', 1, 5), (14, 'gcs_motor', 1, 6), (15, 'gcs_total', 3, 15), (16, 'mechanical_vent', 0, 1), (17, 'lactate', 0, 30),
(18, 'pao2', 20, 800), (19, 'bilirubin', 0, 80), (20, 'creatinine', 0.1, 30), (21, 'platelets', 1, 2000), (22, 'dopamine', 0, 100), (23, 'dobutamine', 0, 100),
(24, 'epinephrine', 0, 10), (25, 'norepinephrine', 0, 10), (26, 'other', -1e18, 1e18)"""
_FEATURES = "heart_rate respiratory_rate spo2 sbp_arterial sbp_noninvasive dbp_arterial dbp_noninvasive map_arterial map_noninvasive map temperature_c fio2 gcs_eye gcs_verbal gcs_motor gcs_total mechanical_vent lactate pao2 bilirubin creatinine platelets dopamine dobutamine epinephrine norepinephrine other".split()


@query(f"""
SELECT event_id, f AS feature, CASE WHEN value BETWEEN lo::DOUBLE AND hi::DOUBLE THEN value END AS value FROM events JOIN ({_RANGES}) r(i, f, lo, hi) ON i = event_id % 27""")
def plausibility(spark, sf):
    e = table(spark, sf, "events").withColumn("feature", _pick(_FEATURES, "event_id"))
    return e.select("event_id", "feature", X.plausible(F.col("value"), F.col("feature")).alias("value"))


_UNITS = ["mcg/kg/min", "mg/kg/min", "mcg/kg/hour", "mcg/kg/hr", "mg/kg/hour", "MG/KG/HR", "mcg/min", "mg/min", "mcg/hour", "mcg/hr", "mg/hour", "mg/hr", "units/hour", None, "direct mcg/min"]
_WEIGHT = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE 15 + event_id % 60 END::DOUBLE AS weight"


def _weight():
    i = F.col("event_id")
    return F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.lit(0)).otherwise(15 + i % 60).cast("double")


@query(f"""
WITH x AS (SELECT event_id, value / 4 AS v, lower({_list_sql(_UNITS, 'event_id')}) AS unit, {_WEIGHT} FROM events)
SELECT event_id, round((v - 32) * (5.0::DOUBLE / 9.0::DOUBLE), 9) AS celsius,
       round(CASE WHEN v BETWEEN 0.21 AND 1 THEN v WHEN v > 1 AND v <= 100 THEN v / 100 END, 9) AS fraction,
       round(CASE WHEN v > 0 AND v <= 1 THEN v * 100 ELSE v END, 9) AS percent,
       round(CASE unit WHEN 'mcg/kg/min' THEN v WHEN 'mg/kg/min' THEN v * 1000 WHEN 'mcg/kg/hour' THEN v / 60 WHEN 'mcg/kg/hr' THEN v / 60 WHEN 'mg/kg/hour' THEN v * 1000 / 60 WHEN 'mg/kg/hr' THEN v * 1000 / 60
            WHEN 'mcg/min' THEN CASE WHEN weight > 0 THEN v / weight END WHEN 'direct mcg/min' THEN CASE WHEN weight > 0 THEN v / weight END WHEN 'mg/min' THEN CASE WHEN weight > 0 THEN v * 1000 / weight END
            WHEN 'mcg/hour' THEN CASE WHEN weight > 0 THEN v / weight / 60 END WHEN 'mcg/hr' THEN CASE WHEN weight > 0 THEN v / weight / 60 END
            WHEN 'mg/hour' THEN CASE WHEN weight > 0 THEN v * 1000 / weight / 60 END WHEN 'mg/hr' THEN CASE WHEN weight > 0 THEN v * 1000 / weight / 60 END END, 9) AS dose FROM x""")
def unit_normalise(spark, sf):
    v = F.col("v")
    x = table(spark, sf, "events").select("event_id", (F.col("value") / 4).alias("v"), _pick(_UNITS, "event_id").alias("unit"), _weight().alias("weight"))
    return X.rounded(x.select("event_id", X.fahrenheit_to_celsius(v).alias("celsius"), X.fio2_fraction(v).alias("fraction"), X.fio2_percent(v).alias("percent"),
                              X.dose_per_kg_minute(v, F.col("unit"), F.col("weight")).alias("dose")), 9)


_DRUGS = ["Dopamine (mcg/kg/min)", "norepinephrine (mg/kg/min)", " Epinephrine (mcg/kg/hr)", "dobutamine drip (mcg/min)", "Norepinephrine (mg/min)", "DOPAMINE (MCG/HR)", "epinephrine (mg/hr)", "Vasopressin (units/min)", "dopamine mcg/min", None]


@query(f"""
WITH x AS (SELECT event_id, value / 4 AS v, event_id % 10 AS i, {_WEIGHT} FROM events)
SELECT event_id, {_list_sql(["dopamine", "norepinephrine", "epinephrine", "dobutamine", "norepinephrine", "dopamine", "epinephrine", None, "dopamine", None], "event_id")} AS drug,
       round(CASE i WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN v / 60 WHEN 3 THEN CASE WHEN weight BETWEEN 20 AND 400 THEN v / weight END WHEN 4 THEN CASE WHEN weight BETWEEN 20 AND 400 THEN v * 1000 / weight END
            WHEN 5 THEN CASE WHEN weight BETWEEN 20 AND 400 THEN v / 60 / weight END WHEN 6 THEN CASE WHEN weight BETWEEN 20 AND 400 THEN v * 1000 / 60 / weight END END, 9) AS dose FROM x""")
def named_dose(spark, sf):
    x = table(spark, sf, "events").select("event_id", (F.col("value") / 4).alias("v"), _pick(_DRUGS, "event_id").alias("name"), _weight().alias("weight"))
    return X.rounded(x.select("event_id", X.pressor(F.col("name")).alias("drug"), X.named_dose(F.col("name"), F.col("v"), F.col("weight")).alias("dose")), 9)


# Texts and, in the SQL, what each is classified as.
_WARDS = ["Neuro Surgical Intensive Care", "Cardiac Vascular (CVICU)", "Trauma SICU (TSICU)", "Medical (MICU)", "Coronary Care Unit (CCU)", "general ward", None, "pacu"]
_STATUS = ["FinishedRunning", "Rewritten", "Stopped", None, "paused", "ChangeDose/Rate", "Cancelled", "canceled"]
_LABELS = ["Urine", " Foley cath #2", "Urine output total", "left nephrostomy output", "urethral catheter flow", "Output Amt-Urinary Catheter #1", "urine color", "stool", None, "Voided amount", "urethral catheter output", "urinary catheter output 24 hr"]
_PEOPLE = ["WHITE - RUSSIAN", "Black/African American", "ASIAN - CHINESE", "HISPANIC/LATINO - CUBAN", "white/asian", "WHITEHALL", None, "BLACK/CARIBBEAN, HISPANIC"]
_VENTILATORS = ["OFF ", " standby", "CMV", None, "", "None", "Other/Remarks", "PSV/SBT"]
_MODELS = ["logreg_v2", "xgb-tuned", "anfis_full", "gru", "my_logreg_xgb"]


@query(f"""
SELECT p_partkey, {_list_sql(["Neuro", "Cardiac", "Surgical/Trauma", "Medical/Mixed", "Cardiac", "Other", "Other", "Surgical/Trauma"], "p_partkey")} AS unit,
       {_list_sql(["TRUE", "FALSE", "FALSE", "TRUE", "FALSE", "TRUE", "FALSE", "FALSE"], "p_partkey")}::BOOLEAN AS status_kept,
       {_list_sql(["TRUE", "TRUE", "FALSE", "TRUE", "FALSE", "TRUE", "FALSE", "FALSE", "FALSE", "TRUE", "TRUE", "FALSE"], "p_partkey")}::BOOLEAN AS urine,
       {_list_sql(["White", "Black", "Asian", "Hispanic/Latino", "White", "Other/Unknown", "Other/Unknown", "Black"], "p_partkey")} AS race,
       {_list_sql([0, 0, 1, 0, 0, 0, 0, 1], "p_partkey")}::INT AS on_support,
       {_list_sql(["Logistic regression", "Boosted trees", "Fuzzy network", "gru", "Logistic regression"], "p_partkey")} AS model,
       CASE WHEN p_partkey % 45 * 40 - 100 BETWEEN 0 AND 1440 THEN floor((p_partkey % 45 * 40 - 100) / 60)::BIGINT END AS hr FROM part""")
def text_classify(spark, sf):
    aliases = [("logreg", "Logistic regression"), ("xgb", "Boosted trees"), ("anfis", "Fuzzy network")]
    k, minutes = "p_partkey", F.col("p_partkey") % 45 * 40 - 100
    return table(spark, sf, "part").select(
        k, X.care_unit(_pick(_WARDS, k)).alias("unit"), X.status_kept(_pick(_STATUS, k)).alias("status_kept"), X.urine_label(_pick(_LABELS, k)).alias("urine"),
        X.race_group(_pick(_PEOPLE, k)).alias("race"), X.ventilated(_pick(_VENTILATORS, k)).alias("on_support"), X.alias_name(_pick(_MODELS, k), aliases).alias("model"),
        X.offset_hour(minutes, F.lit(1440)).alias("hr"))


@query(FILLED + """
SELECT user_id, hr, round(e, 6) AS e, round(coalesce(avg(v) OVER (PARTITION BY user_id ORDER BY hr ROWS 5 PRECEDING), 75), 6) AS v_w6h_mean,
       round(coalesce(v - lag(v, 5) OVER (PARTITION BY user_id ORDER BY hr), 0), 6) AS v_w6h_change, since::DOUBLE AS v_time_since_last FROM filled""")
def column_selection(spark, sf):
    """The columns of one window out of several, what is never observed filled by name."""
    from chronopanel.operators import temporal as T

    w, made = T.timeline("user_id", "hr"), {}
    for n in X.window_list([24, 6]):
        t = T.trailing(w, n)
        made |= {f"v_w{n}h_mean": F.avg("v").over(t), f"v_w{n}h_change": F.col("v") - F.lag("v", n - 1).over(w)}
    wide = filled_panel(spark, sf).withColumns(made | {"v_time_since_last": F.col("since").cast("double")})
    names = X.columns_for_window([*made, "v_time_since_last", "e"], ["e", "v"], 6)
    out = wide.select("user_id", "hr", *[c if c == "e" else F.coalesce(F.col(c), F.lit(X.default_by_name(c, {"v": 75.0}))).alias(c) for c in names])
    return X.rounded(out)


_ABC = """WITH x AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS a, CASE WHEN event_id % 4 > 0 THEN value / 2 END AS b,
                  CASE WHEN event_id % 5 > 0 THEN 100 - value END AS c FROM events)"""


def _abc(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.when(i % 3 > 0, v).alias("a"), F.when(i % 4 > 0, v / 2).alias("b"), F.when(i % 5 > 0, 100 - v).alias("c"))


@query(_ABC + """
SELECT event_id, round(a + b + c, 6) AS strict, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS filled,
       round(CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 1 THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END, 6) AS least_one,
       (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS present, round(greatest(a, b, c), 6) AS worst, round(least(a, b, c), 6) AS best,
       round(coalesce(a, b, c), 6) AS first_present FROM x""")
def null_sums(spark, sf):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return X.rounded(_abc(spark, sf).select("event_id", X.null_strict_sum(a, b, c).alias("strict"), X.filled_sum(a, b, c).alias("filled"), X.filled_sum(a, b, c, least=1).alias("least_one"),
        X.present_count(a, b, c).alias("present"), F.greatest(a, b, c).alias("worst"), F.least(a, b, c).alias("best"), F.coalesce(a, b, c).alias("first_present")))


@query(_ABC + """
SELECT event_id, round(CASE WHEN b > 10 THEN a / b END, 6) AS ratio, round(CASE WHEN a IS NOT NULL THEN greatest(5, least(60, a)) END, 6) AS clipped,
       round(CASE WHEN a IS NOT NULL THEN ln(least(greatest(a / 500, 1e-6), 1 - 1e-6) / (1 - least(greatest(a / 500, 1e-6), 1 - 1e-6))) END, 6) AS log_odds,
       round(1 / (1 + exp(-(b / 100))), 6) AS prob, round(ln(1 + abs(c)), 6) AS log1p, round(tanh(b / 100), 6) AS tanh, round(exp(-0.5 * ((c - 20) / 15) * ((c - 20) / 15)), 6) AS gauss,
       coalesce(a < 10 OR a > 90, FALSE) AS abnormal FROM x""")
def guarded_math(spark, sf):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return X.rounded(_abc(spark, sf).select("event_id", X.guarded_ratio(a, F.when(b > 10, b)).alias("ratio"), X.clip(a, 5.0, 60.0).alias("clipped"), X.logit(a / 500).alias("log_odds"),
        X.sigmoid(b / 100).alias("prob"), F.log1p(F.abs(c)).alias("log1p"), F.tanh(b / 100).alias("tanh"), F.exp(-0.5 * ((c - 20) / 15) * ((c - 20) / 15)).alias("gauss"), X.abnormal(a, 10.0, 90.0).alias("abnormal")))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= 2000 THEN 'low' WHEN c_acctbal > 2000 AND c_acctbal <= 6000 THEN 'mid' WHEN c_acctbal > 6000 THEN 'high' ELSE 'Unknown' END AS band,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'MACHINERY' THEN 'M' ELSE 'Unknown' END AS code FROM customer""")
def banding(spark, sf):
    code = F.coalesce(F.create_map(*[F.lit(x) for x in ("BUILDING", "B", "MACHINERY", "M")])[F.col("c_mktsegment")], F.lit("Unknown"))
    return table(spark, sf, "customer").select("c_custkey", X.right_closed_band(F.col("c_acctbal"), [0.0, 2000.0, 6000.0], ["low", "mid", "high"]).alias("band"), code.alias("code"))


@query(_ABC + """, m AS (SELECT quantile_cont(a, 0.5) AS ma, avg(b) AS mb, stddev_pop(b) AS sb FROM x)
SELECT event_id, round(coalesce(a, ma), 6) AS filled, round((b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6) AS scaled, coalesce(c, 1) AS defaulted FROM x, m""")
def impute_scale(spark, sf):
    x = _abc(spark, sf)
    m, (ma,) = x.agg(F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb")).first(), quantile_values(x, "a", [0.5])  # three numbers, whatever the input
    return X.rounded(x.select("event_id", F.coalesce("a", F.lit(ma)).alias("filled"), ((F.col("b") - F.lit(m["mb"])) / F.lit(m["sb"] or 1.0)).alias("scaled"), F.coalesce("c", F.lit(1.0)).alias("defaulted")))


@query("""
WITH n AS (SELECT user_id, event_id, 'feature_' || event_type || '_w' || (event_id % 24 + 1) || 'h_mean' AS name FROM events)
SELECT event_id, regexp_extract(name, '_w(\\d+)h_', 1) AS hours, split_part(name, '_', -1) AS stat, contains(name, 'error') AS is_error FROM n""")
def name_parse(spark, sf):
    name = F.concat(F.lit("feature_"), "event_type", F.lit("_w"), (F.col("event_id") % 24 + 1).cast("string"), F.lit("h_mean"))
    n = table(spark, sf, "events").select("event_id", name.alias("name"))
    return n.select("event_id", F.regexp_extract("name", "_w(\\d+)h_", 1).alias("hours"), F.split_part("name", F.lit("_"), F.lit(-1)).alias("stat"), F.col("name").contains("error").alias("is_error"))


@query("""
SELECT event_type, count(*) || ' (' || printf('%.1f', round(100.0 * count(*) / sum(count(*)) OVER (), 1)) || '%)' AS n_pct,
       printf('%.2f', round(quantile_cont(value, 0.5), 2)) || ' [' || printf('%.2f', round(quantile_cont(value, 0.25), 2)) || '-' || printf('%.2f', round(quantile_cont(value, 0.75), 2)) || ']' AS median_iqr
FROM events GROUP BY event_type""")
def formatters(spark, sf):
    from pyspark.sql.window import Window

    events = table(spark, sf, "events").select("event_type", "value")
    g = events.groupBy("event_type").agg(F.count("*").alias("n")).join(quantiles(events, "value", [0.25, 0.5, 0.75], ["event_type"]), "event_type")
    share = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())
    return g.select("event_type", F.format_string("%d (%.1f%%)", F.col("n"), F.round(share, 1)).alias("n_pct"), F.format_string("%.2f [%.2f-%.2f]", *[F.round(F.col("q")[i], 2) for i in (1, 0, 2)]).alias("median_iqr"))


@query("""
SELECT o_orderkey, year(o_orderdate) AS yr, 40 + year(o_orderdate) - 1990 AS age, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-01-01')) / 3.6e9)::BIGINT AS hr,
       CASE WHEN o_orderkey % 9 = 0 THEN 90.0 WHEN o_orderkey % 9 = 1 THEN NULL ELSE (o_orderkey % 100)::DOUBLE END AS age_text, o_orderdate + INTERVAL 5 HOUR AS later FROM orders""")
def time_expressions(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, F.lit("> 89")).when(k % 9 == 1, F.lit("unknown")).otherwise((k % 100).cast("string"))
    yr = F.year("o_orderdate").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", yr.alias("yr"), (F.lit(40) + yr - 1990).alias("age"), X.elapsed_hours(F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("hr"),
        X.age_years(text).alias("age_text"), (F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS")).alias("later"))


@query(FILLED + """,
s AS (SELECT user_id, hr, v * 2 AS ratio, (e > 40)::INT AS vent, v AS plt, e / 10 AS bili, v / 8 AS gcs, e / 25 AS creat, v * 4 AS urine, v AS map, CASE WHEN e > 60 THEN e / 8 END AS dopa, CASE WHEN e < 20 THEN e / 100 END AS nor FROM filled),
c AS (SELECT user_id, hr,
  CASE WHEN ratio IS NOT NULL THEN CASE WHEN ratio < 100 AND coalesce(vent, 0) = 1 THEN 4 WHEN ratio < 200 AND coalesce(vent, 0) = 1 THEN 3 WHEN ratio < 300 THEN 2 WHEN ratio < 400 THEN 1 ELSE 0 END END AS resp,
  CASE WHEN plt IS NOT NULL THEN CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END END AS coag,
  CASE WHEN bili IS NOT NULL THEN CASE WHEN bili >= 12 THEN 4 WHEN bili >= 6 THEN 3 WHEN bili >= 2 THEN 2 WHEN bili >= 1.2 THEN 1 ELSE 0 END END AS liver,
  CASE WHEN gcs IS NOT NULL THEN CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs < 15 THEN 1 ELSE 0 END END AS cns,
  CASE WHEN map IS NOT NULL OR dopa IS NOT NULL OR nor IS NOT NULL THEN CASE WHEN dopa > 15 OR nor > 0.1 THEN 4 WHEN (dopa > 5 AND dopa <= 15) OR (nor > 0 AND nor <= 0.1) THEN 3 WHEN dopa > 0 AND dopa <= 5 THEN 2 WHEN map < 70 THEN 1 ELSE 0 END END AS cardio,
  greatest(CASE WHEN creat IS NOT NULL THEN CASE WHEN creat >= 5 THEN 4 WHEN creat >= 3.5 THEN 3 WHEN creat >= 2 THEN 2 WHEN creat >= 1.2 THEN 1 ELSE 0 END END,
           CASE WHEN urine IS NOT NULL THEN CASE WHEN urine < 200 THEN 4 WHEN urine < 500 THEN 3 ELSE 0 END END) AS renal FROM s)
SELECT user_id, hr, resp, coag, liver, cns, cardio, renal, coalesce(resp, 0) + coalesce(coag, 0) + coalesce(liver, 0) + coalesce(cns, 0) + coalesce(cardio, 0) + coalesce(renal, 0) AS total_normal,
       resp + coag + liver + cns + cardio + renal AS total_complete,
       CASE WHEN (resp IS NOT NULL)::INT + (coag IS NOT NULL)::INT + (liver IS NOT NULL)::INT + (cns IS NOT NULL)::INT + (cardio IS NOT NULL)::INT + (renal IS NOT NULL)::INT >= 4
            THEN coalesce(resp, 0) + coalesce(coag, 0) + coalesce(liver, 0) + coalesce(cns, 0) + coalesce(cardio, 0) + coalesce(renal, 0) END AS primary_total FROM c""")
def organ_scores(spark, sf):
    v, e = F.col("v"), F.col("e")
    f = filled_panel(spark, sf)
    nothing = F.lit(None).cast("double")
    c = f.select("user_id", "hr", S.respiration(v * 2, (e > 40).cast("int")).alias("resp"), S.platelets(v).alias("coag"), S.bilirubin(e / 10).alias("liver"), S.coma(v / 8).alias("cns"),
        S.cardiovascular(v, F.when(e > 60, e / 8), nothing, nothing, F.when(e < 20, e / 100)).alias("cardio"), S.renal(e / 25, v * 4).alias("renal"))
    parts = [F.col(n) for n in ("resp", "coag", "liver", "cns", "cardio", "renal")]
    return c.withColumns({"total_normal": X.filled_sum(*parts), "total_complete": X.null_strict_sum(*parts), "primary_total": X.filled_sum(*parts, least=4)})


def _bands_sql(expr, bands):
    return "CASE " + " ".join(f"WHEN {' AND '.join(([f'{expr} >= {lo}'] if lo is not None else []) + ([f'{expr} <= {hi}'] if hi is not None else []))} THEN {s}" for lo, hi, s in bands) + " ELSE 0 END"


_VITALS = {"respiratory_rate": "(v / 4)", "spo2": "(100 - e / 8)", "systolic": "v", "heart_rate": "e", "temperature": "(33 + v / 40)"}
_EWS = " + ".join(_bands_sql(x, S.EARLY_WARNING[k]) for k, x in _VITALS.items())


@query(FILLED + f"""
SELECT user_id, hr, {_EWS} + CASE WHEN e > 21 THEN 2 ELSE 0 END + CASE WHEN v / 8 < 15 THEN 3 ELSE 0 END AS score,
       ({_EWS} + CASE WHEN e > 21 THEN 2 ELSE 0 END + CASE WHEN v / 8 < 15 THEN 3 ELSE 0 END) >= 7 AS urgent FROM filled""")
def early_warning_score(spark, sf):
    v, e = F.col("v"), F.col("e")
    vitals = {"respiratory_rate": v / 4, "spo2": 100 - e / 8, "systolic": v, "heart_rate": e, "temperature": 33 + v / 40}
    out = filled_panel(spark, sf).select("user_id", "hr", S.early_warning(vitals, e, v / 8).alias("score"))
    return out.withColumn("urgent", F.col("score") >= 7)
