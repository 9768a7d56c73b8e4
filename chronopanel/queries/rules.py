"""Rule scoring on the events panel and attribution metrics on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.operators import joins as J
from chronopanel.operators import rules as R
from chronopanel.operators import temporal as T
from chronopanel.operators.quantiles import quantile_columns, settled
from chronopanel.queries.base import FILLED, PANEL, events_panel, filled_panel, query, table

V_TERMS = [R.Term("low", 20.0, 15.0, 0.2), R.Term("mid", 50.0, 20.0, 0.5), R.Term("high", 90.0, 25.0, 1.5)]
E_TERMS = [R.Term("calm", 10.0, 20.0, 0.1), R.Term("alarm", 70.0, 30.0, 1.2)]
CROSS = [(2, 1, 1.4), (0, 0, 0.1), (1, 1, 0.7)]  # place of the v term, of the e term, weight


def _mu(x, t):
    return f"exp(-0.5 * (({x} - {t.centre}) / {t.sigma}) * (({x} - {t.centre}) / {t.sigma}))"


def _risk(x, terms):
    total = " + ".join(_mu(x, t) for t in terms)
    return "(" + " + ".join(f"{_mu(x, t)} / ({total} + 1e-8) * {t.weight}" for t in terms) + ")"


def _norm(x, terms, i):
    return f"({_mu(x, terms[i])} / ({' + '.join(_mu(x, t) for t in terms)} + 1e-8))"


_FIRINGS = [f"({_norm('v', V_TERMS, i)} * {_norm('e', E_TERMS, j)})" for i, j, _ in CROSS]
_CROSS = "(" + " + ".join(f"{f} / ({' + '.join(_FIRINGS)} + 1e-8) * {w}" for f, (_, _, w) in zip(_FIRINGS, CROSS, strict=True)) + ")"
RISK = FILLED + f", risk AS (SELECT user_id, hr, seen, since, v, e, {_risk('v', V_TERMS)} + {_risk('e', E_TERMS)} AS additive, {_CROSS} AS cross_risk FROM filled WHERE v IS NOT NULL AND e IS NOT NULL)"


def _risk_panel(spark, sf):
    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    mv, me = R.normalised(F.col("v"), V_TERMS), R.normalised(F.col("e"), E_TERMS)
    firings = [R.firing([mv[i], me[j]]) for i, j, _ in CROSS]
    additive = R.feature_risk(F.col("v"), V_TERMS) + R.feature_risk(F.col("e"), E_TERMS)
    return f.select("user_id", "hr", "seen", "since", "v", "e", additive.alias("additive"), R.cross_score(firings, [w for *_, w in CROSS]).alias("cross_risk"))


@query(RISK + "SELECT user_id, hr, round(additive, 6) AS additive, round(cross_risk, 6) AS cross_risk, round(additive + 0.2 * cross_risk, 6) AS risk FROM risk")
def rule_static_risk(spark, sf):
    r = _risk_panel(spark, sf)
    return X.rounded(r.select("user_id", "hr", "additive", "cross_risk", (F.col("additive") + 0.2 * F.col("cross_risk")).alias("risk")))


_TEMPORAL = RISK + """,
w AS (SELECT user_id, hr, list(additive + 0.2 * cross_risk) OVER t AS rs, avg((NOT seen)::INT) OVER t AS missing, since FROM risk WINDOW t AS (PARTITION BY user_id ORDER BY hr ROWS 5 PRECEDING)),
s AS (SELECT user_id, hr, rs, missing, since, list_transform(rs, lambda r: exp(tanh(r * 0.8 - 0.5))) AS ex FROM w WHERE len(rs) = 6),
a AS (SELECT user_id, hr, rs, missing, since, list_transform(ex, lambda x: x / list_sum(ex)) AS att FROM s),
temporal AS (SELECT user_id, hr, att, rs, list_sum(list_transform(list_zip(rs, att), lambda z: z[1] * z[2])) AS risk, missing,
                    ln(1 + least(greatest(since, 0), 168)) / ln(169) AS stale FROM a)"""


@query(_TEMPORAL + """SELECT user_id, hr, round(risk, 6) AS risk, round(list_sum(list_transform(att, lambda w: -w * ln(w))) / ln(6), 6) AS entropy, round(att[5] + att[6], 6) AS late_mass FROM temporal""")
def rule_attention(spark, sf):
    w = T.timeline("user_id", "hr")
    r = _risk_panel(spark, sf).withColumn("risk", F.col("additive") + 0.2 * F.col("cross_risk"))
    a = R.attention("risk", 0.8, -0.5, 6, 2, w)
    t = r.select("user_id", "hr", a["attended"].alias("risk"), a["entropy"].alias("entropy"), a["late_mass"].alias("late_mass"), F.count("*").over(T.trailing(w, 6)).alias("n"))
    return X.rounded(t.where("n = 6").drop("n"))


# Weights of the twelve signals before training.
SIGNAL_WEIGHTS = [0.05, 0.02, 0.10, 0.03, 0.12, 0.12, 0.12, 0.20, 0.20, 0.02, 0.02, 0.02]
_W, _T6 = "(PARTITION BY user_id ORDER BY hr)", "(PARTITION BY user_id ORDER BY hr ROWS 5 PRECEDING)"
_BASE = PANEL + f""",
base AS (SELECT user_id, hr, last_value("view" IGNORE NULLS) OVER w AS v, last_value(err IGNORE NULLS) OVER w AS e, ("view" IS NULL)::INT::DOUBLE AS mv, (err IS NULL)::INT::DOUBLE AS me,
                coalesce(hr - last_value(CASE WHEN "view" IS NOT NULL THEN hr END IGNORE NULLS) OVER w, hr + 1) AS sv, coalesce(hr - last_value(CASE WHEN err IS NOT NULL THEN hr END IGNORE NULLS) OVER w, hr + 1) AS se
         FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY hr ROWS UNBOUNDED PRECEDING)),
risks AS (SELECT *, rv + re + 0.2 * cross_risk AS risk FROM (SELECT user_id, hr, v, e, mv, me, sv, se, {_risk('v', V_TERMS)} AS rv, {_risk('e', E_TERMS)} AS re, {_CROSS} AS cross_risk,
                 {', '.join(f'{f} AS f{k}' for k, f in enumerate(_FIRINGS))} FROM base WHERE v IS NOT NULL AND e IS NOT NULL))"""


def _signal_sql(r, m, s):
    bad = f"(1 / (1 + exp(-(({r} - 0.5) / 0.2))))"
    return [f"avg({r}) OVER t / 4", f"min({r}) OVER t / 4", f"max({r}) OVER t / 4", f"stddev_pop({r}) OVER t / 2", f"tanh(regr_slope({r}, hr) OVER t)", f"tanh({r} - lag({r}) OVER w)",
            f"tanh({r} - first_value({r}) OVER t)", f"avg({bad}) OVER t", f"CASE WHEN sum(1 - {m}) OVER t > 0 THEN sum({bad} * (1 - {m})) OVER t / greatest(sum(1 - {m}) OVER t, 1) ELSE 0 END",
            f"avg({m}) OVER t", m, f"ln(1 + least(greatest({s}, 0), 168)) / ln(169)"]


_SIG = _BASE + f""",
sig AS (SELECT user_id, hr, v, e, risk, rv, re, cross_risk, f0, f1, f2, count(*) OVER t AS n, sum(exp(tanh(risk * 0.8 - 0.5)) * risk) OVER t / sum(exp(tanh(risk * 0.8 - 0.5))) OVER t AS attended,
               {', '.join(f'{x} AS v{k}' for k, x in enumerate(_signal_sql('rv', 'mv', 'sv')))}, {', '.join(f'{x} AS e{k}' for k, x in enumerate(_signal_sql('re', 'me', 'se')))}
        FROM risks WINDOW t AS {_T6}, w AS {_W}),
full6 AS (SELECT * FROM sig WHERE n = 6)"""
_EXPLICIT = "(" + " + ".join(f"{f}{k} * {w}" for f in "ve" for k, w in enumerate(SIGNAL_WEIGHTS)) + ")"


def _signal_panel(spark, sf):
    """Risks of two features with what was observed of each."""
    w = T.timeline("user_id", "hr")
    p = events_panel(spark, sf).select(
        "user_id", "hr", T.locf("view", w).alias("v"), T.locf("err", w).alias("e"), F.col("view").isNull().cast("double").alias("mv"), F.col("err").isNull().cast("double").alias("me"),
        T.recency("view", "hr", w).alias("sv"), T.recency("err", "hr", w).alias("se")).where("v IS NOT NULL AND e IS NOT NULL")
    mv, me = R.normalised(F.col("v"), V_TERMS), R.normalised(F.col("e"), E_TERMS)
    firings = [R.firing([mv[i], me[j]]) for i, j, _ in CROSS]
    p = p.withColumns({"rv": R.feature_risk(F.col("v"), V_TERMS), "re": R.feature_risk(F.col("e"), E_TERMS), "cross_risk": R.cross_score(firings, [x for *_, x in CROSS]),
                       **{f"f{k}": f for k, f in enumerate(firings)}})
    return p.withColumn("risk", F.col("rv") + F.col("re") + 0.2 * F.col("cross_risk"))


def _signals(spark, sf):
    """The panel with twelve signals of each feature (v0.., e0..) and the attended risk, where six hours are there."""
    w = T.timeline("user_id", "hr")
    p = _signal_panel(spark, sf)
    a = R.attention("risk", 0.8, -0.5, 6, 2, w)
    made = {f"{f}{k}": c for f in "ve" for k, c in enumerate(T.signals(f"r{f}", f"m{f}", f"s{f}", "hr", 6, w).values())}
    return p.withColumns({"n": F.count("*").over(T.trailing(w, 6)), **a, **made}).where("n = 6")


@query(_SIG + f"SELECT user_id, hr, {', '.join(f'round(v{k}, 6) AS {name}' for k, name in enumerate(T.SIGNALS))} FROM full6")
def temporal_signals(spark, sf):
    return X.rounded(_signals(spark, sf).select("user_id", "hr", *[F.col(f"v{k}").alias(name) for k, name in enumerate(T.SIGNALS)]))


@query(_SIG + f"SELECT user_id, hr, round(1 / (1 + exp(-(attended + 0.3 * {_EXPLICIT} / sqrt(2) - 1.2))), 6) AS probability FROM full6")
def rule_probability(spark, sf):
    """Probability from attended risk and the weighted signals of every feature, over the root of how many there are."""
    explicit = sum((F.col(f"{f}{k}") * x for f in "ve" for k, x in enumerate(SIGNAL_WEIGHTS)), F.lit(0.0))
    p = X.sigmoid(F.col("attended") + 0.3 * explicit / F.sqrt(F.lit(2.0)) - 1.2)
    return X.rounded(_signals(spark, sf).select("user_id", "hr", p.alias("probability")))


# The rule base before training, names of cross rules and signals' weights after it.
V_INITIAL = [R.Term("low", 22.0, 14.0, 0.0), R.Term("mid", 48.0, 22.0, 0.6), R.Term("high", 95.0, 25.0, 1.4)]
E_INITIAL = [R.Term("calm", 12.0, 18.0, 0.0), R.Term("alarm", 75.0, 28.0, 1.0)]
INITIAL, TRAINED = {"v": V_INITIAL, "e": E_INITIAL}, {"v": V_TERMS, "e": E_TERMS}
NAMED_CROSS = [("high_alarm", (("v", "high"), ("e", "alarm")), 1.4), ("low_calm", (("v", "low"), ("e", "calm")), 0.1), ("mid_alarm", (("v", "mid"), ("e", "alarm")), 0.7)]
TRAINED_SIGNALS = {
    "v": {"risk_slope": 0.15, "short_term_change": 0.10, "window_change": 0.02, "abnormal_duration": 0.30, "abnormal_frequency": 0.25},
    "e": {"risk_slope": 0.40, "short_term_change": -0.05, "window_change": 0.12, "abnormal_duration": 0.18, "abnormal_frequency": 0.11},
}
_INITIAL_RISK = f"({_risk('v', V_INITIAL)} + {_risk('e', E_INITIAL)})"


def _rules():
    return R.candidates(INITIAL, TRAINED, TRAINED_SIGNALS, NAMED_CROSS, 0.3, 0.2)


def _rule_rows(spark, sf):
    p = _signals(spark, sf).withColumn("y", (F.col("hr") % 3 == 0).cast("long"))
    mv, me = R.normalised(F.col("v"), V_TERMS), R.normalised(F.col("e"), E_TERMS)
    memberships = {("v", t.name): mv[i] for i, t in enumerate(V_TERMS)} | {("e", t.name): me[i] for i, t in enumerate(E_TERMS)}
    signals = {(f, s): F.col(f"{f}{k}") for f in "ve" for k, s in enumerate(T.SIGNALS)}
    return R.support(p, _rules(), memberships, signals, F.col("y"), 0.35, 0.2)


# What candidates the rule base has, worked out by hand: the strongest risk term of v is high (1.5 > 0.5) and of e alarm;
# their two strongest signals; for cross rules the strongest signal of the feature whose strongest one weighs most, e.
_SCALE = "0.3::DOUBLE / sqrt(2)"
_CANDIDATES = f"""cand AS (SELECT rule_id, signal, raw, alignment, mem, sg, th, least FROM (VALUES
  ('single::v::high::abnormal_duration', 'abnormal_duration', 1.5 + 0.30 * {_SCALE}, 1.0::DOUBLE, 'vh', 'v7', 0.5::DOUBLE, 0.35::DOUBLE),
  ('single::v::high::abnormal_frequency', 'abnormal_frequency', 1.5 + 0.25 * {_SCALE}, 1.0, 'vh', 'v8', 0.5, 0.35),
  ('single::e::alarm::risk_slope', 'risk_slope', 1.2 + 0.40 * {_SCALE}, 1.0, 'ea', 'e4', 0.02, 0.35),
  ('single::e::alarm::abnormal_duration', 'abnormal_duration', 1.2 + 0.18 * {_SCALE}, 1.0, 'ea', 'e7', 0.5, 0.35),
  ('cross::high_alarm::e::risk_slope', 'risk_slope', (1.5 + 1.2) / 2 + 0.40 * {_SCALE} + 1.4 * 0.2, 1.0, 'vh_ea', 'e4', 0.02, 0.2),
  ('cross::low_calm::e::risk_slope', 'risk_slope', (0.2 + 0.1) / 2 + 0.40 * {_SCALE} + 0.1 * 0.2, 0.5, 'vl_ec', 'e4', 0.02, 0.2),
  ('cross::mid_alarm::e::risk_slope', 'risk_slope', (0.5 + 1.2) / 2 + 0.40 * {_SCALE} + 0.7 * 0.2, 1.0, 'vm_ea', 'e4', 0.02, 0.2)) c(rule_id, signal, raw, alignment, mem, sg, th, least)),
seen AS (SELECT (hr % 3 = 0)::INT AS y, v4, v7, v8, e4, e7, {_norm('v', V_TERMS, 2)} AS vh, {_norm('v', V_TERMS, 0)} AS vl, {_norm('v', V_TERMS, 1)} AS vm, {_norm('e', E_TERMS, 1)} AS ea, {_norm('e', E_TERMS, 0)} AS ec FROM full6),
hits AS (SELECT rule_id, y, CASE mem WHEN 'vh' THEN vh WHEN 'ea' THEN ea WHEN 'vh_ea' THEN least(vh, ea) WHEN 'vl_ec' THEN least(vl, ec) ELSE least(vm, ea) END >= c.least
                AND CASE sg WHEN 'v7' THEN v7 WHEN 'v8' THEN v8 WHEN 'e4' THEN e4 ELSE e7 END >= th AS hit FROM seen, cand c),
counted AS (SELECT rule_id, count(*) AS n, avg(y) AS base, sum(hit::INT)::BIGINT AS support, sum((hit AND y = 1)::INT)::BIGINT AS positives FROM hits GROUP BY 1),
ruled AS (SELECT rule_id, signal, raw / max(raw) OVER () AS weight, alignment, support, positives, CASE WHEN support > 0 THEN positives / support / base END AS lift,
                 raw / max(raw) OVER () * sqrt(support / n) AS ranking FROM cand JOIN counted USING (rule_id))"""


@query(_SIG + ", " + _CANDIDATES + """
SELECT rule_id, signal, round(weight, 6) AS weight, round(alignment, 6) AS alignment, support, positives, round(lift, 6) AS lift, round(ranking, 6) AS ranking FROM ruled""")
def candidate_rules(spark, sf):
    """Temporal rules made from the rule base, with their support in the panel."""
    return X.rounded(_rule_rows(spark, sf))


@query(_SIG + ", " + _CANDIDATES + """,
placed AS (SELECT *, starts_with(rule_id, 'cross::') AS crossed, row_number() OVER (ORDER BY round(ranking, 9) DESC, weight DESC, rule_id) AS place FROM ruled),
top AS (SELECT *, row_number() OVER (PARTITION BY crossed ORDER BY place) AS nth FROM placed),
picked AS (SELECT *, place <= greatest(4 - (SELECT count(*) FROM top WHERE crossed AND nth <= 3), 1) AS head FROM top),
ranked AS (SELECT *, row_number() OVER (ORDER BY head DESC, place) AS rank FROM picked WHERE head OR (crossed AND nth <= 3)),
checked AS (SELECT rank, rule_id, (alignment > 0)::INT::DOUBLE AS static_ok, 1.0::DOUBLE AS temporal_ok, CASE WHEN crossed THEN 1.0::DOUBLE END AS cross_ok FROM ranked WHERE rank <= 4)
SELECT rank, rule_id, static_ok, temporal_ok, cross_ok, round((static_ok + temporal_ok + coalesce(cross_ok, 0)) / (2 + (cross_ok IS NOT NULL)::INT), 6) AS score FROM checked""")
def direction_rubric(spark, sf):
    return X.rounded(R.rubric(_rule_rows(spark, sf).withColumn("ranking", F.round("ranking", 9)), 4))


def _fitted_sql(f, terms):
    for i, t in enumerate(terms):
        m = _norm(f, terms, i)
        mean = f"sum({m} * {f}) / sum({m})"
        yield (f"SELECT '{f}' AS feature, '{t.name}' AS term, {t.centre}::DOUBLE AS c0, {t.sigma}::DOUBLE AS s0, {t.weight}::DOUBLE AS w0, {mean} AS c1,"
               f" sqrt(sum({m} * {f} * {f}) / sum({m}) - ({mean}) * ({mean})) AS s1, sum({m} * y) / sum({m}) AS w1 FROM m")  # fmt: skip


@query(FILLED + """,
m AS (SELECT *, (hr * 2 > max(hr) OVER (PARTITION BY user_id))::INT AS y FROM filled WHERE v IS NOT NULL AND e IS NOT NULL),
t AS (""" + " UNION ALL ".join([*_fitted_sql("v", V_INITIAL), *_fitted_sql("e", E_INITIAL)]) + """)
SELECT feature, term, round(c1 - c0, 6) AS centre_shift, round(abs(c1 - c0) / s0, 6) AS shift_in_sigma, round(abs(s1 - s0) / s0, 6) AS sigma_shift, round(abs(w1 - w0), 6) AS weight_shift FROM t""")
def membership_drift(spark, sf):
    """How far each term is from where the panel's values and outcomes would put it."""
    from pyspark.sql.window import Window

    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    f = f.withColumn("y", (F.col("hr") * 2 > F.max("hr").over(Window.partitionBy("user_id"))).cast("int"))
    return X.rounded(R.membership_drift(spark, INITIAL, {k: R.fitted_terms(f, k, terms, F.col("y")) for k, terms in INITIAL.items()}))


@query(_BASE + f""",
a AS (SELECT f0, f1, f2, sum(exp(tanh(risk * 0.8 - 0.5))) OVER t AS s, sum(exp(tanh(risk * 0.8 - 0.5)) * tanh(risk * 0.8 - 0.5)) OVER t AS es, sum(exp(tanh(risk * 0.8 - 0.5))) OVER l AS late, count(*) OVER t AS n,
             round(risk, 6) AS learned, round({_INITIAL_RISK}, 6) AS guide FROM risks WINDOW t AS {_T6}, l AS (PARTITION BY user_id ORDER BY hr ROWS 1 PRECEDING)),
q AS (SELECT * FROM a WHERE n = 6),
k AS (SELECT rank() OVER (ORDER BY learned) + (count(*) OVER (PARTITION BY learned) - 1) / 2 AS ra, rank() OVER (ORDER BY guide) + (count(*) OVER (PARTITION BY guide) - 1) / 2 AS rb FROM q)
SELECT count(*) AS n, round(avg((f0 + f1 + f2) / 3), 6) AS mean_activation, round(avg(((f0 > 0.1)::INT + (f1 > 0.1)::INT + (f2 > 0.1)::INT) / 3), 6) AS active_share, round(avg(greatest(f0, f1, f2)), 6) AS top_activation,
       round(avg((ln(s) - es / s) / ln(6)), 6) AS entropy, round(avg(late / s), 6) AS late_mass, (SELECT round(corr(ra, rb), 5) FROM k) AS concordance FROM q""")
def rule_quality(spark, sf):
    """How strongly rules fire, how attention lies, and how the learned risk ranks rows as the guideline's does."""
    x = _signals(spark, sf)
    guide = R.feature_risk(F.col("v"), V_INITIAL) + R.feature_risk(F.col("e"), E_INITIAL)
    x = x.withColumns({"learned": F.round("risk", 6), "guide": F.round(guide, 6)})
    f = [F.col(f"f{k}") for k in range(len(CROSS))]
    mean = lambda cs: sum(cs[1:], cs[0]) / len(cs)
    averaged = {"mean_activation": mean(f), "active_share": mean([(c > 0.1).cast("int") for c in f]), "top_activation": F.greatest(*f), "entropy": F.col("entropy"), "late_mass": F.col("late_mass")}
    # The panel is read once: rows are summed by what they are ranked by.
    pairs = settled(x.groupBy("learned", "guide").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in averaged.items()]))
    stats = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[(F.sum(k) / F.sum("n")).alias(k) for k in averaged])
    ranks = T.average_rank(T.average_rank(pairs.select("learned", "guide", "n"), "learned", "ra", "n"), "guide", "rb", "n")
    middle = ((F.col("all") + 1) / 2).cast("double")  # the mean of ranks
    ranks = ranks.join(pairs.agg(F.sum("n").alias("all"))).select("n", (F.col("ra") - middle).alias("a"), (F.col("rb") - middle).alias("b"))  # one row
    times = lambda p, q: F.sum(F.col("n") * F.col(p) * F.col(q))
    rho = times("a", "b") / F.nullif(F.sqrt(times("a", "a")) * F.sqrt(times("b", "b")), F.lit(0.0))
    return X.rounded(stats.join(ranks.agg(F.round(rho, 5).alias("concordance"))))  # one row on either side


@query(_SIG + f""",
parts AS (SELECT s.user_id, s.hr, att_v, att_e, att_f0, att_f1, att_f2, {' + '.join(f'v{k} * {w}' for k, w in enumerate(SIGNAL_WEIGHTS))} AS xv, {' + '.join(f'e{k} * {w}' for k, w in enumerate(SIGNAL_WEIGHTS))} AS xe
          FROM full6 s JOIN (SELECT user_id, hr, {', '.join(f"sum(exp(tanh(risk * 0.8 - 0.5)) * {c}) OVER t / sum(exp(tanh(risk * 0.8 - 0.5))) OVER t AS att_{n}" for c, n in (("rv", "v"), ("re", "e"), ("f0", "f0"), ("f1", "f1"), ("f2", "f2")))}
                             FROM risks WINDOW t AS {_T6}) a USING (user_id, hr)),
share AS (SELECT user_id, hr, att_v, att_e, (att_f0 * 1.4 + att_f1 * 0.1 + att_f2 * 0.7) * 0.2 / 2 AS crossed, xv * 0.3 / sqrt(2) AS tv, xe * 0.3 / sqrt(2) AS te FROM parts)
SELECT user_id, hr, round(att_v + crossed + tv, 6) AS v, round(att_e + crossed + te, 6) AS e,
       round((abs(tv) + abs(te)) / (abs(att_v) + abs(att_e) + 2 * abs(crossed) + abs(tv) + abs(te) + 1e-12), 6) AS temporal_mass FROM share""")
def intrinsic_attribution(spark, sf):
    """What each feature adds to the score: its attended risk, half of each cross rule that it is part of, its signals."""
    w = T.timeline("user_id", "hr")
    p, t = _signal_panel(spark, sf), T.trailing(T.timeline("user_id", "hr"), 6)
    e = F.exp(F.tanh(F.col("risk") * 0.8 - 0.5))
    attended = {f"att_{c}": F.sum(e * F.col(c)).over(t) / F.sum(e).over(t) for c in ("rv", "re", *(f"f{k}" for k in range(len(CROSS))))}
    made = {f"{f}{k}": c for f in "ve" for k, c in enumerate(T.signals(f"r{f}", f"m{f}", f"s{f}", "hr", 6, w).values())}
    x = p.withColumns({"n": F.count("*").over(t), **attended, **made}).where("n = 6")
    crossed = sum((F.col(f"att_f{k}") * c for k, (*_, c) in enumerate(CROSS)), F.lit(0.0)) * 0.2 / 2
    explicit = {f: sum((F.col(f"{f}{k}") * c for k, c in enumerate(SIGNAL_WEIGHTS)), F.lit(0.0)) * 0.3 / F.sqrt(F.lit(2.0)) for f in "ve"}
    x = x.select("user_id", "hr", F.col("att_rv").alias("bv"), F.col("att_re").alias("be"), crossed.alias("c"), explicit["v"].alias("tv"), explicit["e"].alias("te"))
    temporal = F.abs("tv") + F.abs("te")
    return X.rounded(x.select("user_id", "hr", (F.col("bv") + F.col("c") + F.col("tv")).alias("v"), (F.col("be") + F.col("c") + F.col("te")).alias("e"),
                              (temporal / (F.abs("bv") + F.abs("be") + 2 * F.abs("c") + temporal + 1e-12)).alias("temporal_mass")))


@query(_BASE + f"""
SELECT user_id, hr, round(CASE k WHEN 2 THEN {_risk('50.0::DOUBLE', V_TERMS)} + {_risk('10.0::DOUBLE', E_TERMS)} ELSE rv + re END, 6) AS risk, CASE k WHEN 1 THEN 0 ELSE mv + me END AS missing,
       (['full', 'no_missingness', 'missingness_only'])[k + 1] AS mode FROM risks, range(3) m(k)""")
def masked_inputs(spark, sf):
    """The risk and the missingness that a model sees with each part of its inputs hidden."""
    p = _signal_panel(spark, sf).select("user_id", "hr", "v", "e", "mv", "me")
    out = None
    for mode in ("full", "no_missingness", "missingness_only"):
        x = R.masked(p, mode, {"v": 50.0, "e": 10.0}, ["mv", "me"])
        x = x.select("user_id", "hr", (R.feature_risk(F.col("v"), V_TERMS) + R.feature_risk(F.col("e"), E_TERMS)).alias("risk"), (F.col("mv") + F.col("me")).alias("missing"), F.lit(mode).alias("mode"))
        out = x if out is None else out.unionByName(x)
    return X.rounded(out)


_UNIT = "(('0x' || substr(md5('9|value|{what}|' || i), 1, 8))::BIGINT / 4294967296)"


@query(f"""
WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, [quantile_cont(value, 0.05), quantile_cont(value, 0.5), quantile_cont(value, 0.95)] AS c FROM events),
g AS (SELECT *, greatest(hi - lo, 1e-3) / 2 AS gap FROM q),
m AS (SELECT i, gap, least(greatest(c[i + 1] + gap * 0.3 * ({_UNIT.format(what='jitter')} - 0.5), lo), hi) AS centre, {_UNIT.format(what='order')} AS o, {_UNIT.format(what='sigma')} AS su, {_UNIT.format(what='weight')} AS wu FROM g, range(3) t(i)),
d AS (SELECT centre, row_number() OVER (ORDER BY o) - 1 AS place FROM m)
SELECT (['low', 'mid', 'high'])[m.i + 1] AS term, round(d.centre, 6) AS centre, round(least(greatest(gap * (0.75 + 0.75 * su), 1e-3), 80), 6) AS sigma, round(0.5 * wu, 6) AS weight FROM m JOIN d ON d.place = m.i""")
def data_driven_terms(spark, sf):
    terms = R.data_terms(table(spark, sf, "events"), "value", ["low", "mid", "high"], 9)
    rows = [(t.name, t.centre, t.sigma, t.weight) for t in terms]
    return X.rounded(spark.createDataFrame(rows, "term string, centre double, sigma double, weight double"))


@query(_BASE + f""",
chosen AS (SELECT hr % 3 AS m, f0 AS c0, f1 AS c1, f2 AS c2, {', '.join(f"arg_max(f{k}, round(risk, 9) * 1000000 - hr * 1e-6) OVER t AS a{k}" for k in range(len(CROSS)))}, count(*) OVER t AS n FROM risks WINDOW t AS {_T6}),
long AS (SELECT 'current' AS basis, (m = 0)::INT AS y, unnest([c0, c1, c2]) AS f, unnest([0, 1, 2]) AS rule FROM chosen WHERE n = 6 UNION ALL SELECT 'attended', (m = 0)::INT, unnest([a0, a1, a2]), unnest([0, 1, 2]) FROM chosen WHERE n = 6)
SELECT basis, t AS threshold, rule::BIGINT AS rule, sum((f >= t)::INT)::BIGINT AS support, sum((f >= t AND y = 1)::INT)::BIGINT AS positives, round(avg(f), 6) AS mean_firing, round(avg(f) FILTER (y = 1), 6) AS mean_positive
FROM long, (VALUES (0.1::DOUBLE), (0.3)) h(t) GROUP BY 1, 2, 3""")
def rule_firing_sensitivity(spark, sf):
    """Firing at each threshold, now and at the hour that attention weights most (the one of greatest risk)."""
    w = T.timeline("user_id", "hr")
    t, places = T.trailing(w, 6), range(len(CROSS))
    order = F.struct(F.round("risk", 9), -F.col("hr"))
    x = _signal_panel(spark, sf).select((F.col("hr") % 3 == 0).cast("long").alias("y"), *[F.col(f"f{k}").alias(f"c{k}") for k in places], *[F.max_by(f"f{k}", order).over(t).alias(f"a{k}") for k in places], F.count("*").over(t).alias("n"))
    x = x.where("n = 6")
    cells = [(basis, th, k, F.col(f"{c}{k}")) for basis, c in (("current", "c"), ("attended", "a")) for th in (0.1, 0.3) for k in places]
    aggs = [a for i, (_, th, _, f) in enumerate(cells) for a in (F.sum((f >= th).cast("long")).alias(f"s{i}"), F.sum(((f >= th) & (F.col("y") == 1)).cast("long")).alias(f"p{i}"), F.avg(f).alias(f"m{i}"), F.avg(F.when(F.col("y") == 1, f)).alias(f"q{i}"))]
    one = x.agg(*aggs)
    parts = [F.struct(F.lit(b).alias("basis"), F.lit(th).alias("threshold"), F.lit(k).cast("long").alias("rule"), F.col(f"s{i}").alias("support"), F.col(f"p{i}").alias("positives"), F.col(f"m{i}").alias("mean_firing"), F.col(f"q{i}").alias("mean_positive"))
             for i, (b, th, k, _) in enumerate(cells)]
    return X.rounded(one.select(F.inline(F.array(*parts))))


@query(FILLED + f""",
m AS (SELECT *, max(hr) OVER (PARTITION BY user_id) AS last FROM filled WHERE v IS NOT NULL AND e IS NOT NULL),
r AS (SELECT t, rule, hit, (hr * 2 > last)::INT AS y FROM (SELECT hr, last, t, unnest([{', '.join(f"{{'rule': {k}, 'hit': {_norm('v', V_TERMS, i)} >= t AND {_norm('e', E_TERMS, j)} >= t}}" for k, (i, j, _) in enumerate(CROSS))}], recursive := true) FROM m, (VALUES (0.3::DOUBLE), (0.5)) h(t)))
SELECT t AS threshold, rule::BIGINT AS rule, round(avg(hit::INT), 6) AS support, sum((hit AND y = 1)::INT)::BIGINT AS positives,
       round(CASE WHEN sum(hit::INT) > 0 THEN (sum((hit AND y = 1)::INT) / sum(hit::INT)) / avg(y) END, 6) AS lift FROM r GROUP BY 1, 2""")
def rule_support(spark, sf):
    """Support and lift of each rule at several membership thresholds, in one pass over the panel."""
    from pyspark.sql.window import Window

    f = filled_panel(spark, sf).where("v IS NOT NULL AND e IS NOT NULL")
    y = (F.col("hr") * 2 > F.max("hr").over(Window.partitionBy("user_id"))).cast("int")
    mv, me = R.normalised(F.col("v"), V_TERMS), R.normalised(F.col("e"), E_TERMS)
    cells = [(t, k, (mv[i] >= t) & (me[j] >= t)) for t in (0.3, 0.5) for k, (i, j, _) in enumerate(CROSS)]
    f = f.withColumn("y", y)
    aggs = [F.count("*").alias("n"), F.sum("y").alias("pos")]
    for c, (_, _, hit) in enumerate(cells):
        aggs += [F.sum(hit.cast("int")).alias(f"s{c}"), F.sum((hit & (F.col("y") == 1)).cast("int")).alias(f"p{c}")]
    one = f.agg(*aggs)
    parts = [F.struct(F.lit(t).alias("threshold"), F.lit(k).cast("long").alias("rule"), (F.col(f"s{c}") / F.col("n")).alias("support"), F.col(f"p{c}").alias("positives"),
                      F.when(F.col(f"s{c}") > 0, F.col(f"p{c}") / F.col(f"s{c}") / (F.col("pos") / F.col("n"))).alias("lift")) for c, (t, k, _) in enumerate(cells)]
    return X.rounded(one.select(F.inline(F.array(*parts))))


@query(RISK + """,
d AS (SELECT user_id, additive - lag(additive) OVER w AS dr, v - lag(v) OVER w AS dv, hr - lag(hr) OVER w AS gap FROM risk WINDOW w AS (PARTITION BY user_id ORDER BY hr))
SELECT user_id, count(*) AS pairs, round(avg((dv > 0.5 AND dr < -0.0001)::INT), 6) AS violations, round(avg((dr > 0)::INT), 6) AS worsening FROM d WHERE gap = 1 GROUP BY 1""")
def rule_behaviour(spark, sf):
    w = T.timeline("user_id", "hr")
    d = _risk_panel(spark, sf).select("user_id", (F.col("additive") - F.lag("additive").over(w)).alias("dr"), (F.col("v") - F.lag("v").over(w)).alias("dv"), T.adjacent(w, "hr").alias("ok")).where("ok")
    bad = (F.col("dv") > 0.5) & (F.col("dr") < -0.0001)
    return X.rounded(d.groupBy("user_id").agg(F.count("*").alias("pairs"), F.avg(bad.cast("int")).alias("violations"), F.avg((F.col("dr") > 0).cast("int")).alias("worsening")))


@query(_BASE + """,
d AS (SELECT rv - lag(rv) OVER w AS dv, re - lag(re) OVER w AS de, risk - lag(risk) OVER w AS dr, hr - lag(hr) OVER w AS gap FROM risks WINDOW w AS (PARTITION BY user_id ORDER BY hr)),
p AS (SELECT *, dv + de AS da, (dv > 1e-6)::INT + (de > 1e-6)::INT AS worse, CASE WHEN dr < -1e-6 THEN (dv > 1e-6)::INT + (de > 1e-6)::INT ELSE 0 END AS against FROM d WHERE gap = 1)
SELECT count(*) AS transitions, round(sum(against) / greatest(sum(worse), 1), 6) AS violation_given_worsening, round(sum(against) / (2 * count(*)), 6) AS violation_rate,
       round(sum(greatest(dv, 0) * greatest(-dr, 0) + greatest(de, 0) * greatest(-dr, 0)) / (2 * count(*)), 9) AS penalty,
       round(sum((da > 1e-6 AND dr < -1e-6)::INT) / greatest(sum((da > 1e-6)::INT), 1), 6) AS reversal_given_worsening, round(avg((da > 1e-6 AND dr < -1e-6)::INT), 6) AS reversal_rate,
       round(coalesce(quantile_cont(CASE WHEN da > 1e-6 AND dr < -1e-6 THEN -dr END, 0.5), 0), 6) AS reversal_median FROM p""")
def rule_consistency(spark, sf):
    """How often a feature's risk rises while the total falls, and how often the total falls against the sum of them."""
    w, eps = T.timeline("user_id", "hr"), 1e-6
    step = lambda c: F.col(c) - F.lag(c).over(w)
    d = settled(_signal_panel(spark, sf).select(step("rv").alias("dv"), step("re").alias("de"), step("risk").alias("dr"), T.adjacent(w, "hr").alias("ok")).where("ok"))
    falls, both = F.col("dr") < -eps, [F.col("dv"), F.col("de")]
    worse = sum(((c > eps).cast("int") for c in both), F.lit(0))
    reversal = (F.col("dv") + F.col("de") > eps) & falls
    penalty = sum((F.greatest(c, F.lit(0.0)) * F.greatest(-F.col("dr"), F.lit(0.0)) for c in both), F.lit(0.0))
    one = d.agg(F.count("*").alias("transitions"), F.sum(worse).alias("w"), F.sum(F.when(falls, worse).otherwise(0)).alias("a"), F.sum(penalty).alias("s"), F.sum((F.col("dv") + F.col("de") > eps).cast("int")).alias("up"),
                F.sum(reversal.cast("int")).alias("r")).join(quantile_columns(d.select(F.when(reversal, -F.col("dr")).alias("back")), "back", {"m": 0.5}))
    n, r = F.col("transitions"), lambda c: F.round(c, 6)
    return one.select(n, r(F.col("a") / F.greatest("w", F.lit(1))).alias("violation_given_worsening"), r(F.col("a") / (2 * n)).alias("violation_rate"), F.round(F.col("s") / (2 * n), 9).alias("penalty"),
                      r(F.col("r") / F.greatest("up", F.lit(1))).alias("reversal_given_worsening"), r(F.col("r") / n).alias("reversal_rate"), r(F.coalesce("m", F.lit(0.0))).alias("reversal_median"))


_EMB = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


@query(_EMB + """,
n AS (SELECT vec_id, list_reverse_sort(list_transform(a, lambda x: abs(x) / (list_sum(list_transform(a, lambda y: abs(y))) + 1e-12))) AS s FROM e),
u AS (SELECT vec_id, i, list_sum(s[1:i]) AS cum FROM (SELECT vec_id, s, unnest(range(1, len(s) + 1)) AS i FROM n))
SELECT vec_id, min(i) FILTER (cum >= 0.8) AS effective FROM u GROUP BY 1""")
def attribution_effective(spark, sf):
    return _embeddings(spark, sf).select("vec_id", R.effective_count(F.col("a"), 0.8).cast("long").alias("effective"))


@query(_EMB + """, p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
t AS (SELECT vec_id, list_transform(list_sort(list_transform(range(0, len(a)), lambda i: {'x': -abs(a[i + 1]), 'i': i}))[1:5], lambda s: s.i) AS ta,
             list_transform(list_sort(list_transform(range(0, len(b)), lambda i: {'x': -abs(b[i + 1]), 'i': i}))[1:5], lambda s: s.i) AS tb, a, b FROM p)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS top_overlap FROM t""")
def attribution_stability(spark, sf):
    e = _embeddings(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    j = e.join(b, "vec_id")
    return X.rounded(j.select("vec_id", R.cosine(F.col("a"), F.col("b")).alias("cosine"), J.jaccard(R.top_places(F.col("a"), 5), R.top_places(F.col("b"), 5)).alias("top_overlap")))


@query(_EMB + "SELECT label::BIGINT AS label, i::BIGINT AS place, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def attribution_summary(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    return X.rounded(e.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")))


_DRAW = "(('0x' || substr(md5('5|' || vec_id || '|{k}|' || (i - 1)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
_NOISE = f"sqrt(-2 * ln({_DRAW.format(k='r')})) * cos(2 * pi() * ({_DRAW.format(k='a')}))"


@query(_EMB + f""",
n AS (SELECT vec_id, a, list_transform(range(1, len(a) + 1), lambda i: a[i] + 0.05::DOUBLE * ({_NOISE})) AS b FROM e)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / len(a), 6) AS moved FROM n""")
def attribution_perturbed(spark, sf):
    """How stable vectors are under Gaussian noise of a fifth of a deviation or so, drawn from hashes of vector and place."""
    def draw(what, i):
        return (X.hash_unit(F.lit(5), F.col("vec_id"), F.lit(what), i) + 0.5) / 4294967296

    def noise(i):
        return F.sqrt(-2 * F.log(draw("r", i))) * F.cos(2 * F.pi() * draw("a", i))

    e = _embeddings(spark, sf).withColumn("b", F.transform("a", lambda x, i: x + 0.05 * noise(i)))
    moved = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    return X.rounded(e.select("vec_id", R.cosine(F.col("a"), F.col("b")).alias("cosine"), moved.alias("moved")))


@query(_EMB + """,
n AS (SELECT max(len(a)) AS n FROM e),
s AS (SELECT vec_id, list_transform(range(0, 4), lambda v: coalesce(list_sum(list_transform(list_filter(range(0, n), lambda k: k * 4 // n = v), lambda k: coalesce(a[k + 1], 0))), 0)) AS g FROM e, n),
t AS (SELECT vec_id, g, abs(g[1]) + abs(g[2]) + abs(g[3]) + abs(g[4]) AS total FROM s)
SELECT vec_id, round(g[1] / (total + 1e-12), 6) AS first, round(g[2] / (total + 1e-12), 6) AS second, round(g[3] / (total + 1e-12), 6) AS third, round(g[4] / (total + 1e-12), 6) AS fourth FROM t""")
def attribution_by_variable(spark, sf):
    """Attributions of summary features added up by the variable that each belongs to, normalised by their sizes' sum."""
    e = _embeddings(spark, sf)
    n = e.agg(F.max(F.size("a"))).first()[0] or 0  # one number
    mapping = [4 * k // n for k in range(n)]
    groups = R.by_variable(F.col("a"), mapping, 4)
    x = e.select("vec_id", groups.alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda s, v: s + F.abs(v)) + 1e-12
    names = ("first", "second", "third", "fourth")
    return X.rounded(x.select("vec_id", *[(F.col("g")[i] / total).alias(n) for i, n in enumerate(names)]))
