"""Hand-checked values of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.functions import scores as S
from chronopanel.operators import metrics as E
from chronopanel.operators import panel as P
from chronopanel.operators import protocol as D
from chronopanel.operators import rules as R
from chronopanel.operators import temporal as T
from chronopanel.plans import guards
from chronopanel.sources import ingest


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def series(spark, rows, schema="k string, h long, v double"):
    return spark.createDataFrame(rows, schema)


def test_locf_and_recency_stay_within_the_entity(spark):
    df = series(spark, [("a", 0, None), ("a", 1, 10.0), ("a", 2, None), ("a", 3, None), ("a", 4, 20.0), ("b", 0, None)])
    w = T.timeline("k", "h")
    out = df.select("k", "h", T.locf("v", w).alias("f"), T.recency("v", "h", w).alias("r")).orderBy("k", "h")
    assert values(out, "f") == [None, 10, 10, 10, 20, None]
    assert values(out, "r") == [1, 0, 1, 2, 0, 1]


def test_window_regimes(spark):
    df = series(spark, [("a", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 8.0])])
    out = df.select("h", *[c.alias(n) for n, c in T.trailing_stats("v", 3, T.timeline("k", "h")).items()]).orderBy("h")
    assert values(out, "v_w3_mean") == pytest.approx([1, 1.5, 7 / 3, 14 / 3])
    assert values(out, "v_w3_change") == [None, None, 3, 6]
    assert values(out, "v_w3_slope") == [None, None, 1.5, 3]
    assert values(out, "v_w3_std")[0] == 0


def test_abnormal_frequency_counts_observed_hours(spark):
    df = spark.createDataFrame([("a", 0, True, True), ("a", 1, True, False), ("a", 2, False, True)], "k string, h long, bad boolean, seen boolean")
    d, f = T.abnormal_exposure(F.col("bad"), F.col("seen"), 3, T.timeline("k", "h"))
    out = df.select("h", d.alias("d"), f.alias("f")).orderBy("h")
    assert values(out, "d") == [1, 2, 2]
    assert values(out, "f") == [1, 1, 0.5]


def test_future_label_is_censored_by_the_last_hour(spark):
    df = series(spark, [("a", i, v) for i, v in enumerate([1.0, 1.0, 3.0, 1.0])])
    w = T.timeline("k", "h")
    out = df.select("h", T.future_max("v", 2, w).alias("m"), T.rise_label("v", "h", 2, 2.0, "k", w).alias("y")).orderBy("h")
    assert values(out, "m") == [3, 3, 1, None]
    assert values(out, "y") == [1, 1, None, None]


def test_refractory(spark):
    df = series(spark, [("a", h, 1.0) for h in (1, 3, 6, 7, 12, 13, 20)])
    assert sorted(values(T.refractory_alerts(df, "k", "h", 6), "h")) == [1, 7, 13, 20]


def test_interval_end_is_excluded_by_a_second(spark):
    t = lambda s: f"2024-01-01 {s}"
    rows = [(1, t("00:30:00"), t("02:00:00")), (2, t("03:00:00"), t("01:00:00"))]
    df = spark.createDataFrame(rows, "id int, a string, b string").selectExpr("id", "cast(a as timestamp_ntz) a", "cast(b as timestamp_ntz) b", "timestamp_ntz'2024-01-01' low", "timestamp_ntz'2024-01-02' high")
    assert sorted(values(P.expand_intervals(df, "a", "b", "low", "high"), "id", "hr")) == [(1, 0), (1, 1)]


def test_fio2(spark):
    df = spark.createDataFrame([(x,) for x in (0.10, 0.21, 0.5, 1.0, 50.0, 100.0, 120.0)], "x double").coalesce(1)
    assert values(df.select(X.fio2_fraction(F.col("x")).alias("f")), "f") == [None, 0.21, 0.5, 1.0, 0.5, 1.0, None]


def test_dose(spark):
    rows = [(1.0, "mg/kg/hour", 80.0), (8.0, "mcg/min", 80.0), (8.0, "mcg/min", None), (5.0, "units/hour", 80.0)]
    df = spark.createDataFrame(rows, "r double, u string, w double").coalesce(1)
    got = values(df.select(X.dose_per_kg_minute(F.col("r"), F.col("u"), F.col("w")).alias("d")), "d")
    assert got[:2] == pytest.approx([1000 / 60, 0.1])
    assert got[2:] == [None, None]


def test_plausible_and_ventilated(spark):
    rows = [("heart_rate", 19.9), ("heart_rate", 20.0), ("heart_rate", 300.0), ("heart_rate", 301.0), ("other", 999.0)]
    df = spark.createDataFrame(rows, "f string, v double").coalesce(1)
    assert values(df.select(X.plausible(F.col("v"), F.col("f")).alias("p")), "p") == [None, 20, 300, None, 999]
    df = spark.createDataFrame([(None,), (" OFF ",), ("Standby",), ("CMV",), ("",)], "t string").coalesce(1)
    assert values(df.select(X.ventilated(F.col("t")).alias("v")), "v") == [0, 0, 0, 1, 0]


def test_scores(spark):
    lit = F.lit
    resp = [S.respiration(lit(float(r)), lit(v)).alias(f"r{r}{v}") for v in (1, 0) for r in (99, 199, 299, 399, 400)]
    assert one(spark, *resp) == (4, 3, 2, 1, 0, 2, 2, 2, 1, 0)
    n = lit(None).cast("double")
    cardio = [S.cardiovascular(n, n, n, n, n), S.cardiovascular(lit(65.0), n, n, n, n), S.cardiovascular(lit(80.0), lit(5.0), n, n, n),
              S.cardiovascular(lit(80.0), lit(5.1), n, n, n), S.cardiovascular(lit(80.0), n, n, n, lit(0.1)), S.cardiovascular(lit(80.0), n, n, n, lit(0.11))]
    assert one(spark, *cardio) == (None, 1, 2, 3, 3, 4)
    assert one(spark, S.renal(n, lit(450.0)), S.renal(lit(5.2), n), S.renal(n, n)) == (3, 4, None)
    bands = S.EARLY_WARNING
    assert one(spark, *[S.in_bands(lit(x), bands["respiratory_rate"]) for x in (24.0, 24.5, 25.0)]) == (2, 0, 3)
    assert one(spark, *[S.in_bands(lit(x), bands["spo2"]) for x in (91.0, 91.5, 92.0)]) == (3, 0, 2)


def test_totals(spark):
    parts = [F.lit(1), F.lit(2), *[F.lit(None).cast("int")] * 4]
    assert one(spark, X.present_count(*parts), X.filled_sum(*parts), X.null_strict_sum(*parts), X.filled_sum(*parts, least=4)) == (2, 3, None, None)


def test_auroc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8)], "y int, p double")
    assert E.auroc(E.curve(df)).first()[0] == 0.875
    assert E.auroc(E.curve(df.where("y = 1"))).first()[0] is None


def test_calibration_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.3, 0.6, 0.7, 1.0)], "p double").coalesce(1)
    assert values(df.select(E.bin_of(F.col("p"), E.equal_edges(10)).alias("b")), "b") == [2, 5, 6, 9]


def test_undefined_rates(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double")
    cells = df.agg(*[c.alias(k) for k, c in E.confusion(F.col("y"), F.col("p") >= 0.5).items()])
    assert cells.select(E.rates(0.0)["ppv"]).first()[0] == 0
    assert cells.select(E.rates(None)["ppv"]).first()[0] is None


def test_allocation(spark):
    parts = [0.7, 0.15, 0.15]
    df = spark.createDataFrame([(10,), (3,), (1,)], "n long").coalesce(1)
    got = values(df.select(F.array(*D.allocation(F.col("n"), parts)).alias("a")), "a")
    assert got == [[7, 2, 1], [1, 1, 1], [1, 0, 0]]


def test_effective_features(spark):
    a = F.array(*[F.lit(x) for x in (5.0, 3.0, 1.0, 1.0)])
    assert one(spark, R.effective_count(a, 0.8)) == (3,)


def test_guards(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(guards.GuardError):
        guards.require_unique(df, ["k"])
    with pytest.raises(guards.GuardError):
        guards.require_columns(df, ["absent"])
    with pytest.raises(guards.GuardError):
        guards.require_fractions([0.5, 0.6])
    with pytest.raises(Exception, match="other values"):
        guards.require_domain(df, "v", [1]).collect()
    guards.require_mapped(df, df.select("k"), "k")


def test_csv_roundtrip_and_optional(spark, tmp_path):
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("id", Ty.LongType()), Ty.StructField("x", Ty.DoubleType())])
    rows = spark.createDataFrame([(1, 0.5), (2, None)], schema)
    rows.write.option("compression", "gzip").csv(str(tmp_path / "t"))
    assert sorted(values(ingest.scan(spark, str(tmp_path / "t"), schema, kind="csv"), "id", "x"), key=str) == [(1, 0.5), (2, None)]
    assert ingest.optional(spark, str(tmp_path / "none"), schema).count() == 0
    ingest.append(rows, str(tmp_path / "p"))
    ingest.append(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert ingest.schema_audit({"t": rows}, {"t": ["id", "y"], "u": ["a"]}) == [
        {"table": "t", "present": True, "missing": ["y"]}, {"table": "u", "present": False, "missing": ["a"]}]
    with pytest.raises(ValueError, match="schema"):
        ingest.scan(spark, "x", kind="csv")
