"""Sources, sinks, guards and protocol errors on small fixtures."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from chronopanel.functions import exprs as X
from chronopanel.operators import aggregates as A
from chronopanel.operators import joins as J
from chronopanel.operators import metrics as E
from chronopanel.operators import ordered
from chronopanel.operators import protocol as D
from chronopanel.operators import rules as R
from chronopanel.operators import severity as O
from chronopanel.operators import temporal as T
from chronopanel.plans import guards
from chronopanel.sources import ingest

MANIFEST = "k long, split string"


def test_units_that_the_rules_know(spark):
    rows = [(6.0, u, 80.0) for u in ("mcg/kg/hr", "mg/kg/hr", "mcg/hour", "mcg/hr", "mg/hour", "mg/hr", "direct mcg/min", "units/hour")] + [(6.0, "mg/min", 0.0), (6.0, "mg/min", None), (6.0, None, 80.0)]
    df = spark.createDataFrame(rows, "r double, u string, w double").coalesce(1)
    got = [r[0] for r in df.select(X.dose_per_kg_minute(F.col("r"), F.col("u"), F.col("w"))).collect()]
    assert got[:7] == pytest.approx([0.1, 100.0, 0.1 / 80, 0.1 / 80, 100 / 80, 100 / 80, 6 / 80]) and got[7:] == [None] * 4


def test_plausible_ranges_of_all_features(spark):
    rows = [("respiratory_rate", 0.5), ("respiratory_rate", 1.0), ("spo2", 49.0), ("spo2", 50.0), ("gcs_total", 16.0), ("lactate", 30.0), ("fio2", 0.2)]
    df = spark.createDataFrame(rows, "f string, v double").coalesce(1)
    assert [r[0] for r in df.select(X.plausible(F.col("v"), F.col("f"))).collect()] == [None, 1.0, None, 50.0, None, 30.0, None]


def test_windows_and_columns():
    assert X.window_list([24, 6]) == [6, 24]
    for bad in ([], [0], [6, 6], [-1, 3]):
        with pytest.raises(ValueError):
            X.window_list(bad)
    assert [X.default_by_name(c, {"hr": 75.0}) for c in ("hr_is_missing", "hr_time_since_last", "hr_w6h_std", "hr_w6h_mean", "hr", "other")] == [1.0, 0.0, 0.0, 75.0, 75.0, 0.0]
    assert X.columns_for_window(["a_w6h_mean", "b", "a_w24h_mean", "a_is_missing"], ["b", "a"], 6) == ["b", "a_is_missing", "a_w6h_mean"]


def test_organs_of_a_day(spark):
    """Worst values stand for a day; only the oxygen fraction is carried; urine counts from a full window on."""
    rows = [("a", h, 80.0 if h == 2 else None, 0.5 if h == 0 else None, 10.0 if h == 3 else None, 90.0 if h == 5 else None) for h in range(30)]
    df = spark.createDataFrame(rows, "k string, h long, pao2 double, fio2 double, urine_output double, platelets double")
    out = {r["h"]: r for r in O.organ_assembly(df, "k", "h", hours=24, least=2).collect()}
    assert (out[1]["respiration"], out[1]["score_observed"], out[1]["score_assume_normal"]) == (None, None, 0)
    assert out[2]["respiration"] == out[25]["respiration"] == 2 and out[26]["respiration"] is None  # 80 / 0.5, no ventilator
    assert out[22]["renal"] is None and out[23]["renal"] == out[26]["renal"] == 4 and out[27]["renal"] is None
    assert (out[5]["coagulation"], out[5]["component_count"], out[5]["score"], out[5]["score_complete"]) == (2, 2, 4, None)
    assert out[4]["score"] is None and set(out[0].asDict()) >= {"pao2", "platelets"} and "creatinine" not in out[0].asDict()


def test_total_or_parts(spark):
    df = spark.createDataFrame([(1, None, 2, 3), (2, None, None, 3)], "i int, t int, a int, b int")
    assert sorted((r["i"], r["t"]) for r in O.total_or_parts(df, "t", ["a", "b"]).collect()) == [(1, 5), (2, None)]
    one = df.withColumn("t", F.when(F.col("i") == 2, 9))
    assert sorted((r["i"], r["t"]) for r in O.total_or_parts(one, "t", ["a", "b"]).collect()) == [(1, None), (2, 9)]


def test_signals_of_a_window(spark):
    rows = [("k", h, r, m, s) for h, (r, m, s) in enumerate([(0.5, 0.0, 0), (1.5, 1.0, 1), (2.5, 0.0, 0)])]
    df = spark.createDataFrame(rows, "k string, h long, r double, m double, s long")
    got = df.select("h", *[c.alias(n) for n, c in T.signals("r", "m", "s", "h", 3, T.timeline("k", "h")).items()]).where("h = 2").first()
    import math

    sig = [1 / (1 + math.exp(-(r - 0.5) / 0.2)) for r in (0.5, 1.5, 2.5)]
    want = (1.5 / 4, 0.5 / 4, 2.5 / 4, math.sqrt(2 / 3) / 2, math.tanh(1), math.tanh(1), math.tanh(2), sum(sig) / 3, (sig[0] + sig[2]) / 2, 1 / 3, 0.0, 0.0)
    assert [got[n] for n in T.SIGNALS] == pytest.approx(want)


def test_attention_by_window_sums(spark):
    df = spark.createDataFrame([("k", h, r) for h, r in enumerate([0.2, 1.0, 3.0])], "k string, h long, r double")
    a = R.attention("r", 0.8, -0.5, 3, 1, T.timeline("k", "h"))
    x = df.select("h", *[c.alias(n) for n, c in a.items()]).where("h = 2").first()
    arr = F.array(F.lit(0.2), F.lit(1.0), F.lit(3.0))
    weights = R.softmax(F.transform(arr, lambda r: F.tanh(r * 0.8 - 0.5)))
    y = spark.range(1).select(R.dot(arr, weights), R.entropy(weights), weights[2]).first()
    assert [x["attended"], x["entropy"], x["late_mass"]] == pytest.approx(list(y))


def test_candidates_and_rubric(spark):
    terms = {"a": [R.Term("lo", 0, 1, 0.0), R.Term("hi", 2, 1, 1.0)], "b": [R.Term("hi", 2, 1, 0.5)]}
    weights = {f: {s: w for s, w in zip(R.SIGNAL_THRESHOLDS, ws, strict=True)} for f, ws in (("a", (0.1, 0.4, -0.2, 0.0, 0.3)), ("b", (0.6, 0.0, 0.0, 0.0, 0.1)))}
    made = R.candidates(terms, terms, weights, [("both", (("a", "hi"), ("b", "hi")), -0.5)], 1.0, 0.2)
    assert [c.rule_id for c in made] == ["single::a::hi::short_term_change", "single::a::hi::abnormal_frequency", "single::b::hi::risk_slope", "single::b::hi::abnormal_frequency", "cross::both::b::risk_slope"]
    assert made[0].weight == pytest.approx(1 + 0.4 / 2**0.5) and made[-1].alignment == 0.75
    rows = [(c.rule_id, c.signal, c.weight, c.alignment, c.weight) for c in made]
    out = R.rubric(spark.createDataFrame(rows, "rule_id string, signal string, weight double, alignment double, ranking double"), 3).collect()
    assert [r["rank"] for r in out] == [1, 2, 3] and out[-1]["rule_id"].startswith("cross::") and out[0]["cross_ok"] is None


def test_masks(spark):
    df = spark.createDataFrame([(5.0, 1.0)], "v double, m double")
    assert [tuple(R.masked(df, mode, {"v": 2.0}, ["m"]).first()) for mode in ("full", "no_missingness", "missingness_only")] == [(5.0, 1.0), (5.0, 0.0), (2.0, 1.0)]
    with pytest.raises(ValueError):
        R.masked(df, "other", {}, [])


def test_even_buckets_spread_any_range(spark):
    for values in ([i / 1000 for i in range(1000)], [i**4 for i in range(1000)]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        sizes = [r["count"] for r in df.groupBy(ordered.even_buckets(df, "v", 10).alias("b")).count().collect()]
        assert len(sizes) == 10 and max(sizes) < 200
    ids = spark.createDataFrame([(v,) for v in (7, -3, 10**15, 7, 0)], "v long")
    assert sorted((r["v"], r["n"]) for r in ordered.numbered(ids, "v", "n").collect()) == [(-3, 0), (0, 1), (7, 2), (10**15, 3)]


def test_joins_by_cells_of_time(spark):
    ts = "cast(timestamp_seconds(s) as timestamp_ntz)"
    e = spark.createDataFrame([(1, s) for s in range(0, 400_000, 7_000)], "k int, s long").selectExpr("k", f"{ts} at", "s")
    stays = spark.createDataFrame([(1, 10_000, 150_000), (1, 140_000, 140_000), (2, 0, 10), (1, 9, 3)], "k int, a long, b long")
    stays = stays.selectExpr("k", "a", "b", "cast(timestamp_seconds(a) as timestamp_ntz) start", "cast(timestamp_seconds(b) as timestamp_ntz) stop")
    got = sorted((r["s"], r["a"]) for r in J.in_interval(e, stays, ["k"], "at", "start", "stop").collect())
    assert got == sorted((s, a) for s in range(0, 400_000, 7_000) for a, b in ((10_000, 150_000), (140_000, 140_000)) if a <= s <= b)


def test_manifests(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    good = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], MANIFEST)
    assert guards.require_manifest(good, "k", "split", ["train", "test"]) is good
    for bad in ([(1, "train"), (1, "test")], [(None, "train")], [(1, "other")], [(1, None)]):
        with pytest.raises(guards.GuardError):
            guards.require_manifest(spark.createDataFrame(bad, MANIFEST), "k", "split", ["train", "test"])
    assert sorted((r["k"], r["split"]) for r in D.attach_split(rows, good, "k").collect()) == [(1, "train"), (2, "test"), (3, "train")]
    with pytest.raises(PySparkException, match="without a split"):
        D.attach_split(rows, good.where("k < 3"), "k").collect()
    assert {n: d.count() for n, d in D.split_ids(rows, good, "k", ["train", "test"]).items()} == {"train": 2, "test": 1}
    with pytest.raises(guards.GuardError):
        D.split_ids(rows, good.where("k < 3"), "k", ["train", "test"])
    with pytest.raises(guards.GuardError):
        D.split_ids(rows.where("k <> 2"), good, "k", ["train", "test"])
    assert D.filter_to(rows, good.where("k < 3"), "k").count() == 2
    with pytest.raises(PySparkException, match="missing"):
        D.filter_to(rows.where("k > 1"), good, "k").collect()
    with pytest.raises(guards.GuardError):
        D.stratified_sample(rows.withColumn("y", F.lit(1)), "k", "y", 2, 1, part="test")


def test_samples_are_whole_whatever_the_group(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    x = D.ranked(rows, "id", "y", 3, "n").collect()
    assert {y: sorted(r["n"] for r in x if r["y"] == y) for y in (0, 1)} == {0: list(range(1, 4501)), 1: list(range(1, 501))}
    order = sorted((r["n"], r["id"]) for r in x if r["y"] == 1)
    hashes = {r["id"]: r["h"] for r in rows.select("id", X.hash_unit(F.lit(3), F.col("id")).alias("h")).collect()}
    assert [i for _, i in order] == sorted((i for _, i in order), key=lambda i: (hashes[i], i))


def test_audits(spark):
    checks = spark.createDataFrame([("a", 1, 1), ("b", None, None), ("c", 1, 2)], "name string, expected int, found int")
    assert [r["ok"] for r in guards.audit(checks).orderBy("name").collect()] == [True, True, False]
    with pytest.raises(guards.GuardError, match="c: expected 1, found 2"):
        guards.require_audit(checks)
    assert guards.truncated({"a": {"max_rows": 5, "limit": None}, "b": [{"smoke": True}, 1]}) == ["/a/max_rows", "/b/0/smoke"]
    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "k int, y int")
    assert tuple(D.reconstruction(a, b, ["k"], "y").first()) == (3, 1, 1, 1)


def test_members_must_cover_the_same_keys(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.1), (2, "b", 0.5)], "k int, m string, p double")
    assert sorted(tuple(r) for r in A.ensemble(rows, ["k"], "m", "p", "q").collect()) == [(1, pytest.approx(0.3)), (2, pytest.approx(0.3))]
    with pytest.raises(PySparkException, match="members"):
        A.ensemble(rows.where("p < 0.5"), ["k"], "m", "p", "q").collect()
    with pytest.raises(guards.GuardError):
        J.one_to_one(rows, rows.select("k").distinct(), ["k"])


def test_platt_is_the_greatest_likelihood(spark):
    rows = spark.createDataFrame([(int((i * 7919) % 100 < 100 * p), p) for i, p in enumerate([0.1, 0.3, 0.6, 0.8] * 50)], "y int, p double")
    a, b = E.platt(rows)
    q = X.sigmoid(F.lit(a) + F.lit(b) * X.logit(F.col("p")))
    slopes = rows.agg(F.sum(F.col("y") - q), F.sum((F.col("y") - q) * X.logit(F.col("p")))).first()
    assert abs(slopes[0]) < 1e-6 and abs(slopes[1]) < 1e-6
    assert [r[0] for r in E.scaled(rows.where("p < 0.2"), "p", "s").select("s").distinct().collect()] == [0.0]


def test_sinks_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", 0.5), (2, None, 1.0)], "id long, name string, x double").coalesce(1)
    for kind in ("csv", "json", "parquet"):
        ingest.write(rows, str(tmp_path / kind), kind)
        back = ingest.scan(spark, str(tmp_path / kind), rows.schema, kind=kind, **({"header": "true"} if kind == "csv" else {}))
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert any(f.endswith(".csv.gz") for f in os.listdir(tmp_path / "csv"))
    with pytest.raises(ValueError):
        ingest.write(rows, str(tmp_path / "z"), "pickle")
    assert ingest.text_table(rows).splitlines() == ["| id | name | x |", "| - | - | - |", "| 1 | a\\|b | 0.5 |", "| 2 |  | 1 |"]
    assert r"1 & a|b & 0.5 \\" in ingest.text_table(rows, latex=True)
    with pytest.raises(ValueError):
        ingest.text_table(rows, most=1)
    built = []

    def build():
        built.append(1)
        return rows

    path, source = str(tmp_path / "cache"), str(tmp_path / "json")
    for force, newer, n in ((False, None, 1), (False, None, 1), (True, None, 2), (False, [source], 2)):
        assert ingest.cached(spark, path, build, force, newer).count() == 2 and len(built) == n
    later = os.stat(os.path.join(path, "_SUCCESS")).st_mtime + 5
    os.utime(source, (later, later))
    assert ingest.cached(spark, path, build, False, [source]).count() == 2 and len(built) == 3


def test_discovery_and_schemas(spark, tmp_path):
    for place in ("six/logreg/val", "six/logreg/test", "six/xgb/test", "day/gru/val", "day/gru/test"):
        folder, part = place.rsplit("/", 1)
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / f"{part}_predictions.csv").write_text("stay_id,y_true,y_prob\n1,0,0.5\n")
    pairs = {r["model"]: r for r in ingest.prediction_pairs(spark, str(tmp_path)).collect()}
    assert set(pairs) == {"six/logreg", "day/gru"} and pairs["day/gru"]["test"].endswith("day/gru/test_predictions.csv")
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    assert ingest.schema_fingerprint({"t": a}) == ingest.schema_fingerprint({"t": a.select("y", "x")}) != ingest.schema_fingerprint({"t": a.select("x")})
    assert ingest.present_columns(a, ["y", "z"]) == (["y"], ["z"])
    broken = tmp_path / "broken"
    broken.write_text("no parquet")
    with pytest.raises(Exception, match="footer"):
        ingest.optional(spark, str(broken), Ty.StructType([Ty.StructField("id", Ty.LongType())])).count()
