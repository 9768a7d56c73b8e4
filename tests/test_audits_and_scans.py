"""Refractory scans, correlation screening, item mappings and JSON audits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import aggregates as A
from chronopanel.operators import panel as P
from chronopanel.operators import temporal as T
from chronopanel.plans import guards


def greedy(hours, gap):
    kept = []
    for h in sorted(set(hours)):
        if not kept or h - kept[-1] >= gap:
            kept.append(h)
    return kept


@pytest.mark.parametrize(("gap", "fan"), [(6, 3), (100, 4), (1, 256)])
def test_refractory_scan_equals_the_greedy_loop(spark, monkeypatch, gap, fan):
    monkeypatch.setattr(T, "FAN", fan)
    rng = random.Random(gap)
    data = {"dense": list(range(3000)), "sparse": [rng.randrange(-50_000, 50_000) for _ in range(300)], "bursts": [b * 640 + rng.randrange(70) for b in range(40) for _ in range(30)], "one": [7], "edge": [0, 63, 64, 127, 128, 129]}
    rows = [(k, h) for k, hs in data.items() for h in hs] + [("one", None), ("one", 7)]
    rng.shuffle(rows)
    got = T.refractory_alerts(spark.createDataFrame(rows, "k string, h long"), "k", "h", gap).collect()
    for k, hs in data.items():
        assert sorted(r["h"] for r in got if r["k"] == k) == greedy(hs, gap), k
    assert T.refractory_alerts(spark.createDataFrame([], "k string, h long"), "k", "h", gap).count() == 0


def test_a_million_alerts_of_one_entity(spark):
    rows = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("h"))
    out = T.refractory_alerts(rows, "k", "h", 7).agg(F.count("*"), F.max("h"), F.sum((F.col("h") % 7 != 0).cast("int"))).first()
    assert tuple(out) == ((1_000_000 + 6) // 7, 999_999 // 7 * 7, 0)


def test_screening(spark):
    rng = random.Random(1)
    rows = [(y := rng.random(), y + rng.random(), rng.random(), 2 * y + 0.001 * rng.random(), 5.0, None) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, same double, none double")
    got = {c: kept for c, _, kept in A.screened(df.withColumn("c2", F.col("c") * 3), "y", ["a", "b", "c", "c2", "same", "none"], ["b"], 3, 0.95)}
    assert got == {"a": True, "b": True, "c": True, "c2": False, "same": False, "none": False}
    assert A.correlations(df, ["y", "same", "none"]) == {("y", "same"): 0.0, ("y", "none"): 0.0, ("same", "none"): 0.0}


def test_items_are_features_in_their_own_units(spark):
    rows = spark.createDataFrame([(1, 98.6), (2, 37.0), (9, 1.0), (1, None)], "item int, value double")
    mapping = spark.createDataFrame([(1, "temperature", 5 / 9, -32.0), (2, "temperature", 1.0, 0.0)], "item int, feature string, scale double, shift double")
    got = P.mapped(rows, mapping, "item", "value").collect()
    assert [(r["item"], r["feature"], r["value"] and round(r["value"], 6)) for r in sorted(got, key=str)] == [(1, "temperature", 37.0), (1, "temperature", None), (2, "temperature", 37.0)]
    with pytest.raises(guards.GuardError):
        P.mapped(rows, mapping.union(mapping.limit(1)), "item", "value")


def test_json_of_any_shape(spark, tmp_path):
    texts = {"a.json": '{"data": {"max_rows": 100, "max_stays": null, "x": [1, {"limit": 5}, []]}, "n": "12", "limit": 0, "deep": {"a": {"b": {"SMOKE": true}}}}', "b.json": "[]", "c.json": "not json", "d.json": "7", "e.json": "{}", "f.json": "null"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = spark.read.text(f"file://{tmp_path}/*.json", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    leaves = guards.json_leaves(files.union(spark.createDataFrame([("g.json", None)], "file string, value string")), "file", "value")
    got = {(r["file"], r["path"]): (r["kind"], r["value"]) for r in leaves.collect()}
    assert got[("a.json", "$.data.x[1].limit")] == ("BIGINT", "5") and got[("a.json", "$.n")] == ("STRING", "12") and got[("c.json", "$")][0] == "MALFORMED" and got[("d.json", "$")] == ("BIGINT", "7")
    assert {k[1] for k in got if k[0] == "a.json"} == {"$.data.max_rows", "$.data.max_stays", "$.data.x[0]", "$.data.x[1].limit", "$.data.x[2]", "$.n", "$.limit", "$.deep.a.b.SMOKE"}
    assert {k[0] for k in got} == {f"{c}.json" for c in "abcdef"}
    cuts = {(r["file"], r["path"]) for r in guards.json_cuts(leaves).collect()}
    assert cuts == {("a.json", "$.data.max_rows"), ("a.json", "$.data.x[1].limit"), ("a.json", "$.deep.a.b.SMOKE")}
    wanted = spark.createDataFrame([("a.json", "$.n", "12"), ("a.json", "$.none", "1"), ("d.json", "$", "8")], "file string, path string, expected string")
    assert {(r["path"], r["ok"]) for r in guards.json_assertions(leaves, "file", wanted).collect()} == {("$.n", True), ("$.none", False), ("$", False)}
