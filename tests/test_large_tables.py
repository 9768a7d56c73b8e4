"""What only shows on large tables: plans, tasks and numbers that small ones don't tell apart."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import queries as base
from chronopanel.operators import metrics as E
from chronopanel.operators import panel as P
from chronopanel.operators import quantiles as Q
from chronopanel.operators import temporal as T
from chronopanel.operators import trees as M

QUERIES = base.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def eager(spark):
    """Whatever may be broadcast is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8g")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def apart(spark):
    """Partitions of few bytes aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bootstrap_draws_are_not_broadcast(eager):
    rows = eager.createDataFrame([(i % 40, i % 2, i % 7 / 7) for i in range(200)], "c long, y long, p double")
    text = plan(E.bootstrap_curves(rows, "c", 20, 17))
    assert re.search(r"SortMergeJoin \[c#\d+L?\], \[c#\d+L?\], Inner", text) and "SortMergeJoin [__i" in text


def test_rebuilt_panel_is_not_broadcast(eager, sf):
    assert re.search(r"SortMergeJoin \[user_id#\d+L?, hr#\d+L?\], .*Inner", plan(QUERIES["reconstruction_check"](eager, sf)))


def test_tasks_of_a_panel_follow_its_hours(spark, monkeypatch):
    """Two events an entity, a year apart: a few bytes, and a million hours."""
    monkeypatch.setattr(P, "TASK_HOURS", 50_000, raising=False)
    rows = [(u, f"{y}-01-01") for u in range(120) for y in (2023, 2024)]
    ends = spark.createDataFrame(rows, "u long, day string").select("u", F.col("day").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    panel = P.hourly_panel(ends, "u", "ts", {"x": F.max("value")})
    assert panel.count() == 120 * (365 * 24 + 1)
    assert panel.rdd.getNumPartitions() == 22


@pytest.mark.parametrize("name", ["rule_quality", "alarm_burden"])
def test_panels_that_are_used_often_are_read_once(spark, sf, name, monkeypatch):
    made, hourly = [], P.hourly_panel
    monkeypatch.setattr(P, "hourly_panel", lambda *a: (made.append(a), hourly(*a))[1])
    assert "events.parquet" not in plan(QUERIES[name](spark, sf)) and len(made) == 1


@pytest.mark.parametrize("side", [1 << 24, 0])
def test_no_task_gets_a_group_of_quantiles(apart, monkeypatch, side):
    """One large group on eight tasks: its rows aren't sent to one to meet their borders, however large the side is."""
    monkeypatch.setattr(Q, "SIDE_BYTES", side, raising=False)
    met, n = [], 40_000
    join = type(apart.range(0)).join
    monkeypatch.setattr(type(apart.range(0)), "join", lambda a, b, *k: (met.append(join(a, b, *k)), met[-1])[1])
    rows = apart.range(n).select(F.lit("a").alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    rows = rows.union(apart.createDataFrame([(None, 3.0), ("b", 5.0)], "k string, v double"))
    got = {r["k"]: r["q"] for r in Q.quantiles(rows, "v", [0.25, 0.5], ["k"], limit=1000).collect()}
    assert got == {"a": [pytest.approx((n - 1) / 4), pytest.approx((n - 1) / 2)], "b": [5.0, 5.0], None: [3.0, 3.0]}
    assert max(max(x.rdd.glom().map(len).collect(), default=0) for x in met if "__v" in x.columns) < n / 2


@pytest.mark.parametrize("n", [1, 5, 6, 7])
def test_summary_vectors_of_blocks(spark, n):
    """Gaps between hours, values missing, windows that aren't full: as by plain loops."""
    rows = [(u, 2 * i if i % 5 else 2 * i - 1, None if (i * 7 + u) % 11 < 2 else float((i * i * 31 + u) % 17) + 1e6, (i + u) % 2, i) for u in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "u long, hr long, x double, x_missing int, x_since int")
    got = {(r["u"], r["last_x_since"]): r for r in T.summary_vector(df, ["x"], "hr", n, T.timeline("u", "hr")).collect()}
    assert len(got) == len(rows)
    for u, _, x, m, i in rows:
        seen = [(h, y) for v, h, y, _, j in rows if v == u and i - n < j <= i and y is not None]
        r, ys, hs = got[u, i], [y for _, y in seen], [h for h, _ in seen]
        assert (r["last_x"], r["last_x_missing"], r["complete"]) == (x, m, len(seen) == n)
        near = [(min(ys), r["min_x"]), (max(ys), r["max_x"]), (np.mean(ys), r["mean_x"]), (np.std(ys), r["std_x"])] if seen else []
        near += [(np.polyfit(hs, np.array(ys) - ys[0], 1)[0], r["slope_x"])] if len(seen) > 1 else []
        assert all(b == pytest.approx(a, abs=1e-6) for a, b in near) and (seen or r["mean_x"] is None) and (len(seen) > 1 or r["slope_x"] is None)
        first = next(y for v, _, y, _, j in rows if v == u and j == max(i - n + 1, 0))
        before = next((y for v, _, y, _, j in rows if v == u and j == i - 1), None)
        assert r["span_x"] == (None if x is None or first is None else x - first) and r["step_x"] == (None if x is None or before is None else x - before)
        assert r["missing_mean_x"] == pytest.approx(np.mean([k for v, _, _, k, j in rows if v == u and i - n < j <= i]))


def test_summary_vector_goes_over_no_frame_of_a_day(spark, sf):
    assert not re.search("regr_slope|stddev_pop", plan(QUERIES["summary_vector"](spark, sf)))


def test_boosting_doesnt_carry_earlier_trees(spark, monkeypatch):
    """What a level sums over is no longer for the last tree than for the first."""
    sizes, grow = [], M.grow
    monkeypatch.setattr(M, "grow", lambda b, cuts, depth, members, *a: (sizes.append(len(str(members))), grow(b, cuts, depth, members, *a))[1])
    rows = spark.range(400).select(F.pmod(F.col("id") * 37, F.lit(101)).alias("x"), (F.pmod(F.col("id") * 37, F.lit(101)) > 40).cast("long").alias("y"))
    model = M.boosted(rows, "y", ["x"], n_trees=3, depth=1)
    assert len(model.trees) == 3 and max(sizes) == min(sizes)


def test_a_forest_draws_once(spark, monkeypatch):
    """Draws are settled with the bins: no level hashes keys again."""
    seen, grow = [], M.grow
    monkeypatch.setattr(M, "grow", lambda b, cuts, depth, members, **k: (seen.append(str(members)), grow(b, cuts, depth, members, **k))[1])
    rows = spark.range(60).select("id", F.pmod("id", F.lit(7)).alias("x"), F.pmod("id", F.lit(2)).alias("y"))
    assert len(M.forest(rows, "id", "y", ["x"], n_trees=2, depth=1).trees) == 2 and "md5" not in seen[0]


@pytest.mark.parametrize("n", [0, 1, 2, 31, 125])
def test_bins_are_found_by_halving(spark, n):
    """As by a look at every border, on ties, nulls, infinities and NaN; no row is compared with all of them."""
    cuts = [k / 4 for k in range(n)]
    values = [None, float("-inf"), float("inf"), float("nan"), -1.0, *[k / 8 for k in range(2 * n + 3)]]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    rows = x.select("x", M.Additive(["x"], [cuts], 0.0, [])._bin(0).alias("bin"))
    every = lambda v: 0 if v is None else 1 + (n if v != v else sum(c < v for c in cuts))
    assert [r["bin"] for r in rows.collect()] == [every(v) for v in values]
    assert "filter(" not in plan(rows)
    assert [r["bins"][0] for r in M.binned(x, ["x"], [cuts]).collect()] == [every(v) for v in values]


def test_additive_steps_go_over_bins_not_rows(spark, monkeypatch):
    made, settled = [], M.settled
    monkeypatch.setattr(M, "settled", lambda df: (made.append(settled(df)), made[-1])[1])
    rows = spark.range(4000).select(F.pmod(F.col("id") * 37, F.lit(1009)).alias("x"), (F.pmod(F.col("id") * 37, F.lit(1009)) > 400).cast("long").alias("y"))
    M.additive(rows, "y", ["x"], rounds=1, bins=8)
    assert made[-1].count() <= 2 * 9 and made[-1].agg(F.sum("n")).first()[0] == 4000
