"""Trees against a search of all splits, boosting on held-out rows, attributions against all subsets of features."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import metrics as E
from chronopanel.operators import trees as T

FEATURES = ["a", "b", "c", "d"]


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = (round(rng.uniform(0, 10), 1) for _ in range(3))
        d = None if rng.random() < 0.2 else float(rng.choice([1, 2, 3]))
        y = int(rng.random() < 1 / (1 + math.exp(-(a - 5) * (1 if b > 4 else -1) - (d or 0) + 1)))
        out.append((i, a, b, c, d, y))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(600, 4), "id long, a double, b double, c double, d double, y int").repartition(4).cache()


def brute(data, cuts, depth, least, node=1):
    """The tree by looking at every split of every node."""
    ys = [r[-1] for r in data]
    value = sum(ys) / len(ys)
    gini = lambda v: sum(v) ** 2 / len(v)
    best = (0.0,)
    for f in range(4):
        for b in range(len(cuts[f]) + 1):
            left = [r for r in data if r[f + 1] is None or (b > 0 and r[f + 1] <= cuts[f][b - 1])]
            right = [r for r in data if not (r[f + 1] is None or (b > 0 and r[f + 1] <= cuts[f][b - 1]))]
            if len(left) >= least and len(right) >= least:
                gain = round(gini([r[-1] for r in left]) + gini([r[-1] for r in right]) - gini(ys), 9)
                best = max(best, (gain, -f, -b, left, right), key=lambda t: t[:3])
    if len(best) == 1 or not depth:
        return {node: (-1, None, value, len(ys))}
    _, f, b, left, right = best
    out = {node: (-f, cuts[-f][-b - 1] if b else None, value, len(ys))}
    return out | brute(left, cuts, depth - 1, least, 2 * node) | brute(right, cuts, depth - 1, least, 2 * node + 1)


@pytest.mark.parametrize("bins", [4, 32])
def test_tree_equals_a_search_of_all_splits(data, bins):
    m = T.decision_tree(data, "y", FEATURES, depth=3, least=10, bins=bins)
    want = brute([tuple(r) for r in data.collect()], m.cuts, 3, 10)
    got = {k: (n.feature, n.threshold, n.value, n.weight) for k, n in m.trees[0].items()}
    assert set(got) == set(want)
    for k, (f, t, v, n) in want.items():
        assert got[k][:2] == (f, t) and got[k][2:] == pytest.approx((v, n)), k
    leaf = data.select("y", m.score().alias("s")).groupBy("s").agg(F.avg("y").alias("m")).collect()
    assert all(r["s"] == pytest.approx(r["m"]) for r in leaf) and len(leaf) > 4


def test_boosting_and_forest_tell_held_out_rows(spark, data):
    test = spark.createDataFrame(rows(800, 9), "id long, a double, b double, c double, d double, y int")
    auc = lambda s: E.auroc(E.curve(test.select("y", s.alias("p")))).first()[0]
    one = auc(T.decision_tree(data, "y", FEATURES, depth=2, least=10).score())
    many = T.boosted(data, "y", FEATURES, n_trees=12, depth=3)
    assert auc(many.probability()) > max(one, 0.8) and len(many.trees) == 12
    f = T.forest(data, "id", "y", FEATURES, n_trees=8, depth=4)
    assert auc(f.score()) > 0.75 and len(f.trees) == 8 and len({tuple(t[1]) for t in f.trees}) > 1
    again = T.forest(data.repartition(7), "id", "y", FEATURES, n_trees=8, depth=4)
    assert [{k: n[:4] for k, n in t.items()} for t in again.trees] == [{k: n[:4] for k, n in t.items()} for t in f.trees]
    loss = lambda k: data.agg(E.log_loss(F.col("y"), T.Model(FEATURES, many.trees[:k], many.base, many.rate).probability())).first()[0]
    losses = [loss(k) for k in range(0, 13, 3)]
    assert losses == sorted(losses, reverse=True)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "id long, a double, y int")
    assert T.boosted(none, "y", ["a"]).trees == [] and len(T.decision_tree(none, "y", ["a"]).trees[0]) == 1
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "id long, a double, y int")
    assert len(T.decision_tree(same, "y", ["a"], least=1).trees[0]) == 1  # nothing to split
    nulls = spark.createDataFrame([(i, None if i < 10 else 1.0, int(i < 10)) for i in range(20)] + [(99, 3.0, None)], "id long, a double, y int")
    t = T.decision_tree(nulls, "y", ["a"], depth=1, bins=4).trees[0]
    assert t[1].threshold is None and (t[2].value, t[3].value) == (1.0, 0.0)


def shapley(model, x):
    """Shares of features by their definition: over all subsets, the score when only these are known."""
    def value(tree, known, node=1):
        n = tree[node]
        if n.feature < 0:
            return n.value
        if n.feature in known:
            v = x[n.feature]
            left = v is None or (n.threshold is not None and v <= n.threshold)
            return value(tree, known, 2 * node + (not left))
        return sum(tree[c].weight / n.weight * value(tree, known, c) for c in (2 * node, 2 * node + 1))

    k, out = len(model.features), [0.0] * len(model.features)
    for tree in model.trees:
        for i in range(k):
            others = [j for j in range(k) if j != i]
            for size in range(k):
                for s in combinations(others, size):
                    w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    out[i] += model.each() * w * (value(tree, {*s, i}) - value(tree, set(s)))
    return out


@pytest.mark.parametrize("kind", ["tree", "boosted", "forest"])
def test_attributions_equal_their_definition(data, kind):
    m = {"tree": lambda: T.decision_tree(data, "y", FEATURES, depth=3, least=10), "boosted": lambda: T.boosted(data, "y", FEATURES, n_trees=4, depth=3),
         "forest": lambda: T.forest(data, "id", "y", FEATURES, n_trees=3, depth=3)}[kind]()
    some = data.where("id < 60")
    got = T.attributions(some.withColumn("s", m.score()), m).collect()
    for r in got:
        assert sum(r["phi"]) == pytest.approx(r["s"] - T.expected(m))
        assert r["phi"] == pytest.approx(shapley(m, [r[f] for f in FEATURES]))


def cyclic(data, m, pairs, rounds, rate=0.5, penalty=1.0):
    """The additive model's base and tables by plain loops over rows."""
    names, k = m.features, len(FEATURES)
    place = {f: i + 1 for i, f in enumerate(FEATURES)}

    def bin_of(r, i):
        x = r[place[names[i].rstrip("'")]]
        return 0 if x is None else 1 + sum(c < x for c in m.cuts[i])

    ys = [r[-1] for r in data]
    base, tables = math.log(sum(ys) / (len(ys) - sum(ys))), {w: {} for w, _ in m.tables}
    for stage in ([w for w in tables if len(w) == 1], [w for w in tables if len(w) == 2]):
        for _ in range(rounds if stage else 0):
            for which in stage:
                g, h, n = {}, {}, {}
                for r in data:
                    z = base + sum(t.get(tuple(bin_of(r, i) for i in w), 0.0) for w, t in tables.items())
                    p, c = 1 / (1 + math.exp(-z)), tuple(bin_of(r, i) for i in which)
                    g[c], h[c], n[c] = g.get(c, 0) + r[-1] - p, h.get(c, 0) + p * (1 - p), n.get(c, 0) + 1
                new = {c: tables[which].get(c, 0.0) + rate * g[c] / (h[c] + penalty) for c in n}
                mean = sum(new[c] * n[c] for c in n) / len(data)
                tables[which], base = {c: v - mean for c, v in new.items()}, base + mean
    return base, tables


def test_additive_terms_equal_plain_loops(spark, data):
    m = T.additive(data, "y", FEATURES, [("a", "b")], rounds=2, bins=8)
    base, tables = cyclic([tuple(r) for r in data.collect()], m, [("a", "b")], 2)
    assert m.base == pytest.approx(base)
    for which, values in m.tables:
        assert values == pytest.approx(tables[which])
    got = data.select(m.score().alias("s"), *[c.alias(f"part {n}") for n, c in m.terms().items()]).collect()
    parts = [f"part {n}" for n in (*FEATURES, "a x b")]
    assert set(got[0].asDict()) == {"s", *parts}
    assert all(r["s"] == pytest.approx(m.base + sum(r[n] for n in parts)) for r in got)
    test = spark.createDataFrame(rows(800, 9), "id long, a double, b double, c double, d double, y int")
    auc = lambda mm: E.auroc(E.curve(test.select("y", (1 / (1 + F.exp(-mm.score()))).alias("p")))).first()[0]
    assert auc(m) > auc(T.additive(data, "y", FEATURES, rounds=2, bins=8)) > 0.6
    assert T.additive(data.limit(0), "y", FEATURES).base == 0.0
