"""Trees, forests and boosting by histograms of gradients, and the shares of features in their scores.

Features are binned once at their quantiles. A level of all trees is then one aggregate: rows are summed by tree, node,
feature and bin, partially before the shuffle, whatever their number. The best split of each node comes from running sums
over a feature's bins. Only splits reach the driver, at most a row a node. Where a row stands in a tree is an expression of
its features, so no level joins anything and nothing is written but the bins.

A loss is told by its gradient g and curvature h in each row: a leaf's value is -G / (H + penalty), a split's gain is the
growth of G * G / (H + penalty). A tree of mean outcomes has g = -y and h = 1. Nulls go left at every split. Splits are
between quantiles only, a node is split if both sides have at least ``least`` rows (or weight) and the gain is positive;
ties go to the first feature and the least bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions.exprs import below, hash_unit, sigmoid
from chronopanel.operators.quantiles import quantiles, settled

#: Bins of a feature besides that of nulls, and digits to which gains are compared.
BINS, DIGITS = 32, 9


class Node(NamedTuple):
    """A node by its number: 1 is the root, the children of k are 2 k and 2 k + 1. ``feature`` is -1 in a leaf."""

    node: int
    feature: int
    bin: int
    threshold: float | None
    value: float
    weight: float
    gain: float


Tree = dict[int, Node]


@dataclass(frozen=True)
class Model:
    """Trees over named features; the score is base + rate times the trees' sum (or their mean)."""

    features: list[str]
    trees: list[Tree]
    base: float = 0.0
    rate: float = 1.0
    mean: bool = False
    cuts: list[list[float]] = field(default_factory=list)

    def each(self) -> float:
        """What a tree's value counts in the score."""
        return self.rate / (len(self.trees) if self.mean and self.trees else 1)

    def score(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.lit(self.each()) * walked(tree, lambda n: _raw_left(self.features[n.feature], n.threshold), lambda n: F.lit(n.value))
        return total

    def probability(self) -> Column:
        return sigmoid(self.score())

    def relation(self, spark: SparkSession) -> DataFrame:
        """A row a node: tree, node, feature (null in leaves), threshold, value, weight, gain."""
        rows = [(t, n.node, self.features[n.feature] if n.feature >= 0 else None, n.threshold, n.value, n.weight, n.gain) for t, tree in enumerate(self.trees) for n in tree.values()]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, value double, weight double, gain double")


def _raw_left(feature: str, threshold: float | None) -> Column:
    x = F.col(feature)
    return x.isNull() if threshold is None else x.isNull() | (x <= threshold)


def _bin_left(n: Node) -> Column:
    return F.col("bins")[n.feature] <= n.bin


def walked(tree: Tree, left: Callable[[Node], Column], leaf: Callable[[Node], Column], node: int = 1) -> Column:
    """What ``leaf`` says of the leaf in which a row ends."""
    n = tree[node]
    if n.feature < 0:
        return leaf(n)
    return F.when(left(n), walked(tree, left, leaf, 2 * node)).otherwise(walked(tree, left, leaf, 2 * node + 1))


def cuts_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Where each feature is cut: its distinct inner quantiles. Rows are read once and counted by feature and value; the
    quantiles of all features are then sought together among distinct values, each as often as it was counted."""
    probs = [i / bins for i in range(1, bins)]
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("e")).select("e.*")
    counted = each.where("v IS NOT NULL").groupBy("f", "v").agg(F.count("*").alias("n"))
    found = {r["f"]: r["q"] for r in quantiles(counted, "v", probs, ["f"], weight="n", settle=True).collect()}  # a row a feature
    return [sorted({q for q in found.get(i) or [] if q is not None and not math.isnan(q)}) for i in range(len(features))]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]], *keep: str | Column) -> DataFrame:
    """The rows' bins as small integers: 0 for null, else 1 and one for each cut below the value; settled."""
    return settled(_bins(rows, features, cuts, *keep))


def _bins(rows: DataFrame, features: list[str], cuts: list[list[float]], *keep: str | Column) -> DataFrame:
    return rows.select(*keep, F.array(*[_binned(F.col(f), c).cast("smallint") for f, c in zip(features, cuts, strict=True)]).alias("bins"))


def _binned(x: Column, cuts: list[float]) -> Column:
    return F.when(x.isNull(), 0).otherwise(1 + (below(F.array(*map(F.lit, cuts)), x, len(cuts)) if cuts else F.lit(0)))


def histograms(rows: DataFrame) -> DataFrame:
    """(tree, node, feature, bin, g, h, w) sums of rows with tree, node, g, h, w and bins."""
    each = rows.select("tree", "node", "g", "h", "w", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "w")])


def best_splits(hist: DataFrame, penalty: float, least: float, allowed: Column | None = None) -> DataFrame:
    """(tree, node, g, h, w, s): a node's sums and its best split (gain, feature, bin), null where none helps."""
    own = Window.partitionBy("tree", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a feature's bins
    sums = {f"{c}_left": F.sum(c).over(upto) for c in "ghw"} | {f"{c}_all": F.sum(c).over(own) for c in "ghw"}
    s = hist.withColumns(sums)
    gain = lambda g, h: g * g / F.nullif(h + F.lit(penalty), F.lit(0.0))
    rest = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghw"}
    gains = gain(F.col("g_left"), F.col("h_left")) + gain(rest["g"], rest["h"]) - gain(F.col("g_all"), F.col("h_all"))
    ok = (F.col("w_left") >= least) & (rest["w"] >= least) & (F.round(gains, DIGITS) > 0)
    ok = ok if allowed is None else ok & allowed
    split = F.when(ok, F.struct(F.round(gains, DIGITS).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return s.groupBy("tree", "node").agg(F.max(split).alias("s"), *[F.first(f"{c}_all").alias(c) for c in "ghw"])


def grow(rows: DataFrame, cuts: list[list[float]], depth: int, members: list[tuple[Column, Column, Column]], penalty: float = 0.0, least: float = 1.0,
         allowed: Column | None = None) -> list[Tree]:
    """Trees grown together on the same binned rows, level by level. ``members`` holds g, h and w of each; rows of weight 0
    are no part of a tree. ``allowed`` says of (tree, node, feature) whether a split may use it."""
    trees: list[Tree] = [{1: Node(1, -1, 0, None, 0.0, 0.0, 0.0)} for _ in members]
    open_nodes = {(t, 1) for t in range(len(trees))}
    for level in range(depth + 1):
        # Values of the last level come with its sums, and so does what isn't split any more.
        parts = []
        for t, (g, h, w) in enumerate(members):
            at = walked(trees[t], _bin_left, lambda n, t=t: F.lit(n.node if (t, n.node) in open_nodes else None).cast("int"))
            parts.append(F.struct(F.lit(t).alias("tree"), at.alias("node"), (g * w).alias("g"), (h * w).alias("h"), w.alias("w")))
        each = rows.select("bins", F.inline(F.array(*parts))).where("node IS NOT NULL AND w > 0")
        found = best_splits(histograms(each), penalty, least, allowed).collect()  # a row an open node
        open_nodes = set()
        for r in found:
            tree, node, value = trees[r["tree"]], r["node"], -r["g"] / (r["h"] + penalty) if r["h"] + penalty else 0.0
            if r["s"] is None or level == depth:
                tree[node] = Node(node, -1, 0, None, value, r["w"], 0.0)
                continue
            feature, b = -r["s"]["f"], -r["s"]["b"]
            tree[node] = Node(node, feature, b, cuts[feature][b - 1] if b else None, value, r["w"], r["s"]["gain"])
            for child in (2 * node, 2 * node + 1):
                tree[child] = Node(child, -1, 0, None, value, 0.0, 0.0)
                open_nodes.add((r["tree"], child))
        if not open_nodes:
            break
    return trees


def decision_tree(rows: DataFrame, y: str, features: list[str], depth: int = 3, least: float = 1.0, bins: int = BINS, weight: Column | None = None) -> Model:
    """A tree of mean outcomes; for outcomes of 0 and 1 its gain is that of the Gini index."""
    cuts = cuts_of(rows, features, bins)
    b = binned(rows.where(F.col(y).isNotNull()), features, cuts, F.col(y).cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    trees = grow(b, cuts, depth, [(-F.col("y"), F.lit(1.0), F.col("w"))], least=least)
    return Model(features, trees, cuts=cuts)


def _poisson(unit: Column, most: int = 6) -> Column:
    """How often a row is drawn, from a uniform number: a Poisson variate of mean 1."""
    below, out, p = 0.0, F.lit(float(most)), math.exp(-1)
    steps = []
    for k in range(most):
        below += p
        p /= k + 1
        steps.append((below, float(k)))
    for edge, k in reversed(steps):
        out = F.when(unit < edge, F.lit(k)).otherwise(out)
    return out


def forest(rows: DataFrame, key: str, y: str, features: list[str], n_trees: int = 20, depth: int = 4, least: float = 5.0, share: float = 0.6, seed: int = 1, bins: int = BINS) -> Model:
    """Trees on rows drawn with replacement, each node splitting on its own share of the features; draws are hashes of seed,
    tree and key, so they are the same in every run and order."""
    cuts = cuts_of(rows, features, bins)
    unit = lambda *parts: hash_unit(F.lit(seed), *parts) / F.lit(2.0**32)
    k = F.col(key).cast("string")
    drawn = [_poisson(unit(F.lit(t), k)).cast("tinyint").alias(f"drawn{t}") for t in range(n_trees)]  # settled: no level draws again
    b = binned(rows.where(F.col(y).isNotNull()), features, cuts, F.col(y).cast("double").alias("y"), *drawn)
    members = [(-F.col("y"), F.lit(1.0), F.col(f"drawn{t}").cast("double")) for t in range(n_trees)]
    trees = grow(b, cuts, depth, members, least=least, allowed=unit(F.lit("f"), F.col("tree"), F.col("node"), F.col("feature")) < share)
    return Model(features, trees, mean=True, cuts=cuts)


def boosted(rows: DataFrame, y: str, features: list[str], n_trees: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, least: float = 5.0, bins: int = BINS) -> Model:
    """Logistic boosting: each tree follows the gradient of the log loss at the score of those before it."""
    rows = rows.where(F.col(y).isNotNull())
    cuts = cuts_of(rows, features, bins)
    b = binned(rows, features, cuts, F.col(y).cast("double").alias("y"))
    share = b.agg(F.avg("y")).first()[0]
    if share is None:
        return Model(features, [], cuts=cuts)
    base, trees = math.log(max(share, 1e-6) / max(1 - share, 1e-6)), []
    b = b.withColumn("score", F.lit(base))
    for k in range(n_trees):
        # What a row's gradient is doesn't change while a tree grows: it is settled, so that a level has only its own tree.
        p = sigmoid(F.col("score"))
        b = settled(b.withColumns({"g": p - F.col("y"), "h": p * (1 - p)}))
        tree = grow(b, cuts, depth, [(F.col("g"), F.col("h"), F.lit(1.0))], penalty, least)[0]
        if tree[1].feature < 0:
            break
        trees.append(tree)
        if k < n_trees - 1:
            b = b.withColumn("score", F.col("score") + F.lit(rate) * walked(tree, _bin_left, lambda n: F.lit(n.value)))
    return Model(features, trees, base, rate, cuts=cuts)


def leaves(model: Model) -> list[dict]:
    """Each leaf of each tree: its value in the score, and for each feature on its path the interval of values that lead
    there, whether nulls do, and the share of training weight that does so."""
    out = []
    for tree in model.trees:
        todo: list[tuple[int, dict]] = [(1, {})]
        while todo:
            node, path = todo.pop()
            n = tree[node]
            if n.feature < 0:
                out.append({"value": model.each() * n.value, "path": [{"f": f, **p} for f, p in path.items()]})
                continue
            for child, left in ((2 * node, True), (2 * node + 1, False)):
                p = dict(path.get(n.feature, {"low": -math.inf, "high": math.inf, "none": True, "z": 1.0}))
                p["z"] *= tree[child].weight / n.weight
                cut = -math.inf if n.threshold is None else n.threshold
                if left:
                    p["high"] = min(p["high"], cut)
                else:
                    p["low"], p["none"] = max(p["low"], cut), False
                    p["any"] = n.threshold is None or p.get("any", False)
                todo.append((child, path | {n.feature: p}))
    return out


def expected(model: Model) -> float:
    """The score's mean over the training weights."""
    return model.base + sum(x["value"] * math.prod(p["z"] for p in x["path"]) for x in leaves(model))


def attributions(rows: DataFrame, model: Model, name: str = "phi") -> DataFrame:
    """Every row with ``name``: by feature, its Shapley value in the row's score, where a feature that isn't known follows
    the training weights at its splits. They sum to the score less its mean.

    All leaves are one constant array. Of a leaf with k features on its path, feature i gets value * (o_i - z_i) times the
    mean over orders of the others' products, o where they are known and z where not: the coefficients of the product of
    (z_j + o_j t), weighted by s! (k - s - 1)! / k!. All of it is done in the row.
    """
    if not model.trees:
        return rows.withColumn(name, F.array(*[F.lit(0.0) for _ in model.features]))
    known = leaves(model)
    most = max(len(x["path"]) for x in known)
    text = json.dumps([{"value": x["value"], "path": [{"f": p["f"], "low": str(p["low"]), "high": str(p["high"]), "none": p["none"], "z": p["z"]} for p in x["path"]]} for x in known if x["path"]])
    kind = "array<struct<value:double,path:array<struct<f:int,low:string,high:string,none:boolean,z:double>>>>"
    weights = [[math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)] for k in range(1, most + 1)]
    table = F.array(*[F.array(*map(F.lit, w)) for w in weights])
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in model.features])

    def number(c: Column) -> Column:
        return F.when(c == "inf", F.lit(math.inf)).when(c == "-inf", F.lit(-math.inf)).otherwise(c.cast("double"))

    def entry(p: Column) -> Column:
        v = F.get("__x", p["f"])
        inside = F.when(v.isNull(), p["none"]).otherwise((v > number(p["low"])) & (v <= number(p["high"])) | ((v == -math.inf) & (number(p["low"]) == -math.inf)))
        return F.struct(p["f"].alias("f"), p["z"].alias("z"), F.when(inside, 1.0).otherwise(0.0).alias("o"))

    def times(acc: Column, e: Column) -> Column:
        at = lambda i: F.coalesce(F.get(acc, i), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(acc)), lambda s: at(s) * e["z"] + F.when(s > 0, at(s - 1)).otherwise(0.0) * e["o"])

    def shares(leaf: Column) -> Column:
        path = leaf["path"]
        w = F.get(table, F.size(path) - 1)

        def one(e: Column) -> Column:
            c = F.aggregate(F.filter(path, lambda q: q["f"] != e["f"]), F.array(F.lit(1.0)), times)
            mean = F.aggregate(F.zip_with(c, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return F.struct(e["f"].alias("f"), (leaf["value"] * (e["o"] - e["z"]) * mean).alias("v"))

        return F.transform(path, one)

    out = rows.withColumn("__x", x).withColumn("__leaves", F.from_json(F.lit(text), kind))
    out = out.withColumn("__leaves", F.transform("__leaves", lambda l: F.struct(l["value"].alias("value"), F.transform(l["path"], entry).alias("path"))))
    out = out.withColumn("__all", F.flatten(F.transform("__leaves", shares)))
    total = lambda f: F.aggregate(F.filter("__all", lambda e: e["f"] == f), F.lit(0.0), lambda a, e: a + e["v"])
    return out.withColumn(name, F.array(*[total(f) for f in range(len(model.features))])).drop("__x", "__leaves", "__all")


# Additive models


@dataclass(frozen=True)
class Additive:
    """A score as a sum of tables: one for the bins of each feature, one for the pairs of bins of each pair. Features come
    twice, the second time with a prime and fewer bins, for pairs."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    tables: list[tuple[tuple[int, ...], dict[tuple[int, ...], float]]]

    def _bin(self, i: int) -> Column:
        return _binned(F.col(self.features[i].rstrip("'")), self.cuts[i])

    def terms(self) -> dict[str, Column]:
        """Each term's part of the score, by name: a lookup of the row's bins in the term's table. Don't alias one to the name
        of a feature that another reads in the same select."""
        return {" x ".join(self.features[i].rstrip("'") for i in which): looked(values, [self._bin(i) for i in which], [len(self.cuts[i]) + 2 for i in which])
                for which, values in self.tables}

    def score(self) -> Column:
        out = F.lit(self.base)
        for c in self.terms().values():
            out = out + c
        return out


def looked(values: dict[tuple[int, ...], float], bins: list[Column], sizes: list[int]) -> Column:
    """A table's entry at the row's bins: a constant array and a place in it."""
    place, flat, step = F.lit(0), [0.0] * math.prod(sizes), 1
    for b, n in zip(bins, sizes, strict=True):
        place, step = place + b * step, step * n
    for key, v in values.items():
        at, step = 0, 1
        for k, n in zip(key, sizes, strict=True):
            at, step = at + k * step, step * n
        flat[at] = v
    return F.get(F.array(*map(F.lit, flat)), place.cast("int"))


def additive(rows: DataFrame, y: str, features: list[str], pairs: list[tuple[str, str]] | None = None, rounds: int = 10, rate: float = 0.5, penalty: float = 1.0, bins: int = 16) -> Additive:
    """Cyclic boosting of the log loss: in every round each feature's table takes a damped Newton step in each of its bins,
    one after the other, then each pair's, on what the single features leave. Rows with equal bins and outcome are one from
    the start, with their number: a step is one aggregate by bin over these, which bins bound, whatever the rows. Tables are
    centred, so that the base holds the mean. Pairs use a quarter of the bins' borders."""
    rows = rows.where(F.col(y).isNotNull())
    cuts = cuts_of(rows, features, bins)
    coarse = [c[1::4] or c[:1] for c in cuts]
    names = features + [f"{f}'" for f in features]
    both = cuts + coarse
    b = _bins(rows.select(*features, y, *[F.col(f).alias(f"{f}'") for f in features]), names, both, F.col(y).cast("double").alias("y"))
    b = settled(b.groupBy("bins", "y").agg(F.count("*").cast("double").alias("n")))
    share = b.agg(F.sum(F.col("y") * F.col("n")) / F.sum("n")).first()[0]
    k = len(features)
    sets: list[tuple[int, ...]] = [(i,) for i in range(k)]
    sets += [tuple(k + features.index(f) for f in pair) for pair in pairs or []]
    if share is None:
        return Additive(names, both, 0.0, [(which, {}) for which in sets])
    base, tables = math.log(max(share, 1e-6) / max(1 - share, 1e-6)), {which: {} for which in sets}
    at = lambda which: [F.col("bins")[i].cast("int") for i in which]
    for stage in (sets[:k], sets[k:]):
        for _ in range(rounds if stage else 0):
            for which in stage:
                score = F.lit(base)
                for other, values in tables.items():
                    if values:
                        score = score + looked(values, at(other), [len(both[i]) + 2 for i in other])
                p = sigmoid(score)
                cells = b.select(F.array(*at(which)).alias("c"), ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"), "n").groupBy("c")
                found = cells.agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()  # a row a bin
                values = {tuple(r["c"]): tables[which].get(tuple(r["c"]), 0.0) + rate * r["g"] / (r["h"] + penalty) for r in found}
                n = sum(r["n"] for r in found)
                mean = sum(values[tuple(r["c"])] * r["n"] for r in found) / n
                tables[which], base = {c: v - mean for c, v in values.items()}, base + mean
    return Additive(names, both, base, list(tables.items()))
