"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.operators.quantiles import quantiles

# Two-sided 95 % quantiles of Student's t by number of runs.
T_QUANTILES = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776}
NORMAL_QUANTILE = 1.96


def mean_ci(value: str) -> dict[str, Column]:
    """Mean, sample deviation (0 for one value) and the half-width of its 95 % interval (null for one value)."""
    n, sd = F.count(value), F.stddev_samp(value)
    t = F.lit(NORMAL_QUANTILE)
    for k, q in T_QUANTILES.items():
        t = F.when(n == k, F.lit(q)).otherwise(t)
    return {"n": n, "mean": F.avg(value), "sd": F.coalesce(sd, F.lit(0.0)), "half_width": F.when(n > 1, t * sd / F.sqrt(n))}


def first_row(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def histogram_quantile(rows: DataFrame, keys: list[str], value: str, count: str, p: float) -> DataFrame:
    """Exact interpolated quantile of values with frequencies."""
    return quantiles(rows, value, [p], keys, weight=count).select(*keys, F.col("q")[0].alias("quantile"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def ensemble(rows: DataFrame, keys: list[str], member: str, value: str, name: str) -> DataFrame:
    """Mean over members by key; a key that a member lacks, or has twice, raises when the result is read."""
    n = rows.select(member).distinct().count()
    out = rows.groupBy(*keys).agg(F.avg(value).alias(name), F.count("*").alias("__n"), F.countDistinct(member).alias("__d"))
    guard = F.assert_true((F.col("__n") == n) & (F.col("__d") == n), F.lit("members don't cover the same keys"))
    return out.where(guard.isNull()).drop("__n", "__d")


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, those with a new one of the same key replaced by it, and new ones."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def profile(rows: DataFrame, cols: list[str]) -> DataFrame:
    """One row a column: rows, observed share, least and most; a single pass."""
    aggs = [F.count("*").alias("n")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__observed"), F.min(c).cast("double").alias(f"{c}__least"), F.max(c).cast("double").alias(f"{c}__most")]
    wide = rows.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("name"), F.col("n"), F.col(f"{c}__observed").alias("observed"), F.col(f"{c}__least").alias("least"), F.col(f"{c}__most").alias("most")) for c in cols]
    return wide.select(F.inline(F.array(*parts)))


def correlations(rows: DataFrame, cols: list[str]) -> dict[tuple[str, str], float]:
    """Pearson correlation of every pair of columns over the rows where both are known: one aggregate of mergeable moments;
    0 where a column never varies."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return {}
    x = {c: F.col(c).cast("double") for c in cols}
    spread = lambda a, b: F.stddev_pop(F.when(x[b].isNotNull(), x[a]))
    one = rows.agg(*[(F.covar_pop(x[a], x[b]) / F.nullif(spread(a, b) * spread(b, a), F.lit(0.0))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: 0.0 if one[i] is None or one[i] != one[i] else one[i] for i, p in enumerate(pairs)}


def screened(rows: DataFrame, target: str, cols: list[str], protected: list[str], most: int | None = None, redundant: float | None = None) -> list[tuple[str, float, bool]]:
    """(column, correlation with the target, kept): protected columns always, then the others from the most correlated on,
    ties by name, while there are fewer than ``most``; one that is more than ``redundant`` correlated with a kept one goes."""
    r = correlations(rows, [target, *cols])
    pair = lambda a, b: r[(a, b)] if (a, b) in r else r[(b, a)]
    kept = [c for c in cols if c in protected]
    for c in sorted((c for c in cols if c not in protected), key=lambda c: (-round(abs(pair(target, c)), 9), c)):
        if (most is None or len(kept) < most) and (redundant is None or all(abs(pair(c, k)) <= redundant for k in kept)):
            kept.append(c)
    return [(c, pair(target, c), c in kept) for c in cols]


def fingerprint(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Order-free fingerprint of a keyed set: sums of hashes, so it merges and never gathers the set."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(label).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"), F.sum(F.col(label)).alias("positives"))
