"""Cohort protocol: reproducible splits, samples, manifests and audits. Chance comes from hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.exprs import hash_unit
from chronopanel.operators.ordered import running
from chronopanel.plans.guards import GuardError, require_fractions, require_mapped, require_whole


def stratum(*labels: str) -> Column:
    """Labels joined by |, null as -1."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(-1)).cast("string") for c in labels])


def allocation(n: Column, parts: list[float]) -> list[Column]:
    """Sizes by largest remainder, ties to the earlier part; with three or more members every part gets one."""
    floors = [F.floor(n * p + 1e-9).cast("long") for p in parts]
    rests = [n * p - f for p, f in zip(parts, floors, strict=True)]
    left = n - sum(floors[1:], floors[0])
    sizes = []
    for i, (f, r) in enumerate(zip(floors, rests, strict=True)):
        ahead = sum((((o > r + 1e-9) | ((F.abs(o - r) <= 1e-9) & F.lit(j < i))).cast("int") for j, o in enumerate(rests) if j != i), F.lit(0))
        sizes.append(f + (ahead < left).cast("long"))
    most = F.greatest(*sizes)
    empty = sum(((s == 0).cast("long") for s in sizes), F.lit(0).cast("long"))
    out, given = [], F.lit(False)
    for s in sizes:
        donor = (s == most) & ~given
        given = given | donor
        out.append(F.when(n >= 3, F.when(s == 0, F.lit(1)).when(donor, s - empty).otherwise(s)).otherwise(s).cast("long"))
    return out


def split(rows: DataFrame, key: str, strat: str, names: list[str], parts: list[float], seed: int) -> DataFrame:
    """Assign every key to a part, stratum by stratum, in the order of a seeded hash."""
    require_fractions(parts)
    sizes = rows.groupBy(strat).agg(F.count("*").alias("__n"))
    sizes = sizes.select(strat, F.array(*allocation(F.col("__n"), parts)).alias("__sizes"))
    placed = ranked(rows, key, strat, seed, "__rn").join(sizes, strat)
    out, upto = F.lit(names[-1]), F.lit(0)
    bounds = []
    for i in range(len(names)):
        upto = upto + F.col("__sizes")[i]
        bounds.append(upto)
    for name, b in reversed(list(zip(names[:-1], bounds, strict=False))):
        out = F.when(F.col("__rn") <= b, F.lit(name)).otherwise(out)
    return placed.withColumn("split", out).drop("__rn", "__sizes")


def ranked(rows: DataFrame, key: str, by: str, seed: int, name: str, buckets: int = 1024) -> DataFrame:
    """Number the rows of each group from 1 in the order of a seeded hash of their keys.

    Hashes are dealt into buckets by their leading bits; buckets' counts are accumulated first, so no group is sorted in
    one task.
    """
    h = hash_unit(F.lit(seed), F.col(key))
    x = rows.withColumns({"__h": h, "__one": F.lit(1).cast("long")}).withColumn("__at", F.struct("__h", key))
    return running(x, "__at", F.floor(F.col("__h") / F.lit((1 << 32) // buckets)), {name: "__one"}, [by]).drop("__h", "__one", "__at")


def stratified_sample(rows: DataFrame, key: str, label: str, n: int, seed: int, part: str = "train") -> DataFrame:
    """n rows with the prevalence kept: positives are rounded half to even and at least one, if there are any. The test
    part may not be sampled."""
    require_whole(part)
    total, pos = rows.agg(F.count("*"), F.sum(label)).first()
    total, pos = total or 0, pos or 0
    n = min(n, total)
    n_pos = min(max(round(n * pos / total), 1), pos, max(n - 1, 0)) if pos else 0
    limit = F.when(F.col(label) == 1, F.lit(n_pos)).otherwise(F.lit(n - n_pos))
    return ranked(rows, key, label, seed, "__rn").where(F.col("__rn") <= limit).select(*rows.columns)


def attach_split(rows: DataFrame, manifest: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows with their key's split; a row whose key has none raises when it is read."""
    out = rows.join(manifest.select(key, split), key, "left")
    guard = F.assert_true(F.col(split).isNotNull(), F.concat(F.lit(f"{key} without a split: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.where(guard.isNull())


def split_ids(keys: DataFrame, manifest: DataFrame, key: str, names: list[str], complete: bool = True, split: str = "split") -> dict[str, DataFrame]:
    """The keys at hand by split. With ``complete``, a key that the manifest lacks is an error; an empty split always is."""
    if complete:
        require_mapped(keys, manifest, key)
    there = manifest.select(key, split).join(keys.select(key).distinct(), key, "left_semi")
    counts = {r[split]: r["n"] for r in there.groupBy(split).agg(F.count("*").alias("n")).collect()}  # a row a split
    if empty := [n for n in names if not counts.get(n)]:
        raise GuardError(f"splits without rows: {empty}")
    return {n: there.where(F.col(split) == n).select(key) for n in names}


def filter_to(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The rows that a manifest names; one that it names and that isn't there raises when the result is read."""
    marked = manifest.select(key).distinct().join(rows.withColumn("__there", F.lit(True)), key, "left")
    guard = F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit(f"{key} of the manifest is missing: "), F.col(key).cast("string")))
    return marked.where(guard.isNull()).select(*rows.columns)


def reconstruction(saved: DataFrame, rebuilt: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: keys that only one side has, and labels that differ."""
    a = saved.select(*keys, F.col(label).alias("__a"), F.lit(True).alias("__in_a"))
    b = rebuilt.select(*keys, F.col(label).alias("__b"), F.lit(True).alias("__in_b"))
    j = a.join(b, keys, "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    return j.agg(F.count("*").alias("n"), count(F.col("__in_b").isNull()).alias("only_saved"), count(F.col("__in_a").isNull()).alias("only_rebuilt"),
                 count(both & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("different"))
