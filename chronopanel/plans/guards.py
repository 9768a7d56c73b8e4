"""Checks that fail early, with what is wrong."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.quantiles import settled


class GuardError(ValueError):
    """An input or result isn't as required."""


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in rows.columns]:
        raise GuardError(f"columns are missing: {', '.join(missing)}")
    return rows


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    twice = rows.groupBy(*key).count().where("count > 1").select(*key).take(1)
    if twice:
        raise GuardError(f"key {tuple(twice[0])} occurs more than once")
    return rows


def require_mapped(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    lost = rows.select(key).where(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti").take(1)
    if lost:
        raise GuardError(f"{key} {lost[0][0]} has no match")
    return rows


def require_domain(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Every value, checked when the rows are read."""
    ok = F.assert_true(F.col(column).isin(*values), F.lit(f"{column} holds other values than {values}"))
    return rows.where(ok.isNull())


def require_fractions(parts: list[float]) -> list[float]:
    if min(parts) <= 0 or abs(sum(parts) - 1) > 1e-9:
        raise GuardError(f"fractions must be positive and sum to 1: {parts}")
    return parts


def require_manifest(manifest: DataFrame, key: str, split: str, names: list[str]) -> DataFrame:
    """A split manifest: keys unique and not null, splits known; one pass tells."""
    require_columns(manifest, [key, split])
    bad = manifest.agg(
        F.sum(F.col(key).isNull().cast("long")).alias("null keys"), F.sum((~F.coalesce(F.col(split).isin(*names), F.lit(False))).cast("long")).alias("unknown splits"),
        (F.count(key) - F.countDistinct(key)).alias("repeated keys")).first().asDict()
    if wrong := {k: v for k, v in bad.items() if v}:
        raise GuardError(f"manifest has {wrong}")
    return manifest


def require_whole(part: str) -> str:
    """The test part is never sampled."""
    if part == "test":
        raise GuardError("the test part may not be sampled")
    return part


#: Settings that say that a run saw only some of the data.
TRUNCATING = ("max_rows", "max_stays", "max_batches", "max_chunks", "limit", "sample", "smoke", "head")


def truncated(config: Any, names: Iterable[str] = TRUNCATING, at: str = "") -> list[str]:
    """Paths of settings in a nested configuration that cut the data short; null, 0 and false ones don't."""
    if isinstance(config, dict):
        found = [f"{at}/{k}" for k, v in config.items() if k in names and v]
        return found + [p for k, v in config.items() for p in truncated(v, names, f"{at}/{k}")]
    if isinstance(config, (list, tuple)):
        return [p for i, v in enumerate(config) for p in truncated(v, names, f"{at}/{i}")]
    return []


def audit(checks: DataFrame) -> DataFrame:
    """(name, expected, found) with whether they agree; null agrees with null."""
    return checks.withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))


def require_audit(checks: DataFrame) -> DataFrame:
    bad = audit(checks).where("NOT ok").take(1)
    if bad:
        raise GuardError(f"{bad[0]['name']}: expected {bad[0]['expected']}, found {bad[0]['found']}")
    return checks


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, name, kind, value): a row a leaf of each JSON text of any shape; ``kind`` is the leaf's type, VOID for a
    JSON null, and MALFORMED for a text that is no JSON (null texts have no leaves). Empty objects and arrays are leaves of
    their own. Each level of nesting is a step over the rows that still have one; nothing is inferred or collected."""
    spark = rows.sparkSession
    now = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.lit("$").alias("path"), F.lit("$").alias("name"), F.try_parse_json(F.col(text)).alias("v"))
    parts = []
    while True:
        kind = F.when(F.col("v").isNull(), "MALFORMED").otherwise(F.schema_of_variant("v"))
        now = settled(now.withColumn("kind", kind))
        full = F.col("kind").rlike("^(OBJECT<.|ARRAY<)") & ~F.col("kind").isin("OBJECT<>", "ARRAY<>") & (F.coalesce(F.variant_get("v", "$", "string"), F.lit("")) != "[]")
        parts.append(now.where(~full).select("__key", "path", "name", "kind", F.variant_get("v", "$", "string").alias("value")))
        inner = now.where(full)
        if inner.isEmpty():
            break
        now = spark.sql("SELECT __key, concat(path, coalesce('.' || t.key, '[' || t.pos || ']')) AS path, coalesce(t.key, name) AS name, t.value AS v FROM {inner}, LATERAL variant_explode(v) t", inner=inner)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumnRenamed("__key", key)


def json_assertions(leaves: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, path, expected, found, ok) of wanted (key, path, expected): a missing path is found null, and not ok."""
    return wanted.join(leaves.select(key, "path", F.col("value").alias("found")), [key, "path"], "left").select(key, "path", "expected", "found", F.col("expected").eqNullSafe(F.col("found")).alias("ok"))


def json_cuts(leaves: DataFrame, names: Iterable[str] = TRUNCATING) -> DataFrame:
    """Leaves at any depth whose name is that of a setting that cuts data short, where it is set: neither null, 0 nor false."""
    unset = F.col("kind").isin("VOID", "OBJECT<>", "ARRAY<>") | F.coalesce(F.col("value"), F.lit("")).isin("", "0", "false", "null")
    return leaves.where(F.lower("name").isin(*names) & ~unset)
