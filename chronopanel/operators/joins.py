"""Joins with asserted cardinality, point-in-interval and band joins, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.plans.guards import require_unique

#: A dimension is broadcast only when it was measured to have so few bytes.
SMALL_BYTES = 16 << 20


def small(side: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """Mark for broadcast what was measured to be small, by rows and the bytes of their texts; all else is left to the
    optimizer."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in side.columns]
    total = texts[0]
    for t in texts[1:]:
        total = total + t
    return F.broadcast(side) if (side.agg(F.sum(total)).first()[0] or 0) <= most else side


def lookup(rows: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Left join many-to-one; fails if the dimension's key isn't unique."""
    require_unique(dim, [key] if isinstance(key, str) else key)
    return rows.join(small(dim), key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join that fails if either side's key isn't unique."""
    return require_unique(left, key).join(require_unique(right, key), key, "left")


def _cells(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def in_interval(events: DataFrame, stays: DataFrame, key: list[str], at: str, start: str, end: str, seconds: int = 86_400) -> DataFrame:
    """Events within their key's intervals, both ends included; an event may match several intervals.

    Intervals are put into every cell of time that they touch and joined on key and cell, so a busy key's events meet
    only the intervals near them, and its cells go to different tasks.
    """
    cells = F.explode(F.sequence(_cells(F.col(start), seconds), _cells(F.col(end), seconds)))
    near = stays.where(F.col(start) <= F.col(end)).withColumn("__cell", cells)
    return events.withColumn("__cell", _cells(F.col(at), seconds)).join(near, [*key, "__cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


def band(left: DataFrame, right: DataFrame, key: str, low: Column, high: Column, value: str, seconds: int = 21_600) -> DataFrame:
    """Right rows of the same key whose time is in (low, high], columns of both; joined on key and cells of time as above.
    Times may be whole numbers as well, such as hours: they count as seconds."""
    near = left.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    near = near.withColumn("__cell", F.explode(F.sequence(_cells(F.col("__low"), seconds), _cells(F.col("__high"), seconds))))
    found = near.join(right.withColumn("__cell", _cells(F.col(value), seconds)), [key, "__cell"])
    return found.where((F.col(value) > F.col("__low")) & (F.col(value) <= F.col("__high"))).drop("__cell", "__low", "__high")


def aligned(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows in the order-free shape of the expected keys; a missing key raises when the result is read."""
    marked = keys.join(rows.withColumn("__there", F.lit(True)), on, "left")
    guard = F.assert_true(F.col("__there").isNotNull(), F.lit("a key has no row"))
    return marked.where(guard.isNull()).drop("__there")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)
