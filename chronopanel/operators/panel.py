"""Calendar spines, interval expansion and reshaping."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions.exprs import elapsed_hours
from chronopanel.operators.joins import small
from chronopanel.plans.guards import require_unique


#: Hours of a dense panel in a task, on average; an entity's are in one.
TASK_HOURS = 250_000


def mapped(rows: DataFrame, mapping: DataFrame, item: str, value: str) -> DataFrame:
    """Rows whose item is in the mapping (item, feature, scale, shift), with ``feature`` and the value in the feature's unit,
    (value + shift) * scale. Several items may be one feature, each with its own unit; an item has one feature only. The
    mapping is broadcast where it was measured to be small."""
    known = require_unique(mapping, [item]).select(item, "feature", F.col("scale").alias("__scale"), F.col("shift").alias("__shift"))
    out = rows.join(small(known), item)
    return out.withColumn(value, (F.col(value) + F.col("__shift")) * F.col("__scale")).drop("__scale", "__shift")


def bounds(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """First and last time of each entity, and its last hour."""
    out = events.groupBy(entity).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"))
    return out.withColumn("last_hour", elapsed_hours(F.col("start"), F.col("stop"))).where("last_hour >= 0")


def spine(stays: DataFrame, last: str = "last_hour", hour: str = "hr") -> DataFrame:
    """A row for each hour from 0 to the entity's last one, both included; made within the entity's row."""
    return stays.withColumn(hour, F.explode(F.sequence(F.lit(0).cast("long"), F.col(last).cast("long")))).drop(last)


def with_hour(events: DataFrame, stays: DataFrame, entity: str, ts: str, hour: str = "hr") -> DataFrame:
    """Point-in-interval join: events within their entity's stay, both ends included, with the hour of the stay."""
    joined = events.join(stays.select(entity, "start", "stop"), entity).where(F.col(ts).between(F.col("start"), F.col("stop")))
    return joined.withColumn(hour, elapsed_hours(F.col("start"), F.col(ts)))


def wide(rows: DataFrame, keys: list[str], features: Mapping[str, Column]) -> DataFrame:
    """Long to wide, a different aggregate for each feature, in one pass and one exchange."""
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in features.items()])


def of(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def hourly_panel(events: DataFrame, entity: str, ts: str, features: Mapping[str, Column]) -> DataFrame:
    """Dense panel: the spine of every entity with its hourly features.

    Spine and features are united and dealt by entity once; the grouping that merges them, and the windows by entity
    that follow, need no further exchange, which a join on (entity, hour) would. The tasks' number follows the hours, which
    a job counts first: mostly nulls, they shrink so much in a shuffle that by its bytes they'd be dealt to a few tasks.
    """
    hours = bounds(events, entity, ts).agg(F.sum(F.col("last_hour") + 1)).first()[0] or 0  # one number
    tasks = max(math.ceil(hours / TASK_HOURS), events.sparkSession.sparkContext.defaultParallelism)
    events = events.repartition(tasks, entity)
    stays = bounds(events, entity, ts)
    hourly = wide(with_hour(events, stays, entity, ts), [entity, "hr"], features)
    both = spine(stays).drop("start", "stop").unionByName(hourly, allowMissingColumns=True).repartition(tasks, entity)
    return both.groupBy(entity, "hr").agg(*[F.max(name).alias(name) for name in features])


def expand_intervals(rows: DataFrame, start: str, end: str, low: str, high: str, hour: str = "hr") -> DataFrame:
    """Hours of a stay [low, high] that an interval touches; its end is excluded by a second. Bad intervals give none."""
    clipped = rows.withColumns({"__a": F.greatest(start, low), "__b": F.least(end, high)})
    first = elapsed_hours(F.col(low), F.col("__a"))
    last = F.floor(F.greatest(F.timestamp_diff("MICROSECOND", F.col(low), F.col("__b")) - 1_000_000, F.lit(0)) / 3.6e9).cast("long")
    clipped = clipped.withColumns({"__first": first, "__last": last}).where("__b >= __a AND __last >= __first")
    return clipped.withColumn(hour, F.explode(F.sequence("__first", "__last"))).drop("__a", "__b", "__first", "__last")


def pivot(rows: DataFrame, keys: list[str], on: str, values: list[str], value: str) -> DataFrame:
    """One column a value of ``on``; the values are given, so no pass looks for them."""
    return rows.groupBy(*keys).pivot(on, values).agg(F.first(value))


def long(rows: DataFrame, keys: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return rows.unpivot(keys, cols, name, value)


def window_tensor(panel: DataFrame, entity: str, hour: str, cols: list[str], length: int) -> DataFrame:
    """The last ``length`` rows of each row that has so many, as an array of structs in order of time."""
    w = Window.partitionBy(entity).orderBy(hour).rowsBetween(-(length - 1), 0)
    out = panel.withColumn("steps", F.collect_list(F.struct(hour, *cols)).over(w))
    return out.where(F.size("steps") == length)


def encode_window(entity: Column, hour: Column, base: int = 100_000) -> Column:
    """entity * base + hour; null where the hour is out of range."""
    return F.when(hour.between(0, base - 1), entity * base + hour)


def decode_window(window_id: Column, base: int = 100_000) -> tuple[Column, Column]:
    return F.floor(window_id / base).cast("long"), window_id % base
