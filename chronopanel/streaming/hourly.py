"""Streams: hourly tumbling features with a watermark, and refractory alerts as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_features(events: DataFrame, entity: str, ts: str, value: str, lateness: str = "2 hours") -> DataFrame:
    """Count, mean and most by entity and hour; hours close when the watermark passes them."""
    hour = F.window(ts, "1 hour")
    out = events.withWatermark(ts, lateness).groupBy(entity, hour).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return out.select(entity, F.col("window.start").alias("hour_start"), "n", "mean", "most")


def refractory_stream(alerts: DataFrame, entity: str, hour: str, gap: int) -> DataFrame:
    """Alerts at least ``gap`` hours after the entity's last kept one. State is one number an entity; within a batch an
    entity's alerts are taken in order of time."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for h in sorted({int(x) for frame in frames for x in frame[hour]}):
            if last is None or h - last >= gap:
                kept.append(h)
                last = h
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({entity: [key[0]] * len(kept), hour: kept})

    return alerts.groupBy(entity).applyInPandasWithState(keep, f"{entity} long, {hour} long", "last long", "append", GroupStateTimeout.NoTimeout)
