"""Running sums over a whole ordered relation without an unpartitioned window over its rows.

Rows are put into buckets that are monotone in the order. Buckets' totals, few rows, are accumulated first; within a
bucket a window partitioned by it does the rest. Results are exact, whatever the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that quantiles make: the driver holds their borders, and nothing else.
BUCKETS = 128


def even_buckets(rows: DataFrame, order: str, n: int = BUCKETS) -> Column:
    """Buckets of about equally many rows, whatever the column's range: borders are approximate quantiles."""
    borders = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0]
    borders = sorted(set(borders or []))
    if not borders:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in borders])
    return F.size(F.filter(array, lambda b: b <= F.col(order)))


def running(rows: DataFrame, order: str, bucket: Column, sums: dict[str, str], by: list[str] | None = None, descending: bool = False,
            exclusive: bool = False) -> DataFrame:
    """Add running sums {new: summed column} in order of a column, up to and with each row, or before it."""
    by = by or []
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    rows = rows.withColumn("__k", bucket)
    totals = rows.groupBy(*by, "__k").agg(*[F.sum(c).alias(f"__t_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(direction("__k")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "__k", *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__b_{new}") for new in sums])
    within = Window.partitionBy(*by, "__k").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = rows.join(bases, [*by, "__k"])
    out = out.withColumns({new: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__b_{new}") for new, c in sums.items()})
    return out.drop("__k", *[f"__b_{new}" for new in sums])


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Number distinct numeric keys from 0 in their order."""
    ones = keys.select(key).distinct().withColumn("__one", F.lit(1).cast("long"))
    return running(ones, key, even_buckets(ones, key), {name: "__one"}, exclusive=True).drop("__one")
