"""Registry of queries and the relations that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import panel

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        key = name or f.__name__
        REGISTRY[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Features of the hourly panel: an aggregate of its own for each kind of event.
def _kind(name: str):
    return F.when(F.col("event_type") == name, F.col("value"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    features = {
        "view": F.avg(_kind("view")),
        "err": F.max(_kind("error")),
        "click": F.min(_kind("click")),
        "buy": F.sum(_kind("purchase")),
    }
    return panel.hourly_panel(events, "user_id", "ts", features)


PANEL = """
WITH bounds AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
spine AS (SELECT user_id, t0, unnest(range(0, floor((epoch_us(t1) - epoch_us(t0)) / 3.6e9)::BIGINT + 1)) AS hr FROM bounds),
hourly AS (SELECT user_id, floor((epoch_us(ts) - epoch_us(t0)) / 3.6e9)::BIGINT AS hr,
                  avg(value) FILTER (event_type = 'view') AS "view", max(value) FILTER (event_type = 'error') AS err,
                  min(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'purchase') AS buy
           FROM events JOIN bounds USING (user_id) GROUP BY 1, 2),
panel AS (SELECT user_id, hr, "view", err, click, buy FROM spine LEFT JOIN hourly USING (user_id, hr))"""


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with two features carried forward, and what was observed."""
    from chronopanel.operators import temporal as T

    w = T.timeline("user_id", "hr")
    raw = events_panel(spark, sf_dir)
    return raw.select(
        "user_id", "hr", F.col("view").isNotNull().alias("seen"), T.recency("view", "hr", w).alias("since"),
        T.locf("view", w).alias("v"), T.locf("err", w).alias("e"),
    )


FILLED = PANEL + """,
filled AS (SELECT user_id, hr, "view" IS NOT NULL AS seen,
                  coalesce(hr - last_value(CASE WHEN "view" IS NOT NULL THEN hr END IGNORE NULLS) OVER w, hr + 1) AS since,
                  last_value("view" IGNORE NULLS) OVER w AS v, last_value(err IGNORE NULLS) OVER w AS e
           FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY hr ROWS UNBOUNDED PRECEDING))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions: outcome y, score p with ties, cluster, site, subgroup, time."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    y = (F.col("o_orderstatus") == "F").cast("long")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("c_nationkey").cast("long").alias("site"),
        F.col("o_orderpriority").alias("grp"), F.col("c_mktsegment").alias("segment"), y.alias("y"),
        F.round(F.col("o_totalprice") / 600000, 2).alias("p"),
    )


PREDICTIONS = """
WITH pred AS (SELECT o_orderkey AS id, o_custkey AS cluster, c_nationkey::BIGINT AS site, o_orderpriority AS grp,
                     c_mktsegment AS segment, (o_orderstatus = 'F')::BIGINT AS y, round(o_totalprice / 600000, 2) AS p
              FROM orders JOIN customer ON o_custkey = c_custkey)"""
