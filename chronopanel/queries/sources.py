"""Scans and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.sources import ingest
from chronopanel.queries.base import query, table


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10")
def scan_pruned(spark, sf):
    items = ingest.scan(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate", "l_quantity"])
    items = items.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return X.rounded(items.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")), 4)


@query("SELECT event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 60)")
def scan_id_set(spark, sf):
    e = table(spark, sf, "events")
    busy = e.groupBy("user_id").count().where("count > 60").select("user_id")
    return e.join(busy, "user_id", "left_semi").select("event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 20)")
def scan_first_entities(spark, sf):
    return ingest.head_entities(table(spark, sf, "events"), "user_id", 20).select("event_id", "user_id")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM events")
def alias_resolution(spark, sf):
    props = F.col("props")
    e = table(spark, sf, "events").select("event_id", F.get_json_object(props, "$.missing").alias("other"), F.get_json_object(props, "$.k").alias("k1"))
    return e.select("event_id", ingest.first_value(e, ["absent", "other", "k1"]).alias("k"))


@query("""
SELECT 'within' AS mode, 'building' AS term, count(*) FILTER (lower(c_mktsegment) LIKE '%building%') AS n FROM customer UNION ALL SELECT 'within', 'mob', count(*) FILTER (lower(c_mktsegment) LIKE '%mob%') FROM customer
UNION ALL SELECT 'prefix', 'building', count(*) FILTER (lower(c_mktsegment) LIKE 'building%') FROM customer UNION ALL SELECT 'prefix', 'mob', count(*) FILTER (lower(c_mktsegment) LIKE 'mob%') FROM customer""")
def term_counts(spark, sf):
    c, terms = table(spark, sf, "customer"), ["building", "mob"]
    parts = [ingest.term_counts(c, "c_mktsegment", terms, prefix).select(F.lit("prefix" if prefix else "within").alias("mode"), "term", "n") for prefix in (False, True)]
    return parts[0].union(parts[1])


@query("SELECT lower(trim(c_mktsegment)) AS label, count(*) AS n FROM customer GROUP BY 1")
def label_counts(spark, sf):
    """A bounded look at a source: its labels among at most ten million rows."""
    return ingest.label_counts(table(spark, sf, "customer"), "c_mktsegment", 10_000_000)


@query("SELECT 'c_custkey' AS name, TRUE AS present, count(c_custkey) AS n FROM customer UNION ALL SELECT 'c_acctbal', TRUE, count(c_acctbal) FROM customer UNION ALL SELECT 'c_absent', FALSE, NULL")
def present_columns(spark, sf):
    """Which of the wanted columns a source has, and how many values they hold."""
    rows = table(spark, sf, "customer")
    there, lacking = ingest.present_columns(rows, ["c_custkey", "c_absent", "c_acctbal"])
    one = rows.agg(*[F.count(c).alias(c) for c in there])
    each = [F.struct(F.lit(c).alias("name"), F.lit(True).alias("present"), F.col(c).alias("n")) for c in there]
    each += [F.struct(F.lit(c).alias("name"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("n")) for c in lacking]
    return one.select(F.inline(F.array(*each)))


@query("SELECT o_orderkey::BIGINT AS stay_id, (o_orderstatus = 'F')::INT::DOUBLE AS y_true, round(o_totalprice / 600000, 4) AS y_prob FROM orders")
def read_predictions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stay_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y_true"), F.round(F.col("o_totalprice") / 600000, 4).cast("string").alias("y_prob"), F.lit("six").alias("target_col"))
    return ingest.predictions(o, ["stay_id"], "six")


@query("SELECT 'none' AS name, 0::BIGINT AS n UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def optional_source(spark, sf):
    """Sources that may be absent: an absent one is empty, others are read."""
    from pyspark.sql import types as T

    absent = ingest.optional(spark, f"{sf}/no_such_table.parquet", T.StructType([T.StructField("id", T.LongType())]))
    out = absent.agg(F.lit("none").alias("name"), F.count("*").alias("n"))
    for name in ("nation", "orders"):
        found = ingest.optional(spark, f"{sf}/{name}.parquet", table(spark, sf, name).schema)
        out = out.union(found.agg(F.lit(name), F.count("*")))
    return out
