"""Exact interpolated quantiles of any number of values and groups in bounded memory.

A built-in exact percentile holds a map of all of a group's distinct values in one task. Here only groups of at most
``limit`` rows go that way. For larger ones the ranks that the quantiles lie between are sought in brackets: approximate
quantiles give a few borders for each group, exact counts between and on the borders tell in which bracket each rank is,
and what is in that bracket is bracketed again. Every pass serves all quantiles of all groups, sums are partial before
they are shuffled, and a bracket is ordered only once it holds at most ``limit`` rows. Borders only set how fast brackets
shrink; counts decide, so results are exact whatever the data, and repeated values end a search at once.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions.exprs import below

#: Rows that are ordered in one task, borders of a bracket that is bracketed again, and how far on either side of a quantile
#: its first borders lie.
LIMIT, BORDERS, MARGIN = 100_000, 24, 0.001

#: Bytes of what is known of large groups up to which it goes to every task; beyond them, into how many parts a key is dealt.
SIDE_BYTES, PARTS = 16 << 20, 64


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed in the folder of ``spark.checkpoint.dir``, or in one of our own if all runs in one
    process."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chronopanel-")
    return path


def quantiles(rows: DataFrame, value: str, probs: list[float], by: list[str] | None = None, weight: str | None = None, limit: int = LIMIT,
              settle: bool | None = False) -> DataFrame:
    """(by, q): the quantiles of each group as an array in the order of ``probs``, nulls for a group without a value.

    ``weight`` is how often a row counts. Null values don't count; a null key is a group; without ``by`` there is one row,
    whatever the input. Sizes are counted by a job of its own; where any group is larger than ``limit``, passes run over a
    settled copy of the columns, with ``settle`` in any case: for rows that are dear to compute. None says that ``rows`` are
    settled already.
    """
    by = by or []
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    x = rows.select(key.alias("__k"), F.col(value).cast("double").alias("__v"), w.alias("__w"))
    array = F.array(*[F.lit(float(p)) for p in probs])
    direct = lambda df: df.groupBy(*(["__k"] if by else [])).agg(F.percentile("__v", array, F.col("__w")).alias("q"))
    plain = lambda df: df.select(*[F.col(f"__k.`{c}`").alias(c) for c in by], "q")
    x = settled(x) if settle else x
    sizes = x.groupBy("__k").agg(F.count("__v").alias("n"), F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))).alias("total"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:  # one number
        return plain(direct(x))
    x = settled(x) if settle is False else x
    big = settled(sizes.where(F.col("n") > limit))
    found = _placed(_met(x.where("__v IS NOT NULL"), big.select("__k"), ["__k"], "left_semi"), big, probs, limit)
    at = [F.expr(f"(total - 1) * {float(p)!r}D") for p in probs]
    pick = lambda i, c: F.element_at("of", F.lit(2 * i + c))
    exact = [pick(i, 0) * (1 - (a - F.floor(a))) + pick(i, 1) * (a - F.floor(a)) for i, a in enumerate(at)]
    whole = found.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("of"))  # two a quantile
    whole = whole.join(big, "__k").select("__k", F.array(*[F.when(pick(i, 0) == pick(i, 1), pick(i, 0)).otherwise(e) for i, e in enumerate(exact)]).alias("q"))
    if not by:
        return plain(whole)
    rest = _met(x, big.select("__k"), ["__k"], "left_anti")
    return plain(whole.unionByName(direct(rest)))


def _met(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with what is known of their groups or brackets, a few settled rows of ``side`` for each large group. No
    task gets all rows of a group: the side goes to every task where it was measured to be small, else to each of the parts
    into which a group's rows are dealt."""
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0  # one number
    if size <= SIDE_BYTES:
        return rows.join(F.broadcast(side), on, how)
    dealt = side.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    return rows.withColumn("__part", part).join(dealt, [*on, "__part"], how).drop("__part")


def _placed(x: DataFrame, big: DataFrame, probs: list[float], limit: int) -> DataFrame:
    """(__k, t, v): the values of the two ranks of quantile i as t = 2 i and 2 i + 1."""
    ranks = [r for i, p in enumerate(probs) for r in ((2 * i, F.floor(F.expr(f"(total - 1) * {float(p)!r}D"))), (2 * i + 1, F.ceil(F.expr(f"(total - 1) * {float(p)!r}D"))))]
    targets = big.select("__k", F.lit(0).cast("long").alias("__g"), F.explode(F.array(*[F.struct(F.lit(t).alias("t"), r.cast("long").alias("rank")) for t, r in ranks])).alias("r"))
    targets, rows = targets.select("__k", "__g", "r.t", "r.rank"), x.withColumn("__g", F.lit(0).cast("long"))
    places = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-MARGIN, MARGIN)})
    done: list[DataFrame] = []
    while True:
        # Approximate quantiles differ from run to run: both the counts and the rows in brackets must see the same borders.
        borders = settled(rows.groupBy("__k", "__g").agg(F.array_distinct(F.percentile_approx("__v", F.array(*[F.lit(p) for p in places]), 10_000)).alias("b")))
        less = _met(rows, borders, ["__k", "__g"]).withColumn("less", below(F.col("b"), F.col("__v"), len(places)))
        number = F.col("less") * 2 + F.coalesce(F.get("b", F.col("less")) == F.col("__v"), F.lit(False)).cast("int")
        rows = less.select("__k", "__g", "__v", "__w", number.alias("i"))
        counts = rows.groupBy("__k", "__g", "i").agg(F.sum("__w").alias("c"), F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        before = Window.partitionBy("__k", "__g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a few brackets
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
        hits = settled(targets.join(counts, ["__k", "__g"]).where(hit).select("__k", "__g", "i", "t", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high"))
        done.append(hits.where("low <=> high").select("__k", "t", F.col("low").alias("v")))
        done.append(_ordered(rows, hits.where(f"NOT low <=> high AND n <= {limit}")))
        deeper = hits.where(f"NOT low <=> high AND n > {limit}")
        if deeper.isEmpty():
            break
        again = (F.col("__g") * 1000 + F.col("i")).cast("long").alias("__g")
        rows = settled(_met(rows, deeper.select("__k", "__g", "i").distinct(), ["__k", "__g", "i"], "left_semi").select("__k", again, "__v", "__w"))
        targets, places = deeper.select("__k", again, "t", "rank"), [i / BORDERS for i in range(1, BORDERS)]
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _ordered(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The values of ranks in brackets that are small enough to be ordered."""
    small = _met(rows, hits.select("__k", "__g", "i").distinct(), ["__k", "__g", "i"], "left_semi")
    upto = Window.partitionBy("__k", "__g", "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    small = small.withColumn("upto", F.sum("__w").over(upto))
    met = small.join(hits.select("__k", "__g", "i", "t", "rank"), ["__k", "__g", "i"])
    return met.where("rank >= upto - __w AND rank < upto").select("__k", "t", F.col("__v").alias("v"))


def quantile_columns(rows: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, **kw) -> DataFrame:
    """(by, a column for each named quantile)."""
    q = quantiles(rows, value, list(probs.values()), by, **kw)
    return q.select(*(by or []), *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])


def quantile_values(rows: DataFrame, value: str, probs: list[float], **kw) -> list[float | None]:
    """Quantiles of a whole column, as numbers for the driver; nulls if it has no value."""
    return list(quantiles(rows, value, probs, **kw).first()["q"] or [None] * len(probs))
