"""Window operators within an entity in order of time. Rows are hours: build the spine first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from chronopanel.functions.exprs import clip, sigmoid
from chronopanel.operators.ordered import even_buckets, running
from chronopanel.operators.quantiles import settled


def timeline(entity: str, time: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def locf(c: str | Column, w: WindowSpec) -> Column:
    """Last value observed up to now, within the entity."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def recency(c: str, hour: str, w: WindowSpec) -> Column:
    """Hours since the last observation; hour + 1 if there was none."""
    seen = F.when(F.col(c).isNotNull(), F.col(hour))
    last = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col(hour) - last, F.col(hour) + 1)


def trailing_stats(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    """Statistics of the last n rows. Mean, least and most need one value; deviation of fewer than two is 0; the change
    needs a full window, and the slope is the change an hour."""
    t = trailing(w, n)
    change = F.col(c) - F.lag(c, n - 1).over(w)
    return {
        f"{c}_w{n}_mean": F.avg(c).over(t),
        f"{c}_w{n}_min": F.min(c).over(t),
        f"{c}_w{n}_max": F.max(c).over(t),
        f"{c}_w{n}_std": F.coalesce(F.stddev_samp(c).over(t), F.lit(0.0)),
        f"{c}_w{n}_change": change,
        f"{c}_w{n}_slope": change / max(n - 1, 1),
    }


def abnormal_exposure(bad: Column, seen: Column, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """Abnormal rows among the last n, and the share of abnormal among observed ones (null if none was observed)."""
    t = trailing(w, n)
    count = F.sum(bad.cast("long")).over(t)
    observed = F.sum(seen.cast("long")).over(t)
    both = F.sum((bad & seen).cast("long")).over(t)
    return count, F.when(observed > 0, both / observed)


def future_max(score: str, n: int, w: WindowSpec) -> Column:
    """Largest of the next n rows, without the present one."""
    return F.max(score).over(w.rowsBetween(1, n))


def rise_label(score: str, hour: str, n: int, rise: float, entity: str, w: WindowSpec) -> Column:
    """Whether the score rises by so much within n hours; null if the entity ends before, or a score is missing."""
    end = F.max(hour).over(Window.partitionBy(entity))
    ahead = future_max(score, n, w)
    known = (end - F.col(hour) >= n) & F.col(score).isNotNull() & ahead.isNotNull()
    return F.when(known, (ahead - F.col(score) >= rise).cast("long"))


def threshold_label(score: str, time: str, n: int, threshold: float, entity: str, w: WindowSpec) -> Column:
    """Whether the score reaches a threshold within the next n rows; null if fewer rows with a time remain."""
    remaining = F.count(time).over(Window.partitionBy(entity)) - F.row_number().over(w)
    ahead = future_max(score, n, w)
    return F.when((remaining >= n) & ahead.isNotNull(), (ahead >= threshold).cast("long"))


def history_index(w: WindowSpec) -> Column:
    return (F.row_number().over(w) - 1).cast("long")


def eligible(valid: Column, label: Column, observe: int, history: int, w: WindowSpec) -> Column:
    """Enough history, all observed rows valid, and a label."""
    complete = F.sum(valid.cast("long")).over(trailing(w, observe)) == observe
    return (history_index(w) >= history - 1) & complete & label.isNotNull()


def ols_slope(c: str, hour: str, n: int, w: WindowSpec) -> Column:
    """Least-squares slope over a full window of n rows without gaps; else null."""
    t = trailing(w, n)
    return F.when(F.count(c).over(t) == n, F.regr_slope(F.col(c), F.col(hour)).over(t))


def _joined(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What is known of two neighbouring blocks of rows together: counts, means, moments about them (Chan, 1979), ends."""
    share = F.coalesce(b["n"] / F.greatest(a["n"] + b["n"], F.lit(1.0)), F.lit(0.0))  # never null, nor is what follows
    dx, dh, both = b["mean"] - a["mean"], b["hour"] - a["hour"], a["n"] * share
    return {
        "n": a["n"] + b["n"], "mean": a["mean"] + dx * share, "hour": a["hour"] + dh * share, "missing": a["missing"] + b["missing"],
        "xx": a["xx"] + b["xx"] + dx * dx * both, "hh": a["hh"] + b["hh"] + dh * dh * both, "xh": a["xh"] + b["xh"] + dx * dh * both,
        "low": F.least(a["low"], b["low"]), "high": F.greatest(a["high"], b["high"]),
    }


def summary_vector(rows: DataFrame, features: list[str], hour: str, n: int, w: WindowSpec) -> DataFrame:
    """Every row with the vector that stands for the last n rows: of each feature its last value, missingness and recency,
    then mean, least, most, deviation, slope, last step and change of the window, then the share of missing rows.

    Beside a feature ``x`` there are ``x_missing`` (0 or 1) and ``x_since``. ``complete`` says whether each feature has n
    values. Blocks of rows are doubled: what is known of one, and of the one as long before it, is what is known of both, and
    a window is the blocks of n's binary digits. So a row costs log n steps, not n for each statistic.
    """
    zero, one = F.lit(0.0), lambda f: F.when(F.col(f).isNull(), 0.0).otherwise(1.0)
    start = lambda f: {
        "n": one(f), "mean": F.coalesce(F.col(f).cast("double"), zero), "hour": one(f) * F.col(hour), "missing": F.coalesce(F.col(f"{f}_missing").cast("double"), zero),
        "xx": zero, "hh": zero, "xh": zero, "low": F.col(f).cast("double"), "high": F.col(f).cast("double"),
    }
    named = lambda size, f, k: f"__{size}_{f}_{k}"
    parts = tuple(start(features[0]))

    def met(out: DataFrame, size: int, near: int, far: int, back: int) -> DataFrame:
        """Adds the blocks of ``size``: those of size ``near`` with those of size ``far`` that end ``back`` rows before."""
        ago = {f"__ago_{f}_{k}": F.lag(named(far, f, k), back, None if k in ("low", "high") else 0.0).over(w) for f in features for k in parts}
        out = out.withColumns(ago)
        both = {f: _joined({k: F.col(named(near, f, k)) for k in parts}, {k: F.col(f"__ago_{f}_{k}") for k in parts}) for f in features}
        return out.withColumns({named(size, f, k): c for f in features for k, c in both[f].items()}).drop(*ago)

    head = F.row_number().over(w) < n
    ends = {c: x for f in features for c, x in (
        (f"__step_{f}", F.col(f) - F.lag(f, 1).over(w)), (f"__first_{f}", F.when(head, F.first(f).over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.lag(f, n - 1).over(w))))}
    out = rows.withColumns({**ends, "__rows": F.least(F.row_number().over(w), F.lit(n))})
    out = out.withColumns({named(1, f, k): c for f in features for k, c in start(f).items()})
    size, covered = 1, 0
    while True:
        old = set()
        if n & size:
            if covered:
                out = met(out, covered + size, covered, size, covered)
                old.add(covered)
            covered += size
        if covered == n:
            break
        out = met(out, 2 * size, size, size, size)
        out = out.drop(*[named(x, f, k) for x in {*old, *({size} - {covered})} for f in features for k in parts])
        size *= 2
    at = lambda f, k: F.col(named(n, f, k))
    vector = {f"last_{c}": F.col(c) for f in features for c in (f, f"{f}_missing", f"{f}_since")}
    for f in features:
        some = at(f, "n") > 0
        vector |= {
            f"mean_{f}": F.when(some, at(f, "mean")), f"min_{f}": at(f, "low"), f"max_{f}": at(f, "high"), f"std_{f}": F.when(some, F.sqrt(at(f, "xx") / at(f, "n"))),
            f"slope_{f}": F.when(at(f, "hh") > 0, at(f, "xh") / at(f, "hh")), f"step_{f}": F.col(f"__step_{f}"),
            f"span_{f}": F.col(f) - F.col(f"__first_{f}"), f"missing_mean_{f}": at(f, "missing") / F.col("__rows"),
        }
    complete = at(features[0], "n") == n
    for f in features[1:]:
        complete = complete & (at(f, "n") == n)
    return out.select(*rows.columns, *[c.alias(k) for k, c in vector.items()], complete.alias("complete"))


#: Names of the explicit temporal signals of a risk trajectory.
SIGNALS = ("mean_risk", "min_risk", "max_risk", "risk_std", "risk_slope", "short_term_change", "window_change", "abnormal_duration",
           "abnormal_frequency", "missing_fraction", "current_missing", "time_since")


def signals(risk: str, missing: str, since: str, hour: str, n: int, w: WindowSpec) -> dict[str, Column]:
    """Twelve signals of the last n rows of a risk between 0 and 4, as window sums: no window is gathered."""
    t = trailing(w, n)
    r, m = F.col(risk), F.col(missing)
    abnormal = sigmoid((r - 0.5) / 0.2)
    seen = F.sum(1 - m).over(t)
    often = F.when(seen > 0, F.sum(abnormal * (1 - m)).over(t) / F.greatest(seen, F.lit(1.0))).otherwise(0.0)
    stale = F.log1p(clip(F.col(since).cast("double"), 0.0, 168.0)) / F.log(F.lit(169.0))
    values = (F.avg(r).over(t) / 4, F.min(r).over(t) / 4, F.max(r).over(t) / 4, F.stddev_pop(r).over(t) / 2,
              F.tanh(F.regr_slope(r, F.col(hour)).over(t)), F.tanh(r - F.lag(r, 1).over(w)), F.tanh(r - F.first(r).over(t)),
              F.avg(abnormal).over(t), often, F.avg(m).over(t), m, stale)
    return dict(zip(SIGNALS, values, strict=True))


def average_rank(rows: DataFrame, by: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """Rank of a numeric column with ties averaged. Counts by distinct value are settled and accumulated, not rows; ``weight``
    is how often a row counts."""
    counts = settled(rows.groupBy(by).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n")))
    below = running(counts, by, even_buckets(counts, by), {"__below": "__n"}, exclusive=True)
    return rows.join(below.select(by, (F.col("__below") + (F.col("__n") + 1) / 2).alias(name)), by)


def adjacent(w: WindowSpec, hour: str) -> Column:
    """Whether the previous row of the entity is the hour before."""
    return F.coalesce(F.col(hour) - F.lag(hour, 1).over(w) == 1, F.lit(False))


#: Hours in a cell, at least, and cells or groups of cells that are composed at a time.
CELL_HOURS, FAN = 64, 256


def _pass(hours: Column, entry: Column, gap: int) -> Column:
    """Of a cell's ascending hours those kept, and the first hour allowed after them, from the first allowed on entry."""
    start = F.struct(entry.cast("bigint").alias("free"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, h: F.when(h >= s["free"], F.struct((h + gap).cast("bigint").alias("free"), F.array_append(s["kept"], h).alias("kept"))).otherwise(s)
    return F.aggregate(hours, start, step)


def _through(children: Column, entry: Column, first: Column, gap: int) -> Column:
    """Entry of each of the children (cell, f) of a group, in order, and the first cell that may follow with what exit."""
    start = F.struct(entry.cast("bigint").alias("r"), first.cast("bigint").alias("next"), F.array().cast("array<struct<cell:bigint,entry:bigint>>").alias("seen"))

    def step(s, c):
        r = F.when(c["cell"] == s["next"], s["r"]).otherwise(F.lit(0).cast("bigint"))  # a cell between lets all wear off
        return F.struct(F.element_at(c["f"], (r + 1).cast("int")).alias("r"), (c["cell"] + 1).alias("next"), F.array_append(s["seen"], F.struct(c["cell"].alias("cell"), r.alias("entry"))).alias("seen"))

    return F.aggregate(children, start, step)


def refractory_alerts(alerts: DataFrame, entity: str, hour: str, gap: int) -> DataFrame:
    """Alerts left by refractory suppression: each at least ``gap`` after the last kept one of its entity. Whole hours.

    A cell of hours is a function: from how many of its first hours are still blocked on entry to how many of the next
    cell's are on exit. Functions of neighbouring cells are composed in groups of FAN, these again, until each entity is
    one; then entries are handed down. No task holds more than a cell's hours or a group's functions, whatever the number
    of an entity's alerts.
    """
    width = max(CELL_HOURS, gap)
    rows = alerts.select(entity, F.col(hour).cast("long").alias("__h")).where("__h IS NOT NULL").distinct()
    ends = rows.agg(F.min("__h"), F.max("__h")).first()  # two numbers
    low, high = ends[0] or 0, ends[1] or 0
    rows = rows.withColumn("cell", F.floor((F.col("__h") - low) / width).cast("long"))
    hours = rows.groupBy(entity, "cell").agg(F.array_sort(F.collect_list(F.col("__h") - low - F.col("cell") * width)).alias("__hours"))
    entries = F.sequence(F.lit(0), F.lit(gap))
    exits = F.transform(entries, lambda r: F.greatest(_pass(F.col("__hours"), r, gap)["free"] - width, F.lit(0)).cast("bigint"))
    levels = [settled(hours.withColumn("f", exits))]
    span = (high - low) // width
    while span > 0:
        at = F.floor(F.col("cell") / FAN).cast("long")
        up = levels[-1].groupBy(entity, at.alias("cell")).agg(F.array_sort(F.collect_list(F.struct("cell", "f"))).alias("children"))
        first, end = F.col("cell") * FAN, (F.col("cell") + 1) * FAN

        def leave(r: Column) -> Column:
            s = _through(F.col("children"), r, first, gap)  # noqa: B023
            return F.when(s["next"] == end, s["r"]).otherwise(F.lit(0).cast("bigint"))  # noqa: B023

        levels.append(settled(up.withColumn("f", F.transform(entries, leave))))
        span //= FAN
    down = levels[-1].select(entity, "cell", F.lit(0).cast("bigint").alias("entry"))
    for i in range(len(levels) - 1, 0, -1):
        met = levels[i].join(down, [entity, "cell"])
        down = met.select(entity, F.inline(_through(F.col("children"), F.col("entry"), F.col("cell") * FAN, gap)["seen"]))
    kept = levels[0].join(down, [entity, "cell"]).select(entity, "cell", F.explode(_pass(F.col("__hours"), F.col("entry"), gap)["kept"]).alias("__kept"))
    return kept.select(entity, (F.col("__kept") + F.col("cell") * width + low).alias(hour))
