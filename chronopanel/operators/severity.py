"""Severity scores assembled from hourly measurements: worst values of a trailing window, then bands, then totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import exprs as X
from chronopanel.functions import scores as S
from chronopanel.operators import temporal as T

#: Measurements that the assembly reads; those that are absent count as never measured.
MEASUREMENTS = (
    "pao2", "fio2", "mechanical_vent", "platelets", "bilirubin", "map", "dopamine", "dobutamine", "epinephrine",
    "norepinephrine", "gcs_eye", "gcs_verbal", "gcs_motor", "gcs_total", "creatinine", "urine_output",
)
ORGANS = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")


def organ_assembly(rows: DataFrame, entity: str, hour: str, hours: int = 24, least: int = 4) -> DataFrame:
    """Organ scores of the worst values within the last ``hours`` rows of a dense panel, and their totals.

    Only the oxygen fraction is carried forward; without a note of a ventilator there is none; a coma total stands
    before its parts, which count if all three are there. Urine is summed where any was measured and the window is full.
    Totals: of what is present, of all with the missing as normal, of complete rows, and ``score``, missing as normal
    where at least ``least`` organs are present.
    """
    w = T.timeline(entity, hour)
    t = T.trailing(w, hours)
    absent = {c: F.lit(None).cast("double") for c in MEASUREMENTS if c not in rows.columns}
    x = rows.withColumns(absent) if absent else rows
    parts = X.null_strict_sum(*[F.col(f"gcs_{p}") for p in ("eye", "verbal", "motor")])
    x = x.withColumns({"__fio2": T.locf("fio2", w), "__vent": F.coalesce("mechanical_vent", F.lit(0)), "__gcs": F.coalesce(F.col("gcs_total"), parts)})
    x = x.withColumn("__ratio", X.guarded_ratio(F.col("pao2"), F.col("__fio2")))
    low = lambda c: F.min(c).over(t)
    high = lambda c: F.max(c).over(t)
    measured = (high(F.col("urine_output").isNotNull().cast("int")) == 1) & (F.col(hour) >= hours - 1)
    worst = {
        "__w_ratio": low("__ratio"), "__w_vent": high("__vent"), "__w_plt": low("platelets"), "__w_bili": high("bilirubin"),
        "__w_map": low("map"), "__w_gcs": low("__gcs"), "__w_creat": high("creatinine"),
        **{f"__w_{d}": high(d) for d in ("dopamine", "dobutamine", "epinephrine", "norepinephrine")},
        "__w_urine": F.when(measured, F.sum(F.coalesce("urine_output", F.lit(0.0))).over(t)),
    }
    x = x.withColumns(worst)
    c = {k.removeprefix("__w_"): F.col(k) for k in worst}
    scores = (
        S.respiration(c["ratio"], c["vent"]), S.platelets(c["plt"]), S.bilirubin(c["bili"]),
        S.cardiovascular(c["map"], c["dopamine"], c["dobutamine"], c["epinephrine"], c["norepinephrine"]), S.coma(c["gcs"]), S.renal(c["creat"], c["urine"]),
    )
    x = x.withColumns(dict(zip(ORGANS, scores, strict=True))).drop(*worst, "__fio2", "__vent", "__gcs", "__ratio", *absent)
    organs = [F.col(o) for o in ORGANS]
    return x.withColumns(
        {
            "component_count": X.present_count(*organs), "score_observed": X.filled_sum(*organs, least=1),
            "score_assume_normal": X.filled_sum(*organs), "score_complete": X.null_strict_sum(*organs), "score": X.filled_sum(*organs, least=least),
        }
    )


def total_or_parts(rows: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """The total as it is if any row has one; only where the whole column is null, the sum of complete parts."""
    some = rows.agg((F.count(total) > 0).alias("__some"))  # one row
    value = F.when(F.col("__some"), F.col(total)).otherwise(X.null_strict_sum(*[F.col(p) for p in parts]))
    return rows.join(F.broadcast(some)).withColumn(total, value).drop("__some")


def early_warning_label(rows: DataFrame, entity: str, hour: str, vitals: list[str], oxygen: str, coma: str, ahead: int = 6, threshold: int = 7) -> DataFrame:
    """Score of the vitals carried forward, the greatest one within the next rows, and whether that reaches the threshold;
    rows with too few after them are left out."""
    w = T.timeline(entity, hour)
    x = rows.select(entity, hour, *[T.locf(c, w).alias(c) for c in (*vitals, oxygen, coma)])
    x = x.select(entity, hour, S.early_warning({v: F.col(v) for v in vitals}, F.col(oxygen), F.col(coma)).alias("score"))
    label = T.threshold_label("score", hour, ahead, threshold, entity, w)
    return x.withColumns({"ahead": T.future_max("score", ahead, w), "label": label}).where("label IS NOT NULL")
