"""Unusual days in daily metrics (A16): an STL-style decomposition with a robust z-score.

Not loess STL: the trend is a centred moving **median** (7 days), the seasonal part the median
of the detrended values by weekday, the residual what is left. The score is the modified
z-score ``0.6745 * (r - median(r)) / MAD`` (Iglewicz and Hoaglin); a zero MAD gives NULL. A
day is flagged when ``|score| >= threshold``.

Scale: the daily roll-up is an ordinary aggregation (partial sums before the shuffle). Each
series is one short day-by-day sequence, so the windows partition by series; many series run
in parallel and no series grows with the event volume, only with the number of days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.operators import metric as mt
from shiftlens.plans.model import MetricSpec, SemanticModel

# ---- fixed values -------------------------------------------------------------------------------
DEFAULT_THRESHOLD = 6.0
TREND_HALF_WIDTH = 3        # centred window of 7 days
MAD_SCALE = 0.6745


def daily_series(events: DataFrame, series: list[str], ts: str = "ts", value: str | None = None,
                 metric: str = "events") -> DataFrame:
    """Roll events up to ``(metric, *series, day, value)``: count per day, or the sum of
    ``value``. Days without events inside a series' first..last day are filled with 0."""
    day = F.to_date(F.col(ts))
    agg = F.count(F.lit(1)).cast("double") if value is None else F.sum(value).cast("double")
    daily = events.groupBy(*series, day.alias("day")).agg(agg.alias("value"))
    spine = (daily.groupBy(*series).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
             .select(*series, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("day")))
    return (spine.join(daily, [*series, "day"], "left")
            .select(F.lit(metric).alias("metric"), *series, "day",
                    F.coalesce("value", F.lit(0.0)).alias("value")))


def daily_metrics(tables: dict[str, DataFrame], model: SemanticModel, specs: dict[str, MetricSpec]) -> DataFrame:
    """Catalogue metrics by day on one common spine of days: ``(metric, day, value)``.

    Metrics that read the same joins are rolled up together: one scan of the orders, and of a child, gives the per-order values
    of all of them, and one aggregate their daily sums and counts. A total is 0 on a day without orders, an average is NULL.
    The periods of ``specs`` are not looked at; an order that a metric's filter leaves out has no value in it."""
    for spec in specs.values():
        spec.validate(model)
    groups: dict[tuple, list[str]] = {}
    for name, spec in specs.items():
        groups.setdefault((spec.date_column, *model.resolve_joins(spec.joins)), []).append(name)
    parts = []
    for (date, *path), names in groups.items():
        o = tables[model.base_table].alias(model.base_alias).filter(F.col(f"{model.base_alias}.{date}").isNotNull())
        keys = [F.col(f"{model.base_alias}.{model.order_key}").alias("order_key"), F.to_date(F.col(f"{model.base_alias}.{date}")).alias("day")]
        values = []
        for i, name in enumerate(names):
            asked = F.max(F.expr(specs[name].filter)) if specs[name].filter else F.lit(True)
            values.append(F.when(asked, F.expr(specs[name].value).cast("double")).alias(f"v{i}"))
        per = mt.per_order(o, tables, model, path, keys, values)
        sums = per.groupBy("day").agg(*[x for i in range(len(names)) for x in (F.sum(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}"))])
        parts.append(sums.select("day", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"s{i}").alias("total"), F.col(f"n{i}").alias("n"))
                                                            for i, n in enumerate(names)])).alias("m")).select("m.metric", "day", "m.total", "m.n"))
    found = reduce(DataFrame.unionByName, parts)
    days = found.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null") \
        .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    spine = days.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(specs[n].kind == "total").alias("is_total")) for n in specs])).alias("m"), "day") \
        .select("m.metric", "m.is_total", "day")
    value = F.when(F.col("is_total"), F.coalesce("total", F.lit(0.0))).otherwise(F.try_divide("total", "n"))
    return spine.join(found, ["metric", "day"], "left").select("metric", "day", value.alias("value"))


def metric_scan(tables: dict[str, DataFrame], model: SemanticModel, specs: dict[str, MetricSpec], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """A16 on the key metrics: every metric's unusual days, largest |score| first."""
    scored = anomaly_scores(daily_metrics(tables, model, specs), [], threshold)
    return scored.filter("is_anomaly").orderBy(F.abs("score").desc(), "metric", "day")


def anomaly_scores(daily: DataFrame, series: list[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Score every day: ``(metric, *series, day, value, trend, seasonal, residual, score, is_anomaly)``; a day without a value has no score."""
    keys = ["metric", *series]
    w_trend = (Window.partitionBy(*keys).orderBy("day")
               .rowsBetween(-TREND_HALF_WIDTH, TREND_HALF_WIDTH))
    t = (daily.withColumn("trend", F.percentile("value", 0.5).over(w_trend))
         .withColumn("weekday", F.dayofweek("day"))
         .withColumn("_detr", F.col("value") - F.col("trend")))
    season = t.groupBy(*keys, "weekday").agg(F.percentile("_detr", 0.5).alias("seasonal"))
    r = (t.join(season, [*keys, "weekday"])
         .withColumn("residual", F.col("_detr") - F.col("seasonal")))
    med = r.groupBy(*keys).agg(F.percentile("residual", 0.5).alias("_med"))
    r = r.join(med, keys)
    mad = (r.groupBy(*keys).agg(F.percentile(F.abs(F.col("residual") - F.col("_med")), 0.5).alias("_mad")))
    scored = r.join(mad, keys).withColumn(
        "score", F.when(F.col("_mad") != 0, F.lit(MAD_SCALE) * (F.col("residual") - F.col("_med")) / F.col("_mad")))
    return scored.select(*keys, "day", "value", "trend", "seasonal", "residual", "score",
                         F.coalesce(F.abs("score") >= threshold, F.lit(False)).alias("is_anomaly"))


def anomaly_scan(events: DataFrame, series: list[str], threshold: float = DEFAULT_THRESHOLD, ts: str = "ts",
                 value: str | None = None, metric: str = "events") -> DataFrame:
    """Flagged days only, largest |score| first."""
    scored = anomaly_scores(daily_series(events, series, ts, value, metric), series, threshold)
    return scored.filter("is_anomaly").orderBy(F.abs("score").desc(), *series, "day")
