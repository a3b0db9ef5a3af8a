"""Change analysis: overall change, segment pivots, abnormal-change ranking, mix/rate split,
top candidates, drill-down, duplicate-rate findings and confidence.

Every per-group denominator is a ``groupBy`` aggregate joined back, never a window over a whole group; only
tables with one row per dimension of the model are broadcast by a hint.
Top-k per dimension is ``row_number() <= k``, which Spark plans as a partial group limit before
the shuffle; full ranks come from a sort by ranges and the sizes of its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.columns import abs_desc, nullable_ratio, percent_change, ratio, zero_if_null
from shiftlens.operators.metric import NONE_SEGMENT

TOTAL = "total"
AVERAGE = "per_order_average"


def _sum_when(period: str, col: str) -> Column:
    return F.sum(F.when(F.col("period") == period, F.col(col)))


# ---- A1 -----------------------------------------------------------------------------------------
def period_change(df: DataFrame, a: str, b: str) -> DataFrame:
    """A1: add ``delta`` and ``pct_change`` (NULL at a zero baseline) for two value columns."""
    return df.withColumn("delta", F.col(b) - F.col(a)).withColumn("pct_change", percent_change(a, b))


# ---- A2 -----------------------------------------------------------------------------------------
def total_change(totals: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """A2: overall value in A and B from ``(period, total, n)`` rows.

    Totals use the sum, averages ``total / n`` (0 when n is 0); a missing period counts as 0.
    ``by`` keeps grouping columns (the drill-down ranks each dimension against its own change).
    """
    by = by or []
    agg = totals.groupBy(*by).agg(
        zero_if_null(_sum_when("A", "total")).alias("_ta"), zero_if_null(_sum_when("B", "total")).alias("_tb"),
        zero_if_null(_sum_when("A", "n")).alias("_na"), zero_if_null(_sum_when("B", "n")).alias("_nb"))
    if kind == TOTAL:
        va, vb = F.col("_ta"), F.col("_tb")
    else:
        va, vb = ratio("_ta", "_na"), ratio("_tb", "_nb")
    out = agg.select(*by, va.cast("double").alias("value_a"), vb.cast("double").alias("value_b"))
    return period_change(out, "value_a", "value_b")


# ---- A3 -----------------------------------------------------------------------------------------
def pivot_periods(by_dim: DataFrame, keys: tuple[str, ...] = ("dimension", "segment")) -> DataFrame:
    """A3: ``(dimension, segment, total_a, total_b, n_a, n_b)``, zero-filled doubles."""
    return by_dim.groupBy(*keys).agg(
        *[zero_if_null(_sum_when(p, m)).cast("double").alias(f"{m}_{p.lower()}")
          for m in ("total", "n") for p in ("A", "B")])


# ---- A4 -----------------------------------------------------------------------------------------
def segment_contributions(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """A4: plain contributions: delta, share of the group's total delta, percent change.

    ``group`` names the column that scopes the total (e.g. ``dimension``); shares sum to 1 in a
    group whose total delta is non-zero.
    """
    d = df.withColumn("delta", F.col(b) - F.col(a))
    sums = d.groupBy(group).agg(F.sum("delta").alias("_total_delta"))
    return (d.join(sums, group)
            .withColumn("share_of_change", ratio("delta", "_total_delta"))
            .withColumn("pct_change", percent_change(a, b))
            .drop("_total_delta"))


# ---- A6 / A7 ------------------------------------------------------------------------------------
def mix_rate_segments(df: DataFrame, num_a: str, den_a: str, num_b: str, den_b: str,
                      group: str = "dimension") -> DataFrame:
    """Weights, rates and the mix / rate / interaction split per segment.

    w = den / group sum of den (NULL when that sum is 0); r = num / den (0 when den is 0).
    """
    sums = df.groupBy(group).agg(F.sum(den_a).alias("_sa"), F.sum(den_b).alias("_sb"))
    d = df.join(sums, group)
    d = (d.withColumn("weight_a", nullable_ratio(den_a, "_sa"))
          .withColumn("weight_b", nullable_ratio(den_b, "_sb"))
          .withColumn("rate_a", ratio(num_a, den_a))
          .withColumn("rate_b", ratio(num_b, den_b)))
    dw = F.col("weight_b") - F.col("weight_a")
    dr = F.col("rate_b") - F.col("rate_a")
    d = (d.withColumn("mix_effect", dw * F.col("rate_a"))
          .withColumn("rate_effect", F.col("weight_a") * dr)
          .withColumn("interaction", dw * dr))
    return (d.withColumn("total_effect", F.col("mix_effect") + F.col("rate_effect") + F.col("interaction"))
            .drop("_sa", "_sb"))


def mix_rate_summary(df: DataFrame, num_a: str, den_a: str, num_b: str, den_b: str,
                     group: str = "dimension") -> DataFrame:
    """Overall rate A/B, delta, and summed mix / rate / interaction effects per group."""
    seg = mix_rate_segments(df, num_a, den_a, num_b, den_b, group)
    out = seg.groupBy(group).agg(
        nullable_ratio(F.sum(num_a), F.sum(den_a)).alias("rate_a"),
        nullable_ratio(F.sum(num_b), F.sum(den_b)).alias("rate_b"),
        F.sum("mix_effect").alias("mix_effect"), F.sum("rate_effect").alias("rate_effect"),
        F.sum("interaction").alias("interaction"))
    return out.withColumn("delta", F.col("rate_b") - F.col("rate_a"))


# ---- A5 / A8 / A9 -------------------------------------------------------------------------------
def abnormal_change(pivot: DataFrame, kind: str, overall: DataFrame) -> DataFrame:
    """Abnormal change per segment and its share of the overall change.

    ``pivot``   - output of ``pivot_periods``
    ``overall`` - ``(dimension, overall_delta)``, one row per dimension
    Totals: ``abnormal = delta - (a / sum a) * sum delta`` (segment sums per dimension).
    Averages: ``abnormal = rate_effect + interaction``; moving orders between segments with equal
    rates leaves it at zero.
    """
    if kind == TOTAL:
        d = (pivot.withColumn("value_a", F.col("total_a")).withColumn("value_b", F.col("total_b"))
             .withColumn("delta", F.col("value_b") - F.col("value_a")))
        sums = d.groupBy("dimension").agg(F.sum("value_a").alias("_sa"), F.sum("delta").alias("_sd"))
        d = d.join(F.broadcast(sums), "dimension")
        d = (d.withColumn("expected_delta", ratio("value_a", "_sa") * F.col("_sd"))
              .withColumn("abnormal", F.col("delta") - F.col("expected_delta"))
              .drop("_sa", "_sd"))
    elif kind == AVERAGE:
        d = mix_rate_segments(pivot, "total_a", "n_a", "total_b", "n_b")
        d = (d.withColumn("value_a", F.col("rate_a")).withColumn("value_b", F.col("rate_b"))
             .withColumn("delta", F.col("value_b") - F.col("value_a"))
             .withColumn("abnormal", F.col("rate_effect") + F.col("interaction")))
    else:
        raise ValueError(f"unknown metric kind {kind!r}")
    d = d.join(F.broadcast(overall.select("dimension", "overall_delta")), "dimension")
    d = d.withColumn("share_of_change",
                     F.when(F.coalesce(F.col("overall_delta"), F.lit(0.0)) != 0,
                            F.try_divide(F.col("abnormal"), F.col("overall_delta"))).otherwise(F.lit(0.0)))
    return d


def _rank_order() -> list[Column]:
    """Inside a dimension: |abnormal| descending, NULL last, ties by segment."""
    return [abs_desc("abnormal"), F.col("segment").asc()]


def rank_segments(abnormal: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every segment's ``rank_in_dimension``, however many segments a dimension has.

    The rows of ``abnormal_change`` are sorted across tasks by ranges of (dimension, rank order), so a dimension is spread over
    many tasks, and given to ``write`` (which persists or checkpoints them: their places must not change any more). A row's rank is its
    place in its task's part of the dimension plus the sizes of the parts before it; those sizes, one row per task and
    dimension, are all that a window looks at. For the first few of a dimension ``top_candidates`` needs no full ranks.
    """
    order = [F.col("dimension"), *_rank_order()]
    placed = write(abnormal.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_at", 33))
    parts = placed.groupBy("dimension", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("dimension").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("dimension", "_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(F.broadcast(starts), ["dimension", "_task"]) \
        .select(*abnormal.columns, (F.col("_at") + F.col("_shift")).cast("int").alias("rank_in_dimension"))


def overall_by_dimension(change: DataFrame, dimensions: list[str]) -> DataFrame:
    """Spread the one-row overall change to ``(dimension, overall_delta)`` without a cross join."""
    return change.select(F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"),
                         F.col("delta").alias("overall_delta"))


# ---- A10 ----------------------------------------------------------------------------------------
def first_segments(abnormal: DataFrame, n: int) -> DataFrame:
    """The first ``n`` segments of each dimension with their ``rank_in_dimension`` (a group limit before the shuffle)."""
    w = Window.partitionBy("dimension").orderBy(*_rank_order())
    return abnormal.withColumn("rank_in_dimension", F.row_number().over(w)).filter(F.col("rank_in_dimension") <= n)


def top_candidates(abnormal: DataFrame, dimensions: list[str], per_dimension: int = 3) -> DataFrame:
    """A10: each dimension's top ``per_dimension`` (taken before ``(none)`` is dropped), rounded half-even to
    4 places, ordered by |share| descending; ties keep dimension order, then rank in dimension."""
    order = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    top = first_segments(abnormal, per_dimension).filter(F.col("segment") != NONE_SEGMENT)
    top = top.select(
        "dimension", "segment",
        F.bround("value_a", 4).alias("value_a"), F.bround("value_b", 4).alias("value_b"),
        F.bround("delta", 4).alias("change"), F.bround("abnormal", 4).alias("abnormal_change"),
        F.bround("share_of_change", 4).alias("share_of_change"),
        order.alias("_dim_order"), "rank_in_dimension")
    w = Window.orderBy(abs_desc("share_of_change"), "_dim_order", "rank_in_dimension")
    # The candidate list is at most per_dimension x (number of dimensions) rows, so one
    # partition for the final numbering is bounded by the model, not by the data.
    return top.withColumn("candidate_rank", F.row_number().over(w)).drop("_dim_order", "rank_in_dimension")


# ---- A12 ----------------------------------------------------------------------------------------
def duplicate_findings(counts: DataFrame, min_increase: float = 0.005) -> DataFrame:
    """Tables whose duplicate-row rate rose by more than ``min_increase`` from A to B."""
    rate = ratio(F.col("row_count") - F.col("distinct_keys"), F.col("row_count"))
    rates = counts.groupBy("table_name").agg(
        zero_if_null(F.max(F.when(F.col("period") == "A", rate))).alias("duplicate_rate_a"),
        zero_if_null(F.max(F.when(F.col("period") == "B", rate))).alias("duplicate_rate_b"))
    return (rates.withColumn("increase", F.col("duplicate_rate_b") - F.col("duplicate_rate_a"))
            .filter(F.col("increase") > F.lit(min_increase)))


# ---- A13 ----------------------------------------------------------------------------------------
def merge_findings(candidates: DataFrame, findings: DataFrame, table_order: list[str] | None = None) -> DataFrame:
    """One list with the findings on duplicate rows before all candidates."""
    order = (F.array_position(F.array(*[F.lit(t) for t in table_order]), F.col("table_name"))
             if table_order else F.lit(0))
    dq = findings.select(
        F.lit("data_quality").alias("dimension"), F.col("table_name").alias("segment"),
        F.lit(None).cast("double").alias("share_of_change"), F.col("duplicate_rate_b"),
        F.lit(0).alias("_group"), order.cast("long").alias("_pos"))
    cand = candidates.select(
        "dimension", "segment", "value_a", "value_b", "change", "abnormal_change", "share_of_change",
        F.lit(None).cast("double").alias("duplicate_rate_b"), F.lit(1).alias("_group"),
        F.col("candidate_rank").cast("long").alias("_pos"))
    merged = dq.unionByName(cand, allowMissingColumns=True)
    w = Window.orderBy("_group", "_pos")
    return merged.withColumn("rank", F.row_number().over(w)).drop("_group", "_pos")


# ---- A14 ----------------------------------------------------------------------------------------
def confidence(change: DataFrame, candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """``(confidence, status)`` in one row.

    quality finding -> high; |pct| < 2 -> no_significant_change; no candidate -> low;
    top |share| >= 0.5 high, >= 0.25 medium, else low. Status: low -> insufficient_evidence.
    """
    null = F.lit(None)
    parts = (
        change.select(F.col("pct_change").cast("double").alias("pct_change"), null.cast("long").alias("f"),
                      null.cast("long").alias("c"), null.cast("double").alias("s"))
        .unionByName(findings.select(null.cast("double").alias("pct_change"), F.lit(1).cast("long").alias("f"),
                                     null.cast("long").alias("c"), null.cast("double").alias("s")))
        .unionByName(candidates.select(
            null.cast("double").alias("pct_change"), null.cast("long").alias("f"), F.lit(1).cast("long").alias("c"),
            F.when(F.col("candidate_rank") == 1, F.abs("share_of_change")).cast("double").alias("s"))))
    # One global aggregate over a one-row change, the findings and the candidates: no join needed.
    row = parts.agg(F.max("pct_change").alias("pct_change"), F.count("f").alias("n_findings"),
                    F.count("c").alias("n_candidates"), F.max("s").alias("top_share"))
    conf = (F.when(F.col("n_findings") > 0, "high")
            .when(F.col("pct_change").isNotNull() & (F.abs("pct_change") < 2), "no_significant_change")
            .when(F.col("n_candidates") == 0, "low")
            .when(F.col("top_share") >= 0.5, "high")
            .when(F.col("top_share") >= 0.25, "medium")
            .otherwise("low"))
    status = (F.when(F.col("confidence") == "low", "insufficient_evidence")
              .when(F.col("confidence") == "no_significant_change", "no_significant_change")
              .otherwise("ok"))
    return row.select(conf.alias("confidence")).withColumn("status", status)
