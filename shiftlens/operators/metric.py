"""Metric layer: period tagging, per-order values, the order-segment bridge and per-dimension sums.

Plan shape (all dimensions in one pass, nothing collected):

    orders --filter(A or B)--> tag period --join children--> groupBy(order, period)     = base
    orders --filter(A or B)--> join dimension paths --> explode(dim, segment) --> distinct = bridge
    base x dimension list --left join bridge--> groupBy(dimension, segment, period)      = by dimension

A metric that reads one child with many rows per order (``Join.fanout``) gets it by an inner join and an aggregate per
order; orders without a child row take the value of a single row with NULLs for the child, which is computed without it.
With several such children the joins are all LEFT, as an order may lack some of them and not others.

``read_children_once`` cuts the children down to the rows of the orders in question, written once: base, bridge and
duplicate check then read that table, and the child itself is scanned a single time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.model import MetricSpec, SemanticModel

NONE_SEGMENT = "(none)"


def _and(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def _typed_literal(df: DataFrame, column: str, value: str) -> Column:
    """A constant of the column's own type, so the comparison is pushed to the scan unchanged."""
    name = column.split(".")[-1]
    dtype = next(f.dataType for f in df.schema.fields if f.name == name)
    return F.lit(value).cast(dtype)


def period_conditions(df: DataFrame, model: SemanticModel, spec: MetricSpec) -> tuple[Column, Column]:
    d = f"{model.base_alias}.{spec.date_column}"
    col = F.col(d)
    a0, a1 = (_typed_literal(df, d, v) for v in spec.period_a)
    b0, b1 = (_typed_literal(df, d, v) for v in spec.period_b)
    return (col >= a0) & (col < a1), (col >= b0) & (col < b1)


def tag_periods(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec,
                apply_filter: bool = True) -> DataFrame:
    """M1 (+M4): base rows in period A or B, tagged ``period``; if the periods overlap, B wins."""
    spec.validate(model)
    o = tables[model.base_table].alias(model.base_alias)
    in_a, in_b = period_conditions(o, model, spec)
    o = o.filter(in_a | in_b)
    if apply_filter and spec.filter:
        o = o.filter(F.expr(spec.filter))
    return o.withColumn("period", F.when(in_b, F.lit("B")).otherwise(F.lit("A")))


def join_path(left: DataFrame, tables: dict[str, DataFrame], model: SemanticModel, names,
              how: str = "left", inner: tuple[str, ...] = ()) -> DataFrame:
    """M2 + chained joins: parents first; ``how`` for every join except those named in ``inner``."""
    for name in model.resolve_joins(names):
        j = model.joins[name]
        right = tables[j.table].alias(j.alias)
        cond = _and([F.col(c) == F.col(p) for c, p in j.keys])
        left = left.join(right, cond, "inner" if name in inner else how)
    return left


def per_order(o: DataFrame, tables: dict[str, DataFrame], model: SemanticModel, joins, keys: list[Column], values: list[Column]) -> DataFrame:
    """``values`` aggregated by ``keys`` (which hold the order key) over the base rows ``o`` LEFT JOINed with ``joins``."""
    path = model.resolve_joins(joins)
    fan = [n for n in path if model.joins[n].fanout]
    if len(fan) != 1:
        return join_path(o, tables, model, path).groupBy(*keys).agg(*values)
    found = join_path(o, tables, model, path, inner=tuple(fan)).groupBy(*keys).agg(*values)
    below = [n for n in path if n in fan or fan[0] in model.resolve_joins([n])]
    padded = join_path(o, tables, model, [n for n in path if n not in below])
    for name in below:  # the same columns, all NULL
        j = model.joins[name]
        nulls = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in tables[j.table].schema.fields])
        padded = padded.withColumn(j.alias, nulls)
    names = found.columns
    own, kept = names[:len(keys)], names[len(keys):]
    default = padded.groupBy(*keys).agg(*values).select(*own, F.struct(*kept).alias("_default"))
    both = default.join(found.select(*own, F.struct(*kept).alias("_found")), own, "left")
    return both.select(*own, *[F.when(F.col("_found").isNotNull(), F.col(f"_found.{c}")).otherwise(F.col(f"_default.{c}")).alias(c) for c in kept])


def metric_base(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec) -> DataFrame:
    """M3: one value per (order, period): ``(order_key, period, v)``. Child joins are LEFT; rows of several children of one
    order multiply before the aggregate, as in one statement with all the joins."""
    o = tag_periods(tables, model, spec)
    keys = [F.col(f"{model.base_alias}.{model.order_key}").alias("order_key"), F.col("period")]
    return per_order(o, tables, model, spec.joins, keys, [F.expr(spec.value).cast("double").alias("v")])


def read_children_once(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec, dimensions: list[str],
                       write: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables with every fan-out child of the metric and the dimensions cut down to the rows of the orders in period A or
    B and the columns that the model and the metric name, each given to ``write`` (which persists or checkpoints it), by parent key.

    Every later join with a child keeps only such rows, so no result changes."""
    path = model.resolve_joins([*spec.joins, *(n for d in dimensions for n in model.dimension(d).joins)])
    texts = [spec.value, spec.filter or "", *(d.sql for d in model.dimensions), *(c for j in model.joins.values() for pair in j.keys for c in pair)]
    out = dict(tables)
    for name in path:
        j = model.joins[name]
        if not j.fanout or j.requires or any(not p.startswith(f"{model.base_alias}.") for _, p in j.keys):
            continue  # only children of the orders themselves
        words = {w for t in texts for w in re.findall(r"\w+", t)} | set(model.keys.get(j.table, ()))
        child = tables[j.table]
        child = child.select(*[c for c in child.columns if c in words]).alias(j.alias)
        o = tag_periods(tables, model, spec, apply_filter=False)
        kept = child.join(o, _and([F.col(c) == F.col(p) for c, p in j.keys]), "left_semi")
        out[j.table] = write(kept.repartition(*[c.split(".")[-1] for c, _ in j.keys]))
    for t in {model.base_table, *(model.joins[n].table for n in path)} - set(out):
        out[t] = tables[t]
    return out


def metric_total(base: DataFrame) -> DataFrame:
    """M6: ``(period, total, n, orders)``; n counts non-NULL values."""
    return base.groupBy("period").agg(
        F.sum("v").alias("total"), F.count("v").alias("n"), F.count(F.lit(1)).alias("orders"))


def segment_bridge(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec,
                   dimensions: list[str] | None = None) -> DataFrame:
    """M7: distinct ``(order_key, dimension, segment)`` for every dimension in one pass per join group.

    Dimensions are grouped by the first one-to-many join on their path (order-level dimensions form
    one group). Inside a group the joins are LEFT and a dimension only emits rows where every join
    of its own path matched, which is the inner-join result of the per-dimension query.
    """
    dims = [model.dimension(n) for n in (dimensions or model.dimension_names)]
    o = tag_periods(tables, model, spec)
    key = F.col(f"{model.base_alias}.{model.order_key}")
    groups: dict[str | None, list] = {}
    for d in dims:
        path = model.resolve_joins(d.joins)
        fan = next((n for n in path if model.joins[n].fanout), None)
        groups.setdefault(fan, []).append((d, path))
    parts = []
    for fan, members in groups.items():
        names = sorted({n for _, path in members for n in path}, key=list(model.joins).index)
        joined = join_path(o, tables, model, names, how="left", inner=(fan,) if fan else ())
        entries = []
        for d, path in members:
            matched = _and([F.col(model.joins[n].keys[0][0]).isNotNull() for n in path if n != fan])
            entries.append(F.when(matched, F.struct(F.lit(d.name).alias("dimension"),
                                                    F.expr(d.sql).cast("string").alias("segment"))))
        arr = F.filter(F.array(*entries), lambda x: x.isNotNull())
        parts.append(joined.select(key.alias("order_key"), F.explode(arr).alias("e"))
                     .select("order_key", "e.dimension", "e.segment"))
    bridge = reduce(DataFrame.unionByName, parts)
    return bridge.distinct()


def metric_by_dimension(base: DataFrame, bridge: DataFrame, dimensions: list[str]) -> DataFrame:
    """M8: ``(dimension, segment, period, total, n, orders)``.

    An order without a segment row, or with a NULL value, folds into ``(none)``. An order in
    several segments counts fully in each (segment sums may exceed the total).
    """
    expanded = base.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions])))
    joined = expanded.join(bridge, ["order_key", "dimension"], "left")
    return (joined.groupBy("dimension", F.coalesce(F.col("segment"), F.lit(NONE_SEGMENT)).alias("segment"),
                           "period")
            .agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.count(F.lit(1)).alias("orders")))


def within_segment(base: DataFrame, bridge: DataFrame, dimension: str, segment: str) -> DataFrame:
    """M5: keep orders with a row in one segment (``IN`` subquery as a left-semi join)."""
    orders = bridge.filter((F.col("dimension") == dimension) & (F.col("segment") == segment)).select("order_key")
    return base.join(orders, "order_key", "left_semi")


def within_segments(base: DataFrame, bridge: DataFrame, picked: DataFrame) -> DataFrame:
    """M5 for segments given as a (small) DataFrame ``(dimension, segment)``, nothing collected."""
    orders = bridge.join(F.broadcast(picked.select("dimension", "segment")), ["dimension", "segment"], "left_semi")
    return base.join(orders.select("order_key"), "order_key", "left_semi")


def duplicate_counts(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec) -> DataFrame:
    """M9: per table the metric reads, rows and distinct keys per period.

    ``(table_name, period, row_count, distinct_keys)``. Tables without a key are skipped. A composite
    key counts distinct tuples, including tuples with a NULL part.
    """
    o = tag_periods(tables, model, spec, apply_filter=False)
    parts = []
    for name in [model.base_table, *model.resolve_joins(spec.joins)]:
        alias, key = model.key_of(name)
        if not key:
            continue
        df = o if name == model.base_table else join_path(o, tables, model, [name], how="inner")
        cols = [F.col(f"{alias}.{k}") for k in key]
        distinct = F.count_distinct(cols[0]) if len(cols) == 1 else F.count_distinct(F.struct(*cols))
        parts.append(df.groupBy("period").agg(F.count(F.lit(1)).alias("row_count"), distinct.alias("distinct_keys"))
                     .select(F.lit(name).alias("table_name"), "period", "row_count", "distinct_keys"))
    return reduce(DataFrame.unionByName, parts)
