"""Semantic model: which table is the base, how the others join to it, and which dimensions exist.

The model is plain configuration. Expressions (join keys, dimension values, metric values) are
Spark SQL strings over table aliases, resolved with ``F.expr`` against aliased DataFrames, so the
extension point stays "one SQL expression per metric and per dimension".
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Join:
    """How one table joins into the order-level row.

    ``keys`` pairs a column of this table with a column already present (both alias-qualified).
    ``fanout`` marks a child with many rows per parent row (items, payments); such joins are
    planned skew-safely, see ``operators.metric.join_path``.
    """

    name: str
    table: str
    alias: str
    keys: tuple[tuple[str, str], ...]
    requires: tuple[str, ...] = ()
    fanout: bool = False


@dataclass(frozen=True)
class Dimension:
    name: str
    sql: str
    joins: tuple[str, ...] = ()


@dataclass(frozen=True)
class SemanticModel:
    base_table: str
    base_alias: str
    order_key: str
    date_columns: tuple[str, ...]
    keys: dict[str, tuple[str, ...]]
    joins: dict[str, Join]
    dimensions: tuple[Dimension, ...]

    # ---- M2: join-path closure -------------------------------------------------------------
    def resolve_joins(self, names) -> list[str]:
        """The named joins and all that they require, in the order of declaration (parents are declared first)."""
        needed: set[str] = set()
        missing = set(names)
        while missing:
            if strange := missing - set(self.joins):
                raise ValueError(f"joins not in the model: {sorted(strange)}")
            needed |= missing
            missing = {p for n in missing for p in self.joins[n].requires} - needed
        return [n for n in self.joins if n in needed]

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise ValueError(f"unknown dimension {name!r}")

    @property
    def dimension_names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    def key_of(self, table_or_join: str) -> tuple[str, tuple[str, ...]]:
        """(alias, key columns) of the base table or of a join."""
        if table_or_join == self.base_table:
            return self.base_alias, self.keys.get(self.base_table, ())
        j = self.joins[table_or_join]
        return j.alias, self.keys.get(j.table, ())


@dataclass(frozen=True)
class MetricSpec:
    """What to measure: one value per order, aggregated as a total or a per-order average.

    ``value`` is an aggregate SQL expression evaluated per order (``MAX(o.col)`` for order
    columns, ``SUM``/``AVG`` over child rows). It may return NULL to exclude an order.
    """

    name: str
    kind: str  # "total" | "per_order_average"
    value: str
    date_column: str
    period_a: tuple[str, str]
    period_b: tuple[str, str]
    joins: tuple[str, ...] = ()
    filter: str | None = None

    def validate(self, model: SemanticModel) -> None:
        if self.kind not in ("total", "per_order_average"):
            raise ValueError(f"unknown metric kind {self.kind!r}")
        if self.date_column not in model.date_columns:
            raise ValueError(f"metric {self.name!r}: periods can't be taken from {self.date_column!r}, only from {list(model.date_columns)}")
        for start, end in (self.period_a, self.period_b):
            if date.fromisoformat(start) >= date.fromisoformat(end):
                raise ValueError(f"metric {self.name!r}: period {start} to {end} is empty")
        model.resolve_joins(self.joins)


def tpch_model() -> SemanticModel:
    """The star schema of the test tables (orders at the centre)."""
    joins = [
        Join("customer", "customer", "c", (("c.c_custkey", "o.o_custkey"),)),
        Join("lineitem", "lineitem", "l", (("l.l_orderkey", "o.o_orderkey"),), fanout=True),
        Join("part", "part", "p", (("p.p_partkey", "l.l_partkey"),), requires=("lineitem",)),
        Join("supplier", "supplier", "s", (("s.s_suppkey", "l.l_suppkey"),), requires=("lineitem",)),
        Join("cust_nation", "nation", "cn", (("cn.n_nationkey", "c.c_nationkey"),), requires=("customer",)),
        Join("cust_region", "region", "cr", (("cr.r_regionkey", "cn.n_regionkey"),), requires=("cust_nation",)),
        Join("supp_nation", "nation", "sn", (("sn.n_nationkey", "s.s_nationkey"),), requires=("supplier",)),
    ]
    dims = (
        Dimension("customer_nation", "cn.n_name", ("customer", "cust_nation")),
        Dimension("market_segment", "c.c_mktsegment", ("customer",)),
        Dimension("supplier_id", "l.l_suppkey", ("lineitem",)),
        Dimension("supplier_nation", "sn.n_name", ("lineitem", "supplier", "supp_nation")),
        Dimension("part_type", "p.p_type", ("lineitem", "part")),
        Dimension("return_flag", "l.l_returnflag", ("lineitem",)),
        Dimension("order_priority", "o.o_orderpriority", ()),
    )
    return SemanticModel(
        base_table="orders",
        base_alias="o",
        order_key="o_orderkey",
        date_columns=("o_orderdate",),
        keys={
            "orders": ("o_orderkey",),
            "lineitem": ("l_orderkey", "l_linenumber"),
            "customer": ("c_custkey",),
            "part": ("p_partkey",),
            "supplier": ("s_suppkey",),
            "nation": ("n_nationkey",),
            "region": ("r_regionkey",),
        },
        joins={j.name: j for j in joins},
        dimensions=dims,
    )


# Default comparison used by the registered queries: 1998 Q1 (A) against 1998 Q2 (B).
Q1_1998 = ("1998-01-01", "1998-04-01")
Q2_1998 = ("1998-04-01", "1998-07-01")


def catalogue(period_a=Q1_1998, period_b=Q2_1998) -> dict[str, MetricSpec]:
    """Metric catalogue over the test tables (one spec per metric kind of the reference)."""
    d = "o_orderdate"

    def spec(name, kind, value, joins=(), filter=None):
        return MetricSpec(name, kind, value, d, period_a, period_b, tuple(joins), filter)

    return {
        "order_count": spec("order count", "total", "1"),
        "fulfilled_orders": spec("fulfilled orders", "total", "1", filter="o.o_orderstatus = 'F'"),
        "revenue": spec("revenue", "total", "MAX(o.o_totalprice)"),
        "item_revenue": spec("item revenue", "total", "SUM(l.l_extendedprice * (1 - l.l_discount))", ["lineitem"]),
        "item_tax": spec("item tax", "total", "SUM(l.l_extendedprice * l.l_tax)", ["lineitem"]),
        "large_item_rate": spec(
            "large item rate", "per_order_average",
            "MAX(CASE WHEN l.l_orderkey IS NULL THEN NULL WHEN l.l_quantity > 45 THEN 1 ELSE 0 END)", ["lineitem"]),
        "pending_rate": spec("pending rate", "per_order_average",
                             "MAX(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END)"),
        "avg_quantity": spec("average quantity", "per_order_average", "AVG(l.l_quantity)", ["lineitem"]),
        "ship_lag_days": spec("ship lag in days", "per_order_average",
                              "AVG(datediff(l.l_shipdate, o.o_orderdate))", ["lineitem"]),
        "avg_order_value": spec("average order value", "per_order_average", "MAX(o.o_totalprice)"),
    }
