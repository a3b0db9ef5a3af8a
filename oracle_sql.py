"""DuckDB oracle SQL for the registered queries.

In the shape of the per-dimension queries the analysis is defined by: a base CTE per metric, one DISTINCT
segment subquery per dimension, a literal dimension list, and the ranking formulas spelled out in
SQL. Metrics, joins and dimensions are written out here, not taken from the library. Doubles are rounded to 6 places
(candidates to 4) on both sides; ranks are BIGINT.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

# ---- metrics, joins and dimensions, written out ---------------------------------------------------------
PERIOD_A = "(o.o_orderdate >= TIMESTAMP '1998-01-01' AND o.o_orderdate < TIMESTAMP '1998-04-01')"
PERIOD_B = "(o.o_orderdate >= TIMESTAMP '1998-04-01' AND o.o_orderdate < TIMESTAMP '1998-07-01')"
ITEMS = "LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey"


def _metric(kind: str, value: str, items: bool = False, where: str = "") -> SimpleNamespace:
    return SimpleNamespace(kind=kind, value=value, joins=ITEMS if items else "", where=where, tables=["orders", "lineitem"] if items else ["orders"])


AVERAGE = "per_order_average"
METRICS = {
    "order_count": _metric("total", "1"),
    "fulfilled_orders": _metric("total", "1", where="o.o_orderstatus = 'F'"),
    "revenue": _metric("total", "MAX(o.o_totalprice)"),
    "item_revenue": _metric("total", "SUM(l.l_extendedprice * (1 - l.l_discount))", True),
    "item_tax": _metric("total", "SUM(l.l_extendedprice * l.l_tax)", True),
    "large_item_rate": _metric(AVERAGE, "MAX(CASE WHEN l.l_orderkey IS NULL THEN NULL WHEN l.l_quantity > 45 THEN 1 ELSE 0 END)", True),
    "pending_rate": _metric(AVERAGE, "MAX(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END)"),
    "avg_quantity": _metric(AVERAGE, "AVG(l.l_quantity)", True),
    "ship_lag_days": _metric(AVERAGE, "AVG(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)))", True),
    "avg_order_value": _metric(AVERAGE, "MAX(o.o_totalprice)"),
}
TO_CUSTOMER, TO_ITEMS = "JOIN customer c ON c.c_custkey = o.o_custkey", "JOIN lineitem l ON l.l_orderkey = o.o_orderkey"
DIMENSIONS = {
    "customer_nation": ("cn.n_name", f"{TO_CUSTOMER} JOIN nation cn ON cn.n_nationkey = c.c_nationkey"),
    "market_segment": ("c.c_mktsegment", TO_CUSTOMER),
    "supplier_id": ("l.l_suppkey", TO_ITEMS),
    "supplier_nation": ("sn.n_name", f"{TO_ITEMS} JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey"),
    "part_type": ("p.p_type", f"{TO_ITEMS} JOIN part p ON p.p_partkey = l.l_partkey"),
    "return_flag": ("l.l_returnflag", TO_ITEMS),
    "order_priority": ("o.o_orderpriority", ""),
}


def base_cte(spec: SimpleNamespace, orders: str = "orders", lineitem: str = "lineitem") -> str:
    where = f"({PERIOD_A} OR {PERIOD_B})" + (f" AND ({spec.where})" if spec.where else "")
    joins = spec.joins.replace("lineitem l ON", f"{lineitem} l ON")
    return (f"base AS (SELECT o.o_orderkey AS order_key, CASE WHEN {PERIOD_B} THEN 'B' ELSE 'A' END AS period, "
            f"CAST({spec.value} AS DOUBLE) AS v FROM {orders} o {joins} WHERE {where} GROUP BY 1, 2)")


def seg_cte(dims: list[str], orders: str = "orders", lineitem: str = "lineitem") -> str:
    parts = []
    for name in dims:
        sql, joins = DIMENSIONS[name]
        joins = joins.replace("lineitem l ON", f"{lineitem} l ON")
        parts.append(f"SELECT DISTINCT b.order_key, '{name}' AS dimension, CAST({sql} AS VARCHAR) AS segment "
                     f"FROM base b JOIN {orders} o ON o.o_orderkey = b.order_key {joins}")
    return "seg AS (" + " UNION ALL ".join(parts) + ")"


def dims_cte(dims: list[str]) -> str:
    rows = ", ".join(f"('{d}', {i + 1})" for i, d in enumerate(dims))
    return f"dims(dimension, dim_order) AS (VALUES {rows})"


def bydim_cte(name: str = "bydim", base: str = "base") -> str:
    return (f"{name} AS (SELECT d.dimension, COALESCE(s.segment, '(none)') AS segment, b.period, "
            f"SUM(b.v) AS total, COUNT(b.v) AS n, COUNT(*) AS orders FROM {base} b CROSS JOIN dims d "
            f"LEFT JOIN seg s ON s.order_key = b.order_key AND s.dimension = d.dimension GROUP BY 1, 2, 3)")


def _sum_when(p: str, c: str) -> str:
    return f"COALESCE(SUM(CASE WHEN period = '{p}' THEN {c} END), 0)"


def change_cte(kind: str, name: str = "chg", src: str = "totals", by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    if kind == "total":
        va, vb = _sum_when("A", "total"), _sum_when("B", "total")
    else:
        va = f"CASE WHEN {_sum_when('A', 'n')} <> 0 THEN {_sum_when('A', 'total')} / {_sum_when('A', 'n')} ELSE 0 END"
        vb = f"CASE WHEN {_sum_when('B', 'n')} <> 0 THEN {_sum_when('B', 'total')} / {_sum_when('B', 'n')} ELSE 0 END"
    return (f"{name} AS (SELECT {sel_by}value_a, value_b, value_b - value_a AS delta, "
            f"CASE WHEN value_a <> 0 THEN (value_b - value_a) / value_a * 100 END AS pct_change FROM "
            f"(SELECT {sel_by}CAST({va} AS DOUBLE) AS value_a, CAST({vb} AS DOUBLE) AS value_b FROM {src}{grp}))")


def pivot_cte(name: str = "piv", src: str = "bydim") -> str:
    cols = ", ".join(f"CAST({_sum_when(p, m)} AS DOUBLE) AS {m}_{p.lower()}" for m in ("total", "n") for p in "AB")
    return f"{name} AS (SELECT dimension, segment, {cols} FROM {src} GROUP BY 1, 2)"


def ranked_cte(kind: str, name: str = "ranked", piv: str = "piv", overall: str = "ovr") -> str:
    """``overall`` is a relation (dimension, overall_delta)."""
    if kind == "total":
        inner = (f"SELECT p.*, p.total_a AS value_a, p.total_b AS value_b, p.total_b - p.total_a AS delta, "
                 f"(CASE WHEN s.sa <> 0 THEN p.total_a / s.sa ELSE 0 END) * s.sd AS expected_delta "
                 f"FROM {piv} p JOIN (SELECT dimension, SUM(total_a) AS sa, SUM(total_b - total_a) AS sd "
                 f"FROM {piv} GROUP BY 1) s USING (dimension)")
        ab = "delta - expected_delta"
    else:
        inner = (f"SELECT *, weight_b - weight_a AS dw, rate_b - rate_a AS dr FROM ("
                 f"SELECT p.*, CASE WHEN s.sa <> 0 THEN p.n_a / s.sa END AS weight_a, "
                 f"CASE WHEN s.sb <> 0 THEN p.n_b / s.sb END AS weight_b, "
                 f"CASE WHEN p.n_a <> 0 THEN p.total_a / p.n_a ELSE 0 END AS rate_a, "
                 f"CASE WHEN p.n_b <> 0 THEN p.total_b / p.n_b ELSE 0 END AS rate_b "
                 f"FROM {piv} p JOIN (SELECT dimension, SUM(n_a) AS sa, SUM(n_b) AS sb FROM {piv} GROUP BY 1) s "
                 f"USING (dimension))")
        inner = (f"SELECT *, rate_a AS value_a, rate_b AS value_b, rate_b - rate_a AS delta, dw * rate_a AS mix_effect, "
                 f"weight_a * dr AS rate_effect, dw * dr AS interaction FROM ({inner})")
        ab = "rate_effect + interaction"
    return (f"{name} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY abs(abnormal) DESC NULLS LAST, "
            f"segment) AS rank_in_dimension FROM (SELECT x.*, {ab} AS abnormal, "
            f"CASE WHEN COALESCE(o.overall_delta, 0) <> 0 THEN ({ab}) / o.overall_delta ELSE 0 END AS share_of_change "
            f"FROM ({inner}) x JOIN {overall} o USING (dimension)))")


def candidates_cte(name: str = "cand", ranked: str = "ranked") -> str:
    return (f"{name} AS (SELECT *, ROW_NUMBER() OVER (ORDER BY abs(share_of_change) DESC NULLS LAST, dim_order, "
            f"rank_in_dimension) AS candidate_rank FROM (SELECT r.dimension, r.segment, round_even(r.value_a, 4) AS value_a, "
            f"round_even(r.value_b, 4) AS value_b, round_even(r.delta, 4) AS change, round_even(r.abnormal, 4) AS abnormal_change, "
            f"round_even(r.share_of_change, 4) AS share_of_change, d.dim_order, r.rank_in_dimension "
            f"FROM {ranked} r JOIN dims d USING (dimension) WHERE r.rank_in_dimension <= 3 AND r.segment <> '(none)'))")


def analysis_ctes(spec: SimpleNamespace, orders: str = "orders", lineitem: str = "lineitem") -> str:
    dims = [*DIMENSIONS]
    return ",\n".join([
        base_cte(spec, orders, lineitem), dims_cte(dims), seg_cte(dims, orders, lineitem),
        bydim_cte(),
        "totals AS (SELECT period, SUM(v) AS total, COUNT(v) AS n, COUNT(*) AS orders FROM base GROUP BY period)",
        change_cte(spec.kind), pivot_cte(),
        "ovr AS (SELECT d.dimension, c.delta AS overall_delta FROM dims d CROSS JOIN chg c)",
        ranked_cte(spec.kind), candidates_cte(),
    ])


def drill_ctes(kind: str) -> str:
    return ",\n".join([
        "top1 AS (SELECT dimension, segment FROM cand WHERE candidate_rank = 1)",
        "subbase AS (SELECT * FROM base WHERE order_key IN (SELECT s.order_key FROM seg s JOIN top1 t "
        "ON s.dimension = t.dimension AND s.segment = t.segment))",
        bydim_cte("bydim2", "subbase").replace("GROUP BY 1, 2, 3)",
                                               "WHERE d.dimension NOT IN (SELECT dimension FROM top1) GROUP BY 1, 2, 3)"),
        change_cte(kind, "chg2", "bydim2", by="dimension"),
        pivot_cte("piv2", "bydim2"),
        "ovr2 AS (SELECT dimension, delta AS overall_delta FROM chg2)",
        ranked_cte(kind, "ranked2", "piv2", "ovr2"),
        "drill AS (SELECT r.dimension, r.segment, r.value_a, r.value_b, r.share_of_change AS share_of_change_within, "
        "ROW_NUMBER() OVER (ORDER BY abs(r.share_of_change) DESC NULLS LAST, d.dim_order) AS drill_rank "
        "FROM ranked2 r JOIN dims d USING (dimension) WHERE r.rank_in_dimension = 1 AND r.segment <> '(none)')",
    ])


R6 = "round({0}, 6) AS {0}"


def r6(*cols: str) -> str:
    return ", ".join(R6.format(c) for c in cols)


def metric_totals_sql(key: str) -> str:
    spec = METRICS[key]
    return (f"WITH {base_cte(spec)} SELECT period, round(SUM(v), 6) AS total, COUNT(v) AS n, "
            f"COUNT(*) AS orders FROM base GROUP BY period")


def ranked_sql(key: str, **kw) -> str:
    spec = METRICS[key]
    extra = ", " + r6("mix_effect", "rate_effect", "interaction") if spec.kind != "total" else ""
    return (f"WITH {analysis_ctes(spec, **kw)} SELECT dimension, segment, "
            f"{r6('value_a', 'value_b', 'delta', 'abnormal', 'share_of_change')}{extra}, "
            f"CAST(rank_in_dimension AS BIGINT) AS rank_in_dimension FROM ranked")


def candidates_sql(key: str, **kw) -> str:
    spec = METRICS[key]
    return (f"WITH {analysis_ctes(spec, **kw)} SELECT dimension, segment, value_a, value_b, change, "
            f"abnormal_change, share_of_change, CAST(candidate_rank AS BIGINT) AS candidate_rank FROM cand")


def drill_sql(key: str, **kw) -> str:
    spec = METRICS[key]
    return (f"WITH {analysis_ctes(spec, **kw)},\n{drill_ctes(spec.kind)} SELECT dimension, segment, "
            f"{r6('value_a', 'value_b', 'share_of_change_within')}, CAST(drill_rank AS BIGINT) AS drill_rank "
            f"FROM drill WHERE drill_rank <= 3")


def change_sql(key: str) -> str:
    spec = METRICS[key]
    return (f"WITH {base_cte(spec)}, "
            "totals AS (SELECT period, SUM(v) AS total, COUNT(v) AS n FROM base GROUP BY period), "
            f"{change_cte(spec.kind)} SELECT {r6('value_a', 'value_b', 'delta', 'pct_change')} FROM chg")


def tag_periods_sql() -> str:
    a, b = PERIOD_A, PERIOD_B
    return f"SELECT o.o_orderkey, CASE WHEN {b} THEN 'B' ELSE 'A' END AS period FROM orders o WHERE {a} OR {b}"


def base_sql(key: str) -> str:
    spec = METRICS[key]
    return f"WITH {base_cte(spec)} SELECT order_key, period, round(v, 6) AS v FROM base"


def within_segment_sql() -> str:
    spec = METRICS["revenue"]
    return (f"WITH {base_cte(spec)} SELECT order_key, period, round(v, 6) AS v FROM base "
            "WHERE order_key IN (SELECT o.o_orderkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey "
            "WHERE CAST(c.c_mktsegment AS VARCHAR) = 'AUTOMOBILE')")


def bridge_sql() -> str:
    spec = METRICS["item_revenue"]
    return (f"WITH {base_cte(spec)}, {seg_cte([*DIMENSIONS])} "
            "SELECT order_key, dimension, segment FROM seg")


def by_dimension_sql(key: str) -> str:
    spec = METRICS[key]
    dims = [*DIMENSIONS]
    return (f"WITH {base_cte(spec)}, {dims_cte(dims)}, {seg_cte(dims)}, {bydim_cte()} "
            "SELECT dimension, segment, period, round(total, 6) AS total, n, orders FROM bydim")


def dup_counts_sql(key: str, lineitem: str = "lineitem", prefix: str = "") -> str:
    a, b = PERIOD_A, PERIOD_B
    per = f"CASE WHEN {b} THEN 'B' ELSE 'A' END"
    return (f"{prefix}SELECT 'orders' AS table_name, {per} AS period, COUNT(*) AS row_count, "
            f"COUNT(DISTINCT o.o_orderkey) AS distinct_keys FROM orders o WHERE {a} OR {b} GROUP BY 2 "
            f"UNION ALL SELECT 'lineitem' AS table_name, {per} AS period, COUNT(*) AS row_count, "
            f"COUNT(DISTINCT row(l.l_orderkey, l.l_linenumber)) AS distinct_keys FROM orders o "
            f"JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE {a} OR {b} GROUP BY 2")


def planted_dup_cte(key: str) -> str:
    b = PERIOD_B
    return (f"lineitem_dup AS (SELECT * FROM lineitem UNION ALL SELECT l.* FROM lineitem l "
            f"WHERE l.l_orderkey % 10 = 0 AND l.l_orderkey IN (SELECT o.o_orderkey FROM orders o WHERE {b}))")


def dup_findings_sql(key: str) -> str:
    counts = dup_counts_sql(key, "lineitem_dup")
    rate = "CASE WHEN row_count <> 0 THEN CAST(row_count - distinct_keys AS DOUBLE) / row_count ELSE 0 END"
    return (f"WITH {planted_dup_cte(key)}, cnt AS ({counts}), r AS (SELECT table_name, "
            f"COALESCE(MAX(CASE WHEN period = 'A' THEN {rate} END), 0) AS duplicate_rate_a, "
            f"COALESCE(MAX(CASE WHEN period = 'B' THEN {rate} END), 0) AS duplicate_rate_b FROM cnt GROUP BY 1) "
            f"SELECT table_name, {r6('duplicate_rate_a', 'duplicate_rate_b')}, "
            f"round(duplicate_rate_b - duplicate_rate_a, 6) AS increase FROM r "
            f"WHERE duplicate_rate_b - duplicate_rate_a > 0.005")


def pivot_sql(key: str) -> str:
    spec = METRICS[key]
    return (f"WITH {analysis_ctes(spec)} SELECT dimension, segment, "
            f"{r6('total_a', 'total_b', 'n_a', 'n_b')} FROM piv")


def contributions_sql() -> str:
    spec = METRICS["order_count"]
    return (f"WITH {analysis_ctes(spec)}, x AS (SELECT *, total_b - total_a AS delta, "
            "SUM(total_b - total_a) OVER (PARTITION BY dimension) AS td FROM piv) "
            "SELECT dimension, segment, round(total_a, 6) AS total_a, round(total_b, 6) AS total_b, "
            "round(delta, 6) AS delta, round(CASE WHEN td <> 0 THEN delta / td ELSE 0 END, 6) AS share_of_change, "
            "round(CASE WHEN total_a <> 0 THEN delta / total_a * 100 END, 6) AS pct_change FROM x")


def _mix_cte() -> str:
    return ("mix AS (SELECT *, (weight_b - weight_a) * rate_a AS mix_effect, weight_a * (rate_b - rate_a) AS rate_effect, "
            "(weight_b - weight_a) * (rate_b - rate_a) AS interaction FROM (SELECT p.*, "
            "CASE WHEN s.sa <> 0 THEN p.n_a / s.sa END AS weight_a, CASE WHEN s.sb <> 0 THEN p.n_b / s.sb END AS weight_b, "
            "CASE WHEN p.n_a <> 0 THEN p.total_a / p.n_a ELSE 0 END AS rate_a, "
            "CASE WHEN p.n_b <> 0 THEN p.total_b / p.n_b ELSE 0 END AS rate_b FROM piv p JOIN "
            "(SELECT dimension, SUM(n_a) AS sa, SUM(n_b) AS sb FROM piv GROUP BY 1) s USING (dimension)))")


def mix_segments_sql() -> str:
    spec = METRICS["large_item_rate"]
    return (f"WITH {analysis_ctes(spec)}, {_mix_cte()} SELECT dimension, segment, "
            f"{r6('weight_a', 'weight_b', 'rate_a', 'rate_b', 'mix_effect', 'rate_effect', 'interaction')}, "
            "round(mix_effect + rate_effect + interaction, 6) AS total_effect FROM mix")


def mix_summary_sql() -> str:
    spec = METRICS["large_item_rate"]
    return (f"WITH {analysis_ctes(spec)}, {_mix_cte()}, x AS (SELECT dimension, "
            "CASE WHEN SUM(n_a) <> 0 THEN SUM(total_a) / SUM(n_a) END AS rate_a, "
            "CASE WHEN SUM(n_b) <> 0 THEN SUM(total_b) / SUM(n_b) END AS rate_b, SUM(mix_effect) AS mix_effect, "
            "SUM(rate_effect) AS rate_effect, SUM(interaction) AS interaction FROM mix GROUP BY 1) "
            f"SELECT dimension, {r6('rate_a', 'rate_b', 'mix_effect', 'rate_effect', 'interaction')}, "
            "round(rate_b - rate_a, 6) AS delta FROM x")


def merged_sql(key: str, planted: bool) -> str:
    """Findings first (table order: orders, then the metric's joins), then candidates; top 5."""
    spec = METRICS[key]
    li = "lineitem_dup" if planted else "lineitem"
    pre = planted_dup_cte(key) + ",\n" if planted else ""
    rate = "CASE WHEN row_count <> 0 THEN CAST(row_count - distinct_keys AS DOUBLE) / row_count ELSE 0 END"
    tables = spec.tables
    order = "CASE table_name " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(tables)) + " END"
    return (f"WITH {pre}{analysis_ctes(spec, lineitem=li)},\n"
            f"cnt AS ({dup_counts_sql(key, li)}),\n"
            f"rates AS (SELECT table_name, COALESCE(MAX(CASE WHEN period = 'A' THEN {rate} END), 0) AS ra, "
            f"COALESCE(MAX(CASE WHEN period = 'B' THEN {rate} END), 0) AS rb FROM cnt GROUP BY 1),\n"
            f"finds AS (SELECT * FROM rates WHERE rb - ra > 0.005),\n"
            f"merged AS (SELECT 'data_quality' AS dimension, table_name AS segment, CAST(NULL AS DOUBLE) AS share_of_change, "
            f"rb AS duplicate_rate_b, 0 AS grp, {order} AS pos FROM finds UNION ALL SELECT dimension, segment, "
            f"share_of_change, CAST(NULL AS DOUBLE), 1, candidate_rank FROM cand),\n"
            f"ranked_all AS (SELECT *, ROW_NUMBER() OVER (ORDER BY grp, pos) AS rank FROM merged),\n"
            f"conf AS (SELECT CASE WHEN (SELECT COUNT(*) FROM finds) > 0 THEN 'high' "
            f"WHEN (SELECT pct_change FROM chg) IS NOT NULL AND abs((SELECT pct_change FROM chg)) < 2 "
            f"THEN 'no_significant_change' WHEN (SELECT COUNT(*) FROM cand) = 0 THEN 'low' "
            f"WHEN (SELECT abs(share_of_change) FROM cand WHERE candidate_rank = 1) >= 0.5 THEN 'high' "
            f"WHEN (SELECT abs(share_of_change) FROM cand WHERE candidate_rank = 1) >= 0.25 THEN 'medium' "
            f"ELSE 'low' END AS confidence)\n")


def investigate_sql(key: str, planted: bool = False) -> str:
    return (merged_sql(key, planted) + "SELECT CAST(rank AS BIGINT) AS rank, dimension, segment, "
            f"{r6('share_of_change', 'duplicate_rate_b')} FROM ranked_all WHERE rank <= 5")


def confidence_sql(key: str, planted: bool = False) -> str:
    return (merged_sql(key, planted) + "SELECT confidence, CASE confidence WHEN 'low' THEN 'insufficient_evidence' "
            "WHEN 'no_significant_change' THEN 'no_significant_change' ELSE 'ok' END AS status FROM conf")


ALL_METRICS = ["order_count", "fulfilled_orders", "revenue", "item_revenue", "item_tax", "large_item_rate",
               "pending_rate", "avg_quantity", "ship_lag_days", "avg_order_value"]


BIG = "1e5"    # from this magnitude on, values are compared at 4 places (float summation noise)
HUGE = "1e15"  # and from this one on as they are (no fraction left to round)


def _plus_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)`` so a negative zero prints as 0.0, and
    compare large values at 4 places, as ``finish`` does on the Spark side."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        span = sql[j:k + 1]
        if span.endswith(", 6)"):
            inner = span[len("round("):-len(", 6)")]
            span = (f"CASE WHEN abs({inner}) >= {HUGE} THEN {inner} WHEN abs({inner}) >= {BIG} THEN round({inner}, 4) "
                    f"ELSE round({inner}, 6) END")
        out.append("(" + span + " + 0.0)")
        i = k + 1


def all_oracles() -> dict[str, str]:
    return {k: _plus_zero(v) for k, v in _all_oracles().items()}


def _all_oracles() -> dict[str, str]:
    q = {
        "m1_tag_periods": tag_periods_sql(),
        "m3_base_item_revenue": base_sql("item_revenue"),
        "m5_within_segment_revenue": within_segment_sql(),
        "m7_segment_bridge": bridge_sql(),
        "m8_by_dimension_revenue": by_dimension_sql("revenue"),
        "m8_by_dimension_item_tax": by_dimension_sql("item_tax"),
        "m9_duplicate_counts_item_revenue": dup_counts_sql("item_revenue"),
        "a2_change_revenue": change_sql("revenue"),
        "a2_change_pending_rate": change_sql("pending_rate"),
        "a3_pivot_avg_quantity": pivot_sql("avg_quantity"),
        "a4_contributions_order_count": contributions_sql(),
        "a5_ranked_order_count": ranked_sql("order_count"),
        "a5_ranked_item_revenue": ranked_sql("item_revenue"),
        "a6_mix_rate_segments_large_item_rate": mix_segments_sql(),
        "a7_mix_rate_summary_large_item_rate": mix_summary_sql(),
        "a8_ranked_large_item_rate": ranked_sql("large_item_rate"),
        "a8_ranked_ship_lag_days": ranked_sql("ship_lag_days"),
        "a11_drill_down_order_count": drill_sql("order_count"),
        "a11_drill_down_large_item_rate": drill_sql("large_item_rate"),
        "a12_duplicate_findings_planted": dup_findings_sql("item_revenue"),
        "m9_duplicate_counts_planted": dup_counts_sql("item_revenue", "lineitem_dup",
                                                      f"WITH {planted_dup_cte('item_revenue')} "),
        "a15_investigate_order_count": investigate_sql("order_count"),
        "a15_investigate_planted_duplicates": investigate_sql("item_revenue", planted=True),
        "a14_confidence_order_count": confidence_sql("order_count"),
        "a14_confidence_planted_duplicates": confidence_sql("item_revenue", planted=True),
    }
    for key in ALL_METRICS:
        q[f"m6_totals_{key}"] = metric_totals_sql(key)
        q[f"a10_candidates_{key}"] = candidates_sql(key)
    q.update(retrieval_oracles())
    q.update(more_oracles())
    q.update(runlog_oracles())
    q.update(audit_oracles())
    q.update(profile_oracles())
    return q


# ---- retrieval ----------------------------------------------------------------------------------
WS = r"^\s+|\s+$"
FM = r"^---[ \t\f\r\x0B]*\n([\s\S]*?)\n---[ \t\f\r\x0B]*\n"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def front_matter_sql(prefix: str = "") -> str:
    fm = FM.replace("\\x0B", "\\v")

    def field(name):
        v = f"regexp_extract(block, '(?m)^{name}[ \\t]*:[ \\t]*(.*?)[ \\t]*$', 1)"
        v = f"""regexp_replace({v}, '^"(.*)"$|^''(.*)''$', '\\1\\2')"""
        return f"NULLIF({v}, '')"

    return (f"WITH raw AS (SELECT '{prefix}' || CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || "
            f"'title: ' || source || ' ' || CAST(doc_id AS VARCHAR) || chr(10) || 'date: ' || "
            f"strftime(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') || chr(10) || 'type: note' || "
            f"chr(10) || '---' || chr(10) || text ELSE text END AS raw FROM documents), "
            f"p AS (SELECT doc_id, CASE WHEN regexp_matches(raw, '{fm}') THEN regexp_extract(raw, '{fm}', 1) ELSE '' END "
            f"AS block, CASE WHEN regexp_matches(raw, '{fm}') THEN regexp_replace(raw, '{fm}', '') ELSE raw END AS body "
            f"FROM raw) SELECT doc_id, COALESCE({field('title')}, replace(doc_id, '_', ' ')) AS title, "
            f"COALESCE({field('type')}, 'document') AS doc_type, TRY_CAST({field('date')} AS DATE) AS doc_date, "
            f"CAST(length({_strip('body')}) AS BIGINT) AS body_chars, md5({_strip('body')}) AS body_md5 FROM p")


def chunks_ctes(max_chars: int = 900) -> str:
    """Dated corpus, lines as paragraphs, greedy packing by a recursive CTE."""
    return (
        "docs AS (SELECT lang AS dataset, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL "
        "ELSE CAST(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS doc_date, "
        f"list_filter(list_transform(string_split({_strip('text')}, chr(10)), lambda x: {_strip('x')}), "
        "lambda x: x <> '') AS paras FROM documents),\n"
        "paras AS (SELECT dataset, doc_id, unnest(paras) AS p, generate_subscripts(paras, 1) AS i FROM docs),\n"
        "rec AS (SELECT dataset, doc_id, 1 AS i, 0 AS chunk_no, p AS cur, CAST(NULL AS VARCHAR) AS emitted "
        "FROM paras WHERE i = 1 UNION ALL SELECT r.dataset, r.doc_id, r.i + 1, "
        f"CASE WHEN length(r.cur) + length(p.p) + 1 > {max_chars} THEN r.chunk_no + 1 ELSE r.chunk_no END, "
        f"CASE WHEN length(r.cur) + length(p.p) + 1 > {max_chars} THEN p.p ELSE r.cur || chr(10) || p.p END, "
        f"CASE WHEN length(r.cur) + length(p.p) + 1 > {max_chars} THEN r.cur END "
        "FROM rec r JOIN paras p ON p.dataset = r.dataset AND p.doc_id = r.doc_id AND p.i = r.i + 1),\n"
        "chunks AS (SELECT c.*, d.doc_date FROM (SELECT dataset, doc_id, chunk_no - 1 AS chunk_no, emitted AS text "
        "FROM rec WHERE emitted IS NOT NULL UNION ALL SELECT dataset, doc_id, chunk_no, cur FROM (SELECT *, "
        "ROW_NUMBER() OVER (PARTITION BY dataset, doc_id ORDER BY i DESC) AS rn FROM rec) WHERE rn = 1) c "
        "JOIN docs d USING (dataset, doc_id))")


def chunks_sql() -> str:
    return (f"WITH RECURSIVE {chunks_ctes()} SELECT dataset, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, doc_date, "
            "CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM chunks")


def tokens_sql() -> str:
    t = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
    return (f"SELECT doc_id, CAST(len({t}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({t})) AS BIGINT) AS n_distinct "
            "FROM documents")


def hash_embed_sql() -> str:
    return ("SELECT doc_id, CAST(('0x' || right(md5(t), 2)) AS INTEGER)::BIGINT AS bucket, "
            "CAST(COUNT(*) AS DOUBLE) AS weight FROM (SELECT doc_id, "
            "unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY 1, 2")


def cosine_centroid_sql(top: int = 5) -> str:
    return ("WITH parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i "
            "FROM embeddings), cen AS (SELECT label, i, AVG(x) AS m FROM parts GROUP BY 1, 2), "
            "dots AS (SELECT p.vec_id, p.label, SUM(CAST(p.x AS DOUBLE) * c.m) AS d, "
            "sqrt(SUM(CAST(p.x AS DOUBLE) * CAST(p.x AS DOUBLE))) AS nv, sqrt(SUM(c.m * c.m)) AS nq "
            "FROM parts p JOIN cen c ON c.label = p.label AND c.i = p.i GROUP BY 1, 2), "
            "sc AS (SELECT vec_id, label, d / CASE WHEN nv * CASE WHEN nq = 0 THEN 1 ELSE nq END = 0 THEN 1 "
            "ELSE nv * CASE WHEN nq = 0 THEN 1 ELSE nq END END AS cosine FROM dots) "
            "SELECT label, vec_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER "
            f"(PARTITION BY label ORDER BY cosine DESC, vec_id) AS BIGINT) AS rank FROM sc) WHERE rank <= {top}")


def _bm25_ctes(corpus: str, queries: str) -> str:
    """BM25 over ``corpus(win, doc_id, chunk_no, text)`` for ``queries(query_id, qtext, win)``, statistics per win."""
    return (
        f"corp AS (SELECT win, doc_id, chunk_no, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tok FROM {corpus}),\n"
        "st AS (SELECT win, COUNT(*) AS n, SUM(len(tok)) / COUNT(*) AS avgdl FROM corp GROUP BY 1),\n"
        "dfq AS (SELECT win, term, COUNT(*) AS df FROM (SELECT win, unnest(list_distinct(tok)) AS term FROM corp) GROUP BY 1, 2),\n"
        "idf0 AS (SELECT win, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfq JOIN st USING (win)),\n"
        "mean_idf AS (SELECT win, AVG(idf) AS m FROM idf0 GROUP BY 1),\n"
        "idf AS (SELECT win, term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf0 JOIN mean_idf USING (win)),\n"
        f"qt AS (SELECT query_id, win, unnest(regexp_extract_all(lower(qtext), '[a-z0-9_]+')) AS term FROM {queries}),\n"
        "tf AS (SELECT win, doc_id, chunk_no, term, len(tok) AS dl, COUNT(*) AS tf FROM (SELECT win, doc_id, chunk_no, tok, "
        "unnest(tok) AS term FROM corp) GROUP BY win, doc_id, chunk_no, term, len(tok)),\n"
        "bm AS (SELECT qt.query_id, tf.doc_id, tf.chunk_no, SUM(COALESCE(idf.idf, 0) * (tf.tf * 2.5) / "
        "(tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / st.avgdl))) AS bm25 FROM qt JOIN tf USING (win, term) "
        "LEFT JOIN idf USING (win, term) JOIN st USING (win) GROUP BY 1, 2, 3)")


def bm25_top_sql(top: int = 10) -> str:
    return (f"WITH RECURSIVE {chunks_ctes()},\nallc AS (SELECT 0 AS win, doc_id, chunk_no, text FROM chunks),\n"
            "qs AS (SELECT item_id AS query_id, text AS qtext, 0 AS win FROM benchmark),\n"
            f"{_bm25_ctes('allc', 'qs')} SELECT query_id, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, "
            "round(round(bm25, 9), 6) AS bm25, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY "
            f"round(bm25, 9) DESC, doc_id, chunk_no) AS BIGINT) AS rank FROM bm) WHERE rank <= {top}")


WINDOW_LO, WINDOW_HI = "1998-03-12", "1998-07-21"  # search window 1998-04-01 .. 1998-07-01 with 20 days margin


def within_window_sql() -> str:
    return (f"WITH RECURSIVE {chunks_ctes()} SELECT dataset, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, doc_date "
            f"FROM chunks WHERE doc_date IS NULL OR (doc_date >= DATE '{WINDOW_LO}' AND doc_date <= DATE '{WINDOW_HI}')")


def search_ctes(k: int = 3) -> str:
    """``hits`` with the text and date of each hit, for ``qs(query_id, qtext, ds, lo, hi, win)`` over ``chunks``."""
    emb = ("SELECT {key}, CAST(('0x' || right(md5(t), 2)) AS INTEGER) AS b, COUNT(*) AS c FROM (SELECT {key}, "
           "unnest(regexp_extract_all(lower({col}), '[a-z0-9]+')) AS t FROM {src}) GROUP BY ALL")
    one = "(CASE WHEN COALESCE(qn.nrm, 0) = 0 THEN 1 ELSE qn.nrm END)"
    return (
        "wins AS (SELECT DISTINCT win, ds, lo, hi FROM qs),\n"
        "wc AS (SELECT win, doc_id, chunk_no, text, doc_date FROM chunks JOIN wins ON dataset = ds AND (doc_date IS NULL OR "
        "((lo IS NULL OR doc_date >= lo) AND (hi IS NULL OR doc_date <= hi)))),\n"
        f"{_bm25_ctes('wc', 'qs')},\n"
        f"ce AS ({emb.format(key='doc_id, chunk_no', col='text', src='chunks')}),\n"
        f"qe AS ({emb.format(key='query_id', col='qtext', src='qs')}),\n"
        "cnr AS (SELECT doc_id, chunk_no, sqrt(SUM(CAST(c * c AS DOUBLE))) AS nrm FROM ce GROUP BY 1, 2),\n"
        "qn AS (SELECT query_id, sqrt(SUM(CAST(c * c AS DOUBLE))) AS nrm FROM qe GROUP BY 1),\n"
        "dt AS (SELECT qe.query_id, ce.doc_id, ce.chunk_no, SUM(CAST(ce.c * qe.c AS DOUBLE)) AS d FROM ce JOIN qe "
        "USING (b) GROUP BY 1, 2, 3),\n"
        "pairs AS (SELECT q.query_id, w.doc_id, w.chunk_no, w.doc_date, w.text, COALESCE(bm.bm25, 0) AS bm25, "
        f"COALESCE(dt.d, 0) / CASE WHEN COALESCE(cnr.nrm, 0) * {one} = 0 THEN 1 ELSE COALESCE(cnr.nrm, 0) * {one} END AS cos "
        "FROM qs q JOIN wc w ON w.win = q.win LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = w.doc_id "
        "AND bm.chunk_no = w.chunk_no LEFT JOIN dt ON dt.query_id = q.query_id AND dt.doc_id = w.doc_id AND "
        "dt.chunk_no = w.chunk_no LEFT JOIN cnr ON cnr.doc_id = w.doc_id AND cnr.chunk_no = w.chunk_no "
        "LEFT JOIN qn ON qn.query_id = q.query_id),\n"
        "rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id, chunk_no) "
        "AS rank_bm25, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, doc_id, chunk_no) "
        "AS rank_cos FROM pairs),\n"
        "fu AS (SELECT *, 1.0 / (60 + rank_bm25) + 1.0 / (60 + rank_cos) AS score FROM rk),\n"
        "hits AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS hit_rank "
        f"FROM fu) WHERE hit_rank <= {k})")


def search_sql() -> str:
    return (
        f"WITH RECURSIVE {chunks_ctes()},\n"
        "qs AS (SELECT *, ds || kind AS win FROM (SELECT item_id AS query_id, text AS qtext, "
        "['de', 'en', 'es', 'fr'][CAST(item_id % 4 + 1 AS INTEGER)] AS ds, CAST(item_id % 3 AS VARCHAR) AS kind, "
        f"CASE WHEN item_id % 3 < 2 THEN DATE '{WINDOW_LO}' END AS lo, CASE WHEN item_id % 3 = 0 THEN DATE '{WINDOW_HI}' END AS hi "
        f"FROM benchmark)),\n{search_ctes()}\n"
        "SELECT query_id, CAST(hit_rank AS BIGINT) AS hit_rank, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, doc_date, "
        "round(score, 4) AS score, CAST(rank_bm25 AS BIGINT) AS rank_bm25, CAST(rank_cos AS BIGINT) AS rank_cos FROM hits")


def context_ctes(key: str, top: str) -> str:
    """``hits`` for the question about metric ``key``; ``top`` is a relation (dimension, segment) of one row."""
    return (f"{chunks_ctes()},\nqs AS (SELECT 'ctx' AS query_id, '{key.replace('_', ' ')} ' || dimension || ' ' || segment || "
            f"' why did the metric change' AS qtext, 'en' AS ds, DATE '{WINDOW_LO}' AS lo, DATE '{WINDOW_HI}' AS hi, 'w' AS win FROM {top}),\n"
            f"{search_ctes()}")


DOCUMENT = ("'D' || hit_rank AS doc_ref, doc_id, replace(doc_id, '_', ' ') AS title, 'document' AS type, doc_date AS date, "
            "substr(text, 1, 500) AS excerpt, CAST(hit_rank AS BIGINT) AS hit_rank")


def find_context_sql(key: str = "order_count") -> str:
    spec = METRICS[key]
    return (f"WITH RECURSIVE {analysis_ctes(spec)},\nfirst_one AS (SELECT dimension, segment FROM cand WHERE candidate_rank = 1),\n"
            f"{context_ctes(key, 'first_one')}\nSELECT {DOCUMENT} FROM hits")


def rrf_sql(k: int = 5) -> str:
    return ("WITH e AS (SELECT label, vec_id, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS long, "
            "CAST(embedding[1] AS DOUBLE) AS first FROM embeddings),\n"
            "r AS (SELECT label AS query_id, vec_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY round(long, 6) DESC, vec_id) AS a, "
            "ROW_NUMBER() OVER (PARTITION BY label ORDER BY round(first, 6) DESC, vec_id) AS b FROM e),\n"
            "f AS (SELECT query_id, vec_id, 1.0 / (60 + a) + 1.0 / (60 + b) AS score FROM r)\n"
            "SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, hit_rank FROM (SELECT *, CAST(ROW_NUMBER() OVER "
            f"(PARTITION BY query_id ORDER BY score DESC, vec_id) AS BIGINT) AS hit_rank FROM f) WHERE hit_rank <= {k}")


def chunk_store_sql() -> str:
    ctes = chunks_ctes().replace("> 900 THEN", "> (CASE WHEN r.dataset = 'en' THEN 400 ELSE 900 END) THEN")
    return (f"WITH RECURSIVE {ctes} SELECT dataset, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, doc_date, "
            "CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM chunks")


def evidence_sql(key: str, planted: bool = False) -> str:
    """One row per field of the evidence document."""
    spec = METRICS[key]

    def field(part, pos, name, src, text=False, expr=None):
        x = f"CAST({expr or name} AS VARCHAR)" if text else f"CAST({expr or name} AS DOUBLE)"
        num = f"TRY_CAST({x} AS DOUBLE)"
        return (f"SELECT '{part}' AS part, CAST({pos} AS BIGINT) AS pos, '{name}' AS field, round({num}, 4) AS num, "
                f"CASE WHEN {num} IS NULL THEN CAST({x} AS VARCHAR) END AS txt FROM {src} WHERE {x} IS NOT NULL")

    rows = [field("top_candidates", "rank - 1", n, "top5", text=n in ("dimension", "segment"))
            for n in ("dimension", "segment", "value_a", "value_b", "change", "abnormal_change", "share_of_change", "duplicate_rate_b")]
    rows += [field("drill_down_inside_top_candidate", "drill_rank - 1", n, "(SELECT * FROM drill WHERE drill_rank <= 3)", text=n in ("dimension", "segment"))
             for n in ("dimension", "segment", "value_a", "value_b", "share_of_change_within")]
    rows += [field("data_quality_findings", 0, n, "finds", expr=e, text=n == "table_name")
             for n, e in (("table_name", "table_name"), ("duplicate_rate_a", "ra"), ("duplicate_rate_b", "rb"), ("increase", "rb - ra"))]
    rows += [field("overall_change", 0, n, "chg") for n in ("value_a", "value_b", "delta", "pct_change")]
    rows += [field("confidence", 0, "confidence", "conf", text=True)]
    rows += [field("related_documents", "hit_rank - 1", n, f"(SELECT {DOCUMENT} FROM hits)", text=True)
             for n in ("doc_ref", "doc_id", "title", "type", "date", "excerpt")]
    first = "(SELECT dimension, segment FROM ranked_all WHERE rank = 1)"
    return (merged_sql(key, planted).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f",\n{drill_ctes(spec.kind)},\n"
            "top5 AS (SELECT a.rank, a.dimension, a.segment, c.value_a, c.value_b, c.change, c.abnormal_change, a.share_of_change, a.duplicate_rate_b "
            "FROM ranked_all a LEFT JOIN cand c ON c.dimension = a.dimension AND c.segment = a.segment WHERE a.rank <= 5),\n"
            f"first_one AS {first},\n{context_ctes(key, 'first_one')}\n" + "\nUNION ALL ".join(rows))


def report_check_sql() -> str:
    spec = METRICS["order_count"]
    return (f"WITH {analysis_ctes(spec)} SELECT 'order_count' AS report_id, CAST(4 AS BIGINT) AS pos, "
            "format('{:,}', CAST(value_b + 1234 AS BIGINT)) AS raw, value_b + 1234 AS value FROM chg")


def query_log_sql() -> str:
    spec = METRICS["order_count"]
    steps = [("overall change", "chg"), ("ranking", "ranked"), ("candidates", "cand"), ("drill-down", "(SELECT * FROM drill WHERE drill_rank <= 3)"),
             ("duplicate check", f"({dup_counts_sql('order_count')})")]
    # only tables that the metric reads are checked for duplicates
    steps[4] = ("duplicate check", f"(SELECT * FROM ({dup_counts_sql('order_count')}) WHERE table_name = 'orders')")
    return (f"WITH {analysis_ctes(spec)},\n{drill_ctes(spec.kind)} " + " UNION ALL ".join(
        f"SELECT 'Q{i}' AS query_id, '{purpose}' AS purpose, COUNT(*) AS row_count FROM {src}" for i, (purpose, src) in enumerate(steps, 1)))


def retrieval_oracles() -> dict[str, str]:
    return {
        "r1_front_matter": front_matter_sql(),
        "s2_markdown_folder": front_matter_sql("doc_"),
        "r3_chunks": chunks_sql(),
        "r4_tokens": tokens_sql(),
        "r5_hash_embed": hash_embed_sql(),
        "r6_cosine_centroid": cosine_centroid_sql(),
        "r7_bm25_top10": bm25_top_sql(),
        "r9_within_window": within_window_sql(),
        "r10_search": search_sql(),
        "r11_find_context": find_context_sql(),
        "r8_rrf": rrf_sql(),
        "s3_chunk_store": chunk_store_sql(),
        "a15_evidence_order_count": evidence_sql("order_count"),
        "a15_evidence_planted_duplicates": evidence_sql("item_revenue", planted=True),
        "g3_report_check": report_check_sql(),
        "u1_query_log": query_log_sql(),
    }


# ---- ad hoc, anomaly scan, grounding, JSON ------------------------------------------------------
def ask_sql_oracle() -> str:
    return ("SELECT c.c_mktsegment AS segment, CAST(COUNT(*) AS BIGINT) AS n_orders, "
            "round(CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS revenue "
            "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")


def top_brands_sql() -> str:
    return ("SELECT p_brand, CAST(COUNT(*) AS BIGINT) AS n_items FROM lineitem JOIN part ON l_partkey = p_partkey "
            "GROUP BY p_brand ORDER BY n_items DESC, p_brand LIMIT 5")


def _anomaly_sql(events: str, flagged_only: bool) -> str:
    sql = (
        f"WITH ev AS ({events}),\n"
        "d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS DOUBLE) AS value FROM ev GROUP BY 1, 2),\n"
        "b AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),\n"
        "sp AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),\n"
        "s AS (SELECT 'events' AS metric, sp.event_type, sp.day, COALESCE(d.value, 0.0) AS value "
        "FROM sp LEFT JOIN d USING (event_type, day)),\n"
        "t AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY metric, event_type ORDER BY day "
        "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend, dayofweek(day) AS wd FROM s),\n"
        "t2 AS (SELECT *, value - trend AS detr FROM t),\n"
        "se AS (SELECT metric, event_type, wd, quantile_cont(detr, 0.5) AS seasonal FROM t2 GROUP BY ALL),\n"
        "r AS (SELECT t2.*, se.seasonal, t2.detr - se.seasonal AS residual FROM t2 JOIN se USING (metric, event_type, wd)),\n"
        "m AS (SELECT metric, event_type, quantile_cont(residual, 0.5) AS med FROM r GROUP BY ALL),\n"
        "r2 AS (SELECT r.*, m.med FROM r JOIN m USING (metric, event_type)),\n"
        "md AS (SELECT metric, event_type, quantile_cont(abs(residual - med), 0.5) AS mad FROM r2 GROUP BY ALL),\n"
        "sc AS (SELECT r2.*, CASE WHEN md.mad <> 0 THEN 0.6745 * (r2.residual - r2.med) / md.mad END AS score "
        "FROM r2 JOIN md USING (metric, event_type))\n"
        "SELECT metric, event_type, day, round(value, 6) AS value, round(trend, 6) AS trend, "
        "round(seasonal, 6) AS seasonal, round(residual, 6) AS residual, round(score, 6) AS score, "
        "COALESCE(abs(score) >= 6.0, false) AS is_anomaly FROM sc")
    return sql + (" WHERE COALESCE(abs(score) >= 6.0, false)" if flagged_only else "")


def _metric_anomaly_sql(orders: str, flagged_only: bool) -> str:
    """C1-C10 by day; totals are 0 and averages missing on a day without orders."""
    values = {False: [], True: []}
    for key, m in METRICS.items():
        values[bool(m.joins)].append((key, f"CASE WHEN bool_or({m.where}) THEN {m.value} END" if m.where else m.value, m.kind))
    per, sums = [], []
    for items, own in values.items():
        cols = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v, _ in own)
        per.append(f"p{int(items)} AS (SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS day, {cols} FROM od o {ITEMS if items else ''} GROUP BY 1, 2)")
        sums += [f"SELECT '{k}' AS metric, '{kind}' AS kind, day, SUM({k}) AS total, COUNT({k}) AS n FROM p{int(items)} GROUP BY day" for k, _, kind in own]
    kinds = ", ".join(f"('{k}', '{m.kind}')" for k, m in METRICS.items())
    days = ("s AS (SELECT k.metric, sp.day, CASE WHEN k.kind = 'total' THEN COALESCE(d.total, 0.0) WHEN d.n > 0 THEN d.total / d.n END AS value FROM "
            "(SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM d)) sp "
            "CROSS JOIN k LEFT JOIN d ON d.metric = k.metric AND d.day = sp.day)")
    tail = _anomaly_sql("SELECT 1", flagged_only).split("t AS (SELECT *", 1)[1].replace("metric, event_type", "metric")
    for c in ("value", "trend", "seasonal", "residual"):
        tail = tail.replace(f"round({c}, 6) AS {c}", f"CASE WHEN abs({c}) >= 1e5 THEN round({c} + 1e-7, 4) ELSE round({c}, 6) END AS {c}")
    return (f"WITH od AS ({orders}),\n" + ",\n".join(per) + f",\nk(metric, kind) AS (VALUES {kinds}),\nd AS ({' UNION ALL '.join(sums)}),\n{days},\n"
            f"t AS (SELECT *{tail}")


PLANTED_ORDERS = ("SELECT * REPLACE (CASE WHEN CAST(o_orderdate AS DATE) = DATE '1997-06-15' THEN o_totalprice * 25 ELSE o_totalprice END AS o_totalprice) "
                  "FROM orders")
PLANTED_EVENTS = ("SELECT * FROM events UNION ALL SELECT e.* FROM events e, range(2, 11) r(c) "
                  "WHERE e.event_type = 'click' AND CAST(e.ts AS DATE) = DATE '2024-01-15'")

# the number pattern without look-behind (DuckDB's regex has none): a consumed prefix, group 2
DUCK_NUMBER = r"(^|[^\p{L}\p{N}_.])([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)"


def _numbers_sql(src: str, key: str, text: str) -> str:
    return (f"SELECT {key}, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS pos, unnest(l) AS raw "
            f"FROM (SELECT {key}, regexp_extract_all({text}, '{DUCK_NUMBER}', 2) AS l FROM {src}) WHERE len(l) > 0")


def extract_numbers_sql() -> str:
    return (f"SELECT page_id, pos, raw, round(CAST(replace(raw, ',', '') AS DOUBLE), 6) AS value "
            f"FROM ({_numbers_sql('pages', 'page_id', 'html')})")


REPORT_CTES = (
    "per AS (SELECT o_custkey AS report_id, COUNT(*) AS n_orders, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total, "
    "MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS max_price FROM orders GROUP BY 1),\n"
    "per2 AS (SELECT per.*, c.c_mktsegment FROM per JOIN customer c ON c.c_custkey = per.report_id),\n"
    "ev AS (SELECT report_id, unnest([CAST(n_orders AS DOUBLE), CAST(total AS DOUBLE), CAST(max_price AS DOUBLE)]) "
    "AS value FROM per2),\n"
    "evx AS (SELECT DISTINCT report_id, v AS value FROM (SELECT report_id, unnest([value, abs(value), value * 100, "
    "abs(value) * 100]) AS v FROM ev UNION ALL SELECT report_id, CAST(unnest(range(0, 11)) AS DOUBLE) FROM "
    "(SELECT DISTINCT report_id FROM ev))),\n"
    "rep AS (SELECT report_id, 'Segment ' || c_mktsegment || ': ' || format('{:,}', CASE WHEN report_id % 7 = 0 "
    "THEN n_orders + 11 ELSE n_orders END) || ' orders worth ' || CAST(CAST(CASE WHEN report_id % 5 = 0 THEN "
    "total + 17.25 ELSE total END AS DECIMAL(18,2)) AS VARCHAR) || ' in total; the largest was ' || "
    "CAST(max_price AS VARCHAR) || '.' AS text FROM per2)")


def evidence_values_sql() -> str:
    return f"WITH {REPORT_CTES} SELECT report_id, round(value, 6) AS value FROM evx"


def nested_evidence_sql() -> str:
    return ("WITH p AS (SELECT o_custkey AS report_id, COUNT(*) AS n, CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS most, "
            "CAST(MIN(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS least FROM orders GROUP BY 1),\n"
            "v AS (SELECT report_id, unnest([CAST(n AS DOUBLE), least, most, (n + 20) * 1000.0, -least]) AS v FROM p)\n"
            "SELECT DISTINCT report_id, round(x, 6) AS value FROM (SELECT report_id, unnest([v, abs(v), v * 100, abs(v) * 100]) AS x FROM v "
            "UNION ALL SELECT report_id, CAST(unnest(range(0, 11)) AS DOUBLE) FROM p)")


def unsupported_sql() -> str:
    return (
        f"WITH {REPORT_CTES},\n"
        f"w AS (SELECT report_id, pos, raw, CAST(replace(raw, ',', '') AS DOUBLE) AS value, "
        "ltrim(replace(raw, ',', ''), '+') AS cleaned FROM (" + _numbers_sql('rep', 'report_id', 'text') + ")),\n"
        "w2 AS (SELECT *, 0.5 * pow(10.0, -(CASE WHEN contains(cleaned, '.') THEN len(split_part(cleaned, '.', 2)) "
        "ELSE 0 END)) + 1e-9 AS tol FROM w)\n"
        "SELECT report_id, pos, raw, round(value, 6) AS value FROM w2 WHERE NOT EXISTS (SELECT 1 FROM evx "
        "WHERE evx.report_id = w2.report_id AND abs(abs(w2.value) - abs(evx.value)) <= w2.tol)")


def extract_json_sql() -> str:
    fence = r"```(?:json)?\s*(\{.*?\})\s*```"
    return (
        "WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Here is the result:' || chr(10) || '```json' "
        "|| chr(10) || props || chr(10) || '```' || chr(10) || 'Done.' WHEN event_id % 3 = 1 THEN '```' || chr(10) "
        "|| props || chr(10) || '```' ELSE 'Sure! The answer is ' || props || ' - hope this helps.' END AS reply "
        "FROM events),\n"
        f"c AS (SELECT event_id, CASE WHEN regexp_matches(reply, '(?s){fence}') THEN "
        f"regexp_extract(reply, '(?s){fence}', 1) ELSE reply END AS cand FROM r),\n"
        "s AS (SELECT event_id, cand, instr(cand, '{') AS st, instr(reverse(cand), '}') AS rv FROM c),\n"
        "j AS (SELECT event_id, CASE WHEN st > 0 AND rv > 0 THEN substr(cand, st, (len(cand) - rv + 1) - st + 1) "
        "END AS json_text FROM s)\n"
        "SELECT event_id, json_text, CAST(json_extract(json_text, '$.k') AS BIGINT) AS k FROM j")


def more_oracles() -> dict[str, str]:
    return {
        "q1_ask_sql": ask_sql_oracle(),
        "q2_top_brands": top_brands_sql(),
        "a16_anomaly_scores": _anomaly_sql("SELECT * FROM events", False),
        "a16_anomalies_planted": _anomaly_sql(PLANTED_EVENTS, True),
        "a16_metric_anomalies": _metric_anomaly_sql("SELECT * FROM orders", False),
        "a16_metric_anomalies_planted": _metric_anomaly_sql(PLANTED_ORDERS, True),
        "q1_ask_sql_capped": "SELECT customer, n_orders, (SELECT COUNT(DISTINCT o_custkey) FROM orders) > 1000 AS truncated FROM (SELECT o_custkey AS customer, "
                             "COUNT(*) AS n_orders FROM orders GROUP BY 1 ORDER BY 1 LIMIT 1000)",
        "q1_answer_preview": "SELECT '{\"customer\":' || customer || ',\"n_orders\":' || n_orders || '}' AS row_json FROM (SELECT o_custkey AS customer, "
                             "COUNT(*) AS n_orders FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10)",
        "g1_extract_numbers": extract_numbers_sql(),
        "g2_evidence_values": evidence_values_sql(),
        "g3_unsupported_numbers": unsupported_sql(),
        "g2_nested_evidence": nested_evidence_sql(),
        "j1_extract_json": extract_json_sql(),
    }


# ---- run log ------------------------------------------------------------------------------------
RUNS_CTE = (
    "cv AS (SELECT *, 'run-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS run_id FROM conversations),\n"
    "per AS (SELECT run_id, conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question, "
    "COUNT(*) AS turns, arg_max(text, turn) AS last_text, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer "
    "FROM cv GROUP BY run_id, conv_id),\n"
    "runs AS (SELECT run_id, conv_id, COALESCE(question, '') AS question, "
    "CASE WHEN conv_id % 2 = 0 THEN 'lab' ELSE 'public' END AS dataset, "
    "CASE WHEN conv_id % 5 = 0 THEN 'insufficient_evidence' ELSE 'completed' END AS status, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) AS created_at, turns, "
    "CAST(turns * 1.5 AS DOUBLE) AS duration_s, last_text, answer FROM per)")


def list_runs_sql() -> str:
    return (f"WITH {RUNS_CTE} SELECT run_id, question, dataset, status, created_at, round(duration_s, 6) AS duration_s "
            "FROM runs ORDER BY created_at DESC, run_id LIMIT 20")


def feedback_rollup_sql() -> str:
    return (f"WITH {RUNS_CTE},\nfb AS (SELECT run_id, CAST(conv_id // 2 AS BIGINT) % 3 - 1 AS rating FROM runs "
            "WHERE conv_id % 2 = 0)\n"
            "SELECT r.dataset, CAST(COUNT(*) AS BIGINT) AS n_feedback, round(AVG(rating), 6) AS avg_rating, "
            "CAST(COUNT(*) FILTER (WHERE rating > 0) AS BIGINT) AS n_positive, "
            "CAST(COUNT(*) FILTER (WHERE rating < 0) AS BIGINT) AS n_negative "
            "FROM fb JOIN runs r USING (run_id) WHERE rating BETWEEN -1 AND 1 GROUP BY r.dataset")


def usage_rollup_sql() -> str:
    return (f"WITH {RUNS_CTE}\n"
            "SELECT dataset, CAST(SUM(turns) AS BIGINT) AS calls, CAST(SUM(turns * 100) AS BIGINT) AS prompt_tokens, "
            "CAST(SUM(turns * 40) AS BIGINT) AS completion_tokens, round(CAST(SUM(turns * 0.0125) AS DOUBLE), 6) AS cost_usd, "
            "round(CAST(SUM(turns * 1.5) AS DOUBLE), 6) AS latency_s, "
            "CASE WHEN bool_or(conv_id % 2 = 0) THEN 'model-a,model-b' ELSE 'model-a' END AS models "
            "FROM runs GROUP BY dataset")


def jstr(x: str) -> str:
    """The value as a JSON string of printable ASCII, or null."""
    special = " ".join(f"WHEN c = {c} THEN '{e}'" for c, e in (
        ("'\"'", '\\"'), ("'\\'", "\\\\"), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t"), ("chr(8)", "\\b"), ("chr(12)", "\\f")))
    return (f"(CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || array_to_string([CASE {special} WHEN unicode(c) < 32 OR unicode(c) > 126 "
            f"THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END for c in string_split({x}, '')], '') || '\"' END)")


def jobj(**fields: str) -> str:
    """A JSON object with sorted keys; values are SQL expressions of JSON texts."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {fields[k]}" for k in sorted(fields)) + " || '}'"


GENESIS = "0" * 64
RUN_QUERIES = (
    "rq AS (SELECT run_id, 'Q' || ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY turn) AS query_id, text, length(text) AS n, "
    "CASE WHEN turn % 5 = 4 THEN 'timeout' END AS error FROM cv WHERE role = 'assistant'),\n"
    "rqs AS (SELECT run_id, COUNT(*) AS n_queries, string_agg("
    + jobj(query_id=jstr("query_id"), sql_executed=jstr("text"), row_count="CAST(n AS VARCHAR)", error=jstr("error"))
    + ", ',' ORDER BY query_id) AS q FROM rq GROUP BY 1)")


def snapshots(runs: str) -> str:
    """Digest and recorded payload of every run."""
    models = "CASE WHEN conv_id % 2 = 0 THEN '[\"model-b\",\"model-a\"]' ELSE '[\"model-a\"]' END"
    snap = jobj(run_id=jstr("run_id"), question=jstr("question"), dataset=jstr("dataset"), status=jstr("status"), models=models,
                report="(" + jobj(summary=jstr("answer"), turns="CAST(turns AS VARCHAR)") + ")",
                created_at="'\"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '+00:00\"'", queries="'[' || COALESCE(q, '') || ']'")
    payload = jobj(digest=jstr("digest"), question=jstr("question"), status=jstr("status"), models=models, queries="CAST(n_queries AS VARCHAR)")
    return (f"(SELECT *, {payload} AS payload FROM (SELECT r.*, COALESCE(n_queries, 0) AS n_queries, sha256({snap}) AS digest "
            f"FROM {runs} r LEFT JOIN rqs USING (run_id)))")


def entry_hash(seq="seq", event="event", run_id="run_id", payload="payload", at="at", prev="prev_hash") -> str:
    return "sha256(" + jobj(seq=f"CAST({seq} AS VARCHAR)", event=jstr(event), run_id=jstr(run_id), payload=payload, at=jstr(at), prev_hash=jstr(prev)) + ")"


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
PER_RUN_LOG = (
    f"{RUNS_CTE},\n{RUN_QUERIES},\nsnap AS {snapshots('runs')},\n"
    f"e1 AS (SELECT *, {entry_hash()} AS hash FROM (SELECT CAST(1 AS BIGINT) AS seq, 'run_recorded' AS event, run_id, payload, "
    f"{ISO.format('created_at')} AS at, '{GENESIS}' AS prev_hash FROM snap)),\n"
    f"e2 AS (SELECT *, {entry_hash()} AS hash FROM (SELECT CAST(2 AS BIGINT) AS seq, 'feedback' AS event, r.run_id, "
    + jobj(rating="CAST(CAST(conv_id // 2 AS BIGINT) % 3 - 1 AS VARCHAR)", comment=jstr("last_text"))
    + f" AS payload, {ISO.format('created_at + INTERVAL 30 SECOND')} AS at, e1.hash AS prev_hash FROM runs r JOIN e1 USING (run_id) "
    "WHERE conv_id % 2 = 0)),\nlog AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)")
NUM = "CAST(substr(run_id, 5, 6) AS INTEGER)"
TAMPERED = (f"t AS (SELECT seq, event, run_id, CASE WHEN {NUM} % 13 = 0 AND seq = 1 THEN replace(payload, '\"status\":\"', '\"status\":\"x') "
            f"ELSE payload END AS payload, at, prev_hash, hash FROM log WHERE NOT ({NUM} % 17 = 0 AND seq = 1))")
CHANGED_RUNS = (f"runs2 AS (SELECT * REPLACE (CASE WHEN {NUM} % 11 = 0 THEN question || '!' ELSE question END AS question) FROM runs "
                f"WHERE {NUM} % 19 <> 0),\nsnap2 AS {snapshots('runs2')}")
CHAIN_MESSAGE = "audit entry altered, removed or out of order"


def bad_chain(log: str, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY seq)"
    return (f"SELECT seq, CAST(NULL AS VARCHAR) AS run_id, '{CHAIN_MESSAGE}' AS problem FROM (SELECT *, COALESCE(lag(hash) {over}, '{GENESIS}') AS pv "
            f"FROM {log}) WHERE prev_hash <> pv OR hash <> {entry_hash(prev='pv')}")


def bad_runs(log: str, snap: str) -> str:
    return ("SELECT seq, l.run_id, CASE WHEN s.digest IS NULL THEN 'run deleted' ELSE 'run or its queries changed after they were recorded' END "
            f"AS problem FROM {log} l LEFT JOIN {snap} s USING (run_id) WHERE event IN ('run_recorded', 'run_baselined') "
            "AND (s.digest IS NULL OR s.digest IS DISTINCT FROM json_extract_string(l.payload, '$.digest'))")


def not_logged(log: str, runs: str) -> str:
    return (f"SELECT CAST(NULL AS BIGINT) AS seq, run_id, 'run has no audit entry (inserted outside the app?)' AS problem FROM {runs} "
            f"WHERE run_id NOT IN (SELECT run_id FROM {log} WHERE event IN ('run_recorded', 'run_baselined'))")


def problems(runs: str, snap: str) -> str:
    return f"{bad_chain('t', 'PARTITION BY run_id')} UNION ALL {bad_runs('t', snap)} UNION ALL {not_logged('t', runs)}"


def audit_oracles() -> dict[str, str]:
    single = (f"one AS (SELECT ROW_NUMBER() OVER (ORDER BY created_at, run_id) AS seq, 'run_recorded' AS event, run_id, payload, "
              f"{ISO.format('created_at')} AS at FROM snap),\n"
              f"ch AS (SELECT *, '{GENESIS}' AS prev_hash, {entry_hash(prev=chr(39) + GENESIS + chr(39))} AS hash FROM one WHERE seq = 1 UNION ALL "
              f"SELECT o.seq, o.event, o.run_id, o.payload, o.at, ch.hash, {entry_hash('o.seq', 'o.event', 'o.run_id', 'o.payload', 'o.at', 'ch.hash')} "
              "FROM ch JOIN one o ON o.seq = ch.seq + 1),\n"
              "bad AS (SELECT seq, event, run_id, CASE WHEN seq % 50 = 7 THEN replace(payload, '\"status\":\"', '\"status\":\"x') ELSE payload END AS payload, "
              "at, prev_hash, hash FROM ch WHERE seq % 70 <> 69)")
    no_digest = (f"ld AS (SELECT seq, event, run_id, CASE WHEN {NUM} % 23 = 0 THEN regexp_replace(payload, '\"digest\":\"[0-9a-f]*\",', '') "
                 "ELSE payload END AS payload FROM log)")
    base = (f"b AS (SELECT CAST(1 AS BIGINT) AS seq, 'run_baselined' AS event, run_id, payload, '2024-02-01T00:00:00+00:00' AS at, "
            f"'{GENESIS}' AS prev_hash FROM snap WHERE {NUM} % 3 = 0)")
    at = re.compile(r"(?<![\"\w'])at(?![\"\w:'])")  # the column's name is a keyword here
    return {name: at.sub('"at"', sql) for name, sql in {
        "u3_run_digests": f"WITH {PER_RUN_LOG} SELECT run_id, digest, CAST(n_queries AS BIGINT) AS n_queries FROM snap",
        "u4_audit_append_per_run": f"WITH {PER_RUN_LOG} SELECT seq, event, run_id, payload, at, prev_hash, hash FROM log",
        "u5_verify_chain": f"WITH RECURSIVE {PER_RUN_LOG},\n{single} {bad_chain('bad')}",
        "u6_verify_runs": f"WITH {PER_RUN_LOG},\n{CHANGED_RUNS},\n{no_digest} SELECT run_id, seq, problem FROM ({bad_runs('ld', 'snap2')})",
        "u7_unlogged_runs": f"WITH {PER_RUN_LOG},\n{TAMPERED} {not_logged('t', 'runs')}",
        "u8_audit_problems_tampered": f"WITH {PER_RUN_LOG},\n{TAMPERED},\n{CHANGED_RUNS} {problems('runs2', 'snap2')}",
        "u8_verify_audit_tampered": f"WITH {PER_RUN_LOG},\n{TAMPERED} SELECT COUNT(*) = 0 AS intact, (SELECT COUNT(*) FROM t) AS entries, "
                                    f"COUNT(*) AS problems FROM ({problems('runs', 'snap')})",
        "u9_baseline_runs": f"WITH {PER_RUN_LOG},\n{base} SELECT run_id, seq, event, payload, {entry_hash()} AS hash FROM b",
        "u10_audit_tail": f"WITH {PER_RUN_LOG} SELECT run_id, seq, event, at, hash FROM log ORDER BY at DESC, run_id, seq DESC LIMIT 50",
        "u11_run": f"WITH {RUNS_CTE} SELECT run_id, question, dataset, status, round(duration_s, 6) AS duration_s FROM runs WHERE run_id = 'run-000042'",
        "s5_saved_runs": f"WITH {PER_RUN_LOG} SELECT dataset, COUNT(*) AS runs, CAST(SUM(n_queries) AS BIGINT) AS queries, "
                         "CAST(SUM(f) AS BIGINT) AS feedback, CAST(SUM(e) AS BIGINT) AS entries FROM (SELECT r.run_id, r.dataset, "
                         "rqs.n_queries, NULLIF(COUNT(l.run_id) FILTER (WHERE event = 'feedback'), 0) AS f, COUNT(l.run_id) AS e FROM runs r "
                         "LEFT JOIN rqs USING (run_id) JOIN log l USING (run_id) GROUP BY ALL) GROUP BY dataset",
    }.items()}


def runlog_oracles() -> dict[str, str]:
    return {"u10_list_runs": list_runs_sql(), "u12_feedback_rollup": feedback_rollup_sql(),
            "u13_usage_rollup": usage_rollup_sql()}


def profile_oracles() -> dict[str, str]:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
             "pages", "benchmark", "labels", "conversations")
    kinds = " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in (
        ("BIGINT", "bigint"), ("INTEGER", "int"), ("VARCHAR", "string"), ("DOUBLE", "double"), ("TIMESTAMP", "timestamp_ntz"), ("FLOAT[]", "array<float>")))
    tables = " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM {n}"
                                for n in names)
    return {
        "s6_profile_date_range": "SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date, "
                                 "CAST(COUNT(*) AS BIGINT) AS row_count FROM orders",
        "s6_profile_tables": tables,
        "s6_profile_columns": "SELECT table_name, CAST(column_index AS BIGINT) AS ordinal_position, column_name, "
                              f"CASE data_type {kinds} ELSE data_type END AS data_type FROM duckdb_columns() WHERE table_name IN {names}",
        "u11_queries_of_run": (
            "SELECT run_id, 'Q' || CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY turn) AS VARCHAR) AS query_id, "
            "text AS sql_executed, CAST(length(text) AS BIGINT) AS row_count, CAST(turn * 7 AS BIGINT) AS duration_ms, "
            "CASE WHEN turn % 5 = 4 THEN 'timeout' END AS error FROM (SELECT 'run-' || lpad(CAST(conv_id AS VARCHAR), "
            "6, '0') AS run_id, turn, text FROM conversations WHERE role = 'assistant') WHERE run_id = 'run-000042'"),
    }
