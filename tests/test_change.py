"""Metric layer and change analysis: algebra identities, edge rules, planted causes."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from shiftlens.operators import change as ch
from shiftlens.operators import metric as mt
from shiftlens.plans.investigate import change_of_all_dimensions, investigate
from shiftlens.plans.model import Join, MetricSpec, SemanticModel, catalogue, tpch_model
from shiftlens.session import materialize
from shiftlens.sources.derived import with_dropped_segment, with_duplicated_items, with_price_jump
from shiftlens.sources.tables import LazyTables


def _ctx(spark, key, tables=None):
    t = tables or LazyTables(spark, SF001)
    return t, tpch_model(), catalogue()[key]


def _ranked(spark, key, tables=None):
    t, m, s = _ctx(spark, key, tables)
    base, bridge = mt.metric_base(t, m, s), mt.segment_bridge(t, m, s)
    change = ch.total_change(mt.metric_total(base), s.kind)
    return change_of_all_dimensions(base, bridge, change, s.kind, m.dimension_names), m


def test_abnormal_sums_to_zero_for_totals(spark):
    ranked, _ = _ranked(spark, "revenue")
    sums = ranked.groupBy("dimension").agg(F.sum("abnormal").alias("s"), F.sum("value_a").alias("a")).collect()
    for r in sums:
        if r["a"] != 0:
            assert abs(r["s"]) < 1e-6 * max(1.0, abs(r["a"]))


def test_mix_rate_parts_add_up(spark):
    piv = spark.createDataFrame(
        [("d", "x", 3.0, 10.0, 8.0, 20.0), ("d", "y", 1.0, 10.0, 1.0, 5.0), ("d", "z", 0.0, 0.0, 2.0, 4.0)],
        "dimension string, segment string, total_a double, n_a double, total_b double, n_b double")
    seg = ch.mix_rate_segments(piv, "total_a", "n_a", "total_b", "n_b")
    summ = ch.mix_rate_summary(piv, "total_a", "n_a", "total_b", "n_b").first()
    parts = summ["mix_effect"] + summ["rate_effect"] + summ["interaction"]
    assert abs(parts - (summ["rate_b"] - summ["rate_a"])) < 1e-12
    assert seg.count() == 3


def test_contribution_shares_sum_to_one(spark):
    df = spark.createDataFrame([("g", "a", 1.0, 4.0), ("g", "b", 2.0, 1.0), ("g", "c", 0.0, 3.0)],
                               "dimension string, segment string, a double, b double")
    out = ch.segment_contributions(df, "dimension", "a", "b")
    assert abs(out.agg(F.sum("share_of_change")).first()[0] - 1.0) < 1e-12


def test_zero_baseline_percent_is_null_and_ratio_zero(spark):
    totals = spark.createDataFrame([("B", 5.0, 5)], "period string, total double, n bigint")
    r = ch.total_change(totals, ch.TOTAL).first()
    assert r["value_a"] == 0.0 and r["value_b"] == 5.0 and r["pct_change"] is None


def test_orders_without_items_fold_into_none(spark):
    t, m, s = _ctx(spark, "order_count")
    by = mt.metric_by_dimension(mt.metric_base(t, m, s), mt.segment_bridge(t, m, s), m.dimension_names)
    none = by.filter((F.col("dimension") == "part_type") & (F.col("segment") == mt.NONE_SEGMENT)).collect()
    assert none and all(r["orders"] > 0 for r in none)


def test_top_candidates_plan_uses_group_limit(spark):
    ranked, m = _ranked(spark, "order_count")
    plan = ch.top_candidates(ranked, m.dimension_names)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan


def test_planted_dropped_segment_ranks_first(spark):
    t, m, s = _ctx(spark, "order_count")
    planted = with_dropped_segment(t, m, s, "BUILDING")
    ranked, m = _ranked(spark, "order_count", planted)
    first = ch.top_candidates(ranked, m.dimension_names).orderBy("candidate_rank").first()
    assert (first["dimension"], first["segment"]) == ("market_segment", "BUILDING")


def test_planted_price_jump_ranks_first(spark):
    t, m, s = _ctx(spark, "revenue")
    planted = with_price_jump(t, m, s, "MACHINERY")
    ranked, m = _ranked(spark, "revenue", planted)
    first = ch.top_candidates(ranked, m.dimension_names).orderBy("candidate_rank").first()
    assert (first["dimension"], first["segment"]) == ("market_segment", "MACHINERY")


def test_planted_duplicates_become_first_finding(spark):
    t, m, s = _ctx(spark, "item_revenue")
    inv = investigate(with_duplicated_items(t, m, s), m, s, cache="none")
    top = inv.merged.orderBy("rank").first()
    assert top["dimension"] == "data_quality" and top["segment"] == "lineitem"
    assert inv.confidence.first()["confidence"] == "high"


def test_clean_lineitem_repeat_is_not_a_finding(spark):
    t, m, s = _ctx(spark, "item_revenue")
    counts = mt.duplicate_counts(t, m, s)
    assert ch.duplicate_findings(counts).count() == 0


def test_a_row_in_both_periods_counts_in_the_second(spark):
    t = {"orders": spark.sql("SELECT 1L AS o_orderkey, timestamp_ntz'1998-02-15' AS o_orderdate, 'F' AS o_orderstatus, 5.0D AS o_totalprice")}
    spec = catalogue(("1998-01-01", "1998-03-01"), ("1998-02-01", "1998-04-01"))["order_count"]
    assert [r["period"] for r in mt.tag_periods(t, tpch_model(), spec).collect()] == ["B"]


def test_keys_with_a_null_part_are_counted(spark):
    t = {"orders": spark.sql("SELECT 1L AS o_orderkey, timestamp_ntz'1998-02-15' AS o_orderdate"),
         "lineitem": spark.sql("SELECT * FROM VALUES (1L, 1, 2.0D), (1L, NULL, 2.0D), (1L, NULL, 3.0D) AS l(l_orderkey, l_linenumber, l_quantity)")}
    r = mt.duplicate_counts(t, tpch_model(), catalogue()["avg_quantity"]).filter("table_name = 'lineitem'").first()
    assert (r["row_count"], r["distinct_keys"]) == (3, 2)


def test_orders_without_items_get_the_value_of_a_row_of_nulls(spark):
    t = {"orders": spark.sql("SELECT id AS o_orderkey, timestamp_ntz'1998-02-15' AS o_orderdate FROM range(3)"),
         "lineitem": spark.sql("SELECT * FROM VALUES (1L, 1, 2.0D), (1L, 2, 4.0D) AS l(l_orderkey, l_linenumber, l_quantity)")}
    for value, want in (("SUM(l.l_quantity)", [None, 6.0, None]), ("COUNT(l.l_quantity)", [0.0, 2.0, 0.0])):
        spec = replace(catalogue()["avg_quantity"], value=value)
        assert [r["v"] for r in mt.metric_base(t, tpch_model(), spec).orderBy("order_key").collect()] == want


def test_one_scan_and_one_shuffle_of_the_items(spark):
    t, m, s = _ctx(spark, "item_revenue")
    plan = _plan(mt.metric_total(mt.metric_base(t, m, s)))
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("lineitem.parquet") == 1


def test_joins_come_with_their_parents(spark):
    m = tpch_model()
    assert m.resolve_joins(["supp_nation", "cust_region"]) == ["customer", "lineitem", "supplier", "cust_nation", "cust_region", "supp_nation"]
    with pytest.raises(ValueError):
        m.resolve_joins(["nowhere"])
    with pytest.raises(ValueError):
        catalogue(("1998-04-01", "1998-01-01"))["revenue"].validate(m)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_a_partial_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked, m = _ranked(spark, "order_count")
        assert "WindowGroupLimit" in _plan(ch.top_candidates(ranked, m.dimension_names))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_period_filter_reaches_the_scan(spark):
    t, m, s = _ctx(spark, "order_count")
    plan = _plan(mt.tag_periods(t, m, s))
    assert "PushedFilters" in plan and "o_orderdate" in plan.split("PushedFilters")[1][:400]


# ---- several child tables, full ranks, one scan of a child ----------------------------------------------
TWO_CHILDREN = SemanticModel(
    "orders", "o", "id", ("d",), {"orders": ("id",), "items": ("id", "no"), "payments": ("id", "no")},
    {j.name: j for j in (Join("customer", "customer", "c", (("c.cid", "o.cid"),)), Join("items", "items", "i", (("i.id", "o.id"),), fanout=True),
                         Join("payments", "payments", "p", (("p.id", "o.id"),), fanout=True), Join("kinds", "kinds", "k", (("k.kid", "i.kid"),), requires=("items",)))}, ())


def _two_children(spark):
    day = "timestamp_ntz'1998-02-15' AS d"
    return {"orders": spark.sql(f"SELECT id, id % 2 AS cid, {day} FROM range(1, 6)"),
            "customer": spark.sql("SELECT 1L AS cid, 100.0D AS bonus"),
            "items": spark.sql("SELECT * FROM VALUES (1L, 1, 10.0D, 7), (1L, 2, 5.0D, 8), (2L, 1, 20.0D, 7), (4L, 1, NULL, 9) AS t(id, no, price, kid)"),
            "payments": spark.sql("SELECT * FROM VALUES (1L, 1, 3.0D), (1L, 2, 4.0D), (3L, 1, 8.0D), (4L, 1, 9.0D) AS t(id, no, amt)"),
            "kinds": spark.sql("SELECT 7 AS kid, 1000.0D AS extra")}


@pytest.mark.parametrize("value,joins,want", [
    # items x payments of one order multiply, as in one statement with both joins
    ("SUM(i.price) + COALESCE(SUM(p.amt), 0)", ("items", "payments"), [44.0, 20.0, None, None, None]),
    ("COALESCE(SUM(i.price), 0) + COALESCE(SUM(p.amt), 0)", ("payments", "items"), [44.0, 20.0, 8.0, 9.0, 0.0]),
    ("COUNT(p.amt)", ("items", "payments"), [4.0, 0.0, 1.0, 1.0, 0.0]),
    # an order without items still has its customer
    ("COALESCE(MAX(c.bonus), 0) + COUNT(i.no)", ("customer", "items"), [102.0, 1.0, 100.0, 1.0, 100.0]),
    ("COALESCE(MAX(k.extra), 0) + COALESCE(MAX(c.bonus), 0)", ("kinds", "customer"), [1100.0, 1000.0, 100.0, 0.0, 100.0])])
def test_children_are_left_joined_in_every_combination(spark, value, joins, want):
    spec = MetricSpec("x", "total", value, "d", ("1998-01-01", "1998-03-01"), ("1998-03-01", "1998-04-01"), joins)
    tables = _two_children(spark)
    got = {r["order_key"]: r["v"] for r in mt.metric_base(tables, TWO_CHILDREN, spec).collect()}
    assert got == dict(enumerate(want, 1))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    left = " ".join(f"LEFT JOIN {j.table} {j.alias} ON {j.keys[0][0]} = {j.keys[0][1]}" for n in TWO_CHILDREN.resolve_joins(joins) for j in [TWO_CHILDREN.joins[n]])
    plain = {r[0]: r[1] for r in spark.sql(f"SELECT o.id, CAST({value} AS DOUBLE) FROM orders o {left} GROUP BY o.id").collect()}
    assert got == plain


def test_full_ranks_come_from_ranges(spark):
    rows = [("big", f"s{i:04d}", float((i * 37) % 101 - 50) if i % 11 else None) for i in range(3000)] + [("small", "x", 2.0), ("small", "y", -2.0), ("small", None, 2.0)]
    df = spark.createDataFrame(rows, "dimension string, segment string, abnormal double").repartition(7)
    ranked = ch.rank_segments(df, lambda d: materialize(d, "checkpoint"))
    got = {(r["dimension"], r["segment"]): r["rank_in_dimension"] for r in ranked.collect()}
    want = {}
    for d in ("big", "small"):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2] is None, -abs(r[2] or 0), r[1] is not None, r[1] or ""))
        want |= {(d, r[1]): i for i, r in enumerate(own, 1)}
    assert got == want and ranked.columns == ["dimension", "segment", "abnormal", "rank_in_dimension"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables as small as this one would be one task
    try:
        placed = []
        ch.rank_segments(df, lambda d: placed.append(d) or d)
        assert placed[0].groupBy(F.shiftright("_at", 33)).count().agg(F.max("count")).first()[0] < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = _plan(ranked)
    assert "row_number" not in plan and "rank(" not in plan
    assert ch.rank_segments(df.limit(0), lambda d: materialize(d, "checkpoint")).count() == 0


def test_candidates_round_half_even(spark):
    rows = [("d", "a", 0.00005, 0.00015, 0.00025, -0.00035, 0.00045)]
    df = spark.createDataFrame(rows, "dimension string, segment string, value_a double, value_b double, delta double, abnormal double, share_of_change double")
    r = ch.top_candidates(df, ["d"]).first()
    assert [r[c] for c in ("value_a", "value_b", "change", "abnormal_change", "share_of_change")] == [0.0, 0.0002, 0.0002, -0.0004, 0.0004]


def test_investigation_scans_a_child_once(spark):
    t, m, s = _ctx(spark, "item_revenue")
    written = []
    once = mt.read_children_once(t, m, s, m.dimension_names, lambda df: written.append(df) or materialize(df, "checkpoint"))
    assert len(written) == 1 and _plan(written[0]).count("l_orderkey") and set(written[0].columns) == {
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"}
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    base, bridge = mt.metric_base(once, m, s), mt.segment_bridge(once, m, s)
    for df in (base, bridge, mt.duplicate_counts(once, m, s)):
        assert "lineitem" not in _plan(df)
    assert rows(mt.duplicate_counts(once, m, s)) == rows(mt.duplicate_counts(t, m, s)) and rows(bridge) == rows(mt.segment_bridge(t, m, s))
    assert rows(base.select("order_key", F.round("v", 4))) == rows(mt.metric_base(t, m, s).select("order_key", F.round("v", 4)))
    inv = investigate(t, m, s, cache="checkpoint")
    assert "lineitem" not in _plan(inv.segments) and "lineitem" not in _plan(inv.counts)
