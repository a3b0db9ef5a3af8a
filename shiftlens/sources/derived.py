"""Inputs derived from the given tables by expressions (planted causes, dated corpus, run log...).

Each function returns new DataFrames; the source tables are never written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.operators.metric import tag_periods
from shiftlens.plans.model import MetricSpec, SemanticModel
from shiftlens.sources.tables import LazyTables


def override(tables: dict[str, DataFrame], **replaced: DataFrame) -> dict[str, DataFrame]:
    """A table mapping with some tables replaced (lazy loading kept)."""
    if isinstance(tables, LazyTables):
        out = LazyTables(tables.spark, tables.path)
        out.update(tables)
    else:
        out = dict(tables)
    out.update(replaced)
    return out


def _period_b_orders(tables, model, spec) -> DataFrame:
    o = tag_periods(tables, model, spec, apply_filter=False)
    return o.filter(F.col("period") == "B").select(F.col(f"{model.base_alias}.{model.order_key}").alias("_k"))


def with_duplicated_items(tables, model: SemanticModel, spec: MetricSpec, modulus: int = 10) -> dict:
    """Planted data bug: lineitem rows of period-B orders with ``pmod(l_orderkey, modulus) = 0`` twice."""
    li = tables["lineitem"]
    extra = li.filter(F.pmod("l_orderkey", F.lit(modulus)) == 0).join(
        _period_b_orders(tables, model, spec), F.col("l_orderkey") == F.col("_k"), "left_semi")
    return override(tables, lineitem=li.unionByName(extra))


def with_dropped_segment(tables, model: SemanticModel, spec: MetricSpec, segment: str, keep_below: int = 8) -> dict:
    """Planted cause: drop period-B orders of one market segment where ``pmod(o_orderkey, 10) < keep_below``."""
    o = tables["orders"]
    cust = tables["customer"].filter(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("_c"))
    b = _period_b_orders(tables, model, spec)
    doomed = (o.join(b, F.col("o_orderkey") == F.col("_k"), "left_semi")
              .join(cust, F.col("o_custkey") == F.col("_c"), "left_semi")
              .filter(F.pmod("o_orderkey", F.lit(10)) < keep_below).select(F.col("o_orderkey").alias("_d")))
    return override(tables, orders=o.join(doomed, F.col("o_orderkey") == F.col("_d"), "left_anti"))


def with_price_jump(tables, model: SemanticModel, spec: MetricSpec, segment: str, factor: float = 5.0) -> dict:
    """Planted cause: ``o_totalprice`` times ``factor`` for one market segment in period B."""
    o = tables["orders"]
    cust = tables["customer"].select(F.col("c_custkey").alias("_c"), F.col("c_mktsegment").alias("_seg"))
    b = _period_b_orders(tables, model, spec).withColumn("_in_b", F.lit(True))
    j = o.join(cust, F.col("o_custkey") == F.col("_c"), "left").join(b, F.col("o_orderkey") == F.col("_k"), "left")
    hit = F.coalesce(F.col("_in_b"), F.lit(False)) & (F.col("_seg") == segment)
    price = F.when(hit, F.col("o_totalprice") * factor).otherwise(F.col("o_totalprice"))
    return override(tables, orders=j.select(*[price.alias(c) if c == "o_totalprice" else F.col(c)
                                              for c in o.columns]))


def dated_corpus(documents: DataFrame, base_date: str = "1998-01-01", undated_every: int = 10) -> DataFrame:
    """Documents as a dated corpus: ``(dataset = lang, doc_id, raw, doc_date)``;
    ``doc_date = base_date + doc_id % 365`` days, NULL where ``doc_id % undated_every = 0``."""
    date = F.date_add(F.lit(base_date).cast("date"), (F.col("doc_id") % 365).cast("int"))
    return documents.select(
        F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("raw"),
        F.when(F.col("doc_id") % undated_every == 0, F.lit(None).cast("date")).otherwise(date).alias("doc_date"))


def with_front_matter(documents: DataFrame, every: int = 3) -> DataFrame:
    """Markdown-like raw text: every ``every``-th document gets a front-matter block
    (title from its source, a date, type ``note``)."""
    fm = F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit(" "), F.col("doc_id").cast("string"),
                  F.lit("\ndate: "), F.date_format(F.date_add(F.lit("1998-01-01").cast("date"),
                                                              (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd"),
                  F.lit("\ntype: note\n---\n"))
    raw = F.when(F.col("doc_id") % every == 0, F.concat(fm, F.col("text"))).otherwise(F.col("text"))
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), raw.alias("raw"))


def with_unusual_day(events: DataFrame, event_type: str = "click", day: str = "2024-01-15",
                     copies: int = 10) -> DataFrame:
    """Planted unusual day: the ``event_type`` events of ``day`` appear ``copies`` times."""
    hit = events.filter((F.col("event_type") == event_type) & (F.to_date("ts") == F.lit(day).cast("date")))
    extra = hit.select("*", F.explode(F.sequence(F.lit(2), F.lit(copies))).alias("_copy")).drop("_copy")
    return events.unionByName(extra)


def with_unusual_order_day(tables, day: str = "1997-06-15", factor: float = 25.0) -> dict:
    """Planted unusual day: ``o_totalprice`` times ``factor`` for the orders of ``day``."""
    o = tables["orders"]
    price = F.when(F.to_date("o_orderdate") == F.lit(day).cast("date"), F.col("o_totalprice") * factor).otherwise(F.col("o_totalprice"))
    return override(tables, orders=o.withColumn("o_totalprice", price))


def customer_reports(orders: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grounding inputs from the order table: per customer, evidence numbers ``(report_id, value)``
    and a written report ``(report_id, text)``. Some reports are altered: ``+ 17.25`` on the total
    where ``custkey % 5 = 0``, ``+ 11`` orders where ``custkey % 7 = 0``."""
    per = (orders.groupBy(F.col("o_custkey").alias("report_id"))
           .agg(F.count(F.lit(1)).alias("n_orders"),
                F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
                F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("max_price")))
    per = per.join(customer.select(F.col("c_custkey").alias("report_id"), "c_mktsegment"), "report_id")
    evidence = per.select("report_id", F.explode(F.array(
        F.col("n_orders").cast("double"), F.col("total").cast("double"), F.col("max_price").cast("double")))
        .alias("value"))
    n_written = F.when(F.col("report_id") % 7 == 0, F.col("n_orders") + 11).otherwise(F.col("n_orders"))
    total_written = F.when(F.col("report_id") % 5 == 0, F.col("total") + F.lit(17.25).cast("decimal(4,2)")) \
        .otherwise(F.col("total")).cast("decimal(18,2)")
    text = F.concat(F.lit("Segment "), F.col("c_mktsegment"), F.lit(": "), F.format_number(n_written, 0),
                    F.lit(" orders worth "), total_written.cast("string"), F.lit(" in total; the largest was "),
                    F.col("max_price").cast("string"), F.lit("."))
    return evidence, per.select("report_id", text.alias("text"))


def model_replies(events: DataFrame) -> DataFrame:
    """Replies around ``events.props``: fenced with ```json, fenced bare, or in chatter."""
    p = F.col("props")
    kind = F.col("event_id") % 3
    text = (F.when(kind == 0, F.concat(F.lit("Here is the result:\n```json\n"), p, F.lit("\n```\nDone.")))
            .when(kind == 1, F.concat(F.lit("```\n"), p, F.lit("\n```")))
            .otherwise(F.concat(F.lit("Sure! The answer is "), p, F.lit(" - hope this helps."))))
    return events.select("event_id", text.alias("reply"))
