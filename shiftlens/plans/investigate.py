"""The whole "why did it change?" investigation as one set of lazy plans.

One persisted per-order base and one persisted order-segment bridge feed every step: overall
change, ranking over all dimensions, drill-down inside the top candidate and the duplicate check.
Nothing is collected midway; the drill-down joins to the one-row top candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.columns import abs_desc
from shiftlens.operators import change as ch
from shiftlens.operators import metric as mt
from shiftlens.operators.search import find_context
from shiftlens.plans.model import MetricSpec, SemanticModel
from shiftlens.session import materialize


def change_of_all_dimensions(base: DataFrame, bridge: DataFrame, change: DataFrame, kind: str,
                             dimensions: list[str]) -> DataFrame:
    """Abnormal change of the segments of every dimension, against the overall change."""
    by_dim = mt.metric_by_dimension(base, bridge, dimensions)
    return ch.abnormal_change(ch.pivot_periods(by_dim), kind, ch.overall_by_dimension(change, dimensions))


def drill_down(base: DataFrame, bridge: DataFrame, candidates: DataFrame, kind: str, dimensions: list[str],
               top_n: int = 3) -> DataFrame:
    """Inside candidate 1, rank every other dimension against that subset's own change.

    Each dimension contributes its first segment unless it is ``(none)``; the best ``top_n`` by
    |share of change within| are kept. The inner change of a dimension uses that dimension's
    segment sums, as the per-dimension queries do.
    """
    top = candidates.filter(F.col("candidate_rank") == 1).select("dimension", "segment")
    sub = mt.within_segments(base, bridge, top)
    by_dim = mt.metric_by_dimension(sub, bridge, dimensions)
    by_dim = by_dim.join(F.broadcast(top.select("dimension")), "dimension", "left_anti")
    inner = ch.total_change(by_dim, kind, by=["dimension"])
    abnormal = ch.abnormal_change(ch.pivot_periods(by_dim), kind,
                                  inner.select("dimension", F.col("delta").alias("overall_delta")))
    first = ch.first_segments(abnormal, 1).filter(F.col("segment") != mt.NONE_SEGMENT)
    order = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    # at most one row per dimension of the model reaches this window
    w = Window.orderBy(abs_desc("share_of_change_within"), order)
    return (first.select("dimension", "segment", "value_a", "value_b",
                         F.col("share_of_change").alias("share_of_change_within"))
            .withColumn("drill_rank", F.row_number().over(w))
            .filter(F.col("drill_rank") <= top_n))


@dataclass
class Investigation:
    """Lazy results of one investigation; call ``close()`` to release the persisted inputs."""

    base: DataFrame
    bridge: DataFrame
    change: DataFrame
    segments: DataFrame
    candidates: DataFrame
    drilldown: DataFrame
    counts: DataFrame
    findings: DataFrame
    merged: DataFrame
    confidence: DataFrame
    documents: DataFrame | None = None
    _cached: list = field(default_factory=list)

    def top(self, n: int = 5) -> DataFrame:
        return self.merged.filter(F.col("rank") <= n)

    def evidence(self, spec: MetricSpec) -> DataFrame:
        """One row: ``confidence``, ``status`` and the evidence document as JSON (``evidence_json``).

        Every list is bounded by the model (top 5, 3 drill-downs, one finding per table). The parts
        are unioned as JSON fragments and assembled by one global aggregate, without joins.
        """
        def part(df, name, order, cols):
            return df.select(F.lit(name).alias("part"), order.cast("long").alias("o"),
                             F.to_json(F.struct(*cols)).alias("j"))

        top_cols = ["dimension", "segment", "value_a", "value_b", "change", "abnormal_change", "share_of_change",
                    "duplicate_rate_b"]
        parts = (
            part(self.top(5), "top_candidates", F.col("rank"), top_cols)
            .unionByName(part(self.drilldown, "drill_down_inside_top_candidate", F.col("drill_rank"),
                              ["dimension", "segment", "value_a", "value_b", "share_of_change_within"]))
            .unionByName(part(self.findings, "data_quality_findings", F.lit(0),
                              ["table_name", "duplicate_rate_a", "duplicate_rate_b", "increase"]))
            .unionByName(part(self.change, "overall_change", F.lit(0), ["value_a", "value_b", "delta", "pct_change"]))
            .unionByName(part(self.confidence, "confidence", F.lit(0), ["confidence", "status"])))
        if self.documents is not None:
            parts = parts.unionByName(part(self.documents, "related_documents", F.col("hit_rank"),
                                           ["doc_ref", "doc_id", "title", "type", "date", "excerpt"]))

        def arr(name):
            items = F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct("o", "j"))))
            return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]"))

        def one(name):
            return F.max(F.when(F.col("part") == name, F.col("j")))

        row = parts.agg(*(arr(n).alias(n) for n in ("top_candidates", "drill_down_inside_top_candidate",
                                                     "data_quality_findings", "related_documents")),
                        one("overall_change").alias("overall_change"), one("confidence").alias("_conf"))
        head = F.to_json(F.struct(F.lit(spec.name).alias("metric"), F.lit(spec.kind).alias("kind"),
                                  F.array(*[F.lit(x) for x in spec.period_a]).alias("period_a"),
                                  F.array(*[F.lit(x) for x in spec.period_b]).alias("period_b")))
        body = F.concat(
            F.expr("substring(__head, 1, length(__head) - 1)"),
            F.lit(',"overall_change":'), F.col("overall_change"),
            F.lit(',"top_candidates":'), F.col("top_candidates"),
            F.lit(',"drill_down_inside_top_candidate":'), F.col("drill_down_inside_top_candidate"),
            F.lit(',"data_quality_findings":'), F.col("data_quality_findings"),
            F.lit(',"related_documents":'), F.col("related_documents"),
            F.lit(',"confidence":"'), F.get_json_object("_conf", "$.confidence"), F.lit('"'),
            F.lit("}"))
        conf = F.from_json("_conf", "confidence string, status string")
        return (row.withColumn("__head", head)
                .select(conf["confidence"].alias("confidence"), conf["status"].alias("status"),
                        body.alias("evidence_json")))

    def steps(self) -> list[tuple[str, str, DataFrame]]:
        """(purpose, what is run, result) of the queries behind the investigation, for the query log."""
        return [("overall change", "metric per period", self.change), ("ranking", "metric per segment and period", self.segments),
                ("candidates", "three segments of each dimension", self.candidates),
                ("drill-down", "other dimensions inside the first candidate", self.drilldown),
                ("duplicate check", "rows and distinct keys per table", self.counts)]

    def close(self) -> None:
        for df in self._cached:
            df.unpersist()


def investigate(tables: dict[str, DataFrame], model: SemanticModel, spec: MetricSpec,
                dimensions: list[str] | None = None, cache: str = "persist",
                min_increase: float = 0.005, chunks: DataFrame | None = None, question: str = "",
                dataset: str = "") -> Investigation:
    """Overall change, ranked candidates, drill-down, duplicate check, merged list, confidence; with
    ``chunks`` also the documents of ``dataset`` around period B that match the first entry of the list."""
    spec.validate(model)
    dims = dimensions or model.dimension_names
    held: list[DataFrame] = []

    def write(df: DataFrame) -> DataFrame:
        held.append(materialize(df, cache))
        return held[-1]

    if cache != "none":  # one scan of each child feeds base, bridge and duplicate check
        tables = mt.read_children_once(tables, model, spec, dims, write)
    base = materialize(mt.metric_base(tables, model, spec), cache)
    bridge = materialize(mt.segment_bridge(tables, model, spec, dims), cache)
    change = ch.total_change(mt.metric_total(base), spec.kind)
    segments = change_of_all_dimensions(base, bridge, change, spec.kind, dims)
    candidates = ch.top_candidates(segments, dims)
    drill = drill_down(base, bridge, candidates, spec.kind, dims)
    counts = mt.duplicate_counts(tables, model, spec)
    findings = ch.duplicate_findings(counts, min_increase)
    table_order = [model.base_table, *model.resolve_joins(spec.joins)]
    merged = ch.merge_findings(candidates, findings, table_order)
    conf = ch.confidence(change, candidates, findings)
    cached = [df for df in (*held, base, bridge) if cache == "persist"]
    documents = None
    if chunks is not None:
        top = merged.select(F.col("rank").alias("candidate_rank"), "dimension", "segment")
        documents = find_context(chunks, top, spec.name, question, dataset, spec.period_b)
    return Investigation(base, bridge, change, segments, candidates, drill, counts, findings, merged, conf, documents,
                         _cached=cached)
