"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

The queries run over whole tables, or inputs that Spark derives from them. Doubles are
rounded to 6 places and integer ranks widened to BIGINT so results compare exactly with the
SQL oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.operators import change as ch
from shiftlens.operators import metric as mt
from shiftlens.plans.investigate import change_of_all_dimensions, drill_down, investigate
from shiftlens.plans.model import catalogue, tpch_model
from shiftlens.sources.derived import with_duplicated_items
from shiftlens.session import lean, materialize, scratch_path
from shiftlens.sources.tables import LazyTables


def finish(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles and widen ints, keeping column order."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            if places == 6:  # large values at 4 places: summation order moves their 6th decimal
                c = F.when(F.abs(c) >= 1e15, c).when(F.abs(c) >= 1e5, F.round(c, 4)).otherwise(F.round(c, 6))
            else:
                c = F.round(c, places)
            c = c + F.lit(0.0)  # no negative zero
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _ctx(spark: SparkSession, sf_dir: str, key: str):
    return LazyTables(spark, sf_dir), tpch_model(), catalogue()[key]


def _base(spark, sf_dir, key):
    t, m, s = _ctx(spark, sf_dir, key)
    return mt.metric_base(t, m, s)


# ---- metric layer -------------------------------------------------------------------------------
def q_tag_periods(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "order_count")
    return mt.tag_periods(t, m, s).select("o_orderkey", "period")


def q_base_item_revenue(spark, sf_dir):
    return finish(_base(spark, sf_dir, "item_revenue"))


def q_within_segment(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "revenue")
    base = mt.metric_base(t, m, s)
    bridge = mt.segment_bridge(t, m, s, ["market_segment"])
    return finish(mt.within_segment(base, bridge, "market_segment", "AUTOMOBILE"))


def q_totals(key):
    def run(spark, sf_dir):
        return finish(mt.metric_total(_base(spark, sf_dir, key)))
    return run


def q_bridge(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "item_revenue")
    return mt.segment_bridge(t, m, s)


def q_by_dimension(key):
    def run(spark, sf_dir):
        t, m, s = _ctx(spark, sf_dir, key)
        by = mt.metric_by_dimension(mt.metric_base(t, m, s), mt.segment_bridge(t, m, s), m.dimension_names)
        return finish(by)
    return run


def q_duplicate_counts(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "item_revenue")
    return mt.duplicate_counts(t, m, s)


# ---- change analysis ----------------------------------------------------------------------------
def q_change(key):
    def run(spark, sf_dir):
        t, m, s = _ctx(spark, sf_dir, key)
        return finish(ch.total_change(mt.metric_total(mt.metric_base(t, m, s)), s.kind))
    return run


def _pivot(spark, sf_dir, key):
    t, m, s = _ctx(spark, sf_dir, key)
    by = mt.metric_by_dimension(mt.metric_base(t, m, s), mt.segment_bridge(t, m, s), m.dimension_names)
    return ch.pivot_periods(by)


def q_pivot(key):
    def run(spark, sf_dir):
        return finish(_pivot(spark, sf_dir, key))
    return run


def q_contributions(spark, sf_dir):
    piv = _pivot(spark, sf_dir, "order_count")
    out = ch.segment_contributions(piv, "dimension", "total_a", "total_b")
    return finish(out.select("dimension", "segment", "total_a", "total_b", "delta", "share_of_change", "pct_change"))


def q_mix_rate_segments(spark, sf_dir):
    piv = _pivot(spark, sf_dir, "large_item_rate")
    out = ch.mix_rate_segments(piv, "total_a", "n_a", "total_b", "n_b")
    return finish(out.select("dimension", "segment", "weight_a", "weight_b", "rate_a", "rate_b", "mix_effect",
                             "rate_effect", "interaction", "total_effect"))


def q_mix_rate_summary(spark, sf_dir):
    piv = _pivot(spark, sf_dir, "large_item_rate")
    return finish(ch.mix_rate_summary(piv, "total_a", "n_a", "total_b", "n_b"))


def _abnormal(spark, sf_dir, key, tables=None):
    t, m, s = _ctx(spark, sf_dir, key)
    t = tables or t
    base, bridge = mt.metric_base(t, m, s), mt.segment_bridge(t, m, s)
    change = ch.total_change(mt.metric_total(base), s.kind)
    return base, bridge, change_of_all_dimensions(base, bridge, change, s.kind, m.dimension_names), m, s


def q_ranked(key):
    def run(spark, sf_dir):
        _, _, abnormal, _, s = _abnormal(spark, sf_dir, key)
        ranked = ch.rank_segments(abnormal, lambda df: materialize(df, "checkpoint"))
        cols = ["dimension", "segment", "value_a", "value_b", "delta", "abnormal", "share_of_change"]
        if s.kind != ch.TOTAL:
            cols += ["mix_effect", "rate_effect", "interaction"]
        return finish(ranked.select(*cols, "rank_in_dimension"))
    return run


def q_candidates(key):
    def run(spark, sf_dir):
        _, _, abnormal, m, _ = _abnormal(spark, sf_dir, key)
        return finish(ch.top_candidates(abnormal, m.dimension_names))
    return run


def q_drill(key):
    def run(spark, sf_dir):
        base, bridge, abnormal, m, s = _abnormal(spark, sf_dir, key)
        cand = ch.top_candidates(abnormal, m.dimension_names)
        return finish(drill_down(base, bridge, cand, s.kind, m.dimension_names))
    return run


def _planted_dup(spark, sf_dir, key):
    t, m, s = _ctx(spark, sf_dir, key)
    return with_duplicated_items(t, m, s), m, s


def q_dup_counts_planted(spark, sf_dir):
    t, m, s = _planted_dup(spark, sf_dir, "item_revenue")
    return mt.duplicate_counts(t, m, s)


def q_dup_findings_planted(spark, sf_dir):
    t, m, s = _planted_dup(spark, sf_dir, "item_revenue")
    return finish(ch.duplicate_findings(mt.duplicate_counts(t, m, s)))


def q_investigate(key, planted_dup: bool = False):
    def run(spark, sf_dir):
        if planted_dup:
            t, m, s = _planted_dup(spark, sf_dir, key)
        else:
            t, m, s = _ctx(spark, sf_dir, key)
        # base and bridge feed every step: written once to the checkpoint folder
        inv = investigate(t, m, s, cache="checkpoint")
        return finish(inv.top(5).select("rank", "dimension", "segment", "share_of_change", "duplicate_rate_b"))
    return run


def q_confidence(key, planted_dup: bool = False):
    def run(spark, sf_dir):
        if planted_dup:
            t, m, s = _planted_dup(spark, sf_dir, key)
        else:
            t, m, s = _ctx(spark, sf_dir, key)
        inv = investigate(t, m, s, cache="none")
        return inv.confidence
    return run


QUESTION, CONTEXT_DATASET = "why did the metric change", "en"


def _evidence(spark, sf_dir, key, planted_dup: bool = False):
    """The investigation's evidence document with related documents: one row."""
    t, m, s = _planted_dup(spark, sf_dir, key) if planted_dup else _ctx(spark, sf_dir, key)
    inv = investigate(t, m, s, cache="checkpoint", chunks=corpus_chunks(spark, sf_dir), question=QUESTION, dataset=CONTEXT_DATASET)
    return inv.evidence(s)


def q_evidence(key, planted_dup: bool = False):
    """The evidence document taken apart again: one row per field, numbers at 4 places."""
    def run(spark, sf_dir):
        lists = ["top_candidates", "drill_down_inside_top_candidate", "data_quality_findings", "related_documents"]
        schema = "overall_change map<string,string>, confidence string, " + ", ".join(f"{n} array<map<string,string>>" for n in lists)
        doc = _evidence(spark, sf_dir, key, planted_dup).select(F.from_json("evidence_json", schema).alias("e")).select("e.*")
        parts = [doc.select(F.lit(n).alias("part"), F.posexplode(n).alias("pos", "entry")) for n in lists]
        parts += [doc.select(F.lit("overall_change").alias("part"), F.lit(0).alias("pos"), F.col("overall_change").alias("entry")),
                  doc.select(F.lit("confidence").alias("part"), F.lit(0).alias("pos"), F.create_map(F.lit("confidence"), "confidence").alias("entry"))]
        rows = reduce(DataFrame.unionByName, parts).select("part", "pos", F.explode("entry").alias("field", "txt"))
        num = F.col("txt").try_cast("double")
        return finish(rows.select("part", "pos", "field", num.alias("num"), F.when(num.isNull(), F.col("txt")).alias("txt")), places=4)
    return run


def q_report_check(spark, sf_dir):
    """G1-G3 on a report about the investigation: its numbers come from the evidence, but for one that is 1,234 too high."""
    ev = _evidence(spark, sf_dir, "order_count").select(F.lit("order_count").alias("report_id"), "evidence_json")
    v = F.from_json(F.get_json_object("evidence_json", "$.overall_change"), "value_a double, value_b double, pct_change double")
    count = lambda c: F.format_number(c, 0)
    report = ev.select("report_id", v.alias("v")).select("report_id", F.concat(
        F.lit("Orders went from "), count(F.col("v.value_a")), F.lit(" to "), count(F.col("v.value_b")), F.lit(" (caf\u00e95, "),
        F.format_number("v.pct_change", 1), F.lit(" %); 3 segments stand out and "), count(F.col("v.value_b") + 1234), F.lit(" were expected.")).alias("text"))
    written = grounding.extract_numbers(report, ["report_id"], "text")
    return finish(grounding.unsupported_numbers(written, grounding.evidence_values(grounding.json_numbers(ev, ["report_id"], "evidence_json"))))


def q_query_log(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "order_count")
    log = au.log_queries(spark, investigate(t, m, s, cache="checkpoint").steps())
    return log.select("query_id", "purpose", "row_count")


# ---- retrieval ----------------------------------------------------------------------------------
from shiftlens.operators import retrieval as rt, search as se  # noqa: E402
from shiftlens.sources.derived import dated_corpus, with_front_matter  # noqa: E402
from shiftlens.sources.documents import build_chunks, export_chunks, load_chunks, read_markdown, write_chunks, write_markdown  # noqa: E402

SEARCH_WINDOW = ("1998-04-01", "1998-07-01")


def corpus_chunks(spark, sf_dir):
    """Chunks of the dated corpus (documents have no blank lines, so lines are the paragraphs).

    Written once to the checkpoint folder, as the chunk store would be at ingest time, so the
    several passes of a search read stored chunks instead of re-chunking and re-embedding. The documents
    are dealt out first, because a table may be one file with one row group, and never over fewer tasks than their scan has."""
    docs = dated_corpus(LazyTables(spark, sf_dir)["documents"])
    partitions = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    with lean(spark):
        return materialize(build_chunks(docs, separator="\n", partitions=partitions), "checkpoint")


DATASETS = ("de", "en", "es", "fr")


def benchmark_queries(spark, sf_dir):
    """Benchmark texts as queries, dealt over the datasets and over three windows (bounded, open at the end, none)."""
    b = LazyTables(spark, sf_dir)["benchmark"]
    kind = F.col("item_id") % 3
    day = lambda i, on: F.when(kind.isin(on), F.lit(SEARCH_WINDOW[i]).cast("date"))
    dataset = F.element_at(F.array(*map(F.lit, DATASETS)), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), dataset.alias("dataset"), F.col("text").alias("qtext"),
                    day(0, [0, 1]).alias("start"), day(1, [0]).alias("end"))


def q_front_matter(spark, sf_dir):
    docs = with_front_matter(LazyTables(spark, sf_dir)["documents"])
    p = rt.parse_front_matter(docs)
    return p.select("doc_id", "title", "doc_type", "doc_date", F.length("body").cast("bigint").alias("body_chars"),
                    F.md5("body").alias("body_md5"))


def q_chunks(spark, sf_dir):
    c = corpus_chunks(spark, sf_dir)
    return c.select("dataset", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "doc_date",
                    F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_tokens(spark, sf_dir):
    d = LazyTables(spark, sf_dir)["documents"]
    t = rt.tokens("text")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def q_hash_embed(spark, sf_dir):
    d = LazyTables(spark, sf_dir)["documents"]
    return rt.hash_embed_sparse(d, ["doc_id"], "text")


def q_cosine_centroid(spark, sf_dir, top: int = 5):
    """Vectors ranked by cosine to their own label's mean vector (top ``top`` per label)."""
    e = LazyTables(spark, sf_dir)["embeddings"]
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    centroid = (parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
                .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c"))
                .select("label", F.transform("_c", lambda s: s["m"]).alias("qvec")))
    scored = rt.cosine_scores(e, centroid, ["label"])
    w = Window.partitionBy("label").orderBy(F.col("cosine").desc(), "vec_id")
    return finish(scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
                  .select("label", "vec_id", "cosine", "rank"))


def q_bm25_top(spark, sf_dir, top: int = 10):
    return finish(se.bm25_top(corpus_chunks(spark, sf_dir), benchmark_queries(spark, sf_dir), top))


def q_within_window(spark, sf_dir):
    c = corpus_chunks(spark, sf_dir)
    return finish(rt.within_window(c, *SEARCH_WINDOW).select("dataset", "doc_id", "chunk_no", "doc_date"))


def q_search(spark, sf_dir):
    hits = se.search(corpus_chunks(spark, sf_dir), benchmark_queries(spark, sf_dir), k=3)
    return hits.select("query_id", "hit_rank", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                       "doc_date", "score", "rank_bm25", "rank_cos")


def q_find_context(spark, sf_dir):
    t, m, s = _ctx(spark, sf_dir, "order_count")
    _, _, abnormal, _, _ = _abnormal(spark, sf_dir, "order_count")
    cand = ch.top_candidates(abnormal, m.dimension_names)
    return finish(se.find_context(corpus_chunks(spark, sf_dir), cand, s.name, QUESTION, CONTEXT_DATASET, s.period_b))


def q_rrf(spark, sf_dir, k: int = 5):
    """R8 on its own: two rankings of each label's vectors (by length and by first component), fused."""
    e = LazyTables(spark, sf_dir)["embeddings"].select(F.col("label").alias("query_id"), "vec_id", rt.norm("embedding").alias("long"),
                                                       F.col("embedding")[0].cast("double").alias("first"))
    parts = []
    for name in ("long", "first"):
        w = Window.partitionBy("query_id").orderBy(F.round(name, 6).desc(), "vec_id")
        parts.append(e.select("query_id", "vec_id", F.lit(name).alias("list_name"), F.row_number().over(w).alias("rank")))
    return finish(rt.rrf(parts[0].unionByName(parts[1]), ["vec_id"], k))


def _store(spark, name):
    return scratch_path(spark, name)


def q_chunk_store(spark, sf_dir):
    """The chunk store written, one dataset replaced by smaller chunks, exported and read back."""
    docs = dated_corpus(LazyTables(spark, sf_dir)["documents"])
    path = _store(spark, "store")
    write_chunks(build_chunks(docs, separator="\n"), path)
    write_chunks(build_chunks(docs.filter("dataset = 'en'"), separator="\n", max_chars=400), path, dataset="en")
    export_chunks(load_chunks(spark, path), f"{path}-export")
    c = spark.read.parquet(f"{path}-export")
    return c.select("dataset", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "doc_date", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


def q_saved_runs(spark, sf_dir):
    """Runs, queries and feedback saved with their audit entries, read back and counted per dataset."""
    runs, queries, fb = _runlog(spark, sf_dir)
    path = _store(spark, "runs")
    early = F.col("created_at") < F.timestamp_seconds(F.lit(START + 60 * 100))
    for part in (early, ~early):  # two calls: the second continues the chains of the first
        save_runs(path, runs.filter(part), queries.join(runs.filter(part), "run_id", "left_semi"), chain_by="run_id")
    save_feedback(path, fb, chain_by="run_id")
    save_feedback(path, fb, chain_by="run_id")  # again: adds nothing
    r, q, f, log = (read_store(spark, path, n) for n in ("runs", "queries", "feedback", "audit_log"))
    counted = r.select("dataset", "run_id").join(q.groupBy("run_id").agg(F.count("*").alias("q")), "run_id", "left") \
        .join(f.groupBy("run_id").agg(F.count("*").alias("f")), "run_id", "left").join(log.groupBy("run_id").agg(F.count("*").alias("e")), "run_id", "left")
    return counted.groupBy("dataset").agg(F.count("*").alias("runs"), F.sum("q").alias("queries"), F.sum("f").alias("feedback"), F.sum("e").alias("entries"))


# ---- ad hoc, anomaly scan, grounding, JSON ------------------------------------------------------
from shiftlens.operators import adhoc, anomaly, grounding, jsonx  # noqa: E402
from shiftlens.sources.derived import customer_reports, model_replies, with_unusual_day, with_unusual_order_day  # noqa: E402
from shiftlens.sources.tables import load_dataset  # noqa: E402

ASK_SQL = ("SELECT c.c_mktsegment AS segment, COUNT(*) AS n_orders, "
           "CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue "
           "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")


def q_ask_sql(spark, sf_dir):
    load_dataset(spark, sf_dir, names=("orders", "customer"), register_views=True)
    return finish(adhoc.ask_sql(spark, ASK_SQL))


ASK_CUSTOMERS = "SELECT o_custkey AS customer, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey ORDER BY o_custkey"


def q_ask_sql_capped(spark, sf_dir, max_rows: int = 1000):
    """Q1 with its row cap, which is the feature: the first rows of an ordered answer and whether there were more."""
    load_dataset(spark, sf_dir, names=("orders",), register_views=True)
    return adhoc.ask_sql(spark, ASK_CUSTOMERS, max_rows)


def q_answer_preview(spark, sf_dir):
    """Q1: the first ten rows of an ordered answer, as an answer is written from them."""
    load_dataset(spark, sf_dir, names=("orders",), register_views=True)
    return adhoc.preview(spark.sql(ASK_CUSTOMERS))


def q_markdown_folder(spark, sf_dir):
    """Every document written as a markdown file, the folder read back and its front matter parsed."""
    docs = with_front_matter(LazyTables(spark, sf_dir)["documents"]).select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), "raw")
    path = _store(spark, "markdown")
    write_markdown(docs.repartition(spark.sparkContext.defaultParallelism), path)
    p = rt.parse_front_matter(read_markdown(spark, path))
    return p.select("doc_id", "title", "doc_type", "doc_date", F.length("body").cast("bigint").alias("body_chars"), F.md5("body").alias("body_md5"))


def _metric_scores(tables):
    scored = anomaly.anomaly_scores(anomaly.daily_metrics(tables, tpch_model(), catalogue()), [])
    # averages of prices end in exact fives: a ten-millionth settles how large values are rounded
    for c in ("value", "trend", "seasonal", "residual"):
        scored = scored.withColumn(c, F.when(F.abs(c) >= 1e5, F.round(F.col(c) + 1e-7, 4)).otherwise(F.col(c)))
    return finish(scored)


def q_metric_anomalies(spark, sf_dir):
    """A16 on the key metrics: C1-C10 by day with their scores."""
    return _metric_scores(LazyTables(spark, sf_dir))


def q_metric_anomalies_planted(spark, sf_dir):
    """The unusual days of the key metrics, one of them planted."""
    return _metric_scores(with_unusual_order_day(LazyTables(spark, sf_dir))).filter("is_anomaly")


def q_top_brands(spark, sf_dir):
    t = LazyTables(spark, sf_dir)
    items = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return adhoc.top_k_groups(items, "p_brand", k=5, count_name="n_items")


def _event_scores(events):
    daily = anomaly.daily_series(events, ["event_type"])
    return finish(anomaly.anomaly_scores(daily, ["event_type"]))


def q_anomaly_scores(spark, sf_dir):
    return _event_scores(LazyTables(spark, sf_dir)["events"])


def q_anomalies_planted(spark, sf_dir):
    return _event_scores(with_unusual_day(LazyTables(spark, sf_dir)["events"])).filter("is_anomaly")


def q_extract_numbers(spark, sf_dir):
    pages = LazyTables(spark, sf_dir)["pages"]
    return finish(grounding.extract_numbers(pages, ["page_id"], "html"))


def _reports(spark, sf_dir):
    t = LazyTables(spark, sf_dir)
    return customer_reports(t["orders"], t["customer"])


def q_evidence_values(spark, sf_dir):
    ev, _ = _reports(spark, sf_dir)
    return finish(grounding.evidence_values(ev))


def q_unsupported_numbers(spark, sf_dir):
    ev, rep = _reports(spark, sf_dir)
    written = grounding.extract_numbers(rep, ["report_id"], "text")
    return finish(grounding.unsupported_numbers(written, grounding.evidence_values(ev)))


def q_extract_json(spark, sf_dir):
    replies = model_replies(LazyTables(spark, sf_dir)["events"])
    out = jsonx.extract_json(replies, "reply", "k int", keep=["event_id"])
    return out.select("event_id", "json_text", F.col("parsed.k").cast("bigint").alias("k"))


# ---- run log and audit --------------------------------------------------------------------------
from shiftlens.operators import audit as au  # noqa: E402
from shiftlens.sources.runlog import START, read_store, runs_from_conversations, save_feedback, save_runs  # noqa: E402


def _runlog(spark, sf_dir):
    return runs_from_conversations(LazyTables(spark, sf_dir)["conversations"])


def q_run_digests(spark, sf_dir):
    runs, queries, _ = _runlog(spark, sf_dir)
    return au.run_snapshots(runs, queries).select("run_id", "digest", "n_queries")


def _per_run_log(spark, sf_dir):
    """Per-run chains (parallel): each run's ``run_recorded`` entry, then its feedback."""
    runs, queries, fb = _runlog(spark, sf_dir)
    snaps = au.run_snapshots(runs, queries)
    recorded = (au.run_event_payload(snaps).join(runs.select("run_id", "created_at"), "run_id")
                .select(F.lit("run_recorded").alias("event"), "run_id", "payload",
                        au.utc_iso("created_at").alias("at"),
                        F.struct("created_at", "run_id").alias("_ord")))
    events = recorded.unionByName(au.feedback_events(fb))
    # the log is stored data that verification reads several times: write it once
    return materialize(au.append_audit(None, events, "_ord", chain_by="run_id"), "checkpoint"), runs, queries


def q_audit_append(spark, sf_dir):
    log, _, _ = _per_run_log(spark, sf_dir)
    return log


def _tampered(log):
    """Alter one payload of every 13th run, drop the feedback entry of every 17th run."""
    num = F.substring("run_id", 5, 6).cast("int")
    t = log.withColumn("payload", F.when((num % 13 == 0) & (F.col("seq") == 1),
                                         F.regexp_replace("payload", '"status":"', '"status":"x')).otherwise(F.col("payload")))
    return t.filter(~((num % 17 == 0) & (F.col("seq") == 1)))


def _changed(runs):
    """The question of every 11th run edited, every 19th run deleted."""
    num = F.substring("run_id", 5, 6).cast("int")
    edited = F.when(num % 11 == 0, F.concat(F.col("question"), F.lit("!"))).otherwise(F.col("question"))
    return runs.withColumn("question", edited).filter(num % 19 != 0), num


def q_audit_problems(spark, sf_dir):
    log, runs, queries = _per_run_log(spark, sf_dir)
    runs2, _ = _changed(runs)
    return au.audit_problems(_tampered(log), runs2, queries, chain_by="run_id")


def q_audit_verify(spark, sf_dir):
    log, runs, queries = _per_run_log(spark, sf_dir)
    return au.verify_audit(_tampered(log), runs, queries, chain_by="run_id")


def q_list_runs(spark, sf_dir):
    runs, _, _ = _runlog(spark, sf_dir)
    return finish(au.list_runs(runs, 20).withColumn("created_at", au.utc_ntz(F.col("created_at"))))


def q_feedback_rollup(spark, sf_dir):
    runs, _, fb = _runlog(spark, sf_dir)
    return finish(au.feedback_rollup(fb, runs))


def q_usage_rollup(spark, sf_dir):
    runs, _, _ = _runlog(spark, sf_dir)
    u = au.usage_rollup(runs, ["dataset"])
    return finish(u.withColumn("models", F.array_join("models", ",")))


# ---- profile and single-run lookups -------------------------------------------------------------
from shiftlens.sources.tables import TABLES, profile_columns, profile_date_range, profile_tables  # noqa: E402


def q_profile_date_range(spark, sf_dir):
    return profile_date_range(LazyTables(spark, sf_dir), "orders", "o_orderdate")


def q_profile_tables(spark, sf_dir):
    t = LazyTables(spark, sf_dir)
    return profile_tables({n: t[n] for n in TABLES})


def q_profile_columns(spark, sf_dir):
    t = LazyTables(spark, sf_dir)
    return finish(profile_columns(spark, {n: t[n] for n in TABLES}))


def q_queries_of_run(spark, sf_dir, run_id: str = "run-000042"):
    _, queries, _ = _runlog(spark, sf_dir)
    return au.get_queries(queries, run_id).select("run_id", "query_id", "sql_executed",
                                                  F.col("row_count").cast("bigint").alias("row_count"),
                                                  F.col("duration_ms").cast("bigint").alias("duration_ms"), "error")


def q_audit_tail(spark, sf_dir):
    log, _, _ = _per_run_log(spark, sf_dir)
    return au.audit_tail(log, 50).select("run_id", "seq", "event", "at", "hash")


def q_verify_chain(spark, sf_dir):
    """U5 alone, on one chain over all runs with altered entries; it is verified in buckets."""
    runs, queries, _ = _runlog(spark, sf_dir)
    log = materialize(au.record_runs(None, runs, queries), "checkpoint")
    bad = log.withColumn("payload", F.when(F.col("seq") % 50 == 7, F.replace("payload", F.lit('"status":"'), F.lit('"status":"x'))).otherwise(F.col("payload")))
    return au.verify_chain(bad.filter(F.col("seq") % 70 != 69), bucket_rows=64)


def q_verify_runs(spark, sf_dir):
    """U6 alone: questions edited, runs deleted, one entry in 23 without a digest."""
    log, runs, queries = _per_run_log(spark, sf_dir)
    runs2, num = _changed(runs)
    log = log.withColumn("payload", F.when(num % 23 == 0, F.regexp_replace("payload", '"digest":"[0-9a-f]*",', "")).otherwise(F.col("payload")))
    return au.verify_runs(log, au.run_snapshots(runs2, queries)).select("run_id", "seq", "problem")


def q_unlogged_runs(spark, sf_dir):
    log, runs, _ = _per_run_log(spark, sf_dir)
    return au.unlogged_runs(_tampered(log), runs)


def q_baseline_runs(spark, sf_dir):
    """Entries for the runs that a tampered log no longer mentions."""
    log, runs, queries = _per_run_log(spark, sf_dir)
    num = F.substring("run_id", 5, 6).cast("int")
    return au.baseline_runs(log.filter(num % 3 != 0), runs, queries, "2024-02-01T00:00:00+00:00", chain_by="run_id") \
        .select("run_id", "seq", "event", "payload", "hash")


def q_get_run(spark, sf_dir, run_id: str = "run-000042"):
    runs, _, _ = _runlog(spark, sf_dir)
    return finish(au.get_run(runs, run_id).select("run_id", "question", "dataset", "status", "duration_s"))


def q_nested_evidence(spark, sf_dir):
    """G2 on nested evidence documents, one per customer: numbers at any depth and inside strings."""
    t = LazyTables(spark, sf_dir)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    per = t["orders"].groupBy(F.col("o_custkey").alias("report_id")).agg(F.count("*").alias("n"), F.max(price).alias("most"), F.min(price).alias("least"))
    doc = per.select("report_id", F.to_json(F.struct(
        F.struct("n", F.array("least", "most").alias("5 prices")).alias("orders"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("none"),
        F.concat(F.lit('He said "caf\u00e95": '), (F.col("n") + 20).cast("string"), F.lit(",000 of "), (-F.col("least")).cast("string")).alias("note"))).alias("j"))
    return finish(grounding.evidence_values(grounding.json_numbers(doc, ["report_id"], "j")))
