"""Run log tables (S5): runs, queries and feedback, saved with their audit entries in one step; and a run log derived
from the ``conversations`` table (one run per conversation) for tests and registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions.canonical import json_int, json_object, json_str, json_str_array
from shiftlens.operators import audit as au
from shiftlens.sources.commits import CommitLog, Conflict

RUN_COLUMNS = ["run_id", "question", "dataset", "status", "report", "usage", "created_at", "duration_s"]
QUERY_COLUMNS = ["run_id", "query_id", "purpose", "sql_submitted", "sql_executed", "row_count", "duration_ms",
                 "error", "preview"]


START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


TABLES = {"runs": "run_id string, question string, dataset string, status string, report string, usage string, created_at timestamp, duration_s double",
          "queries": "run_id string, query_id string, purpose string, sql_submitted string, sql_executed string, row_count int, duration_ms int, "
                     "error string, preview string",
          "feedback": "run_id string, rating smallint, comment string, created_at timestamp",
          "audit_log": au.LOG_SCHEMA}
#: Times that a save is tried anew because another writer was faster.
ATTEMPTS = 5


def read_store(spark: SparkSession, store: str, table: str, records: list[dict] | None = None) -> DataFrame:
    """The published rows of ``runs``, ``queries``, ``feedback`` or ``audit_log``."""
    records = CommitLog(spark, store).records() if records is None else records
    folders = [f"{store.rstrip('/')}/{r['folder']}/{table}" for r in records if table in r["tables"]]
    return spark.read.schema(TABLES[table]).parquet(*folders) if folders else spark.createDataFrame([], TABLES[table])


def _save(store: str, kind: str, tables: dict[str, DataFrame], entries) -> bool:
    """Write the tables and their audit entries, made by ``entries(log)``, and publish all of them in one step."""
    spark = next(iter(tables.values())).sparkSession
    log = CommitLog(spark, store)
    first = next(iter(tables))
    # the content's digest names the save: a repeated call is known by it
    content = tables[first].select(F.xxhash64(*[F.col(c).cast("string") for c in tables[first].columns]).alias("h")) \
        .agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0))).first()
    save_id = f"{kind}-{'-'.join(str(x) for x in content)}"
    folder, written = f"{kind}-{uuid.uuid4().hex}", False
    for _ in range(ATTEMPTS):
        records = log.records()
        if any(r["save_id"] == save_id for r in records):
            return False
        if not written:
            for name, df in tables.items():
                columns = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(TABLES[name])]
                df.select(*columns).write.parquet(f"{store.rstrip('/')}/{folder}/{name}")
            written = True
        saved = {n: spark.read.schema(TABLES[n]).parquet(f"{store.rstrip('/')}/{folder}/{n}") for n in tables}
        # the entries follow the chain's head of this version; if another writer takes the number first, they are made anew
        entries(read_store(spark, store, "audit_log", records) if records else None, saved) \
            .write.mode("overwrite").parquet(f"{store.rstrip('/')}/{folder}/audit_log")
        try:
            log.publish({"save_id": save_id, "folder": folder, "tables": [*tables, "audit_log"]}, len(records))
            return True
        except Conflict:
            continue
    raise Conflict(f"{store}: other writers were faster {ATTEMPTS} times")


def save_runs(store: str, runs: DataFrame, queries: DataFrame, chain_by: str | None = None) -> bool:
    """Save runs, their queries and their audit entries in one step.

    Either all three are seen by ``read_store`` or none: a save that fails on the way leaves nothing visible. A save of
    the same runs again adds nothing (False). The entries follow the newest published one; of two writers
    at a time the slower one makes its entries anew, so chains never fork. Columns beside those of the store are left out."""
    return _save(store, "runs", {"runs": runs, "queries": queries}, lambda log, t: au.record_runs(log, t["runs"], t["queries"], chain_by))


def save_feedback(store: str, feedback: DataFrame, chain_by: str | None = None) -> bool:
    """Save feedback and its audit entries in one step, as ``save_runs`` does."""
    return _save(store, "feedback", {"feedback": feedback}, lambda log, t: au.append_audit(log, au.feedback_events(t["feedback"]), "_ord", chain_by))


def runs_from_conversations(conv: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run per conversation: the first user turn is the question, assistant turns are its
    queries ``Q1..`` (text order), some conversations leave feedback. Deterministic."""
    conv = conv.withColumn("run_id", F.concat(F.lit("run-"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))
    w = Window.partitionBy("run_id").orderBy("turn")
    asst = (conv.filter(F.col("role") == "assistant")
            .withColumn("_n", F.row_number().over(w)))
    queries = asst.select(
        "run_id", F.concat(F.lit("Q"), F.col("_n").cast("string")).alias("query_id"), F.lit("explain").alias("purpose"),
        F.col("text").alias("sql_submitted"), F.col("text").alias("sql_executed"),
        F.length("text").alias("row_count"), (F.col("turn") * 7).cast("int").alias("duration_ms"),
        F.when(F.col("turn") % 5 == 4, F.lit("timeout")).alias("error"), F.lit("[]").alias("preview"))
    per = conv.groupBy("run_id", "conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
        .alias("question"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("_answer"),
        F.count(F.lit(1)).alias("_turns"),
        F.max_by("text", "turn").alias("_last"))
    models = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("model-b"), F.lit("model-a"))) \
        .otherwise(F.array(F.lit("model-a")))
    runs = per.select(
        "run_id", F.coalesce("question", F.lit("")).alias("question"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("lab")).otherwise(F.lit("public")).alias("dataset"),
        F.when(F.col("conv_id") % 5 == 0, F.lit("insufficient_evidence")).otherwise(F.lit("completed")).alias("status"),
        json_object({"summary": json_str("_answer"), "turns": json_int("_turns")}).alias("report"),
        json_object({"calls": json_int("_turns"), "prompt_tokens": json_int(F.col("_turns") * 100),
                     "completion_tokens": json_int(F.col("_turns") * 40),
                     "cost_usd": F.format_string("%.4f", (F.col("_turns") * F.lit(0.0125)).cast("double")),
                     "latency_s": F.format_string("%.2f", (F.col("_turns") * F.lit(1.5)).cast("double")),
                     "models": json_str_array(models)}).alias("usage"),
        F.timestamp_seconds(F.lit(START) + 60 * F.col("conv_id")).alias("created_at"),
        (F.col("_turns") * F.lit(1.5)).cast("double").alias("duration_s"),
        "_last", "conv_id")
    feedback = runs.filter(F.col("conv_id") % 2 == 0).select(
        "run_id", ((F.col("conv_id") / 2).cast("bigint") % 3 - 1).cast("smallint").alias("rating"),
        F.col("_last").alias("comment"),
        (F.col("created_at") + F.expr("INTERVAL 30 SECONDS")).alias("created_at"))
    return runs.select(*RUN_COLUMNS), queries, feedback
