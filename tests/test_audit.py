"""Canonical digests equal Python's; the chain verifies; tampering is reported."""

import datetime
import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle_sql
from conftest import SF001
from shiftlens.functions.canonical import json_str
from shiftlens.operators import audit as au
from shiftlens.plans import registered as rq
from shiftlens.session import materialize
from shiftlens.sources import commits
from shiftlens.sources.runlog import read_store, runs_from_conversations, save_feedback, save_runs
from shiftlens.sources.tables import LazyTables


def _log(spark):
    runs, queries, fb = runs_from_conversations(LazyTables(spark, SF001)["conversations"])
    return runs.cache(), queries.cache(), fb


def test_json_strings_match_python(spark):
    samples = ['plain', 'quote " and \\ back', "new\nline\ttab\r\b\f", "ünï ☃ 😀", "\x01\x1f\x7f", "ends\n", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["j"] for r in df.select("i", json_str("s").alias("j")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == json.dumps(s)


def test_snapshot_digests_match_python(spark):
    runs, queries, _ = _log(spark)
    snaps = {r["run_id"]: r["digest"] for r in au.run_snapshots(runs, queries).collect()}
    qs = {}
    for q in queries.collect():
        qs.setdefault(q["run_id"], []).append(q)
    for run in runs.limit(30).collect():
        qq = sorted(qs.get(run["run_id"], []), key=lambda x: x["query_id"])
        snap = {"run_id": run["run_id"], "question": run["question"], "dataset": run["dataset"],
                "status": run["status"], "report": json.loads(run["report"]),
                "models": json.loads(run["usage"]).get("models", []),
                "created_at": str(run["created_at"].replace(tzinfo=datetime.timezone.utc)),
                "queries": [{"query_id": q["query_id"], "sql_executed": q["sql_executed"],
                             "row_count": q["row_count"], "error": q["error"]} for q in qq]}
        canon = json.dumps(snap, sort_keys=True, default=str, separators=(",", ":"))
        assert snaps[run["run_id"]] == hashlib.sha256(canon.encode()).hexdigest()


def test_single_chain_verifies_across_buckets_and_reports_tampering(spark):
    runs, queries, _ = _log(spark)
    log = au.record_runs(None, runs, queries).cache()
    assert log.count() == runs.count()
    assert au.verify_chain(log, bucket_rows=7).count() == 0
    assert au.verify_audit(log, runs, queries).first()["intact"]
    t = (log.withColumn("payload", F.when(F.col("seq") == 5, F.regexp_replace("payload", "completed", "done"))
                        .otherwise(F.col("payload")))
         .filter(F.col("seq") != 20)
         .withColumn("seq", F.when(F.col("seq") == 30, 31).when(F.col("seq") == 31, 30).otherwise(F.col("seq"))))
    assert sorted(r["seq"] for r in au.verify_chain(t, bucket_rows=7).collect()) == [5, 21, 30, 31, 32]
    assert sorted(r["seq"] for r in au.verify_chain(t, bucket_rows=1000).collect()) == [5, 21, 30, 31, 32]


def test_run_changes_deletions_and_unlogged_runs(spark):
    runs, queries, _ = _log(spark)
    log = au.record_runs(None, runs, queries).cache()
    changed = runs.withColumn("question", F.when(F.col("run_id") == "run-000042", F.lit("edited"))
                              .otherwise(F.col("question")))
    probs = au.audit_problems(log.filter(F.col("run_id") != "run-000007"),
                              changed.filter(F.col("run_id") != "run-000010"), queries).collect()
    kinds = {(r["run_id"], r["problem"]) for r in probs}
    assert ("run-000042", au.RUN_CHANGED) in kinds
    assert ("run-000010", au.RUN_DELETED) in kinds
    assert ("run-000007", au.RUN_UNLOGGED) in kinds


def test_appending_continues_the_chain(spark):
    runs, queries, fb = _log(spark)
    first = au.record_runs(None, runs.filter(F.col("run_id") < "run-000050"), queries).cache()
    more = au.record_runs(first, runs.filter(F.col("run_id") >= "run-000050"), queries)
    full = first.unionByName(more)
    assert full.count() == runs.count()
    assert au.verify_chain(full).count() == 0
    base = au.baseline_runs(full, runs, queries, at="2024-02-01T00:00:00+00:00")
    assert base.count() == 0


def test_baseline_runs_append_missing_runs_in_time_order(spark):
    runs, queries, _ = _log(spark)
    first = au.record_runs(None, runs.filter(F.col("run_id") < "run-000020"), queries).cache()
    base = au.baseline_runs(first, runs, queries, at="2024-02-01T00:00:00+00:00").cache()
    assert base.count() == runs.count() - first.count()
    assert {r["event"] for r in base.collect()} == {"run_baselined"}
    order = [r["run_id"] for r in base.orderBy("seq").collect()]
    assert order == sorted(order)  # created_at grows with the run number
    full = first.unionByName(base)
    assert au.verify_audit(full, runs, queries).first()["intact"]


def test_payloads_in_any_form_verify_after_append(spark):
    payloads = ['{"b": 1, "a": 2}', '{"x":1.50}', '{"t": "caf\u00e9 \\u00e9", "n": [1, {"z": null, "y": 1e3}]}', '{}']
    ev = spark.createDataFrame([("note", f"r{i}", p, "2024-01-01T00:00:00+00:00", i) for i, p in enumerate(payloads)],
                               "event string, run_id string, payload string, at string, n int")
    for by in (None, "run_id"):
        log = au.append_audit(None, ev, "n", chain_by=by).cache()
        assert au.verify_chain(log, by).count() == 0
        assert sorted(r["payload"] for r in log.collect()) == sorted(json.dumps(json.loads(p), sort_keys=True, separators=(",", ":")) for p in payloads)


def test_an_entry_without_a_digest_is_reported(spark):
    runs, queries, _ = _log(spark)
    log = au.record_runs(None, runs, queries).withColumn("payload", F.when(F.col("seq") == 3, F.lit('{"status":"completed"}')).otherwise(F.col("payload")))
    assert [(r["seq"], r["problem"]) for r in au.verify_runs(log, au.run_snapshots(runs, queries)).collect()] == [(3, au.RUN_CHANGED)]


def test_digests_do_not_depend_on_the_time_zone(spark):
    got = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            runs, queries, _ = runs_from_conversations(LazyTables(spark, SF001)["conversations"])
            got.append({r["run_id"]: r["digest"] for r in au.run_snapshots(runs, queries).collect()})
            df = spark.sql("SELECT timestamp_micros(v) AS t FROM VALUES (1710054000000000L), (-1500000L), (1704067200250000L) AS x(v)")
            assert [r["s"] for r in df.select(au.py_timestamp_text("t").alias("s")).collect()] == [
                "2024-03-10 07:00:00+00:00", "1969-12-31 23:59:58.500000+00:00", "2024-01-01 00:00:00.250000+00:00"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[1] == got[2]


def test_a_long_chain_per_key_is_verified_in_buckets(spark):
    ev = spark.sql("SELECT 'note' AS event, concat('k', id % 2) AS run_id, '{}' AS payload, '2024-01-01T00:00:00+00:00' AS at, id AS n FROM range(400)")
    log = au.append_audit(None, ev, "n", chain_by="run_id").cache()
    for size in (7, 1000):
        assert au.verify_chain(log, "run_id", bucket_rows=size).count() == 0
        bad = log.filter(~((F.col("run_id") == "k1") & (F.col("seq") == 70)))
        bad = bad.withColumn("payload", F.when((F.col("run_id") == "k0") & (F.col("seq") == 140), F.lit('{"x":1}')).otherwise(F.col("payload")))
        assert sorted(r["seq"] for r in au.verify_chain(bad, "run_id", bucket_rows=size).collect()) == [71, 140]


def test_usage_without_groups_and_without_models(spark):
    runs = spark.createDataFrame([("a", '{"calls":1,"models":["m2","m1"]}'), ("b", '{"calls":2,"models":["m1"]}'), (None, '{"calls":4}')], "dataset string, usage string")
    assert (au.usage_rollup(runs).first()["models"], au.usage_rollup(runs).first()["calls"]) == (["m1", "m2"], 7)
    got = {r["dataset"]: (r["calls"], r["models"]) for r in au.usage_rollup(runs, ["dataset"]).collect()}
    assert got == {"a": (1, ["m1", "m2"]), "b": (2, ["m1"]), None: (4, [])}


def test_saving_runs_and_feedback_continues_the_chain(spark, tmp_path):
    runs, queries, fb = _log(spark)
    store = str(tmp_path)
    early = F.col("run_id") < "run-000050"
    for part in (early, ~early):
        save_runs(store, runs.filter(part), queries.join(runs.filter(part), "run_id", "left_semi"))
    save_feedback(store, fb)
    log = read_store(spark, store, "audit_log")
    assert log.count() == runs.count() + fb.count() and au.verify_audit(log, runs, queries).first()["intact"]
    assert read_store(spark, store, "queries").count() == queries.count()
    assert not save_feedback(store, fb) and not save_runs(store, runs.filter(early), queries.join(runs.filter(early), "run_id", "left_semi"))
    assert read_store(spark, store, "audit_log").count() == log.count() and read_store(spark, store, "runs").count() == runs.count()


def test_a_save_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    runs, queries, fb = _log(spark)
    store = str(tmp_path)
    for broken in ("record_runs", "append_audit"):  # after the tables, or the entries, were written in part
        with monkeypatch.context() as m:
            m.setattr(au, broken, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                save_runs(store, runs, queries)
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            save_runs(store, runs, queries)
    assert all(read_store(spark, store, t).count() == 0 for t in ("runs", "queries", "audit_log", "feedback"))
    assert save_runs(store, runs, queries)  # the retry
    assert read_store(spark, store, "runs").count() == runs.count() and au.verify_audit(read_store(spark, store, "audit_log"), runs, queries).first()["intact"]


def test_of_two_writers_the_slower_one_follows_the_other(spark, tmp_path, monkeypatch):
    """Both read the same head; the one that publishes second makes its entries anew, so the chain does not fork."""
    runs, queries, _ = _log(spark)
    store, early = str(tmp_path), F.col("run_id") < "run-000050"
    publish, raced = commits.CommitLog.publish, []

    def late(self, record, version):
        if not raced:
            raced.append(version)
            monkeypatch.setattr(commits.CommitLog, "publish", publish)
            save_runs(store, runs.filter(~early), queries.join(runs.filter(~early), "run_id", "left_semi"))
        publish(self, record, version)

    monkeypatch.setattr(commits.CommitLog, "publish", late)
    assert save_runs(store, runs.filter(early), queries.join(runs.filter(early), "run_id", "left_semi")) and raced == [0]
    log = read_store(spark, store, "audit_log")
    assert log.count() == runs.count() == log.select("seq").distinct().count() and au.verify_audit(log, runs, queries).first()["intact"]
    assert len(commits.CommitLog(spark, store).records()) == 2


def test_a_number_is_taken_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    log.publish({"n": 0}, 0)
    with pytest.raises(commits.Conflict):
        log.publish({"n": 1}, 0)
    log.publish({"n": 1}, 1)
    assert [r["n"] for r in log.records()] == [0, 1]


def test_a_run_of_many_queries_is_folded(spark):
    """Digest and number of queries of a long run, of runs without queries, of repeated and null run ids."""
    runs = spark.createDataFrame([(i, "q", "d", "s", '{"a":1}', '{"models":["m"]}', datetime.datetime(2024, 1, 1), 1.0) for i in ("r1", "r2", "r2", None)],
                                 "run_id string, question string, dataset string, status string, report string, usage string, created_at timestamp, duration_s double")
    queries = spark.sql("SELECT CASE WHEN id < 20000 THEN 'r1' WHEN id < 20002 THEN 'r2' WHEN id < 20003 THEN 'gone' END AS run_id, concat('Q', id) AS query_id, "
                        "'SELECT 1' AS sql_executed, cast(id AS int) AS row_count, cast(NULL AS string) AS error FROM range(20004)")
    got = sorted((str(r["run_id"]), r["digest"], r["n_queries"]) for r in au.run_snapshots(runs.repartition(3), queries.repartition(5)).collect())

    def want(run_id, ids):
        snap = {"run_id": run_id, "question": "q", "dataset": "d", "status": "s", "report": {"a": 1}, "models": ["m"], "created_at": "2024-01-01 00:00:00+00:00",
                "queries": [{"query_id": q, "sql_executed": "SELECT 1", "row_count": int(q[1:]), "error": None} for q in sorted(f"Q{i}" for i in ids)]}
        return str(run_id), hashlib.sha256(json.dumps(snap, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), len(ids)

    assert got == sorted([want("r1", range(20000)), want("r2", range(20000, 20002)), want("r2", range(20000, 20002)), want(None, [])])
    plan = au.run_snapshots(runs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_short_chains_are_verified_without_a_join(spark):
    ev = spark.sql("SELECT 'note' AS event, concat('k', id % 50) AS run_id, '{}' AS payload, '2024-01-01T00:00:00+00:00' AS at, id AS n FROM range(200)")
    log = materialize(au.append_audit(None, ev, "n", chain_by="run_id"), "checkpoint")
    checked = au.verify_chain(log, "run_id", bucket_rows=1000)
    assert checked.collect() == []
    final = checked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in final and final.count("Window") >= 1


def test_a_logged_query_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(25, numPartitions=3).mapInArrow(count, "id long")
    rows = au.log_queries(spark, [("first", "a", df), ("second", "b", spark.range(4))]).collect()
    assert seen.value == 25
    assert [(r["query_id"], r["purpose"], r["row_count"], len(json.loads(r["preview"]))) for r in rows] == [("Q1", "first", 25, 10), ("Q2", "second", 4, 4)]


def test_query_log_entry_counts_and_previews(spark):
    df = spark.range(25).withColumnRenamed("id", "x")
    row = au.query_log_entry(spark, df, "Q1", "count rows", "SELECT x FROM t").first()
    assert row["row_count"] == 25 and row["error"] is None
    assert len(json.loads(row["preview"])) == 10
    bad = au.query_log_entry(spark, df.selectExpr("x / 0 AS y"), "Q2", "fails", "SELECT x / 0").first()
    assert bad["error"] is not None and bad["row_count"] is None


def test_the_registered_chain_runs_over_all_runs(spark, tmp_path):
    """datasets and days share one chain, in the query and in its SQL."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}") for c in range(1, 3200, 10) for t in range(2)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    n = 320
    want = sorted([s for s in range(1, n + 1) if s % 50 == 7 and s % 70 != 69] + [s for s in range(2, n + 1) if (s - 1) % 70 == 69])
    assert sorted(r["seq"] for r in rq.q_verify_chain(spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(r[0] for r in con.execute(oracle_sql.all_oracles()["u5_verify_chain"]).fetchall()) == want
