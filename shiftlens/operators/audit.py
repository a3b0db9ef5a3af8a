"""Run log and tamper-evident audit trail.

Every record that must be trusted is hashed in canonical JSON form (sorted keys, compact
separators, ASCII escapes) with SHA-256. Audit entries form hash chains: an entry's hash covers
its fields and the previous entry's hash; the first entry of a chain follows 64 zeros.

- Appending (U4) is sequential by definition: each hash needs the one before. ``chain_by`` runs
  one chain per key in parallel (an extension); without it there is one chain, as in the original
  design, and the new entries of that chain are hashed in one task.
- Verifying (U5) is parallel: an entry's expected hash uses only the previous entry's **stored**
  hash. A chain is cut into sequence buckets; inside a bucket a ``lag`` gives the
  predecessor, and the first entry of a bucket takes the last stored hash of the nearest earlier
  non-empty bucket (one small per-bucket table). No task holds the whole log.
- The payload is hashed as stored (canonical text); a whitespace-only edit is therefore reported,
  which is stricter than re-canonicalising it before hashing.
- Deleting the newest entries cannot be seen from the chain alone; U6/U7 catch it when those
  entries recorded runs that still exist.
"""

from __future__ import annotations

import hashlib
import json
import time
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.functions.canonical import digest, json_int, json_object, json_str, json_str_array
from shiftlens.session import materialize

# ---- fixed values -------------------------------------------------------------------------------
GENESIS = "0" * 64
RUN_EVENTS = ("run_recorded", "run_baselined")
ALTERED = "audit entry altered, removed or out of order"
RUN_DELETED = "run deleted"
RUN_CHANGED = "run or its queries changed after they were recorded"
RUN_UNLOGGED = "run has no audit entry (inserted outside the app?)"
LOG_SCHEMA = "seq bigint, event string, run_id string, payload string, at string, prev_hash string, hash string"
PROBLEM_SCHEMA = "seq bigint, run_id string, problem string"
USAGE_SCHEMA = ("struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,cost_usd:double,"
                "latency_s:double,models:array<string>>")
BUCKET_ROWS = 1 << 20


def py_timestamp_text(ts) -> Column:
    """``str(datetime)`` of a UTC instant: ``YYYY-MM-DD HH:MM:SS[.ffffff]+00:00``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1000000))
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.when(ts.isNull(), F.lit(None)).otherwise(F.concat(utc_seconds(ts), frac, F.lit("+00:00")))


def utc_ntz(ts: Column) -> Column:
    """Wall clock of an instant in UTC, whatever the session's time zone."""
    seconds = F.floor(F.unix_micros(ts.cast("timestamp")) / 1000000)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def utc_seconds(ts: Column) -> Column:
    return utc_ntz(ts).cast("string")


def utc_iso(ts) -> Column:
    """``YYYY-MM-DDTHH:MM:SS+00:00``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.replace(utc_seconds(ts), F.lit(" "), F.lit("T")), F.lit("+00:00"))


# ---- U3 -----------------------------------------------------------------------------------------
SNAPSHOT_SCHEMA = "run_id string, digest string, question string, status string, models array<string>, n_queries bigint"


def _fold_snapshots(batches):
    """Digests of snapshots from their pieces in order: a run's head (kind 0), then its queries (kind 1).

    A run's SHA-256 takes in one piece after another, across batches; nothing of a run is held but its hash."""
    import hashlib

    runs: list[list] = []  # of the current id: [hash so far, end of the text, question, status, models, queries]
    current, out = None, []

    def close():
        for h, end, question, status, models, n in runs:
            h.update(("]" + end).encode())
            out.append((current, h.hexdigest(), question, status, models, n))
        runs.clear()

    def batch():
        cols = list(zip(*out)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["run_id", "digest", "question", "status", "models", "n_queries"])

    for b in batches:
        for run_id, kind, piece, end, question, status, models in zip(*(b.column(c).to_pylist() for c in (
                "run_id", "kind", "piece", "end", "question", "status", "models"))):
            if run_id != current or run_id is None:
                close()
                current = run_id
            if kind == 0:
                runs.append([hashlib.sha256((piece + "[").encode()), end, question, status, models, 0])
            for r in runs if kind == 1 and run_id is not None else ():
                r[0].update((("," if r[5] else "") + piece).encode())
                r[5] += 1
        yield batch()
    close()
    yield batch()


def run_snapshots(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(run_id, digest, question, status, models, n_queries)`` per run.

    The digest covers the run's fields and its queries ordered by id (text order), as one canonical JSON text. ``report``
    is stored canonical JSON text and embedded as is. The text is never put together: a task folds its pieces, sorted
    by run and query, into the hash, so a run may have any number of queries. Queries of unknown runs are left out."""
    q = queries.select("run_id", F.lit(1).alias("kind"), F.col("query_id").alias("key"), json_object({
        "query_id": json_str("query_id"), "sql_executed": json_str("sql_executed"),
        "row_count": json_int("row_count"), "error": json_str("error")}).alias("piece"))
    models = F.coalesce(F.from_json("usage", USAGE_SCHEMA)["models"], F.array().cast("array<string>"))
    r = runs.withColumn("_models", models)
    # the fields of the snapshot in order of name, cut where the queries stand
    before = {"created_at": json_str(py_timestamp_text("created_at")), "dataset": json_str("dataset"), "models": json_str_array("_models")}
    after = {"question": json_str("question"), "report": F.coalesce(F.col("report"), F.lit("null")), "run_id": json_str("run_id"),
             "status": json_str("status")}
    head = F.concat(F.lit("{"), *[x for k, v in before.items() for x in (F.lit(f'"{k}":'), v, F.lit(","))], F.lit('"queries":'))
    end = F.concat(*[x for k, v in after.items() for x in (F.lit(f',"{k}":'), v)], F.lit("}"))
    heads = r.select("run_id", F.lit(0).alias("kind"), head.alias("piece"), end.alias("end"), "question", "status", F.col("_models").alias("models"))
    # dealt by a hash of the id of its own: a deal by the id itself may be taken for one that both sides of the union have already,
    # which does not hold where they were cached with unlike numbers of partitions
    pieces = heads.unionByName(q, allowMissingColumns=True).repartition(F.xxhash64("run_id")).sortWithinPartitions("run_id", "kind", "key", "piece")
    return pieces.drop("key").mapInArrow(_fold_snapshots, SNAPSHOT_SCHEMA)


def run_event_payload(snapshots: DataFrame) -> DataFrame:
    """Payload of a ``run_recorded`` / ``run_baselined`` entry, canonical text."""
    return snapshots.select("run_id", json_object({
        "digest": json_str("digest"), "question": json_str("question"), "status": json_str("status"),
        "models": json_str_array("models"), "queries": json_int("n_queries")}).alias("payload"))


# ---- U4 -----------------------------------------------------------------------------------------
def entry_text(seq: Column, event: Column, run_id: Column, payload: Column, at: Column, prev: Column) -> Column:
    """Canonical text of an audit entry (the payload is canonical JSON text already)."""
    return json_object({"seq": json_int(seq), "event": json_str(event), "run_id": json_str(run_id),
                        "payload": payload, "at": json_str(at), "prev_hash": json_str(prev)})


def _chain_batches(batches):
    """Hash entries in (chain, order) order; a partition holds whole chains, sorted. The state
    (last seq and hash per chain) is carried across the partition's Arrow batches."""
    state: dict[str, tuple[int, str]] = {}
    for pdf in batches:
        rows = []
        for ch, ev, run_id, payload, at, last_seq, last_hash in zip(
                pdf["_chain"], pdf["event"], pdf["run_id"], pdf["payload"], pdf["at"], pdf["_last_seq"],
                pdf["_last_hash"]):
            if ch not in state:
                state.clear()  # chains arrive one after another: keep only the current one
                state[ch] = (int(last_seq) if pd.notna(last_seq) else 0,
                             last_hash if isinstance(last_hash, str) else GENESIS)
            seq, prev = state[ch]
            seq += 1
            held = json.loads(payload)
            payload = json.dumps(held, sort_keys=True, separators=(",", ":"))  # stored as it is hashed
            entry = {"seq": seq, "event": ev, "run_id": str(run_id), "payload": held, "at": at, "prev_hash": prev}
            h = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            rows.append((ch, seq, ev, str(run_id), payload, at, prev, h))
            state[ch] = (seq, h)
        yield pd.DataFrame(rows, columns=["_chain", "seq", "event", "run_id", "payload", "at", "prev_hash", "hash"])


def append_audit(log: DataFrame | None, events: DataFrame, order: str, chain_by: str | None = None, keep_chain: bool = False) -> DataFrame:
    """U4: new entries for ``events (event, run_id, payload, at, <order>)``, chained after ``log``.

    Payloads are JSON in any form; the entry stores the canonical text that its hash covers.
    Returns the new entries only (append them to the stored log). With ``chain_by`` each key has
    its own chain and sequence; chains are hash-partitioned and hashed in parallel, one Python
    pass per partition (not per chain). ``keep_chain``: the entries also have the column ``chain_by``."""
    key = F.col(chain_by) if chain_by else F.lit("")
    ev = events.select(key.cast("string").alias("_chain"), "event", F.col("run_id").cast("string").alias("run_id"),
                       "payload", "at", F.col(order).alias("_o"))
    if log is not None:
        lkey = F.col(chain_by) if chain_by else F.lit("")
        last = (log.select(lkey.cast("string").alias("_chain"), "seq", "hash").groupBy("_chain")
                .agg(F.max("seq").alias("_last_seq"), F.max_by("hash", "seq").alias("_last_hash")))
        ev = ev.join(last, "_chain", "left")
    else:
        ev = ev.withColumn("_last_seq", F.lit(None).cast("bigint")).withColumn("_last_hash", F.lit(None).cast("string"))
    ordered = ev.repartition("_chain").sortWithinPartitions("_chain", "_o").drop("_o")
    out = ordered.mapInPandas(_chain_batches, "_chain string, " + LOG_SCHEMA)
    return out.withColumnRenamed("_chain", chain_by) if keep_chain and chain_by and chain_by != "run_id" else out.drop("_chain")


# ---- U5 -----------------------------------------------------------------------------------------
def expected_hash(seq, event, run_id, payload, at, prev) -> Column:
    return digest(entry_text(seq, event, run_id, payload, at, prev))


def verify_chain(log: DataFrame, chain_by: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Entries whose stored previous hash or own hash does not match, ``(seq, run_id, problem)``.

    ``chain_by``: one chain per key; without it there is one chain. A chain that is longer than ``bucket_rows`` is verified in
    sequence buckets as described in the module notes, so it is many tasks; shorter chains need one ``lag`` and no join (the
    table of bucket ends is empty for them, which adaptive execution takes out of the plan)."""
    chain = F.col(chain_by).cast("string") if chain_by else F.lit("")
    b = log.withColumn("_chain", chain).withColumn("_bucket", F.floor(F.col("seq") / F.lit(bucket_rows)))
    long = b.filter(F.col("seq") >= bucket_rows).select("_chain").distinct()
    last = b.select("_chain", "_bucket", "seq", "hash").join(long, "_chain", "left_semi") \
        .groupBy("_chain", "_bucket").agg(F.max_by("hash", "seq").alias("_bucket_last"))
    wb = Window.partitionBy("_chain").orderBy("_bucket")  # one row per ``bucket_rows`` entries
    carry = last.select("_chain", "_bucket", F.lag("_bucket_last").over(wb).alias("_carry"))
    w = Window.partitionBy("_chain", "_bucket").orderBy("seq")
    chk = (b.join(carry, ["_chain", "_bucket"], "left")
           .withColumn("_prev", F.coalesce(F.lag("hash").over(w), F.col("_carry"), F.lit(GENESIS))))
    bad = (F.col("prev_hash") != F.col("_prev")) | (
        F.col("hash") != expected_hash(F.col("seq"), F.col("event"), F.col("run_id"), F.col("payload"), F.col("at"),
                                       F.col("_prev")))
    return chk.filter(F.coalesce(bad, F.lit(True))).select(
        "seq", F.lit(None).cast("string").alias("run_id"), F.lit(ALTERED).alias("problem"))


# ---- U6 / U7 ------------------------------------------------------------------------------------
def verify_runs(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Run entries whose run is gone, or whose current digest differs from the logged one."""
    entries = log.filter(F.col("event").isin(*RUN_EVENTS)).select(
        "seq", "run_id", F.get_json_object("payload", "$.digest").alias("_logged"))
    j = entries.join(snapshots.select("run_id", F.col("digest").alias("_now")), "run_id", "left")
    return j.filter(F.col("_now").isNull() | ~F.col("_now").eqNullSafe(F.col("_logged"))).select(
        "seq", "run_id", F.when(F.col("_now").isNull(), F.lit(RUN_DELETED)).otherwise(F.lit(RUN_CHANGED))
        .alias("problem"))


def unlogged_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs without a run entry in the log."""
    logged = log.filter(F.col("event").isin(*RUN_EVENTS)).select("run_id")
    return runs.select("run_id").join(logged, "run_id", "left_anti").select(
        F.lit(None).cast("bigint").alias("seq"), "run_id", F.lit(RUN_UNLOGGED).alias("problem"))


# ---- U8 -----------------------------------------------------------------------------------------
def audit_problems(log: DataFrame, runs: DataFrame, queries: DataFrame, chain_by: str | None = None) -> DataFrame:
    """U8 (detail): every problem of U5-U7."""
    snaps = run_snapshots(runs, queries)
    return verify_chain(log, chain_by).unionByName(verify_runs(log, snaps)).unionByName(unlogged_runs(log, runs))


def verify_audit(log: DataFrame, runs: DataFrame, queries: DataFrame, chain_by: str | None = None) -> DataFrame:
    """U8: one row ``(intact, entries, problems)``; both counts come from one union and aggregate."""
    probs = audit_problems(log, runs, queries, chain_by).select(F.lit(0).alias("_e"), F.lit(1).alias("_p"))
    ents = log.select(F.lit(1).alias("_e"), F.lit(0).alias("_p"))
    agg = ents.unionByName(probs).agg(F.sum("_e").cast("bigint").alias("entries"),
                                      F.sum("_p").cast("bigint").alias("problems"))
    return agg.select((F.coalesce("problems", F.lit(0)) == 0).alias("intact"),
                      F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("problems", F.lit(0)).alias("problems"))


# ---- U9 -----------------------------------------------------------------------------------------
def baseline_runs(log: DataFrame | None, runs: DataFrame, queries: DataFrame, at: str,
                  chain_by: str | None = None) -> DataFrame:
    """``run_baselined`` entries for runs the log never mentions, in ``created_at`` order."""
    todo = runs if log is None else runs.join(log.select("run_id").distinct(), "run_id", "left_anti")
    snaps = run_snapshots(todo, queries)
    events = (run_event_payload(snaps).join(todo.select("run_id", "created_at", *([chain_by] if chain_by and
                                                                                  chain_by != "run_id" else [])),
                                            "run_id")
              .select(F.lit("run_baselined").alias("event"), "run_id", "payload", F.lit(at).alias("at"),
                      F.struct("created_at", "run_id").alias("_ord"),
                      *([chain_by] if chain_by and chain_by != "run_id" else [])))
    return append_audit(log, events, "_ord", chain_by)


def record_runs(log: DataFrame | None, runs: DataFrame, queries: DataFrame, chain_by: str | None = None, keep_chain: bool = False) -> DataFrame:
    """``run_recorded`` entries for newly saved runs; ``at`` is the run's own time. ``keep_chain`` as in ``append_audit``."""
    snaps = run_snapshots(runs, queries)
    keep = [chain_by] if chain_by and chain_by != "run_id" else []
    events = (run_event_payload(snaps).join(runs.select("run_id", "created_at", *keep), "run_id")
              .select(F.lit("run_recorded").alias("event"), "run_id", "payload",
                      utc_iso("created_at").alias("at"),
                      F.struct("created_at", "run_id").alias("_ord"), *keep))
    return append_audit(log, events, "_ord", chain_by, keep_chain)


def feedback_events(feedback: DataFrame) -> DataFrame:
    """Feedback rows as audit events (payload ``{"comment", "rating"}``)."""
    return feedback.select(F.lit("feedback").alias("event"), "run_id",
                           json_object({"rating": json_int("rating"), "comment": json_str("comment")}).alias("payload"),
                           utc_iso("created_at").alias("at"),
                           F.struct("created_at", "run_id").alias("_ord"))


# ---- U10 / U11 ----------------------------------------------------------------------------------
def list_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """Latest ``n`` runs (a top-k: TakeOrderedAndProject)."""
    return (runs.select("run_id", "question", "dataset", "status", "created_at", "duration_s")
            .orderBy(F.col("created_at").desc(), "run_id").limit(n))


def audit_tail(log: DataFrame, n: int = 50) -> DataFrame:
    """Latest ``n`` audit entries by time; entries of one time by run and falling sequence."""
    return log.orderBy(F.col("at").desc(), "run_id", F.col("seq").desc()).limit(n)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """One run."""
    return runs.filter(F.col("run_id") == run_id)


def get_queries(queries: DataFrame, run_id: str) -> DataFrame:
    """A run's queries ordered by id (text order)."""
    return queries.filter(F.col("run_id") == run_id).orderBy("query_id")


# ---- U12 / U13 ----------------------------------------------------------------------------------
def valid_feedback(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback with a rating in -1..1 for an existing run."""
    return feedback.filter(F.col("rating").between(-1, 1)).join(runs.select("run_id"), "run_id", "left_semi")


def feedback_rollup(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """U12 (re-aimed): answer quality per dataset from valid feedback."""
    fb = valid_feedback(feedback, runs).join(runs.select("run_id", "dataset"), "run_id")
    return fb.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_feedback"), F.avg("rating").alias("avg_rating"),
        F.count(F.when(F.col("rating") > 0, 1)).alias("n_positive"),
        F.count(F.when(F.col("rating") < 0, 1)).alias("n_negative"))


def usage_rollup(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens, cost (6 places), latency (2 places) and the sorted distinct models.

    Models are told apart before they are listed, so a list is as long as there are models."""
    by = by or []
    names = [f"_by{i}" for i in range(len(by))]
    u = runs.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.lit(0).alias("_one"), F.from_json("usage", USAGE_SCHEMA).alias("u"))
    models = (u.select(*names, "_one", F.explode("u.models").alias("m")).distinct().groupBy(*names, "_one")
              .agg(F.sort_array(F.collect_list("m")).alias("models")))
    sums = u.groupBy(*names, "_one").agg(
        F.sum("u.calls").alias("calls"), F.sum("u.prompt_tokens").alias("prompt_tokens"),
        F.sum("u.completion_tokens").alias("completion_tokens"),
        F.round(F.sum("u.cost_usd"), 6).alias("cost_usd"), F.round(F.sum("u.latency_s"), 2).alias("latency_s"))
    same = [F.col(f"s.{n}").eqNullSafe(F.col(f"m.{n}")) for n in [*names, "_one"]]
    return (sums.alias("s").join(models.alias("m"), same, "left")
            .select(*[F.col(f"s.{n}").alias(b) for n, b in zip(names, by)], "calls", "prompt_tokens", "completion_tokens", "cost_usd",
                    "latency_s", F.coalesce("models", F.array().cast("array<string>")).alias("models")))


# ---- U1 -----------------------------------------------------------------------------------------
LOG_ENTRY = ("query_id string, purpose string, sql_executed string, row_count bigint, duration_ms bigint, error string, "
             "preview string")


def logged(df: DataFrame, preview_rows: int = 10) -> tuple[DataFrame, int, list[str]]:
    """Run ``df`` once: its result, written to the shared checkpoint folder, its number of rows, observed on the way, and its
    first rows as JSON, read back from what was written."""
    rows = Observation()
    result = materialize(df.observe(rows, F.count(F.lit(1)).alias("n")), "checkpoint")
    first = result.limit(preview_rows).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).collect()
    return result, rows.get["n"], [r["j"] for r in first]


def query_log_entry(spark: SparkSession, df: DataFrame, query_id: str, purpose: str, sql_text: str,
                    preview_rows: int = 10, error_chars: int | None = None) -> DataFrame:
    """Run ``df`` once and describe it in one row of ``LOG_ENTRY``.

    The number of rows is observed while the query runs; the preview is read from its written result. A failed query has
    its error's first line (cut to ``error_chars`` if given) and no row count."""
    t0 = time.time()
    err, n, shown = None, None, []
    try:
        _, n, shown = logged(df, preview_rows)
    except Exception as ex:  # noqa: BLE001 - the error text is part of the log
        err = str(ex).splitlines()[0][:error_chars]
    ms = int((time.time() - t0) * 1000)
    return spark.createDataFrame([(query_id, purpose, sql_text, n, ms, err, f"[{','.join(shown)}]")], LOG_ENTRY)


def log_queries(spark: SparkSession, steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """U1 for the steps (purpose, text, result) of one investigation: entries ``Q1``, ``Q2``, ... in order."""
    return reduce(DataFrame.unionByName, [query_log_entry(spark, df, f"Q{i}", purpose, text)
                                          for i, (purpose, text, df) in enumerate(steps, 1)])
