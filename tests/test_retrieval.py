"""Chunking, tokens, embedder, BM25, window filter and the exact fused search."""

import datetime
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from shiftlens.operators import retrieval as rt, search as se
from shiftlens.plans import registered as rq
from shiftlens.session import lean, materialize
from shiftlens.sources.documents import build_chunks


def py_chunks(text, max_chars=900, sep="\n\n"):
    out, cur = [], ""
    for p in (x.strip() for x in text.split(sep)):
        if not p:
            continue
        if cur and len(cur) + len(p) + len(sep) > max_chars:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}{sep}{p}" if cur else p
    if cur:
        out.append(cur)
    return out


def test_chunk_packing_matches_greedy_rule(spark):
    texts = ["a" * 500 + "\n\n" + "b" * 300 + "\n\n" + "c" * 200, "x" * 1000 + "\n\n  \n\n" + "y",
             "", "one\n\n\n\ntwo", " \t lead\n\ntrail \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", rt.chunk_text("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_chunks(t), i


def test_packing_takes_time_in_proportion(spark):
    """10^5 paragraphs: the pointers equal the greedy rule, and no step copies what is packed already."""
    lengths = [(i * 37) % 300 + 1 for i in range(100_000)]
    cuts = rt.next_chunks(np.array(lengths), 900, 2)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(lengths) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    size = lambda a, b: sum(lengths[a:b]) + 2 * (b - a - 1)
    assert all(b - a == 1 or size(a, b) <= 900 for a, b in cuts) and all(size(a, c + 1) > 900 for (a, b), (c, _) in zip(cuts, cuts[1:]))
    text = "\n\n".join("x" * n for n in lengths)
    got = spark.createDataFrame([(text,)], "t string").select(rt.chunk_text("t").alias("c")).first()["c"]
    assert got == py_chunks(text) and rt.next_chunks(np.array([], np.int64), 9, 2) == []
    assert spark.sql("SELECT cast(NULL AS string) AS t").select(rt.chunk_text("t").alias("c")).first()["c"] is None


def test_front_matter_defaults(spark):
    df = spark.createDataFrame([("my_note", "---\ntitle: Hello\ndate: 1998-02-03\n---\nBody text\n"),
                                ("plain_doc", "Just text")], "doc_id string, raw string")
    rows = {r["doc_id"]: r for r in rt.parse_front_matter(df).collect()}
    assert rows["my_note"]["title"] == "Hello" and str(rows["my_note"]["doc_date"]) == "1998-02-03"
    assert rows["my_note"]["body"] == "Body text"
    assert rows["plain_doc"]["title"] == "plain doc" and rows["plain_doc"]["doc_type"] == "document"


def test_hash_embed_equals_python(spark):
    texts = ["Hello world, hello_again 42!", "", "Ünïcode and ASCII mix 7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: (list(r["e"]), list(r["x"])) for r in
           df.select("id", rt.hash_embed("t").alias("e"), rt.hash_embed_expr("t").alias("x")).collect()}
    for i, t in enumerate(texts):
        v = [0.0] * 256
        for tok in re.findall(r"[a-z0-9]+", t.lower()):
            v[int(hashlib.md5(tok.encode()).hexdigest(), 16) % 256] += 1
        assert got[i][0] == v and got[i][1] == v


def test_bm25_matches_hand_formula(spark):
    docs = ["the cat sat", "the dog sat on the mat", "cats and dogs", "the the the"]
    chunks = spark.createDataFrame([(str(i), 0, d) for i, d in enumerate(docs)], "doc_id string, chunk_no int, text string")
    q = spark.createDataFrame([(1, "the cat")], "query_id int, qtext string")
    got = {r["doc_id"]: r["bm25"] for r in se.bm25_top(chunks, q, 10).collect()}
    toks = [re.findall(r"[a-z0-9_]+", d.lower()) for d in docs]
    n, avgdl = len(toks), sum(map(len, toks)) / len(toks)
    dfreq = Counter(t for ts in toks for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in dfreq.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
    for i, ts in enumerate(toks):
        tf = Counter(ts)
        s = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for t in ["the", "cat"]
                if tf[t])
        assert (str(i) in got) == any(tf[t] for t in ["the", "cat"])
        if str(i) in got:
            assert abs(got[str(i)] - s) < 1e-8


def test_window_filter_edges(spark):
    df = spark.createDataFrame([(1, "1998-03-12"), (2, "1998-03-11"), (3, None), (4, "1998-07-21"), (5, "1998-07-22")],
                               "id int, d string").withColumn("doc_date", F.to_date("d"))
    ids = sorted(r["id"] for r in rt.within_window(df, "1998-04-01", "1998-07-01").collect())
    assert ids == [1, 3, 4]
    assert sorted(r["id"] for r in rt.within_window(df, None, "1998-07-01").collect()) == [1, 2, 3, 4]


def test_exact_search_equals_full_ranking(spark):
    chunks = rq.corpus_chunks(spark, SF0001)
    q = rq.benchmark_queries(spark, SF0001)
    fast = {(r["query_id"], r["hit_rank"]): (r["doc_id"], r["chunk_no"], r["score"], r["rank_bm25"], r["rank_cos"])
            for r in se.search(chunks, q, k=3).collect()}
    plain = {(r["query_id"], r["hit_rank"]): (r["doc_id"], r["chunk_no"], r["score"], r["rank_bm25"], r["rank_cos"])
             for r in rt.search_plain(chunks, q, k=3).collect()}
    assert fast == plain and len(fast) > 0


def test_scans_move_no_pairs(spark):
    """What leaves a task of the first scan is cut to its best per query; the second sends counts."""
    index = se.build_index(rq.corpus_chunks(spark, SF0001))
    rows = next(se._query_blocks(rq.benchmark_queries(spark, SF0001), 256, 1 << 20))
    block = se._block(rows, index, 20, False)
    found = se._best(block["index"], spark.sparkContext.broadcast(block["shared"]), 65, 2, False)
    assert found.filter("q >= 0").count() <= 2 * 65 * len(rows)
    assert {r.q for r in found.filter("q < 0").collect()} == {-1}


@pytest.mark.parametrize("segment", [7, 512])
def test_pruned_search_equals_full_ranking_and_scores_fewer(spark, segment, monkeypatch):
    """With small segments and depths the bounds rule chunks out; hits and ranks stay those of the full ranking."""
    chunks, q = rq.corpus_chunks(spark, SF0001), rq.benchmark_queries(spark, SF0001)
    columns = ["query_id", "hit_rank", "doc_id", "chunk_no", "score", "rank_bm25", "rank_cos"]
    index = materialize(se.build_index(chunks, segment), "checkpoint")
    report = []
    got = sorted(tuple(r) for r in se.search(chunks, q, k=2, index=index, report=report).select(*columns).collect())
    assert got == sorted(tuple(r) for r in rt.search_plain(chunks, q, k=2).select(*columns).collect())
    assert [r["list"] for r in report] == ["bm25", "cosine"] and all(0 < r["scored"] <= r["pairs"] for r in report)
    one = materialize(index.coalesce(1), "checkpoint")  # one task: its thresholds rise with every segment
    top = []
    all_ = sorted(tuple(r) for r in se.bm25_top(chunks, q, 10**6, index=one).collect())
    few = sorted(tuple(r) for r in se.bm25_top(chunks, q, 3, index=one, report=top).collect())
    assert few == [r for r in all_ if r[4] <= 3] and top[0]["scored"] < (0.7 if segment == 7 else 0.9) * len(all_)


def test_odd_chunks_and_queries(spark):
    schema = "dataset string, doc_id string, chunk_no int, title string, doc_type string, doc_date date, text string, buckets array<int>, weights array<float>"
    day = datetime.date
    rows = [("en", "b", 0, "t", "d", day(1998, 5, 1), "the cat sat", [1, 5], [2.0, 1.0]), ("en", "a", 0, "t", "d", None, "the cat sat", [1, 5], [2.0, 1.0]),
            ("en", "c", 0, "t", "d", day(1990, 1, 1), "the cat", [1], [1.0]), ("01", "d", 0, "t", "d", None, None, None, None), (None, "e", 0, "t", "d", None, "cat", [], []),
            ("en", "f", 0, "t", "d", day(1998, 5, 2), "", [], [])]
    chunks = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(1, "en", "cat the", day(1998, 4, 1), day(1998, 6, 1)), (2, "01", "cat", None, None), (3, None, "cat", None, None), (4, "en", "", None, None),
                               (5, "en", None, None, None), (6, "zz", "cat", None, None)], "query_id int, dataset string, qtext string, start date, end date")
    columns = ["query_id", "hit_rank", "doc_id", "rank_bm25", "rank_cos"]
    got = sorted(tuple(r) for r in se.search(chunks, q).select(*columns).collect())
    assert got == sorted(tuple(r) for r in rt.search_plain(chunks, q).select(*columns).collect()) and {r[0] for r in got} == {1, 2, 4, 5}


def test_scan_of_a_stored_index_is_pruned(spark, tmp_path):
    chunks = rq.corpus_chunks(spark, SF0001)
    se.write_index(se.build_index(chunks), f"{tmp_path}/index")
    index = se.load_index(spark, f"{tmp_path}/index")
    scan = se._pruned(index, [("en", 10_300, 10_400), ("de", 10_350, 10_500)])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [dataset" in plan and "GreaterThanOrEqual(day_hi,1998-03-15)" in plan and "LessThanOrEqual(day_lo,1998-1" in plan
    q = rq.benchmark_queries(spark, SF0001)
    columns = ["query_id", "hit_rank", "doc_id", "chunk_no", "rank_bm25", "rank_cos"]
    assert sorted(map(tuple, se.search(chunks, q, index=index).select(*columns).collect())) == sorted(map(tuple, se.search(chunks, q).select(*columns).collect()))
    assert "embedding" not in chunks.columns and chunks.select(F.max(F.size("buckets"))).first()[0] <= 256


def test_search_blocks_give_same_hits(spark):
    chunks = rq.corpus_chunks(spark, SF0001)
    q = rq.benchmark_queries(spark, SF0001)
    one = sorted(tuple(r) for r in se.search(chunks, q, k=2).select("query_id", "doc_id", "chunk_no", "score").collect())
    many = sorted(tuple(r) for r in se.search(chunks, q, k=2, block_bytes=900)
                  .select("query_id", "doc_id", "chunk_no", "score").collect())
    assert one == many and one
    assert se.search(chunks, q.limit(0)).count() == 0 and se.search(chunks.limit(0), q).count() == 0


def test_rrf_fuses_ranks(spark):
    ranked = spark.createDataFrame(
        [(1, "a", "bm25", 1), (1, "b", "bm25", 2), (1, "c", "bm25", 3),
         (1, "a", "cos", 3), (1, "b", "cos", 1), (1, "c", "cos", 2)],
        "query_id int, item string, list string, rank int")
    got = [(r["item"], r["hit_rank"]) for r in rt.rrf(ranked, ["item"], k=2).orderBy("hit_rank").collect()]
    # b: 1/62 + 1/61, a: 1/61 + 1/63, c: 1/63 + 1/62
    assert got == [("b", 1), ("a", 2)]


def test_one_pass_chunks_equal_their_parts_and_hold_few_texts(spark, monkeypatch):
    """Chunks, numbers and vectors of the one pass are those of the plain steps, however the texts are cut into parts,
    and no part is much larger than asked."""
    texts = ["a b\u0130 K\u212ael \u2028\n \u00a0x_y z9\n" * 90, None, "", " \n\t", "\x1cq\x1c\n\u3000tail\u2003", "one", "word " * 400 + "\n" + "two"] * 40
    docs = spark.createDataFrame([("en", str(i), datetime.date(1998, 1, 1), t) for i, t in enumerate(texts)], "dataset string, doc_id string, doc_date date, raw string")
    body = rt.strip("raw")
    plain = docs.select("dataset", "doc_id", F.posexplode(rt.chunk_text(body, 300, "\n")).alias("chunk_no", "text"))
    plain = plain.withColumn("v", rt.hash_embed_pairs("text", 256)).select("dataset", "doc_id", "chunk_no", "text", "v.buckets", "v.weights")
    want = sorted(map(tuple, plain.collect()), key=str)
    monkeypatch.setattr(rt, "PART_BYTES", 2000)
    got = build_chunks(docs, max_chars=300, separator="\n")
    assert sorted(map(tuple, got.select("dataset", "doc_id", "chunk_no", "text", "buckets", "weights").collect()), key=str) == want and want
    column = pa.array(texts)
    parts = rt._parts(column, 2000)
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
    assert max(sum(len((t or "").encode()) for t in texts[a + 1:b]) for a, b in parts) <= 2000
    assert rt._parts(pa.array([], pa.string()), 10) == []
    for t in texts[:7]:
        assert [w.decode() for w in rt.split_tokens(t or "", rt.BREAK_EMBED)] == re.findall(rt.EMBED_TOKEN, (t or "").lower())
        assert [w.decode() for w in rt.split_tokens(t or "", rt.BREAK_SEARCH)] == re.findall(rt.SEARCH_TOKEN, (t or "").lower())


def test_a_task_holds_a_bounded_part_of_the_index(spark, tmp_path, monkeypatch):
    """a reader decoded all segments of a file at a time, tasks held Arrow batches of 64 MB, and scan 1 read the index twice, its two
    readings at the same time."""
    import glob

    import pyarrow.parquet as pq

    import shiftlens.session as ss

    chunks, q = rq.corpus_chunks(spark, SF0001), rq.benchmark_queries(spark, SF0001)
    index = se.build_index(chunks.drop("buckets", "weights"), segment=8)
    monkeypatch.setattr(se, "GROUP_BYTES", 20_000)
    se.write_index(index.coalesce(1), f"{tmp_path}/index")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/index/*/*.parquet")]
    assert sum(f.num_rows for f in files) == index.count() and min(f.num_row_groups for f in files) > 1
    stored = se.load_index(spark, f"{tmp_path}/index")
    block = se._block(next(se._query_blocks(q, 256, 1 << 20)), stored, 0, True)
    found = se._best(block["index"], spark.sparkContext.broadcast(block["shared"]), 10, 1, True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(se.bm25_top(chunks, q, index=stored)) == rows(se.bm25_top(chunks, q))

    key, wide = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    old, largest = spark.conf.get(key), lambda: wide.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0]
    assert largest() > 2 * ss.BATCH_BYTES
    with pytest.raises(KeyError), ss.lean(spark):
        assert largest() < 1.1 * ss.BATCH_BYTES
        with ss.lean(spark):
            raise KeyError
    assert spark.conf.get(key) == old


def test_chunks_are_dealt_over_no_fewer_tasks_than_the_scan_has(spark):
    """the corpus came in as many parts as there were cores, whatever its size."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        assert rq.corpus_chunks(spark, SF0001).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(key, old)


def test_no_shuffle_files_stay_behind_chunks_and_index(spark):
    """the shuffle files of chunking and indexing stayed until the driver happened to collect its garbage."""
    import os
    import time

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    chunks = rq.corpus_chunks(spark, SF0001)
    with lean(spark):
        index = se._stored(chunks.drop("buckets", "weights"), None)
    for _ in range(50):  # they are deleted a little later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert chunks.count() == index.agg(F.sum(F.size("chunk_nos"))).first()[0] > 0  # both can still be read
