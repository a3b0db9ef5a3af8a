"""Markdown folder source, chunk store replace-by-dataset, export order."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shiftlens.sources import documents as docs


def test_markdown_folder_to_chunk_store(spark):
    folder = tempfile.mkdtemp(prefix="shiftlens-md-")
    with open(os.path.join(folder, "q3_review.md"), "w") as f:
        f.write("---\ntitle: Q3 review\ndate: 1998-05-02\ntype: memo\n---\nFirst paragraph.\n\nSecond one.\n")
    with open(os.path.join(folder, "plain_note.md"), "w") as f:
        f.write("Only text here.")
    with open(os.path.join(folder, "ignored.txt"), "w") as f:
        f.write("not markdown")
    raw = docs.read_markdown(spark, folder)
    assert sorted(r["doc_id"] for r in raw.collect()) == ["plain_note", "q3_review"]
    chunks = docs.build_chunks(raw, dataset="lab", max_chars=12)
    rows = {(r["doc_id"], r["chunk_no"]): r for r in chunks.collect()}
    assert rows[("q3_review", 0)]["title"] == "Q3 review" and rows[("q3_review", 0)]["doc_type"] == "memo"
    assert [rows[("q3_review", i)]["text"] for i in (0, 1)] == ["First paragraph.", "Second one."]
    assert rows[("plain_note", 0)]["title"] == "plain note" and rows[("plain_note", 0)]["doc_date"] is None

    store = tempfile.mkdtemp(prefix="shiftlens-store-")
    docs.write_chunks(chunks, store)
    docs.write_chunks(chunks.withColumn("dataset", F.lit("public")), store)
    assert docs.load_chunks(spark, store).groupBy("dataset").count().count() == 2
    # replacing one dataset leaves the other untouched
    docs.write_chunks(chunks.filter(F.col("doc_id") == "plain_note"), store)
    docs.write_chunks(chunks.limit(0), f"{store}-2")  # an empty first write leaves nothing
    docs.write_chunks(chunks, f"{store}-2")
    docs.write_chunks(chunks.limit(0), f"{store}-2", dataset="lab")  # replaced by nothing
    docs.write_chunks(chunks.withColumn("dataset", F.lit("public")), f"{store}-2")
    assert {r["dataset"] for r in docs.load_chunks(spark, f"{store}-2").select("dataset").distinct().collect()} == {"public"}
    counts = {r["dataset"]: r["count"] for r in docs.load_chunks(spark, store).groupBy("dataset").count().collect()}
    assert counts == {"lab": 1, "public": 3}


def _chunks(spark, rows):
    schema = docs.CHUNK_SCHEMA
    return spark.createDataFrame([(d, i, 0, "t", "document", None, f"text {i}", [1], [1.0]) for d, i in rows], schema)


def test_replacing_a_dataset_is_one_step(spark, tmp_path, monkeypatch):
    store = str(tmp_path)
    stored = lambda: sorted((str(r["dataset"]), r["doc_id"]) for r in docs.load_chunks(spark, store).collect())
    assert docs.load_chunks(spark, store).count() == 0 and docs.load_chunks(spark, store).columns[-2:] == ["buckets", "weights"]
    docs.write_chunks(_chunks(spark, [("a", "1"), ("a", "2"), ("b/c=1", "3"), ("01", "4"), (None, "5")]), store)
    old = [("01", "4"), ("None", "5"), ("a", "1"), ("a", "2"), ("b/c=1", "3")]
    assert stored() == old
    with monkeypatch.context() as m:  # a writer that fails when its files are there, before it publishes
        m.setattr(docs.CommitLog, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            docs.write_chunks(_chunks(spark, [("a", "9"), ("b/c=1", "9")]), store)
    assert stored() == old
    reader = docs.load_chunks(spark, store)  # a reader keeps what it saw
    docs.write_chunks(_chunks(spark, [("a", "7"), (None, "8")]), store)
    assert stored() == [("01", "4"), ("None", "8"), ("a", "7"), ("b/c=1", "3")]
    assert sorted((str(r["dataset"]), r["doc_id"]) for r in reader.collect()) == old
    docs.write_chunks(_chunks(spark, []), store, dataset="01")
    assert stored() == [("None", "8"), ("a", "7"), ("b/c=1", "3")]
    assert docs.vacuum_chunks(spark, store) == 1 and stored() == [("None", "8"), ("a", "7"), ("b/c=1", "3")]
    plan = docs.load_chunks(spark, store).filter("dataset = 'a' and doc_date >= date'1998-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(doc_date,1998-01-01)" in plan


def test_two_writers_of_different_datasets_both_publish(spark, tmp_path, monkeypatch):
    publish, raced = docs.CommitLog.publish, []

    def late(self, record, version):
        if not raced:
            raced.append(version)
            monkeypatch.setattr(docs.CommitLog, "publish", publish)
            docs.write_chunks(_chunks(spark, [("b", "2")]), str(tmp_path))
        publish(self, record, version)

    monkeypatch.setattr(docs.CommitLog, "publish", late)
    docs.write_chunks(_chunks(spark, [("a", "1")]), str(tmp_path))
    assert {r["dataset"] for r in docs.load_chunks(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_markdown_files_written_by_tasks_are_read_back(spark, tmp_path):
    rows = [("one", "# Title\r\n\r\ntext"), ("zwei_ä", "---\ntitle: x\n---\nbody"), ("empty", None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id string, raw string").repartition(3)
    assert docs.write_markdown(df, f"file:{tmp_path}/md") == 3
    assert sorted(map(tuple, docs.read_markdown(spark, f"{tmp_path}/md").collect())) == sorted([("one", "# Title\n\ntext"), ("zwei_ä", rows[1][1])])  # no empty file
    with pytest.raises(ValueError):
        docs.write_markdown(spark.createDataFrame([("a/b", "x")], "doc_id string, raw string"), f"{tmp_path}/md")


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """a folder is read by a number of tasks that its files do not raise, and whole."""
    for i in range(1400):
        (tmp_path / f"d{i}.md").write_text(f"text {i}\r\n")
    files = docs.read_markdown(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert {(r["doc_id"], r["raw"]) for r in files.collect()} == {(f"d{i}", f"text {i}\n") for i in range(1400)}


def test_no_list_of_a_folders_files_in_the_driver(spark, tmp_path, monkeypatch):
    """the driver held the name and status of every file. Which files are documents stays as in Spark's scan."""
    monkeypatch.setattr(docs, "NAMES", 3)
    monkeypatch.setattr(docs, "READ_BYTES", 10)
    folder = tmp_path / "md"
    (folder / "sub.md").mkdir(parents=True)
    (folder / "sub.md" / "inner.md").write_text("not of this folder")
    for name, raw in {"a b%20c.md": "x\r\ny\r", "_own.md": "hidden", ".dot.md": "hidden", "_k=v.md": "1", "empty.md": "", "note.txt": "no", "ü.md": "ü", "a~[b]\u00a0\u2028#?(c)'@;+&$,=!*^`{|}<>\".md": "odd",
                      **{f"n{i}.md": "text " * i for i in range(1, 12)}}.items():
        (folder / name).write_bytes(raw.encode())
    (folder / "link.md").symlink_to(folder / "ü.md")
    (folder / "gone.md").symlink_to(folder / "nowhere")
    files = docs.read_markdown(spark, f"file:{folder}")
    assert files.inputFiles() == []
    scan = docs.read_markdown(spark, f"{folder}*")  # a pattern, which Spark's scan reads
    assert len(scan.inputFiles()) > 10
    got = sorted(map(tuple, files.collect()))
    assert got == sorted(map(tuple, scan.collect()))
    assert len(got) == 16 and ("a%20b%2520c", "x\ny\n") in got and ("link", "ü") in got and ("_k=v", "1") in got


def test_parted_markdown_folders_are_read_whole(spark, tmp_path):
    for part in ("lang=de", "lang=en"):
        (tmp_path / part).mkdir()
        (tmp_path / part / f"{part[5:]}.md").write_text(part)
    assert sorted(map(tuple, docs.read_markdown(spark, str(tmp_path)).collect())) == [("de", "lang=de"), ("en", "lang=en")]
    (tmp_path / "none").mkdir()
    assert docs.read_markdown(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        docs.read_markdown(spark, str(tmp_path / "missing")).count()
