"""Document sources and the chunk store."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators import retrieval as rt
from shiftlens.sources.commits import CommitLog, Conflict

#: Tasks that read a folder, for each core of the cluster.
TASKS_PER_CORE = 8
#: Names that the listing of a folder hands on at a time, and bytes of files that a task holds.
NAMES, READ_BYTES = 10_000, 4 << 20
CHUNK_SCHEMA = ("dataset string, doc_id string, chunk_no int, title string, doc_type string, doc_date date, "
                "text string, buckets array<int>, weights array<float>")


def _plain_folder(spark: SparkSession, path: str) -> tuple[bytes, int] | None:
    """(folder, number of entries) of a path on a disk that driver and executors share. None for patterns, other stores and folders
    parted by ``key=value`` folders. Entries are counted as they come, none is held."""
    if set(path) & set("*?[]{}\\"):
        return None
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toUri()
    folder, n = os.fsencode(uri.getPath()), 0
    if uri.getScheme() != "file" or not os.path.isdir(folder):
        return None
    with os.scandir(folder) as entries:
        for e in entries:
            n += 1
            if b"=" in e.name and e.is_dir():
                return None
    return folder, n


def _contents(spark: SparkSession, folder: bytes, tasks: int) -> DataFrame:
    """``(doc_id, content)`` of a folder's ``*.md`` files. One task lists the names as it goes, since a folder has one list; others
    read the files, by names dealt over them. Files are those that Spark's scan would take: not hidden, not without a byte."""

    def names(_):
        import pyarrow as pa

        held = []
        with os.scandir(folder) as entries:
            for e in entries:
                if e.name.endswith(b".md") and not e.name.startswith(b".") and (b"=" in e.name or not e.name.startswith(b"_")) and e.is_file():
                    held.append(e.name)
                if len(held) == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["name"])
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["name"])

    def read(batches):
        import unicodedata
        from urllib.parse import quote

        import pyarrow as pa

        def quoted(stem):  # as in Spark's _metadata.file_name: spaces, control characters and what is not allowed in the path of a URI
            plain = lambda c: c > "\x7f" and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")
            return "".join(c if plain(c) else quote(c, safe="_-!.~'()*,;:$&+=@") for c in stem)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary())], names=["doc_id", "content"])

        ids, contents, size = [], [], 0
        for name in (n for b in batches for n in b.column("name").to_pylist()):
            with open(os.path.join(folder, name), "rb") as f:
                content = f.read()
            if content:
                stem = name.removesuffix(b".md").decode("utf-8", "replace")
                ids.append(stem if stem.isascii() and stem.replace("_", "").isalnum() else quoted(stem))
                contents.append(content)
                size += len(content)
            if size >= READ_BYTES:
                yield batch()
                ids, contents, size = [], [], 0
        yield batch()

    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "name binary")
    return listed.repartition(tasks, "name").mapInArrow(read, "doc_id string, content binary")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.md`` file of a folder as ``(doc_id, raw)``; the id is the file stem, quoted as in a URI. All kinds of line
    ends become ``\\n``, as in text files. Spark reads no files without a byte, so these are no documents (they would have no chunks).

    A folder on a shared disk is listed by a task when the result is computed, so the driver holds no list of its files. Spark's scan,
    which holds one in the driver, reads other stores, patterns and folders parted by ``key=value`` folders."""
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    plain = _plain_folder(spark, path)
    if plain:
        df = _contents(spark, plain[0], max(1, min(tasks, plain[1])))
    else:
        df = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
        # a scan takes some 30 files a task, however small they are; merged tasks read as many as there are
        df = df.coalesce(tasks).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), "content")
    return df.select("doc_id", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("raw"))


def write_markdown(docs: DataFrame, path: str) -> int:
    """A markdown folder from ``(doc_id, raw)``: one file ``<doc_id>.md`` for each row with an id; the number of files.

    Tasks write their own rows to ``path``, which driver and executors share; a task that is run again writes the same
    files. An id must be usable as a file name, and rows of one id are one file."""
    if docs.filter(F.col("doc_id").rlike(r"[/\\\x00]|^\.|^_|^$")).limit(1).count():
        raise ValueError("document ids that are no file names")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        n = 0
        for b in batches:
            for name, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
                with store.open_output_stream(f"{folder}/{name}.md") as out:
                    out.write((raw or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.filter("doc_id is not null").select("doc_id", "raw").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def build_chunks(docs: DataFrame, dataset: str | None = None, max_chars: int = rt.MAX_CHARS,
                 separator: str = rt.PARAGRAPH_SEPARATOR, dims: int = rt.DEFAULT_DIMS, partitions: int | None = None) -> DataFrame:
    """R1 + R3 + R5: ``(doc_id, raw[, dataset][, doc_date])`` to chunk rows with sparse embeddings.

    A ``doc_date`` column on the input fills in where the front matter has no date. ``partitions`` deals
    the documents out first; it is for inputs of a few large files that cannot be split.
    """
    docs = docs.repartition(partitions) if partitions else docs
    parsed = rt.parse_front_matter(docs.withColumnRenamed("doc_date", "_given_date")
                                   if "doc_date" in docs.columns else docs)
    if "_given_date" in parsed.columns:
        parsed = parsed.withColumn("doc_date", F.coalesce("doc_date", "_given_date"))
    if dataset is not None:
        parsed = parsed.withColumn("dataset", F.lit(dataset))
    return rt.chunk_documents(parsed.withColumn("doc_id", F.col("doc_id").cast("string")),
                              max_chars=max_chars, separator=separator, dims=dims)


STORED = CHUNK_SCHEMA.split(", ", 1)[1] + ", version string, dataset string"


def write_chunks(chunks: DataFrame, path: str, dataset: str | None = None) -> None:
    """S3: replace the chunks of the datasets present in ``chunks``, all of them in one step; other datasets stay.

    With ``dataset``, all of ``chunks`` belong to it and it is replaced also by no chunks at all. The new chunks are
    written beside the old ones, as a version of their own; then one record in the commit log says which version each
    dataset has now. Readers see the old chunks until then and the new ones from then on, never a mixture, and a
    writer that fails before leaves nothing visible. Inside a dataset the chunks are stored in order of date."""
    spark = chunks.sparkSession
    log, version = CommitLog(spark, path), uuid.uuid4().hex
    own = chunks.withColumn("dataset", F.lit(dataset)) if dataset is not None else chunks
    columns = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    own.select(*columns).withColumn("version", F.lit(version)).repartitionByRange("dataset", "doc_date", "doc_id", "chunk_no") \
        .sortWithinPartitions("dataset", "doc_date", "doc_id", "chunk_no").write.mode("append").partitionBy("version", "dataset").parquet(f"{path}/data")
    if dataset is not None:
        names = [dataset]
    else:  # one name per dataset
        names = [r["dataset"] for r in _data(spark, path).filter(F.col("version") == version).select("dataset").distinct().collect()]
    while True:  # versions of different datasets do not depend on each other, so a taken number is no conflict
        try:
            log.publish({"version": version, "datasets": names}, len(log.records()))
            return
        except Conflict:
            continue


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{path}/data")


def _current(spark: SparkSession, path: str) -> dict[str | None, str]:
    """Dataset -> its version now."""
    return {name: r["version"] for r in CommitLog(spark, path).records() for name in r["datasets"]}


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Read the chunk store as it is published now. Only the folders of current versions are read (partition pruning), and
    a filter on ``dataset`` or ``doc_date`` prunes folders and row groups."""
    columns = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    now = _current(spark, path)
    if not now:
        return spark.createDataFrame([], CHUNK_SCHEMA)
    df = _data(spark, path)
    one = [(F.col("version") == v) & F.col("dataset").eqNullSafe(F.lit(name)) for name, v in now.items()]
    return df.filter(reduce(lambda a, b: a | b, one)).select(*columns)


def vacuum_chunks(spark: SparkSession, path: str) -> int:
    """Delete the chunks of versions that no dataset has any more; the number of folders that went. Only for times without
    writers, whose versions are not published yet, and without readers of older versions."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    keep, gone = {f"version={v}" for v in _current(spark, path).values()}, 0
    for status in fs.listStatus(hadoop.Path(f"{path}/data")):
        folder = status.getPath()
        if folder.getName().startswith("version=") and folder.getName() not in keep:
            gone += bool(fs.delete(folder, True))
    return gone


def export_chunks(chunks: DataFrame, path: str) -> None:
    """One ordered export of every chunk (all datasets), for shipping a read-only copy."""
    chunks.orderBy("dataset", "doc_id", "chunk_no").write.mode("overwrite").parquet(path)
