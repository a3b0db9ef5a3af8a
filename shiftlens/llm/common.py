"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
         "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
         "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fold_is(key: str, mod: int, rest: int) -> Column:
    """True where crc32 of the key's decimal text leaves ``rest`` modulo ``mod``; False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(mod) == F.lit(rest), F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With it, Spark deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Queries that write a table leave no shuffle files: nothing reads them again once the table is there."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


#: Blocks that delete all tables written inside them, the innermost last.
_COLLECTING: list[Scratch] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back: the lineage
    is cut, the files are compressed and outlive any executor."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with without_shuffle_files(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _COLLECTING:
        _COLLECTING[-1].tables.append(out)
    return out


class Scratch:
    """The tables that an operator writes on its way; leaving the block deletes them.

    What outlives the block must have been written by ``stage``, or taken out of ``tables``, before. With ``collect``
    the tables that operators called in the block write by ``stage`` are deleted too."""

    def __init__(self, spark: SparkSession, collect: bool = False):
        self.spark, self.tables, self.collect = spark, [], collect

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        out = stage(df, label)
        if not any(t is out for t in self.tables):
            self.tables.append(out)
        return out

    def keep(self, table: DataFrame) -> None:
        """This table outlives the block."""
        for held in (self, *_COLLECTING):
            held.tables = [t for t in held.tables if t is not table]

    def drop(self, table: DataFrame) -> None:
        """Delete the files of one table at once."""
        for file in table.inputFiles()[:1]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def discard(self, table: DataFrame) -> None:
        """This table is needed no more: its files are deleted at once."""
        self.keep(table)
        self.drop(table)

    def __enter__(self) -> Scratch:
        if self.collect:
            _COLLECTING.append(self)
        return self

    def __exit__(self, *_) -> None:
        if self.collect:
            _COLLECTING.remove(self)
        for t in self.tables:
            self.drop(t)


def nested(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): all columns beside the text as one, so that no name of theirs can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select((F.struct(*others) if others else F.lit(None).cast("int")).alias("row"), F.col(f"`{text}`").alias("text"))


def flat(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """What ``nested`` was given, in the order of ``columns``."""
    return rows.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in columns])


#: Rows whose texts are Python objects at one time.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``SLICE`` rows; an empty batch once."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), SLICE):
            yield b.slice(at, SLICE)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are used again, and what each keeps adds up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, make: Callable[[], Callable], fields: dict[str, str], text: str = "text",
              keep: list[str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that are computed from each row's whole text.

    ``make()`` runs once per task and returns a function from (list of UTF-8 texts or None, batch)
    to one list per entry of ``fields`` (name -> type). ``keep`` names the input columns to carry
    along (all, if None); an input column that has the name of an output column is replaced. Columns
    in ``also`` are given to the function and not carried along.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields and c not in also]
    wanted = list(dict.fromkeys([*kept, *also, text]))
    schema = T.StructType([df.schema[c] for c in kept]
                          + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items())).fields)
    kinds = {n: ARROW[t] for n, t in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in slices(batches):
            got = work(raw_texts(b.column(text)), b)
            arrays = [b.column(c) for c in kept] + [pa.array(g, t) for g, t in zip(got, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *kinds])
            del got, arrays
        del work
        release()

    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def emit_rows(df: DataFrame, make: Callable[[], Callable], schema: str, columns: list[str]) -> DataFrame:
    """Rows made from the batches of ``columns``: ``make()`` runs once per task and returns a function
    from a batch to dicts of columns (one dict per output batch)."""
    out = T.StructType.fromDDL(schema)
    kinds = {f.name: ARROW[f.dataType.simpleString()] for f in out.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in slices(batches):
            for got in work(b):
                yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], t) for n, t in kinds.items()], names=list(kinds))

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, out)
