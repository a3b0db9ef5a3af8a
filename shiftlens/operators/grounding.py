"""Grounding of numbers in text (G1-G3): which numbers of a report no evidence value accounts for.

An evidence value accounts for a written number if the value, or a hundred times the value, differs from
it by at most half a unit of the last decimal that is written (plus 1e-9), signs aside. The integers 0 to
10 need no evidence.

Only the nearest evidence value below and above can decide, so values and numbers are sorted together
in buckets of width one; a number looks into its own bucket and the two beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
# a number not inside a word (of any alphabet) or after a dot; optional sign, thousands commas, decimals
NUMBER = r"(?<![\p{L}\p{N}_.])[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
# what a JSON text holds: strings, each perhaps a key, and bare numbers
JSON_TOKEN = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'
ALWAYS_ALLOWED = list(range(0, 11))
#: Tasks that expand evidence, for each core of the cluster (at least; and no fewer than shuffles have).
TASKS_PER_CORE = 4


def number_value(raw: Column) -> Column:
    return F.regexp_replace(raw, ",", "").cast("double")


def extract_numbers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """G1: ``(*keys, pos, raw, value)`` for every number in ``text`` (``pos`` from 0)."""
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), 0)).alias("pos", "raw"))
    return found.withColumn("value", number_value(F.col("raw")))


def json_numbers(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """G2 (input): ``(*keys, value)`` for the numbers of an evidence document at any depth, also those written
    inside its strings; keys, booleans and nulls hold none."""
    token = df.select(*keys, F.explode(F.regexp_extract_all(F.col(json), F.lit(JSON_TOKEN), 0)).alias("t"))
    token = token.filter(~(F.col("t").startswith('"') & F.col("t").endswith(":")))
    text = F.from_json(F.concat(F.lit("["), F.col("t"), F.lit("]")), "array<string>")[0]
    found = F.when(F.col("t").startswith('"'), F.regexp_extract_all(text, F.lit(NUMBER), 0)).otherwise(F.array("t"))
    return token.select(*keys, F.explode(found).alias("raw")).select(*keys, number_value(F.col("raw")).alias("value"))


def evidence_values(numbers: DataFrame, key: str = "report_id", value: str = "value") -> DataFrame:
    """Expand evidence numbers ``(key, value)`` to ``n, |n|, 100 n, 100 |n|`` plus 0..10 per key.

    Booleans and NULLs are not numbers: drop them before (NULL values are ignored here)."""
    v = F.col(value).cast("double")
    # a number becomes several rows here, which adaptive execution does not foresee where it merges tasks: so many are left
    session = numbers.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * session.sparkContext.defaultParallelism)
    numbers = numbers.repartition(tasks, key, value)
    expanded = numbers.filter(v.isNotNull()).select(
        key, F.explode(F.array(v, F.abs(v), v * 100, F.abs(v) * 100)).alias("value"))
    small = numbers.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(float(i)) for i in ALWAYS_ALLOWED])).alias("value"))
    return expanded.unionByName(small).distinct()


def tolerance(raw: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(raw, ",", ""), r"^\+", "")
    decimals = F.when(cleaned.contains("."), F.length(F.substring_index(cleaned, ".", -1))).otherwise(F.lit(0))
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-9)


def _bucket(x: Column) -> Column:
    """The whole part as a double (numbers may have any number of digits)."""
    return x - x % 1


def unsupported_numbers(written: DataFrame, evidence: DataFrame, key: str = "report_id") -> DataFrame:
    """The written numbers ``(key, pos, raw, value)`` that no evidence value supports."""
    none = F.lit(None)
    ev = evidence.select(key, _bucket(F.abs("value")).alias("_b"), F.abs("value").alias("_x"), F.abs("value").alias("_ev"),
                         none.cast("int").alias("pos"), none.cast("double").alias("_tol"))  # repeated values change no nearest one
    w = written.select(key, "pos", F.abs("value").alias("_x"), tolerance(F.col("raw")).alias("_tol"))
    probes = w.select(key, F.explode(F.array_distinct(F.array(*[_bucket(F.col("_x")) + d for d in (-1, 0, 1)]))).alias("_b"), "_x",
                      none.cast("double").alias("_ev"), "pos", "_tol")
    by = Window.partitionBy(key, "_b").orderBy("_x")
    below = F.max("_ev").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min("_ev").over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = ev.unionByName(probes).withColumn("_lo", below).withColumn("_hi", above).filter("pos is not null")
    supported = near.filter((F.col("_x") - F.col("_lo") <= F.col("_tol")) | (F.col("_hi") - F.col("_x") <= F.col("_tol"))) \
        .select(key, "pos").distinct()
    return written.join(supported, [key, "pos"], "left_anti")
