"""Ad-hoc questions (Q1, Q2): a read query with an optional row cap and preview, and top-k groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREVIEW_ROWS = 10    # rows shown back with an answer


def ask_sql(spark: SparkSession, sql: str, max_rows: int | None = None) -> DataFrame:
    """Q1: run a read query on the registered views. With ``max_rows`` at most so many rows come back, and a
    column ``truncated`` tells whether there were more."""
    df = spark.sql(sql)
    if max_rows is None:
        return df
    # one row more than wanted tells; a limited result is one partition, so its rows are numbered from 0 in its order
    got = df.limit(max_rows + 1).withColumn("_n", F.monotonically_increasing_id())
    n = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return got.withColumn("truncated", F.max("_n").over(n) >= max_rows).filter(F.col("_n") < max_rows).drop("_n")


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows of a result, as JSON strings (what an answer is written from)."""
    return df.limit(n).select(F.to_json(F.struct(*df.columns)).alias("row_json"))


def top_k_groups(df: DataFrame, by: list[str] | str, k: int = 5, count_name: str = "n") -> DataFrame:
    """Q2: the ``k`` groups with the most rows (ties by the group key). Partial counts are
    combined before the shuffle; the final ordering is a TakeOrderedAndProject over the groups."""
    by = [by] if isinstance(by, str) else list(by)
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.col(count_name).desc(), *by).limit(k))
