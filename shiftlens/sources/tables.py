"""Load a dataset's tables read-only, and profile them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def load_dataset(spark: SparkSession, path: str, names=TABLES, register_views: bool = False) -> dict[str, DataFrame]:
    """One DataFrame per ``{path}/{name}.parquet``; optionally registered as temp views."""
    tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    if register_views:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
    return tables


class LazyTables(dict):
    """Tables read on first use, so a query only plans the files it touches."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        self[name] = df
        return df


def profile_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """S6 (schema part): ``(table_name, ordinal_position, column_name, data_type)`` from the schemas."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")


def profile_date_range(tables: dict[str, DataFrame], table: str, column: str) -> DataFrame:
    """S6 (range part): min and max of the default date column, one aggregate pass."""
    return tables[table].agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"),
                             F.count(F.lit(1)).alias("row_count"))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
