"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

``docs`` has doc_id, text, lang and any other columns, under any names beside these. All stages but the last return the columns of
``docs`` with the values that they had (substring dedup cuts texts). Repeated rows and rows with a null id count each for
themselves; a null or empty text has no letter, so language ID rejects it. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import bpe as bpe_op
from shiftlens.llm import decontam, langid, minhash, substring
from shiftlens.llm.common import flat, fold_is, nested, stage, table
from shiftlens.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is learned from three folds of four of them."""
    model = langid.fit(docs.filter(~fold_is("doc_id", 4, 2)))
    return flat(langid.predict(nested(docs), model).filter("not rejected"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity of 0.8 or more): that with the smallest id, a null id last.

    Rows get a number of their own, so repeated rows and rows without an id are copies like any others. A text without
    words is linked with nothing and stays."""
    rows = stage(nested(docs).select(F.monotonically_increasing_id().alias("number"), "row", "text"), "numbered")
    found = minhash.near_duplicates(rows, key="number", percent=80)
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("number"))
    # the keys grow with the input, so they are never broadcast
    first = found.select("number", "component_id").join(rows.select("number", order.alias("o")).hint("merge"), "number") \
        .groupBy("component_id").agg(F.min("o").alias("o"))
    # a group is known by its smallest number, which most often is the row to stay
    moved = stage(first.filter("o.number <> component_id").select(F.col("o.number").alias("stays"), F.col("component_id").alias("goes")), "moved")
    gone = found.filter("not kept").select("number").join(moved.select(F.col("stays").alias("number")), "number", "left_anti") \
        .unionByName(moved.select(F.col("goes").alias("number")))
    return flat(rows.join(gone.hint("merge"), "number", "left_anti"), docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that start earlier elsewhere (smaller id, or earlier in the text).

    A row without an id comes after all others and is known by a hash of its text."""
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = nested(docs).select(F.coalesce(F.col("row.doc_id").cast("bigint"), late).alias("key"), "row", "text")
    return flat(substring.dedup_texts(keyed, key="key"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return flat(decontam.decontaminate(nested(docs), table(spark, sf_dir, "benchmark")).filter("n_hit = 0"), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and decoded text."""
    return bpe_op.tokenise(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), keep=["doc_id", "lang", "source"]).select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
