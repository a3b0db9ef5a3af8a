"""Ranked lexical search turned round: the items are the index, the documents are streamed through it.

The items' terms make an inverted index (term -> items with their number of occurrences) that is broadcast in
blocks of bounded text. One scan cuts every document into terms and keeps, for the terms of the index, how often
each occurs; the corpus statistics (documents, terms, documents per term) are aggregates of that table. A second
pass streams each document's term counts through the index and holds the best ``k`` documents of every item; tasks
send these and nothing else, and the rest is a merge of the tasks' lists. No (item, document) pair is written.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts, stage

#: Bytes of item text in one block of the index, about (items are dealt round).
BLOCK_BYTES = 4 << 20
#: (document, item) scores that a task holds at a time.
CELLS = 1 << 20
#: Parts in which the tasks' lists of one item are merged first.
SALTS = 64

# ---- fixed values -------------------------------------------------------------------------------
WEIGHT_SCALE, TF_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 75

#: Every byte of a term itself, A-Z in lower case, all others a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters from U+0080 on; A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(documents: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counted(docs: DataFrame, number: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tf): each document's length and its counts of the index's terms, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def make():
        index = shared.value

        def work(texts, _):
            sizes, terms, tfs = [], [], []
            for t in texts:
                words = terms_of(t)
                found = [(index[w], c) for w, c in Counter(words).items() if w in index]
                sizes.append(len(words))
                terms.append([x for x, _ in found])
                tfs.append([c for _, c in found])
            return sizes, terms, tfs

        return work

    renamed = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    return map_texts(renamed, make, {"n": "bigint", "terms": "array<int>", "tf": "array<bigint>"}, "_text", keep=["_doc"])


def _index(texts: list[bytes | None]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Terms numbered in byte order, and each one's postings: row borders, items, occurrences in the item."""
    counts = [Counter(terms_of(t)) for t in texts]
    number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    rows = sorted((number[t], i, c) for i, held in enumerate(counts) for t, c in held.items())
    term, item, times = (np.array([r[j] for r in rows], np.int64) for j in range(3))
    return number, np.searchsorted(term, np.arange(len(number) + 1)), item, times


def _keep_best(held: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` rows of every item of two lists (item, score, no document id, document)."""
    item, score, none, doc = (np.concatenate(x) for x in zip(held, new))
    order = np.lexsort((doc, none, -score, item))
    item = item[order]
    start = np.searchsorted(item, item)  # the first row of the same item
    best = order[np.arange(len(item)) - start < k]
    item = np.concatenate((held[0], new[0]))
    return item[best], score[best], none[best], doc[best]


def _streamed(counted: DataFrame, block: dict, k: int) -> DataFrame:
    """(item, score, doc): every task's best ``k`` documents of every item."""
    shared = counted.sparkSession.sparkContext.broadcast(block)

    def make():
        b = shared.value
        ptr, item, times, w, n_items = b["ptr"], b["item"], b["times"], b["weight"], b["items"]
        rows_at_once = max(1, CELLS // max(1, n_items))

        def scores(size, ends, term, tf):
            """One row per document and one column per item."""
            row = np.repeat(np.arange(len(size)), np.diff(ends))
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * size * b["documents"] // b["length"]
            part = w[term] * ((TF_SCALE * tf) // (1000 * tf + 8 * m[row]))
            many = ptr[term + 1] - ptr[term]
            at = np.repeat(ptr[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out = np.zeros(len(size) * n_items, np.int64)
            np.add.at(out, np.repeat(row, many) * n_items + item[at], np.repeat(part, many) * times[at])
            return out.reshape(len(size), n_items)

        return scores, rows_at_once, n_items

    def run(batches):
        scores, step, n_items = make()
        held = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        limit = np.zeros(n_items, np.int64)  # the score that an item's next document must reach
        for batch in batches:
            size = batch.column("n").to_numpy()
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            term, tf = (batch.column(c).values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf"))
            ids = batch.column("_doc")
            none, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                a, z = ends[lo], ends[hi]
                got = scores(size[lo:hi], ends[lo:hi + 1], term[a:z], tf[a:z])
                row, of = np.nonzero((got >= limit) & (got > 0))
                if not len(row):
                    continue
                held = _keep_best(held, (of, got[row, of], none[lo:hi][row], doc[lo:hi][row]), k)
                full = np.bincount(held[0], minlength=n_items) >= k
                last = np.searchsorted(held[0], np.arange(n_items), "right") - 1
                limit = np.where(full, held[1][last], 0)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1], pa.int64()), pa.array(held[3], pa.int64(), mask=held[2])],
                                         names=["item", "score", "doc"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, "item int, score bigint, doc bigint")


def search_items(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every item: ``(item_id, rank, doc_id, score)``.

    Document ids are whole numbers. Every row of ``docs`` and of ``items`` counts for itself: documents that repeat are ranked each,
    items that repeat are answered each. Equal scores go by ascending document id, a null id last. A null or empty
    text has no terms: such a document is in no statistic and no list, such an item has no rows; the same
    holds for empty tables. Columns beside the named ones are not looked at. Eager: the statistics of a block
    (one number per term of its items) come to the driver.
    """
    spark = docs.sparkSession
    kinds = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    schema = f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint"
    # written once with a number of its own for every item, so that blocks are the same whenever they are read
    named = stage(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"),
                               F.monotonically_increasing_id().alias("number")), "items")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for i in range(blocks):
        rows = named.filter(F.pmod(F.col("number") + F.shiftright("number", 33), F.lit(blocks)) == i).orderBy("number").collect()
        number, ptr, item, times = _index([None if r["text"] is None else r["text"].encode() for r in rows])
        if not number:
            continue
        counted = stage(_counted(docs, number, doc_id, text), "term-counts")
        whole = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        if not whole["documents"]:
            continue
        holding = counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        weights = np.zeros(len(number), np.int64)
        for r in holding:
            weights[r["t"]] = weight(whole["documents"], r["count"])
        best = _streamed(counted, {"ptr": ptr, "item": item, "times": times, "weight": weights, "items": len(rows),
                                   "documents": whole["documents"], "length": whole["length"]}, k)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS))).orderBy(*order)
        best = best.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(rows)], f"item int, item_id {kinds[0]}")
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").cast(kinds[1]).alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
