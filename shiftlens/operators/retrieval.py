"""Document retrieval: front matter, paragraph packing, tokens, hashing embedder, BM25, cosine,
reciprocal rank fusion and the plain form of the hybrid search (R1-R9); ``operators.search`` has the search over an index.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.session import release

# ---- fixed values (they define the scores and must not drift) ---------------------------------
SEARCH_TOKEN = "[a-z0-9_]+"   # search tokens keep the underscore
EMBED_TOKEN = "[a-z0-9]+"     # the hashing embedder drops it
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
FRONT_MATTER = r"(?sU)^---\s*\n(.*?)\n---\s*\n"
DEFAULT_DOC_TYPE = "document"
MAX_CHARS = 900
PARAGRAPH_SEPARATOR = "\n\n"
MARGIN_DAYS = 20
DEFAULT_DIMS = 256
#: What ``(?U)\s`` matches in Java, and so what ``strip`` removes.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that are Python objects at one time, and tokens whose bucket is remembered, in a task.
PART_BYTES, MEMORY = 1 << 20, 200_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python-style ``str.strip()``: leading and trailing white space of any kind."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# ---- R1 -----------------------------------------------------------------------------------------
def _front_field(block: Column, name: str) -> Column:
    v = F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    v = F.regexp_replace(v, r"""^"(.*)"$|^'(.*)'$""", "$1$2")
    return F.when(v != "", v)


def parse_front_matter(df: DataFrame, raw: str = "raw", doc_id: str = "doc_id") -> DataFrame:
    """Split ``---`` front matter from the body; adds ``title``, ``doc_type``, ``doc_date``, ``body``.

    Flat ``key: value`` lines only. Defaults: title = id with ``_`` as spaces, type ``document``.
    """
    has = _c(raw).rlike(FRONT_MATTER)
    block = F.when(has, F.regexp_extract(_c(raw), FRONT_MATTER, 1)).otherwise(F.lit(""))
    body = F.when(has, F.regexp_replace(_c(raw), FRONT_MATTER, "")).otherwise(_c(raw))
    return (df.withColumn("title", F.coalesce(_front_field(block, "title"),
                                              F.regexp_replace(_c(doc_id).cast("string"), "_", " ")))
              .withColumn("doc_type", F.coalesce(_front_field(block, "type"), F.lit(DEFAULT_DOC_TYPE)))
              .withColumn("doc_date", F.try_to_date(_front_field(block, "date")))
              .withColumn("body", strip(body)))


# ---- R2 / R3 ------------------------------------------------------------------------------------
def next_chunks(lengths: np.ndarray, max_chars: int, separator: int) -> list[tuple[int, int]]:
    """Greedy packing of paragraphs of these lengths: [first, end) of every chunk.

    The prefix sums of the lengths tell for each paragraph where a chunk that starts with it ends: at the first
    paragraph that no longer fits. The chunks are the chain of these pointers from the first paragraph on."""
    total = np.concatenate(([0], np.cumsum(lengths + separator)))
    start = np.arange(len(lengths))
    pointer = np.maximum(np.searchsorted(total, total[:-1] + max_chars + separator, "right") - 1, start + 1).tolist()
    out, at = [], 0
    while at < len(lengths):
        out.append((at, pointer[at]))
        at = pointer[at]
    return out


def _pack_udf(max_chars: int, separator: str):
    @F.pandas_udf("array<string>")
    def pack(paragraphs: pd.Series) -> pd.Series:
        out = []
        for p in paragraphs:
            if p is None:
                out.append(None)
                continue
            cuts = next_chunks(np.fromiter(map(len, p), np.int64, len(p)), max_chars, len(separator))
            out.append([separator.join(p[a:b]) for a, b in cuts])
        return pd.Series(out, dtype=object)
    return pack


def chunk_text(text, max_chars: int = MAX_CHARS, separator: str = PARAGRAPH_SEPARATOR) -> Column:
    """R2: greedy paragraph packing into ``array<string>``; paragraphs stay whole, an oversize
    paragraph becomes its own chunk. Linear in the text's length; parallel over texts. A null text has no array."""
    paras = F.filter(F.transform(F.split(_c(text), r"\Q" + separator + r"\E"), strip), lambda p: p != "")
    return _pack_udf(max_chars, separator)(paras)


def _parts(column: pa.Array, size: int) -> list[tuple[int, int]]:
    """[first, end) of runs of texts with about ``size`` bytes."""
    at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // size
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class Buckets(dict):
    """``int(md5(token), 16) % dims``, remembered."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[token] = int.from_bytes(hashlib.md5(token).digest(), "big") % self.dims
        return got


#: All bytes that are in no token become spaces (tokens are ASCII, and no byte of another character is).
BREAK_SEARCH, BREAK_EMBED = (bytes(i if re.match(p, chr(i)) and i < 128 else 32 for i in range(256)) for p in (SEARCH_TOKEN, EMBED_TOKEN))


def split_tokens(text: str, breaks: bytes) -> list[bytes]:
    """R4 inside tasks: the lower-case tokens of a text."""
    return text.lower().encode().translate(breaks).split()


def chunk_documents(df: DataFrame, text: str = "body", keys: tuple[str, ...] = ("dataset", "doc_id"),
                    keep: tuple[str, ...] = ("title", "doc_type", "doc_date"), max_chars: int = MAX_CHARS,
                    separator: str = PARAGRAPH_SEPARATOR, dims: int | None = None) -> DataFrame:
    """One row per chunk, numbered from 0: ``(*keys, chunk_no, *keep, text)``; with ``dims`` also the sparse vector of
    ``hash_embed_pairs``, ``(buckets, weights)``.

    One pass in Python per task, over texts of about ``PART_BYTES`` at a time, so that its memory does not grow with the input."""
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("chunk_no", T.IntegerType()), *(df.schema[c] for c in keep),
                           T.StructField("text", T.StringType())])
    if dims:
        schema = schema.add("buckets", T.ArrayType(T.IntegerType())).add("weights", T.ArrayType(T.FloatType()))

    def run(batches):
        bucket = Buckets(dims)
        for b in batches:
            for lo, hi in _parts(b.column(text), PART_BYTES):
                row, number, texts = [], [], []
                for i, t in enumerate(b.column(text).slice(lo, hi - lo).to_pylist(), lo):
                    p = [x for x in (y.strip(SPACE) for y in (t or "").split(separator)) if x]
                    for n, (first, end) in enumerate(next_chunks(np.fromiter(map(len, p), np.int64, len(p)), max_chars, len(separator))):
                        row.append(i)
                        number.append(n)
                        texts.append(separator.join(p[first:end]))
                own = pa.array(row, pa.int64())
                out = {c: b.column(c).take(own) for c in (*keys, *keep)} | {"chunk_no": pa.array(number, pa.int32()), "text": pa.array(texts, pa.string())}
                if dims:
                    held = [list(map(bucket.__getitem__, split_tokens(t, BREAK_EMBED))) for t in texts]
                    of = np.repeat(np.arange(len(texts)), list(map(len, held)))
                    cell, many = np.unique(of * dims + np.fromiter(chain.from_iterable(held), np.int64, len(of)), return_counts=True)
                    ends = pa.array(np.searchsorted(cell, np.arange(len(texts) + 1) * dims), pa.int32())
                    out |= {"buckets": pa.ListArray.from_arrays(ends, pa.array(cell % dims, pa.int32())),
                            "weights": pa.ListArray.from_arrays(ends, pa.array(many, pa.float32()))}
                yield pa.RecordBatch.from_arrays([out[f] for f in schema.names], names=schema.names)
        release()

    return df.select(*keys, *keep, text).mapInArrow(run, schema)


# ---- R4 / R5 ------------------------------------------------------------------------------------
def tokens(text, pattern: str = SEARCH_TOKEN) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), 0)


def md5_bucket(token: Column, dims: int = DEFAULT_DIMS) -> Column:
    """``int(md5(token), 16) % dims``, exactly, on the JVM."""
    for k in range(1, 16):
        if 16 ** k % dims == 0:
            return F.conv(F.substring(F.md5(token), 33 - k, k), 16, 10).cast("long") % F.lit(dims)
    digits = F.split(F.md5(token), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"),
                       lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % F.lit(dims))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding; expressions inside a
    higher-order function are otherwise re-evaluated on every call)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_in_sorted(asc: Column, desc: Column, value: Column) -> Column:
    """Occurrences of ``value`` in an ascending array ``asc`` (``desc`` is its reverse): last
    position - first position + 1, found with two native scans (no per-element lambda)."""
    first = F.array_position(asc, value)
    return F.when(first == 0, F.lit(0)).otherwise(F.size(asc) + 2 - F.array_position(desc, value) - first)


def hash_buckets(text, dims: int = DEFAULT_DIMS) -> Column:
    """Bucket of every embedder token (JVM md5), as ``array<bigint>``."""
    return F.transform(tokens(text, EMBED_TOKEN), lambda t: md5_bucket(t, dims))


def _bincount_udf(dims: int):
    @F.pandas_udf("array<float>")
    def bincount(buckets: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x if x is not None else [], dtype=np.int64),
                                      minlength=dims).astype(np.float32) for x in buckets])
    return bincount


def hash_embed(text, dims: int = DEFAULT_DIMS) -> Column:
    """R5 (dense): term counts hashed into ``array<float>`` of ``dims``.

    Tokens and md5 buckets are computed on the JVM; only the scatter into a dense vector (a
    bincount, which has no native array form) runs in an Arrow-batched pandas UDF."""
    return _bincount_udf(dims)(hash_buckets(text, dims))


def _pairs_udf(dims: int):
    @F.pandas_udf("struct<buckets:array<int>,weights:array<float>>")
    def pairs(buckets: pd.Series) -> pd.DataFrame:
        own = [np.unique(np.asarray(x if x is not None else [], dtype=np.int32), return_counts=True) for x in buckets]
        return pd.DataFrame({"buckets": [b for b, _ in own], "weights": [n.astype(np.float32) for _, n in own]})
    return pairs


def hash_embed_pairs(text, dims: int = DEFAULT_DIMS) -> Column:
    """R5 (sparse, at rest): the buckets that occur, in order, and their term counts, as a struct of two arrays."""
    return _pairs_udf(dims)(hash_buckets(text, dims))


def dense(buckets, weights, dims: int = DEFAULT_DIMS) -> Column:
    """The ``array<double>`` of a sparse vector."""
    return let(F.map_from_arrays(_c(buckets), _c(weights)), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("double")))


def hash_embed_expr(text, dims: int = DEFAULT_DIMS) -> Column:
    """R5 (dense), pure-JVM form for a handful of rows (e.g. query texts): sorted buckets, then
    two native scans per dimension."""
    buckets = F.sort_array(hash_buckets(text, dims))
    return let(F.struct(buckets.alias("a"), F.reverse(buckets).alias("d")), lambda bk: F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
        lambda i: count_in_sorted(bk["a"], bk["d"], i).cast("float")))


def hash_embed_sparse(df: DataFrame, keys: list[str], text: str, dims: int = DEFAULT_DIMS) -> DataFrame:
    """R5 (sparse): ``(*keys, bucket, weight)`` for whole texts; explode + partial aggregation."""
    t = df.select(*keys, F.explode(tokens(text, EMBED_TOKEN)).alias("_t"))
    return (t.groupBy(*keys, md5_bucket(F.col("_t"), dims).alias("bucket"))
             .agg(F.count(F.lit(1)).cast("double").alias("weight")))


# ---- R6 -----------------------------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vec, query) -> Column:
    """``v . q / (|v| * (|q| or 1))``; a zero denominator counts as 1 (score 0)."""
    nq = norm(query)
    den = norm(vec) * F.when(nq == 0, F.lit(1.0)).otherwise(nq)
    return dot(vec, query) / F.when(den == 0, F.lit(1.0)).otherwise(den)


def cosine_scores(vectors: DataFrame, queries: DataFrame, on: list[str], vec: str = "embedding",
                  qvec: str = "qvec") -> DataFrame:
    """R6 over DataFrames: each vector against the queries that share its ``on`` key (a group,
    a query window, a label). The equi-join lets adaptive execution broadcast a small query side."""
    return vectors.join(queries, on).withColumn("cosine", cosine(vec, qvec))


# ---- R7 -----------------------------------------------------------------------------------------
def bm25_term(tf: Column, idf: Column, dl: Column, avgdl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    norm_len = F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * norm_len))


def bm25_idf(corpus: DataFrame, group: list[str], tok: str = "tok", epsilon: float = BM25_EPSILON) -> DataFrame:
    """Per group: ``(*group, term, idf)`` with idf = ln(N - df + .5) - ln(df + .5); negative idf is
    replaced by ``epsilon`` times the mean idf over the group's vocabulary (mean taken before).
    Without a group the corpus-wide N and mean are scalar subqueries."""
    dfreq = (corpus.select(*group, F.explode(F.array_distinct(tok)).alias("term"))
             .groupBy(*group, "term").agg(F.count(F.lit(1)).alias("_df")))
    if group:
        n = corpus.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        idf = dfreq.join(n, group)
    else:
        idf = dfreq.withColumn("_n", corpus.agg(F.count(F.lit(1))).scalar())
    idf = idf.withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    if group:
        idf = idf.join(idf.groupBy(*group).agg(F.avg("_idf").alias("_mean")), group)
    else:
        idf = idf.withColumn("_mean", idf.agg(F.avg("_idf")).scalar())
    return idf.select(*group, "term", F.when(F.col("_idf") < 0, F.lit(epsilon) * F.col("_mean"))
                      .otherwise(F.col("_idf")).alias("idf"))


# ---- R8 -----------------------------------------------------------------------------------------
def rrf(ranked: DataFrame, item_keys: list[str], k: int = 3, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse ``(query_id, *item_keys, list_name, rank)`` rows: ``sum 1/(rrf_k + rank)``, top ``k``
    per query (ties by item keys)."""
    fused = ranked.groupBy("query_id", *item_keys).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *item_keys)
    return fused.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k)


# ---- R9 -----------------------------------------------------------------------------------------
def window_condition(doc_date, start, end, margin_days: int = MARGIN_DAYS) -> Column:
    """Undated documents always pass; both ends inclusive with a margin; an open end is skipped."""
    d = _c(doc_date)
    s, e = _c(start), _c(end)
    lo = s.isNull() | (d >= F.date_sub(s.cast("date"), margin_days))
    hi = e.isNull() | (d <= F.date_add(e.cast("date"), margin_days))
    return d.isNull() | (lo & hi)


def within_window(df: DataFrame, start: str | None, end: str | None, margin_days: int = MARGIN_DAYS,
                  doc_date: str = "doc_date") -> DataFrame:
    s = F.lit(start).cast("date") if start else F.lit(None).cast("date")
    e = F.lit(end).cast("date") if end else F.lit(None).cast("date")
    return df.filter(window_condition(doc_date, s, e, margin_days))


# ---- R10 ----------------------------------------------------------------------------------------
CHUNK_KEYS = ["doc_id", "chunk_no"]


def prepare_queries(queries: DataFrame, dims: int) -> DataFrame:
    """Queries ``(query_id, dataset, qtext, start, end)`` with tokens, the non-zero dimensions ``(b, w)`` of the
    hashed vector and its norm."""
    qvec = hash_embed_expr("qtext", dims)
    nz = F.filter(F.transform(qvec, lambda w, i: F.struct(i.alias("b"), w.cast("double").alias("w"))),
                  lambda e: e["w"] != 0)
    return (queries.withColumn("qtok", tokens("qtext"))
            .withColumn("_qnz", nz)
            .withColumn("_qnorm", norm(qvec)))


def search_plain(chunks: DataFrame, queries: DataFrame, k: int = 3, margin_days: int = MARGIN_DAYS,
                 dims: int = DEFAULT_DIMS) -> DataFrame:
    """Plain form of R10 for tests: full ranks per query by window functions (small inputs)."""
    q = prepare_queries(queries, dims).withColumn("qvec", hash_embed_expr("qtext", dims))
    pairs = (chunks.join(q.withColumnRenamed("dataset", "_ds"), (F.col("dataset") == F.col("_ds"))
                         & window_condition("doc_date", "start", "end", margin_days))
             .withColumn("tok", tokens("text")))
    g = ["query_id"]
    stats = pairs.groupBy(*g).agg((F.sum(F.size("tok")) / F.count(F.lit(1))).alias("avgdl"))
    idf = bm25_idf(pairs, g)
    qt = pairs.select("query_id", "qtok").distinct().select("query_id", F.explode("qtok").alias("term"))
    qt = qt.join(idf, ["query_id", "term"], "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    tf = (pairs.select("query_id", *CHUNK_KEYS, F.size("tok").alias("dl"), F.explode("tok").alias("term"))
          .groupBy("query_id", *CHUNK_KEYS, "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    s = (qt.join(tf, ["query_id", "term"]).join(stats, "query_id")
         .groupBy("query_id", *CHUNK_KEYS).agg(F.sum(bm25_term(F.col("tf"), F.col("idf"), F.col("dl"),
                                                               F.col("avgdl"))).alias("bm25")))
    allp = (pairs.select("query_id", *CHUNK_KEYS, F.round(cosine(dense("buckets", "weights", dims), "qvec"), 9).alias("cos"))
            .join(s, ["query_id", *CHUNK_KEYS], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9)))
    w1 = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), *CHUNK_KEYS)
    w2 = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), *CHUNK_KEYS)
    ranked = (allp.withColumn("rank_bm25", F.row_number().over(w1)).withColumn("rank_cos", F.row_number().over(w2))
              .withColumn("score", 1.0 / (RRF_K + F.col("rank_bm25")) + 1.0 / (RRF_K + F.col("rank_cos"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *CHUNK_KEYS)
    return (ranked.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k)
            .select("query_id", "hit_rank", *CHUNK_KEYS, F.round("score", 4).alias("score"), "rank_bm25", "rank_cos"))
