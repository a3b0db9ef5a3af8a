"""Hybrid search over an inverted index with score bounds.

The index has one row per *segment*: up to ``SEGMENT`` chunks of one dataset that stand together in order of date. It holds
the postings of every term (chunk, occurrences) and of every bucket of the sparse hashed vectors (chunk, weight),
and for each term what bounds its score in the segment: the most occurrences and the least length, for a bucket the
greatest weight. As bounds are kept for tf and length apart, they hold for the statistics of every date window.

- The query set is cut into blocks of bounded text. The scan of a block reads the datasets that its queries name (partition
  pruning) and the segments that the hull of their windows touches (row-group pruning on the segments' days).
- BM25 statistics of each window come from the postings of its segments, by ordinary aggregations.
- Scan 1 keeps, per task, query and list (BM25, cosine), the best ``59 + 2k`` chunks. The worst of them is a threshold: a segment whose
  bounds add up to less is skipped; in the others only chunks in the postings of *essential* terms, those without
  which the threshold is out of reach, are scored. A chunk that ranks deeper than ``59 + 2k`` in both lists cannot reach the fused top ``k``.
- Scan 2 runs only for survivors whose rank in the other list is open and could still matter: it counts the chunks that
  beat them, with their own scores as thresholds.
- No (query, chunk) pair is written or shuffled, except each task's best.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.operators.retrieval import BM25_B, BM25_EPSILON, BM25_K1, BREAK_SEARCH, CHUNK_KEYS, DEFAULT_DIMS, MARGIN_DAYS, RRF_K, prepare_queries, split_tokens
from shiftlens.session import checkpoint_dir, lean, materialize, release, scratch_path

QUERY_BLOCK_BYTES = 256 << 10  # query text per block of a search
SEGMENT = 512                  # chunks per segment of the index
POSTINGS = 1 << 21             # postings that a task expands at a time
GROUP_BYTES = 4 << 20          # bytes of a row group of a stored index; readers decode one at a time
#: Scores are rounded to so many places before they are compared, so that the order of summation cannot reorder
#: near-equal chunks; a bound must fall short by more than that to rule a chunk out.
PLACES, SLACK = 9, 1e-8
LISTS = 2                      # BM25, cosine
FEW_HITS = 50_000              # so many hits (keys and ranks) are broadcast to the chunks

INDEX_SCHEMA = ("undated boolean, day_lo date, day_hi date, doc_ids array<string>, chunk_nos array<int>, days array<int>, "
                "lengths array<int>, terms array<string>, term_ptr array<int>, term_chunk array<int>, term_tf array<int>, "
                "most_tf array<int>, least_length array<int>, buckets array<int>, bucket_ptr array<int>, "
                "bucket_chunk array<int>, bucket_weight array<double>, most_weight array<double>, dataset string")


# ---- the index ------------------------------------------------------------------------------------
def _postings(row: np.ndarray, code: np.ndarray, codes: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(borders by code, rows, values) of entries, by code and row."""
    order = np.lexsort((row, code))
    return np.searchsorted(code[order], np.arange(codes + 1)), row[order], value[order]


class Codes(dict):
    """Numbers of things in order of their first use."""

    def __missing__(self, key) -> int:
        got = self[key] = len(self)
        return got


def _segment(rows: pa.Table) -> dict:
    """One index row of chunks of one dataset, all dated or all undated."""
    n, seen = rows.num_rows, Codes()
    tok = [list(map(seen.__getitem__, split_tokens(t or "", BREAK_SEARCH))) for t in rows.column("text").to_pylist()]
    length = np.array(list(map(len, tok)), np.int64)
    names = [w.decode() for w in seen]
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    code = place[np.fromiter(chain.from_iterable(tok), np.int64, length.sum())]
    pair, tf = np.unique(np.repeat(np.arange(n), length) * max(1, len(names)) + code, return_counts=True)
    ptr, chunk, tf = _postings(pair // max(1, len(names)), pair % max(1, len(names)), len(names), tf)
    buckets, weights = (rows.column(c).combine_chunks() for c in ("buckets", "weights"))
    many = pc.list_value_length(buckets).to_numpy(zero_copy_only=False).astype(np.int64)
    row, w = np.repeat(np.arange(n), many), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    norm = np.sqrt(np.bincount(row, w ** 2, minlength=n))
    known, b_code = np.unique(buckets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    b_ptr, b_chunk, b_weight = _postings(row, b_code.astype(np.int64), len(known), w / np.where(norm == 0, 1.0, norm)[row])
    day = rows.column("day").to_pylist()
    dated = day[0] is not None
    reach = lambda f, x, p: f.reduceat(x, p[:-1]) if len(p) > 1 else np.empty(0, x.dtype)
    return {"undated": not dated, "day_lo": min(day) if dated else None, "day_hi": max(day) if dated else None,
            "doc_ids": rows.column("doc_id").to_pylist(), "chunk_nos": rows.column("chunk_no").to_pylist(), "days": day if dated else [],
            "lengths": length, "terms": [names[i] for i in order], "term_ptr": ptr, "term_chunk": chunk, "term_tf": tf,
            "most_tf": reach(np.maximum, tf, ptr), "least_length": reach(np.minimum, length[chunk], ptr), "buckets": known, "bucket_ptr": b_ptr,
            "bucket_chunk": b_chunk, "bucket_weight": b_weight, "most_weight": reach(np.maximum, b_weight, b_ptr), "dataset": rows.column("dataset")[0].as_py()}


_ARROW = {"boolean": pa.bool_(), "date": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
          "array<double>": pa.list_(pa.float64())}


def build_index(chunks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The index of ``chunks (dataset, doc_id, chunk_no, doc_date, text[, buckets, weights])``, one row per segment.

    Chunks are dealt by ranges of (dataset, date, key), so a dataset of any size is many tasks and a segment's days are close
    together; undated chunks have segments of their own. A null text has no terms. Without ``buckets`` no vectors are indexed."""
    none = F.array().cast
    col = lambda c, kind: F.col(c).cast(kind) if c in chunks.columns else F.lit(None).cast(kind)
    vectors = [F.coalesce(F.col(c), none(k)).alias(c) if c in chunks.columns else none(k).alias(c) for c, k in (("buckets", "array<int>"), ("weights", "array<float>"))]
    rows = chunks.select(col("dataset", "string").alias("dataset"), F.unix_date(col("doc_date", "date")).alias("day"), col("doc_id", "string").alias("doc_id"),
                         col("chunk_no", "int").alias("chunk_no"), "text", *vectors)
    order = ["dataset", "day", "doc_id", "chunk_no"]
    fields = T.StructType.fromDDL(INDEX_SCHEMA).fields
    kinds = {f.name: _ARROW[f.dataType.simpleString()] for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush():
            got = _segment(pa.Table.from_batches(held))
            arrays = [pa.array([got[n]], k) for n, k in kinds.items()]
            return pa.RecordBatch.from_arrays([a.cast(pa.date32()) if n in ("day_lo", "day_hi") else a for n, a in zip(kinds, arrays)], names=list(kinds))

        for b in batches:
            of = list(zip(b.column("dataset").to_pylist(), b.column("day").is_null().to_pylist()))
            at = 0
            while at < len(of):
                if held and (of[at] != last or size == segment):
                    yield flush()
                    held, size = [], 0
                end = at + 1
                while end < len(of) and of[end] == of[at] and end - at < segment - size:
                    end += 1
                held.append(b.slice(at, end - at))
                size, last, at = size + end - at, of[at], end
        if held:
            yield flush()
        release()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, T.StructType(fields))


def write_index(index: DataFrame, path: str) -> None:
    """Store an index, one folder per dataset. Rows are large, so row groups are small and their size is looked at after every row."""
    small = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}
    index.write.mode("overwrite").options(**small).partitionBy("dataset").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index."""
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def _pruned(index: DataFrame, windows: list[tuple]) -> DataFrame:
    """The segments that may hold a chunk of the windows (dataset, first day, last day), by filters on stored columns."""
    if all(w[0] is not None for w in windows):
        index = index.filter(F.col("dataset").isin(sorted({w[0] for w in windows})))
    day = lambda n: F.lit(n).cast("int")
    inside = F.lit(True)
    if all(w[1] is not None for w in windows):
        inside = inside & (F.col("day_hi") >= F.date_from_unix_date(day(min(w[1] for w in windows))))
    if all(w[2] is not None for w in windows):
        inside = inside & (F.col("day_lo") <= F.date_from_unix_date(day(max(w[2] for w in windows))))
    return index.filter(F.col("undated") | inside)


class Segment:
    """One index row, as numpy arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, counts: bool = False):
        def array(name, kind=np.int64):
            return batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(kind)

        self.dataset, self.undated = batch.column("dataset")[i].as_py(), batch.column("undated")[i].as_py()
        self.terms, self.lengths, self.days = batch.column("terms")[i].values, array("lengths"), array("days")
        self.ptr, self.chunk = array("term_ptr"), array("term_chunk")
        if counts:
            return
        self.keys, self.tf = list(zip(batch.column("doc_ids")[i].as_py(), batch.column("chunk_nos")[i].as_py())), array("term_tf")
        self.most_tf, self.least_length = array("most_tf"), array("least_length")
        self.buckets, self.b_ptr, self.b_chunk = array("buckets"), array("bucket_ptr"), array("bucket_chunk")
        self.b_weight, self.most_weight = array("bucket_weight", np.float64), array("most_weight", np.float64)
        order = sorted(range(len(self.keys)), key=self.keys.__getitem__)
        self.order = np.empty(len(order), np.int64)
        self.order[order] = np.arange(len(order))  # each chunk's place in order of key
        self.sorted_keys = [self.keys[j] for j in order]

    def inside(self, dataset, lo, hi) -> np.ndarray | None:
        """Which chunks are in a window; None if no one is."""
        if dataset is not None and dataset != self.dataset:
            return None
        if self.undated:
            return np.ones(len(self.lengths), bool)
        got = np.ones(len(self.lengths), bool)
        if lo is not None:
            got &= self.days >= lo
        if hi is not None:
            got &= self.days <= hi
        return got if got.any() else None


SCAN_COLUMNS = [f.split()[0] for f in INDEX_SCHEMA.split(", ") if not f.startswith("day_")]
#: What statistics need of them.
COUNT_COLUMNS = ["undated", "days", "lengths", "terms", "term_ptr", "term_chunk", "dataset"]


def _segments(batches, counts: bool = False) -> Iterator[Segment]:
    for b in batches:
        for i in range(b.num_rows):
            yield Segment(b, i, counts)


# ---- statistics -------------------------------------------------------------------------------------
def _window_stats(index: DataFrame, windows: list[tuple], terms: list[str]) -> dict[int, tuple]:
    """Per window number: (average length, {term: idf}) over its chunks, for the given terms.

    idf follows K16: the mean that replaces negative values is taken over the window's whole vocabulary, of which only
    the mean, and the values of the block's own terms, come to the driver."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(windows)

    def run(batches):
        for s in _segments(batches, counts=True):
            alike: dict[bytes, list] = {}  # windows with the same chunks of the segment are counted once
            for w, window in enumerate(shared.value):
                inside = s.inside(*window)
                if inside is not None:
                    alike.setdefault(inside.tobytes(), [inside]).append(w)
            for inside, *ws in alike.values():
                df = np.diff(s.ptr) if inside.all() else np.add.reduceat(inside[s.chunk].astype(np.int64), s.ptr[:-1]) if len(s.terms) else np.empty(0, np.int64)
                on = np.flatnonzero(df)
                n = len(on) + 1
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, ws))] * n), pa.concat_arrays([s.terms.take(pa.array(on)), pa.array([None], pa.string())]),
                                                  pa.array(np.append(df[on], inside.sum()), pa.int64()),
                                                  pa.array(np.append(np.zeros(len(on), np.int64), s.lengths[inside].sum()), pa.int64())],
                                                 names=["ws", "term", "n", "length"])
        release()

    counts = index.select(*COUNT_COLUMNS).mapInArrow(run, "ws string, term string, n bigint, length bigint")
    counts = counts.groupBy("ws", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")) \
        .select(F.explode(F.split("ws", ",").cast("array<int>")).alias("w"), "term", "n", "length")
    counts = materialize(counts.groupBy("w", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "checkpoint")
    sizes = {r["w"]: (r["n"], r["length"]) for r in counts.filter("term is null").collect()}  # one row per window
    if not sizes:
        return {}
    total = spark.createDataFrame([(w, n) for w, (n, _) in sizes.items()], "w int, total bigint")
    idf = counts.filter("term is not null").join(F.broadcast(total), "w") \
        .select("w", "term", (F.log(F.col("total") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("idf"))
    mean = {r["w"]: r["mean"] for r in idf.groupBy("w").agg(F.avg("idf").alias("mean")).collect()}
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    out = {w: (length / n, {}) for w, (n, length) in sizes.items()}
    for r in idf.join(F.broadcast(wanted), "term").collect():  # terms of the block x its windows
        out[r["w"]][1][r["term"]] = BM25_EPSILON * mean[r["w"]] if r["idf"] < 0 else r["idf"]
    return out


# ---- a block of queries -----------------------------------------------------------------------------
def _query_blocks(queries: DataFrame, dims: int, block_bytes: int) -> Iterator[list]:
    """Prepared queries in blocks of about ``block_bytes`` of query text, dealt by a hash of the id."""
    q = prepare_queries(queries, dims)
    total = queries.agg(F.coalesce(F.sum(F.octet_length("qtext")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    for i in range(blocks):
        own = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()
        if own:
            yield sorted(own, key=lambda r: str(r["query_id"]))


def _day(date, margin: int) -> int | None:
    return None if date is None else int((np.datetime64(date) - np.datetime64("1970-01-01")).astype(int)) + margin


def _block(rows: list, index: DataFrame, margin_days: int, whole: bool) -> dict:
    """What the scans need of one query block: its windows, and per list the entries (query, term or bucket, weight)."""
    place = [(None, None, None) if whole else (r["dataset"], _day(r["start"], -margin_days), _day(r["end"], margin_days)) for r in rows]
    windows = sorted({p for p in place if whole or p[0] is not None}, key=str)
    number = {w: i for i, w in enumerate(windows)}
    terms = sorted({t for r in rows for t in r["qtok"] or ()})
    code = {t: i for i, t in enumerate(terms)}
    index = _pruned(index, windows) if windows else index.limit(0)
    stats = _window_stats(index, windows, terms)
    lexical: dict[tuple, float] = {}
    vectors, avgdl = [], np.zeros(len(rows))
    for q, r in enumerate(rows):
        avgdl[q], idf = stats.get(number.get(place[q]), (0.0, {}))
        for t in r["qtok"] or ():
            lexical[q, code[t]] = lexical.get((q, code[t]), 0.0) + idf.get(t, 0.0)
        vectors += [(q, e["b"], e["w"] / (r["_qnorm"] or 1.0)) for e in r["_qnz"] or ()]
    entries = [[(q, t, w) for (q, t), w in lexical.items() if w != 0], vectors]
    arrays = [tuple(np.array([e[i] for e in own], k) for i, k in enumerate((np.int64, np.int64, np.float64))) for own in entries]
    return {"index": index, "shared": {"n": len(rows), "windows": windows, "window": np.array([number.get(p, -1) for p in place]), "avgdl": avgdl, "terms": terms,
                                       "entries": arrays}}


class Scorer:
    """Scores of one segment's chunks for the queries of a block, list by list (0: BM25, 1: cosine)."""

    def __init__(self, block: dict, s: Segment):
        self.block, self.s = block, s
        inside = [s.inside(*w) for w in block["windows"]]
        self.inside = np.zeros((len(inside) + 1, len(s.keys)), bool)  # the last row: queries without a window
        for i, x in enumerate(inside):
            if x is not None:
                self.inside[i] = x
        self.live = self.inside.any(1)[block["window"]]
        self.avgdl = np.where(block["avgdl"] > 0, block["avgdl"], np.inf)
        self.entries = [self._lexical(), self._vectors()]

    def _lexical(self):
        s, (q, t, w) = self.s, self.block["entries"][0]
        at = pc.index_in(pa.array(self.block["terms"], pa.string()), value_set=s.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = at[t] if len(t) else t
        on = (at >= 0) & self.live[q]
        q, at, w = q[on], at[on], w[on]
        most = self._tf_part(s.most_tf[at], s.least_length[at], q)
        return q, at, w, np.maximum(w * most, 0.0), s.ptr, s.chunk

    def _vectors(self):
        s, (q, b, w) = self.s, self.block["entries"][1]
        at = np.minimum(np.searchsorted(s.buckets, b), max(0, len(s.buckets) - 1))
        on = (s.buckets[at] == b if len(s.buckets) else np.zeros(len(b), bool)) & self.live[q]
        q, at, w = q[on], at[on], w[on]
        return q, at, w, np.maximum(w * s.most_weight[at], 0.0), s.b_ptr, s.b_chunk

    def _tf_part(self, tf, length, q):
        return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / self.avgdl[q]))

    def _add(self, which: int, on: np.ndarray, column: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Scores (queries by ``column`` x chunks) of the marked cells, from the entries ``on``, some at a time."""
        q, at, w, _, ptr, chunk = self.entries[which]
        out, size = np.zeros(marked.size), marked.shape[1]
        flat, entry = marked.ravel(), np.flatnonzero(on)
        many = ptr[at[entry] + 1] - ptr[at[entry]]
        part = np.cumsum(many) // POSTINGS
        for p in range(int(part[-1]) + 1 if len(part) else 0):
            e, m = entry[part == p], many[part == p]
            post = np.repeat(ptr[at[e]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            e = np.repeat(e, m)
            cell = column[q[e]] * size + chunk[post]
            keep = flat[cell]
            e, post, cell = e[keep], post[keep], cell[keep]
            if which == 0:
                value = self._tf_part(self.s.tf[post], self.s.lengths[self.s.chunk[post]], q[e])
            else:
                value = self.s.b_weight[post]
            out += np.bincount(cell, w[e] * value, minlength=out.size)
        return np.round(out.reshape(marked.shape), PLACES)

    def reaching(self, which: int, least: np.ndarray, only_shared: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, chunks, scores) with every chunk of the query's window that scores ``least[query]`` or more, and some
        that don't. Chunks that the bounds rule out are not scored. ``only_shared``: only chunks with a term of the query."""
        q, at, _, bound, ptr, chunk = self.entries[which]
        n = self.block["n"]
        best = np.bincount(q, bound, minlength=n)
        every = (least <= SLACK) & ~np.bool_(only_shared)  # a chunk without a shared term scores 0
        asked = np.flatnonzero(self.live & (every | (best + SLACK >= least)))
        if only_shared:
            asked = asked[np.isin(asked, q)]
        size = len(self.s.keys)
        step = max(1, POSTINGS // max(1, size))
        order = np.lexsort((bound, q))
        total = np.cumsum(bound[order])
        first = np.searchsorted(q[order], q[order])
        reach = np.empty(len(q))
        reach[order] = total - (total[first] - bound[order][first] if len(q) else 0)  # with all smaller bounds of the query
        essential = reach + SLACK >= least[q]
        for lo in range(0, len(asked), step):
            own = asked[lo:lo + step]
            column = np.full(n, -1)
            column[own] = np.arange(len(own))
            marked = np.zeros((len(own), size), bool)
            marked[every[own]] = True
            mine = column[q] >= 0
            need = np.flatnonzero(mine & essential & ~every[q])
            many = ptr[at[need] + 1] - ptr[at[need]]
            part = np.cumsum(many) // POSTINGS
            for p in range(int(part[-1]) + 1 if len(part) else 0):
                e, m = need[part == p], many[part == p]
                post = np.repeat(ptr[at[e]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                marked[np.repeat(column[q[e]], m), chunk[post]] = True
            marked &= self.inside[self.block["window"][own]]
            scores = self._add(which, mine, column, marked)
            for i, number in enumerate(own.tolist()):
                on = np.flatnonzero(marked[i])
                if len(on):
                    yield number, on, scores[i, on]

    def at(self, which: int, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """Scores of single (query, chunk) pairs."""
        own = sorted({p[0] for p in pairs})
        out = {}
        step = max(1, POSTINGS // max(1, len(self.s.keys)))
        for lo in range(0, len(own), step):
            column = np.full(self.block["n"], -1)
            column[own[lo:lo + step]] = np.arange(len(own[lo:lo + step]))
            here = [p for p in pairs if column[p[0]] >= 0]
            marked = np.zeros((len(own[lo:lo + step]), len(self.s.keys)), bool)
            marked[[column[a] for a, _ in here], [b for _, b in here]] = True
            scores = self._add(which, column[self.entries[which][0]] >= 0, column, marked)
            out |= {p: scores[column[p[0]], p[1]] for p in here}
        return out

    def size(self) -> int:
        """Number of (query, chunk) pairs inside the queries' windows."""
        return int(self.inside.sum(1)[self.block["window"]].sum())


# ---- scans ------------------------------------------------------------------------------------------
def _best(index: DataFrame, shared, depth: int, lists: int, only_shared: bool) -> DataFrame:
    """Scan 1: (q, l, score, other, doc_id, chunk_no, r), the best ``depth`` of every query and list; ``other`` is the score in the
    other list. A row with q = -1 per task and list has the numbers of pairs that were scored and of all pairs. The index is read once."""

    def run(batches):
        block = shared.value
        held: dict[tuple[int, int], list] = {}
        least = np.full((LISTS, block["n"]), -np.inf)
        scored, total = [0] * lists, [0] * lists
        for s in _segments(batches):
            scorer = Scorer(block, s)
            new: list[tuple[int, int, int]] = []
            for which in range(lists):
                total[which] += scorer.size()
                for q, chunks, score in scorer.reaching(which, least[which], only_shared):
                    scored[which] += len(chunks)
                    old = held.get((q, which), [])
                    up = score >= least[which, q]
                    chunks, score = chunks[up], score[up]
                    top = np.lexsort((s.order[chunks], -score))[:depth]
                    rows = [(-float(score[i]), *s.keys[chunks[i]], int(chunks[i])) for i in top.tolist()]
                    kept = sorted(old + rows, key=lambda x: x[:3])[:depth]
                    held[q, which] = kept
                    new += [(q, which, x[3]) for x in kept if isinstance(x[3], int)]
                    if len(kept) == depth:
                        least[which, q] = -kept[-1][0]
            for which in range(lists):
                pairs = [(q, c) for q, w, c in new if w == which]
                other = scorer.at(1 - which, pairs) if pairs and lists == LISTS else {}
                for q in {p[0] for p in pairs}:  # a float in the last place is the score in the other list
                    held[q, which] = [(*x[:3], float(other.get((q, x[3]), 0.0))) if isinstance(x[3], int) else x for x in held[q, which]]
        flat = [(q, which, -s, other, doc, no) for (q, which), rows in held.items() for s, doc, no, other in rows]
        flat += [(-1, which, float(scored[which]), float(total[which]), "", 0) for which in range(lists)]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), kinds)], names=["q", "l", "score", "other", "doc_id", "chunk_no"])
        release()

    found = index.select(*SCAN_COLUMNS).mapInArrow(run, "q int, l int, score double, other double, doc_id string, chunk_no int")
    w = Window.partitionBy("q", "l").orderBy(F.col("score").desc(), "doc_id", "chunk_no")
    return found.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= depth) | (F.col("q") < 0))


def _beaten_by(index: DataFrame, shared) -> DataFrame:
    """Scan 2: (slot, n), the number of chunks that rank before each wanted survivor. The block holds
    ``wanted``: (query, list) -> scores, keys and slots."""

    def run(batches):
        block = shared.value
        total = np.zeros(block["slots"], np.int64)
        least = np.full((LISTS, block["n"]), np.inf)
        for (q, which), (limits, _, _) in block["wanted"].items():
            least[which, q] = limits.min()
        for s in _segments(batches):
            scorer = Scorer(block, s)
            for which in range(LISTS):
                for q, chunks, score in scorer.reaching(which, least[which], False):
                    if (q, which) not in block["wanted"]:
                        continue
                    limits, of, slots = block["wanted"][q, which]
                    before = np.array([bisect.bisect_left(s.sorted_keys, k) for k in of])
                    ties = (score[:, None] == limits) & (s.order[chunks][:, None] < before)
                    total[slots] += (score[:, None] > limits).sum(0) + ties.sum(0)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], names=["slot", "n"])
        release()

    return index.select(*SCAN_COLUMNS).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def _stored(chunks: DataFrame, index: DataFrame | None) -> DataFrame:
    """The given index, or one of the chunks, written once to the shared checkpoint folder."""
    if index is not None:
        return index
    path = scratch_path(chunks.sparkSession, "search-index")
    write_index(build_index(chunks), path)
    return load_index(chunks.sparkSession, path)


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int = 10, dims: int = DEFAULT_DIMS, block_bytes: int = QUERY_BLOCK_BYTES,
             index: DataFrame | None = None, report: list | None = None) -> DataFrame:
    """The ``k`` chunks with the greatest BM25 for every query ``(query_id, qtext)`` among those that share a
    term with it: ``(query_id, doc_id, chunk_no, bm25, rank)``; ties by chunk key. All chunks are one corpus.

    Eager: index, statistics and the best ``k`` of every query of a block are written or fetched block by block."""
    spark = chunks.sparkSession
    q = queries.select("query_id", "qtext", F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("date").alias("start"),
                       F.lit(None).cast("date").alias("end"))
    kind = queries.schema["query_id"].dataType.simpleString()
    with lean(spark):
        index = _stored(chunks.drop("buckets", "weights"), index)
    parts = []
    for rows in _query_blocks(q, dims, block_bytes):
        with lean(spark):
            block = _block(rows, index, 0, True)
            best = materialize(_best(block["index"], spark.sparkContext.broadcast(block["shared"]), k, 1, True), "checkpoint")
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"q int, query_id {kind}")
        _note(report, best)
        parts.append(best.filter("q >= 0").join(F.broadcast(names), "q").select("query_id", "doc_id", "chunk_no", F.col("score").alias("bm25"), F.col("r").alias("rank")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id {kind}, doc_id string, chunk_no int, bm25 double, rank int")


def _note(report: list | None, best) -> None:
    """Numbers of pairs scored and of all pairs, per list, of one block."""
    if report is not None:
        rows = best.filter("q < 0").collect() if isinstance(best, DataFrame) else [r for r in best if r["q"] < 0]
        report += [{"list": ("bm25", "cosine")[n], "scored": int(sum(r["score"] for r in rows if r["l"] == n)), "pairs": int(sum(r["other"] for r in rows if r["l"] == n))}
                   for n in sorted({r["l"] for r in rows})]


def search(chunks: DataFrame, queries: DataFrame, k: int = 3, margin_days: int = MARGIN_DAYS, dims: int = DEFAULT_DIMS,
           block_bytes: int = QUERY_BLOCK_BYTES, index: DataFrame | None = None, report: list | None = None) -> DataFrame:
    """Hybrid search for a set of queries.

    ``chunks``  : (dataset, doc_id, chunk_no, title, doc_type, doc_date, text, buckets, weights)
    ``queries`` : (query_id, dataset, qtext, start, end); start/end are dates and may be NULL
    ``index``   : a stored index of the chunks (``load_index``); without one, the chunks of the queries' datasets are indexed
    ``report``  : a list that gets, per block and list, the numbers of pairs that were scored and of all pairs of the windows
    Returns ``(query_id, hit_rank, doc_id, chunk_no, title, doc_type, doc_date, text, score,
    rank_bm25, rank_cos)``: fused RRF score rounded to 4 places, best ``k`` per query.

    Eager: per block of queries (``block_bytes`` of text) the statistics of its terms and the best ``59 + 2k`` of both lists of its
    queries come to the driver, and its hits are written; their texts are joined lazily.
    """
    spark = chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, hit_rank bigint, dataset string, doc_id string, chunk_no int, score double, rank_bm25 bigint, rank_cos bigint"
    if index is None:
        own = [r["dataset"] for r in queries.filter("dataset is not null").select("dataset").distinct().limit(1001).collect()]
        with lean(spark):
            index = _stored(chunks.filter(F.col("dataset").isin(own)) if own and len(own) <= 1000 else chunks, None)
    parts, n = [], 0
    for rows in _query_blocks(queries, dims, block_bytes):
        with lean(spark):
            block = _block(rows, index, margin_days, False)
            hits = _fused(block, rows, k, report)
        parts.append(materialize(spark.createDataFrame(hits, schema), "checkpoint"))
        n += len(hits)
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    best = F.broadcast(best) if n <= FEW_HITS else best  # else the texts of all chunks are shuffled for a few
    return (chunks.select("dataset", *CHUNK_KEYS, "title", "doc_type", "doc_date", "text").join(best, ["dataset", *CHUNK_KEYS])
            .select("query_id", "hit_rank", *CHUNK_KEYS, "title", "doc_type", "doc_date", "text", F.round("score", 4).alias("score"),
                    "rank_bm25", "rank_cos"))


def _fused(block: dict, rows: list, k: int, report: list | None) -> list[tuple]:
    """Hits of one query block: (query_id, hit_rank, dataset, doc_id, chunk_no, score, rank_bm25, rank_cos)."""
    index, share, depth = block["index"], block["index"].sparkSession.sparkContext.broadcast, RRF_K - 1 + 2 * k
    ranks: dict[int, dict] = {}
    scores: dict[tuple, dict] = {}
    found = _best(index, share(block["shared"]), depth, LISTS, False).collect()
    _note(report, found)
    for t in found:
        if t["q"] >= 0:
            ranks.setdefault(t["q"], {}).setdefault((t["doc_id"], t["chunk_no"]), [None, None])[t["l"]] = t["r"]
            scores[t["q"], t["doc_id"], t["chunk_no"]] = {t["l"]: t["score"], 1 - t["l"]: t["other"]}
    # a rank is open where a chunk is not among the best of a list; it matters if its least possible value wins
    wanted: dict[tuple, list] = {}
    slots = []
    for q, own in ranks.items():
        low = {key: sum(1.0 / (RRF_K + r) for r in both if r) for key, both in own.items()}
        high = {key: low[key] + sum(1.0 / (RRF_K + depth + 1) for r in both if r is None) for key, both in own.items()}
        need = sorted(low.values())[-k:][0]
        for key, both in own.items():
            if high[key] >= need - 1e-12 and None in both:
                which = both.index(None)
                wanted.setdefault((q, which), []).append((scores[q, *key][which], key, len(slots)))
                slots.append((q, key, which))
        ranks[q] = {key: both for key, both in own.items() if high[key] >= need - 1e-12}
    if wanted:
        more = {qw: (np.array([x[0] for x in w]), [x[1] for x in w], np.array([x[2] for x in w])) for qw, w in wanted.items()}
        counts = {r["slot"]: r["n"] for r in _beaten_by(index, share(block["shared"] | {"wanted": more, "slots": len(slots)})).collect()}
        for slot, (q, key, which) in enumerate(slots):
            ranks[q][key][which] = counts.get(slot, 0) + 1
    out = []
    for q, own in sorted(ranks.items()):
        hits = sorted((-sum(1.0 / (RRF_K + r) for r in both), *key, *both) for key, both in own.items())[:k]
        out += [(rows[q]["query_id"], n, rows[q]["dataset"], doc, no, -score, rb, rc) for n, (score, doc, no, rb, rc) in enumerate(hits, 1)]
    return out


# ---- R11 ----------------------------------------------------------------------------------------
def find_context(chunks: DataFrame, candidates: DataFrame, metric_name: str, question: str, dataset: str,
                 period_b: tuple[str, str], k: int = 3, excerpt_chars: int = 500, index: DataFrame | None = None) -> DataFrame:
    """Documents for an investigation: query = metric name, top candidate and question;
    window = period B. Returns ``(doc_ref D1.., doc_id, title, type, date, excerpt)``."""
    # the top candidate, or empty strings when there is none (the text query still runs)
    picked = candidates.filter(F.col("candidate_rank") == 1).select(
        F.lit(1).alias("_prio"), F.struct("dimension", "segment").alias("_c"))
    default = candidates.sparkSession.range(1).select(
        F.lit(0).alias("_prio"), F.struct(F.lit("").alias("dimension"), F.lit("").alias("segment")).alias("_c"))
    first = picked.unionByName(default).agg(F.max_by("_c", "_prio").alias("_c")).select("_c.*")
    q = first.select(F.lit("ctx").alias("query_id"), F.lit(dataset).alias("dataset"),
                     F.concat_ws(" ", F.lit(metric_name), "dimension", "segment", F.lit(question)).alias("qtext"),
                     F.lit(period_b[0]).cast("date").alias("start"), F.lit(period_b[1]).cast("date").alias("end"))
    # one row, written once: the blocks of the search read it several times
    hits = search(chunks, materialize(q, "checkpoint"), k, index=index)
    return hits.select(F.concat(F.lit("D"), F.col("hit_rank")).alias("doc_ref"), "doc_id", "title",
                       F.col("doc_type").alias("type"), F.col("doc_date").alias("date"),
                       F.substring("text", 1, excerpt_chars).alias("excerpt"), "hit_rank")
