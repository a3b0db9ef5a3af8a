"""Near-duplicate detection: universal hash minima, banding, verification and connected components.

1. Every text becomes its set of word shingles, the minima of ``HASHES`` universal hash functions over it,
   one byte of each minimum (the signature, for estimates) and one key per band of minima.
2. Texts with the same set collapse to one representative, so copies never meet each other.
3. Representatives that share a band key are compared by signature inside their bucket. A bucket is
   dealt out in pairs of blocks of bounded size; from each block pair comes a spanning forest of
   the similar pairs, never the pairs themselves. Its components are the candidate groups.
4. Candidate groups, in block pairs again, are compared on the full sets; a spanning forest of the true
   links comes out, and its components, together with the copies, are the result.

A link of similarity 0.85 is missed by all 25 bands with probability 4e-7, and by the signature estimate
with about 5e-6. A spanning forest loses none of the connections between texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import Scratch, map_texts, raw_texts, release, stage
from shiftlens.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Least number of equal signature bytes for a link of similarity 0.85 (five standard deviations below its mean).
LEAST_EQUAL = 86
#: Texts, and shingles, in a block of a bucket or group.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Words whose hash is remembered in a task.
MEMORY = 200_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 62, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """63-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return got


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the text's words (A-Z lower-cased); the whole sequence is
    one shingle where there are fewer words; empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([hashes[x] for x in words], np.int64).view(np.uint64)
    k = min(size, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * _STEP + w[j:len(w) - k + 1 + j]
    return np.unique(mix(acc))


def minima(shingles: np.ndarray, block: int = 512) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    x = shingles >> np.uint64(32)
    for at in range(0, len(x), block):
        np.minimum(out, (_A[:, None] * x[None, at:at + block] + _B[:, None]).min(1), out=out)
    return out >> np.uint64(32)


def signature(mins: np.ndarray) -> bytes:
    return (mix(mins + np.uint64(1)) & np.uint64(255)).astype(np.uint8).tobytes()


def band_keys(mins: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64)
    for column in mins.reshape(BANDS, ROWS).T:
        acc = acc * _STEP + column
    return mix(acc).view(np.int64)


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, digest, sig, bands) of every document; the last three are null for an empty set."""

    def make():
        hashes = WordHashes()

        def work(texts, _):
            rows = []
            for t in texts:
                s = shingle_set(t, hashes)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minima(s)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(m), band_keys(m)))
            return list(zip(*rows, strict=True)) if rows else [[]] * 4

        return work

    return map_texts(docs, make, {"n_shingles": "bigint", "digest": "binary", "sig": "binary", "bands": "array<bigint>"}, text, [key])


def block_pairs(members: DataFrame, group: str, key: str, blocks: str) -> DataFrame:
    """``members`` once for every pair of blocks that its block is in, dealt and sorted by ``pair``.

    ``blocks`` is the number of blocks of the row's group; a row belongs to one of them by its key's hash.
    """
    own = F.pmod(F.xxhash64(key), F.col(blocks))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1),
                                  lambda o: F.xxhash64(F.col(group), F.least(o, F.col("_own")), F.greatest(o, F.col("_own")))))
    return members.withColumn("_own", own).withColumn("pair", pairs).drop("_own", blocks) \
        .repartition("pair").sortWithinPartitions("pair")


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a sorted column, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for start, end in zip(cuts, cuts[1:]):
            if held and v[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = v[start]
    if held:
        yield pa.Table.from_batches(held)


def forest(ids: list, near) -> list[tuple]:
    """A spanning forest of the similar pairs of ``ids``: ``near(i, rest)`` tells which of the positions
    ``rest`` are linked with position i."""
    rest, out = np.arange(1, len(ids)), []
    queue = [0] if ids else []
    while queue:
        i = queue.pop()
        if len(rest):
            got = near(i, rest)
            out += [(ids[j], ids[i]) for j in rest[got]]
            queue += rest[got].tolist()
            rest = rest[~got]
            if not queue and len(rest):
                queue, rest = [int(rest[0])], rest[1:]
    return out


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)


def _edges(kind: str, find):
    """A mapInArrow function: edges of each run of ``pair`` by ``find(table)``."""
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def run(batches):
        src, dst = [], []
        for t in runs(batches, "pair"):
            for a, b in find(t):
                src.append(a)
                dst.append(b)
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, arrow), pa.array(dst, arrow)], names=["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, arrow), pa.array(dst, arrow)], names=["src", "dst"])
        release()

    return run


def _similar(least: int):
    def find(t: pa.Table):
        if t.num_rows < 2:
            return []
        sig = _signatures(t)
        return forest(t.column("id").to_pylist(), lambda i, rest: (sig[rest] == sig[i]).sum(1) >= least)

    return find


def _linked(least: int, percent: int):
    hashes = WordHashes()

    def find(t: pa.Table):
        if t.num_rows < 2:
            return []
        sig, ids = _signatures(t), t.column("id").to_pylist()
        sets = [shingle_set(x, hashes) for x in raw_texts(t.column("text").combine_chunks())]
        size = np.array(list(map(len, sets)))

        def near(i, rest):
            small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            got = (100 * small >= percent * large) & ((sig[rest] == sig[i]).sum(1) >= least)
            for at in np.flatnonzero(got):
                a, b = sets[i], sets[rest[at]]
                both = int((a[np.searchsorted(a, b).clip(max=len(a) - 1)] == b).sum())
                got[at] = 100 * both >= percent * (len(a) + len(b) - both)
            return got

        return forest(ids, near)

    return find


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked where 100 x intersection >= ``percent`` x union of their shingle sets (``percent`` of 80
    or more); component_id is the smallest key that links reach, and the document with that key is kept.
    A null text or one without words has an empty set and is linked with nothing. Rows with the same
    key are one vertex: they are in one component, also with different texts, and all have the same
    ``kept``. A row with a null key is in no component (null) and kept. The result is a written table;
    those on the way to it are deleted.
    """
    with Scratch(docs.sparkSession) as scratch:
        return stage(_components(docs, text, key, percent, scratch), "near-duplicates")


def _components(docs: DataFrame, text: str, key: str, percent: int, scratch: Scratch) -> DataFrame:
    least = LEAST_EQUAL if percent >= 85 else 77  # 77: five standard deviations below the mean at 0.80
    sketches = scratch.stage(sketch(docs, text, key).withColumnRenamed(key, "id"), "sketches")
    sets = sketches.filter("n_shingles > 0 and id is not null")
    kind = sketches.schema["id"].dataType.simpleString()
    # equal sets have equal sketches, so any row of a digest will do
    heads = scratch.stage(sets.groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
                                             F.first("bands").alias("bands")), "heads")

    bands = heads.select("id", F.explode("bands").alias("bucket"))
    # written before the join: then a bucket that holds many of the rows can be split
    full = scratch.stage(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = bands.join(full, "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "n")).alias("in"))  # at most BANDS each
    members = shared.join(heads.select("id", "sig"), "id").select("id", "sig", F.explode("in").alias("in")) \
        .select("id", "sig", "in.bucket", F.ceil(F.col("in.n") / BLOCK).alias("blocks"))
    edges = "src {0}, dst {0}".format(kind)
    similar = block_pairs(members, "bucket", "id", "blocks").select("pair", "id", "sig").mapInArrow(_edges(kind, _similar(least)), edges)
    groups = connected_components(similar, "similar")
    scratch.tables.append(groups)

    inside = groups.join(heads.select("id", "sig", "digest", "n_shingles"), "id")
    sizes = inside.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    inside = inside.join(sizes, "component").join(texts, "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    linked = block_pairs(inside, "component", "id", "blocks").select("pair", "id", "sig", "text") \
        .mapInArrow(_edges(kind, _linked(least, percent)), edges)

    # a copy follows its representative; only a key with several sets ties their groups together
    of_set = heads.select("digest", F.col("id").alias("head"))
    several = sets.groupBy("id").agg((F.min("digest") < F.max("digest")).alias("several")).filter("several").select("id")
    ties = sets.join(several, "id", "left_semi").join(of_set, "digest").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    found = connected_components(linked.unionByName(ties), "links")
    scratch.tables.append(found)
    found = found.select(F.col("id").alias("head"), F.col("component").alias("component_id"))
    groups_of = of_set.join(found, "head", "left").select("digest", F.coalesce("component_id", "head").alias("component_id"))
    out = sketches.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")) \
        .join(groups_of, "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
