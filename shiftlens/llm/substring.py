"""Substring de-duplication with suffix automata of reference shards.

A window of ``size`` words is removed where the same words also start earlier (smaller key, or earlier in
the same document). The corpus is its own reference:

1. Every window has an anchor: its k-gram of words with the smallest hash. Equal windows have equal
   anchors at equal places, so only windows whose anchor occurs more than once can repeat. Neighbouring
   windows with the same anchor form a segment.
   An anchor that occurs only in copies of one whole text is no reason to look into it: the first of
   the copies stands for the others, whose windows all start earlier in it.
2. Segments with a repeated anchor are taken from the texts. Equal ones collapse to their first
   occurrence; all windows of the others start earlier elsewhere and are removed.
3. The distinct segments are dealt by anchor to reference shards of bounded size. A task builds the suffix
   automaton of a shard and streams the shard's segments through it for matching statistics: a match of
   ``size`` words or more gives the window's first occurrence, and the window is removed if that is
   not its own.

Anchors with more distinct segments than a shard may hold (say, a passage of which a third of all
documents differ in the word that follows) are settled by the first occurrence of each window's words
instead: a pre-aggregated group-by and a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import Scratch, emit_rows, flat, map_texts, nested, stage

SIZE = 20
#: Words of an anchor. A text has about one anchor in (SIZE - ANCHOR + 2) / 2 = 8 words.
ANCHOR = 6
#: Words that a task puts into one automaton (about 1 KB of memory each word).
SHARD_WORDS = 60_000
#: Distinct segments of one anchor, beyond which its windows are settled by a group-by.
ANCHOR_SEGMENTS = 1_500
#: Bytes whose words are hashed at a time, and the length from which a word is hashed on its own.
BLOCK, LONG_WORD = 1 << 18, 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Splitter:
    """Words of many texts at a time, as numbers: made once per task."""

    def __init__(self):
        self.is_word = np.ones(256, bool)
        self.is_word[list(b" \t\n\x0b\x0c\r")] = False
        # powers of an odd number and of its inverse modulo 2^64: a word's hash is a difference of prefix sums
        self.power, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, x, np.uint64))))
                                 for x in (int(_STEP), pow(int(_STEP), -1, 1 << 64)))

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each word, and where it starts and ends in the text."""
        buf = np.frombuffer(text, np.uint8)
        inside = np.concatenate(([False], self.is_word[buf], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):  # some bytes at a time
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, "right")))
            part = buf[lo:min(int(end[j - 1]), lo + BLOCK)].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * self.power[:len(part)])))
            s, e = start[i:j] - lo, np.minimum(end[i:j] - lo, len(part))
            out[i:j] = (sums[e] - sums[s]) * self.back[s]
            i = j
        for w in np.flatnonzero(end - start > LONG_WORD).tolist():
            out[w] = xxhash.xxh3_64_intdigest(text[start[w]:end[w]])
        return _mixed(out), start, end

    def segments(self, texts: list[bytes], size: int = SIZE, k: int = ANCHOR) -> Segments:
        """The segments of all texts, in order."""
        joined = b"\n".join(texts)
        h, start, end = self.words(joined)
        border = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # the first word of each text
        doc = np.repeat(np.arange(len(texts)), np.diff(border))
        none = np.empty(0, np.int64)
        n = len(h) - size + 1
        if n < 1:
            return Segments(joined, start, end, border, none, none, none, none)
        grams = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * _STEP + h[j:len(h) - k + 1 + j]
        grams = _mixed(grams)
        window = np.flatnonzero(doc[:n] == doc[size - 1:])  # those inside one text
        at = (sliding_window_view(grams, size - k + 1).argmin(1) + np.arange(n))[window]  # the leftmost of equal hashes
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)))) if len(window) else none
        of = doc[window[first]]
        return Segments(joined, start, end, border, of, grams[at[first]].view(np.int64), window[first] - border[of], np.diff(np.append(first, len(window))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Segments:
    text: bytes          # all texts, one per line or more
    start: np.ndarray    # of each word in it
    end: np.ndarray
    border: np.ndarray   # the first word of each text
    doc: np.ndarray      # of each segment: the number of its text, its anchor, first window and number of windows
    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def content(self, i: int, size: int) -> bytes:
        """The words of a segment, joined by single spaces."""
        w = self.border[self.doc[i]] + self.first[i]
        return b" ".join(self.text[self.start[w]:self.end[w + self.count[i] + size - 2]].split())


class SuffixAutomaton:
    """Of several word sequences; every state has the place at which its words first end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, words: list, place: int) -> None:
        """Insert a sequence whose word i is at ``place + i``; sequences come in order of place."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for i, w in enumerate(words):
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to  # these words are known already
                continue
            if to is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(place + i)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
                last = new
            else:
                last = self._split(last, to, w)

    def _split(self, p: int, q: int, w) -> int:
        """A state of its own for the shorter words of q that end in p's words and w."""
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matches(self, words: list, size: int) -> Iterator[int]:
        """Matching statistics: for each word, where the last ``size`` words first end, or -1 if the longest
        match that ends here is shorter."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = n = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            while state and length[link[state]] >= size:
                state = link[state]
                n = length[state]
            yield first[state] if n >= size else -1


def _own_windows(size: int, shard_words: int):
    """mapInArrow over distinct segments sorted by anchor: windows of their first occurrence that another
    segment has earlier."""

    def judge(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort()  # by first occurrence
        seqs = [r[3].split(b" ") for r in rows]
        places = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).tolist()
        automaton = SuffixAutomaton()
        for s, place in zip(seqs, places):
            automaton.add(s, place)
        for (doc, h, start, _), s, place in zip(rows, seqs, places):
            for i, ends in enumerate(automaton.matches(s, size)):
                if 0 <= ends < place + i:
                    yield doc, h, start + i - size + 1, 1

    def run(batches):
        pending, words, last = [], 0, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("anchor", "doc", "h", "start")] + [b.column("content").cast(pa.binary()).to_pylist()]
            out = []
            for anchor, doc, h, start, content in zip(*cols):
                if anchor != last and words >= shard_words:  # equal anchors stay in one shard
                    out += judge(pending)
                    pending, words = [], 0
                last = anchor
                pending.append((doc, h, start, content))
                words += content.count(b" ") + 1
            if out:
                yield _ranges(out, b.schema.field("doc").type)
        if pending:
            yield _ranges(list(judge(pending)), b.schema.field("doc").type)

    return run


def _ranges(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    doc, h, start, n = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                                      names=["doc", "h", "start", "n"])


def _explode_windows(size: int):
    """mapInArrow over distinct segments: a row for every window, with a 128-bit hash of its words."""

    def work(b):
        out = {"wa": [], "wb": [], "doc": [], "h": [], "start": []}
        for doc, h, start, content in zip(*(b.column(c).to_pylist() for c in ("doc", "h", "start")), b.column("content").cast(pa.binary()).to_pylist()):
            words = content.split(b" ")
            for i in range(len(words) - size + 1):
                x = xxhash.xxh3_128_intdigest(b" ".join(words[i:i + size]))
                out["wa"].append((x >> 64) - (1 << 63))
                out["wb"].append((x & ((1 << 64) - 1)) - (1 << 63))
                out["doc"].append(doc)
                out["h"].append(h)
                out["start"].append(start + i)
        yield out

    return lambda: work


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BLOCK`` bytes together."""
    at = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= BLOCK or i == len(texts):
            yield at, i
            at, size = i, 0


def _anchored(rows: DataFrame, size: int) -> DataFrame:
    """Per document: a 128-bit digest of its text, its number of words, the SHA-256 of its words joined by single
    spaces, and its segments' anchors and first windows; ``again`` marks anchors that occur twice in the text."""

    def make():
        splitter = Splitter()

        def part(texts):
            s = splitter.segments(texts, size)
            # an anchor that is repeated in its text; the few that only seem so do no harm
            _, back, counts = np.unique(s.anchor.view(np.uint64) + s.doc.astype(np.uint64) * _STEP, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(s.doc, np.arange(1, len(texts)))
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
            return (digests[:, 0].tolist(), digests[:, 1].tolist(), np.diff(s.border).tolist(), [hashlib.sha256(b" ".join(t.split())).digest() for t in texts],
                    *(np.split(x, cuts) for x in (s.anchor, s.first, (counts[back] > 1).astype(np.int32))))

        def work(texts, _):
            parts = [part(texts[a:b]) for a, b in _groups(texts)]
            return [[x for p in parts for x in p[i]] for i in range(7)]

        return work

    fields = {"da": "bigint", "db": "bigint", "n_words": "bigint", "sha": "binary", "anchors": "array<bigint>", "starts": "array<bigint>",
              "again": "array<int>"}
    return map_texts(rows, make, fields, keep=["doc", "h"])


@dataclass
class Repeats:
    """What is repeated in a corpus, by document (``doc`` is its key, ``h`` a hash of its text)."""

    texts: DataFrame      # doc, h, n_words, sha: every document
    copies: DataFrame     # doc, h, n_words: documents whose whole text has a smaller key elsewhere
    corpus: DataFrame     # doc, h, packed: compressed texts of the documents that were looked into
    ranges: DataFrame     # doc, h, start, n: windows to remove from them

    def spans(self, size: int) -> DataFrame:
        """(doc, h, starts, counts) of all documents with removable windows."""
        whole = self.copies.filter(F.col("n_words") >= size).select("doc", "h", F.lit(0).cast("bigint").alias("start"), (F.col("n_words") - size + 1).alias("n"))
        return _gathered(self.ranges.unionByName(whole))


def _gathered(ranges: DataFrame) -> DataFrame:
    """The ranges of each document in one row: as many as the document has segments at most, or windows."""
    return ranges.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "n")).alias("r")) \
        .select("doc", "h", F.col("r.start").alias("starts"), F.col("r.n").alias("counts"))


def find_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", size: int = SIZE,
                 shard_words: int = SHARD_WORDS, anchor_segments: int = ANCHOR_SEGMENTS, corpus_again: bool = True) -> Repeats:
    """The windows to remove; rows with a null key or text take no part. The tables in ``scratch`` must outlive the use
    of the result. Tables are deleted as soon as nothing needs them; without ``corpus_again`` the corpus is one of them."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    anchors = scratch.stage(_anchored(rows, size), "anchors")
    known = scratch.stage(anchors.select("doc", "h", "da", "db", "n_words", "sha"), "texts")  # what outlives the anchors
    occurrence = F.struct("doc", "h", "start")

    # a whole text that is there already: the first of its copies stands for all of them
    # (tables of the few are written before the many are joined to them: then a hot key can be split)
    firsts = known.groupBy("da", "db").agg(F.min(F.struct("doc", "h")).alias("first"), F.max(F.struct("doc", "h")).alias("last"))
    firsts = scratch.stage(firsts.filter("first <> last").select("da", "db", "first"), "firsts")
    copies = known.select("doc", "h", "da", "db", "n_words").join(firsts, ["da", "db"]).filter(F.struct("doc", "h") != F.col("first")) \
        .select("doc", "h", "n_words").distinct()

    found = anchors.select("doc", "h", F.explode(F.arrays_zip("anchors", "starts", "again")).alias("a")) \
        .select(F.col("a.anchors").alias("anchor"), "doc", "h", F.col("a.starts").alias("start"), F.col("a.again").alias("again"))
    often = found.groupBy("anchor").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("again").alias("again")) \
        .filter("lo <> hi or again = 1").select("anchor")
    often = scratch.stage(often, "often")
    flagged = found.select("anchor", "doc", "h", "start").join(often, "anchor").groupBy("doc", "h").agg(F.collect_set("start").alias("starts")) \
        .join(copies, ["doc", "h"], "left_anti")  # the starts are those of one document

    def pack():
        z = zstandard.ZstdCompressor(level=1)
        return lambda texts, _: ([z.compress(t) for t in texts],)

    corpus = scratch.stage(map_texts(rows, pack, {"packed": "binary"}, keep=["doc", "h"]).join(flagged, ["doc", "h"]), "corpus")
    scratch.discard(anchors)

    def take():
        splitter, z = Splitter(), zstandard.ZstdDecompressor()

        def work(b):
            texts = [z.decompress(p) for p in b.column("packed").to_pylist()]
            for lo, hi in _groups(texts):
                yield part(b.slice(lo, hi - lo), texts[lo:hi])

        def part(b, texts):
            s = splitter.segments(texts, size)
            asked = b.column("starts")
            rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(asked).to_numpy())
            on = np.flatnonzero(np.isin((s.doc << 40) + s.first, (rows << 40) + asked.flatten().to_numpy()))
            contents = [s.content(i, size) for i in on.tolist()]
            digests = [xxhash.xxh3_128_digest(c) for c in contents]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            # a segment that stood in its text before is removed; its words need not be looked at again
            seen: set[tuple[int, bytes]] = set()
            for i, key in enumerate(zip(s.doc[on].tolist(), digests)):
                if key in seen:
                    contents[i] = None
                seen.add(key)
            of = pa.array(s.doc[on])
            return {"anchor": s.anchor[on], "ca": halves[:, 0], "cb": halves[:, 1], "content": contents, "doc": b.column("doc").take(of), "h": b.column("h").take(of),
                   "start": s.first[on], "n": s.count[on]}

        return work

    taken = emit_rows(corpus, take, f"anchor bigint, ca bigint, cb bigint, content string, doc {kind}, h bigint, start bigint, n bigint", ["doc", "h", "packed", "starts"])
    taken = scratch.stage(taken, "segments")
    if not corpus_again:
        scratch.discard(corpus)
    in_text = taken.filter("content is null").select("doc", "h", "start", "n")
    taken = taken.filter("content is not null")
    distinct = scratch.stage(taken.groupBy("anchor", "ca", "cb").agg(F.min(occurrence).alias("own"), F.first("content").alias("content"))
                     .select("anchor", "ca", "cb", "own.*", "content"), "distinct")
    # all windows of a later occurrence of the same segment start earlier in its first one
    later = taken.select("ca", "cb", "doc", "h", "start", "n").join(distinct.select("ca", "cb", occurrence.alias("own")), ["ca", "cb"]) \
        .filter(occurrence != F.col("own")).select("doc", "h", "start", "n")

    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > anchor_segments).select("anchor")
    crowded = scratch.stage(crowded, "crowded")
    few = distinct.join(crowded, "anchor", "left_anti").select("anchor", "doc", "h", "start", "content") \
        .repartition("anchor").sortWithinPartitions("anchor")
    by_automaton = few.mapInArrow(_own_windows(size, shard_words), f"doc {kind}, h bigint, start bigint, n bigint")

    windows = emit_rows(distinct.join(crowded, "anchor", "left_semi"), _explode_windows(size), f"wa bigint, wb bigint, doc {kind}, h bigint, start bigint",
                        ["doc", "h", "start", "content"])
    windows = scratch.stage(windows, "windows")
    earliest = scratch.stage(windows.groupBy("wa", "wb").agg(F.min(occurrence).alias("own")), "earliest")
    by_window = windows.join(earliest, ["wa", "wb"]).filter(occurrence != F.col("own")).select("doc", "h", "start", F.lit(1).cast("bigint").alias("n"))

    ranges = in_text.unionByName(later).unionByName(by_automaton).unionByName(by_window)
    return Repeats(known.select("doc", "h", "n_words", "sha"), copies, corpus, ranges)


def removed_words(n_words: int, starts: list[int] | None, counts: list[int] | None, size: int = SIZE) -> np.ndarray:
    """True for every word that a removable window covers."""
    if not starts:
        return np.zeros(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    s, n = np.array(starts), np.array(counts)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, **limits: int) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row of ``docs``.

    A null text has no words. Rows with the same key and the same text are one document, and rows with the
    same key and different texts are told apart (and ordered) by a hash of the text. Rows with a null
    key are compared with nothing and keep all their words. The result is a written table; those on the
    way to it are deleted.
    """
    with Scratch(docs.sparkSession) as scratch:
        return stage(_digests(docs, find_repeats(docs, scratch, text, key, size, **limits), text, key, size), "kept-words")


def _digests(docs: DataFrame, found: Repeats, text: str, key: str, size: int) -> DataFrame:
    nothing = hashlib.sha256(b"").hexdigest()

    def cut():
        unpack = zstandard.ZstdDecompressor().decompress

        def work(texts, b):
            rows = []
            for p, s, n in zip(texts, b.column("starts").to_pylist(), b.column("counts").to_pylist()):
                words = unpack(p).split()
                gone = removed_words(len(words), s, n, size)
                rows.append((int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()))
            return list(zip(*rows, strict=True)) if rows else [[]] * 2

        return work

    changed = map_texts(found.corpus.drop("starts").join(_gathered(found.ranges), ["doc", "h"]), cut, {"n_removed": "bigint", "kept": "string"},
                        "packed", ["doc", "h"], ("starts", "counts")).dropDuplicates(["doc", "h"])
    whole = found.copies.filter(F.col("n_words") >= size).select("doc", "h", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept"))
    compared = found.texts.join(changed.unionByName(whole), ["doc", "h"], "left").select(
        F.col("doc").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"))

    def count():
        def work(texts, _):
            words = [(t or b"").split() for t in texts]
            return [len(w) for w in words], [0] * len(words), [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]

        return work

    rest = docs.select(F.col(key), F.col(text).alias("text")).filter(F.col(key).isNull() | F.col("text").isNull())
    return compared.unionByName(map_texts(rest, count, {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}, "text", [key]))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def dedup_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, **limits: int) -> DataFrame:
    """``docs`` with the repeated words cut from their texts, each together with the white space behind it.

    All other columns, and the texts without repeats, stay as they are; a text may become empty. Nulls and
    repeated rows are treated as in ``dedup_digests``.
    """
    with Scratch(docs.sparkSession) as scratch:
        spans = stage(find_repeats(docs, scratch, text, key, size, corpus_again=False, **limits).spans(size), "spans")
    # the other columns travel as one, so that their names are of no matter
    rows = nested(docs, text).withColumn("h", F.xxhash64("text")).withColumn("doc", F.col(f"row.`{key}`"))
    joined = rows.join(spans.select("doc", "h", "starts", "counts"), ["doc", "h"], "left")

    def make():
        def work(texts, b):
            out = []
            for t, s, n in zip(texts, b.column("starts").to_pylist(), b.column("counts").to_pylist()):
                if s:
                    gone = removed_words(len(t.split()), s, n, size).tolist()
                    lead = t[:len(t) - len(t.lstrip())]
                    t = lead + b"".join(w for w, g in zip(_WORD.findall(t), gone) if not g)
                out.append(t if t is None else t.decode())
            return (out,)

        return work

    return flat(map_texts(joined, make, {"cut": "string"}, "text", ["row"], ("starts", "counts")).withColumnRenamed("cut", "text"), docs.columns, text)
