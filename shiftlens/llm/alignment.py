"""Alignment of two tokenizers' tokens by their bytes.

A text's tokens and the bytes they stand for make an incidence matrix, rows for tokens and columns for bytes, kept
as row borders and column numbers (CSR). The product A B^T by Gustavson's rows has an entry where a token of A and one of B
share bytes: the overlap links. Offsets where tokens of both end cut the text into groups; the products of the
group-incidence matrices link tokens of one group. Those products are kept as their two factors (the group's tokens on
either side) and counted, not written out, since a group may be long on both sides.

How often a pair of ids is linked in the whole corpus is a sum over all documents. The pairs that occur most, a bounded number
of them, are broadcast; all others meet the documents that hold them in a join.

Texts are cut into chunks before their white space, where no token of either tokenizer reaches over. Every Python worker keeps
a bounded table of the chunks it met with the ids of both, so that each is encoded once.
"""

from __future__ import annotations

import json
import re
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.llm.bpe import byte_symbols
from shiftlens.llm.common import map_texts, stage
from shiftlens.llm.pieces import MARK, SHORT, Encoder, Model, Table, read_model

#: Pairs that are broadcast at most (24 bytes each).
COMMON = 1 << 19
#: Pairs that a task counts before it passes them on.
HELD_PAIRS = 1 << 20
#: Bytes of text whose matrices are held at a time; a block ends where tokens of both end.
BLOCK = 1 << 18
#: Chunks in each half of a worker's table with the ids of both tokenizers, the characters up to which a chunk is kept there,
#: and chunks in each half of its table of B's segmentation alone.
CHUNKS, CHUNK_CHARS, PARTS = 400_000, 32, 100_000
#: What ``\s`` is in a pattern.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Patterns whose words look at nothing before them and reach neither over white space behind anything else nor from a letter
#: over ASCII punctuation: what stands before such a place, and the rest, are cut alike alone and together.
APART = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}


# ---- sparse matrices ------------------------------------------------------------------------------
Csr = tuple[np.ndarray, np.ndarray]  # (row borders, column numbers)


def expand(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (many[i] of them), one row after another."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def transpose(m: Csr, columns: int) -> Csr:
    """The transposed incidence matrix."""
    borders, cols = m
    rows = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    return np.concatenate(([0], np.cumsum(np.bincount(cols, minlength=columns)))), rows[np.argsort(cols, kind="stable")]


def multiply(a: Csr, b: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product of two incidence matrices: (row, column, number of shared inner entries).

    Every entry (i, k) of ``a`` adds row k of ``b`` to row i of the result; equal columns of a row are then added up."""
    row = np.repeat(np.arange(len(a[0]) - 1), np.diff(a[0]))
    start, many = b[0][a[1]], b[0][a[1] + 1] - b[0][a[1]]
    cell = np.repeat(row, many) * columns + b[1][expand(start, many)]
    if len(cell) and (cell[1:] < cell[:-1]).any():
        cell.sort(kind="stable")
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    return cell[first] // columns, cell[first] % columns, np.diff(np.append(first, len(cell)))


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A, and which of B, end where one of the other ends, for two rising rows of ends of the same bytes."""
    at = np.searchsorted(ends_b, ends_a)  # the last ends are equal
    on_a = ends_b[at] == ends_a
    on_b = np.zeros(len(ends_b), bool)
    on_b[at[on_a]] = True
    return on_a, on_b


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) that share bytes, in order, for two cuts of the same bytes; ``both`` are the common ends, if known."""
    left, right = [], []
    if both is None:
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    at = a0 = b0 = 0
    while at < (both[-1] if len(both) else 0):
        end = both[min(np.searchsorted(both, at + BLOCK), len(both) - 1)]
        a1, b1 = np.searchsorted(ends_a, end, "right"), np.searchsorted(ends_b, end, "right")
        size = int(end - at)
        incidence = [(np.concatenate(([0], ends[x:y] - at)), np.arange(size)) for ends, x, y in ((ends_a, a0, a1), (ends_b, b0, b1))]
        i, j, _ = multiply(incidence[0], transpose(incidence[1], size), max(1, int(b1 - b0)))
        left.append(i + a0)
        right.append(j + b0)
        at, a0, b0 = end, a1, b1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


# ---- tokens ---------------------------------------------------------------------------------------
def read_byte_level(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """(bytes -> id, bytes by id) of a byte-level BPE file whose ids are in the order of its merges, without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    value = {c: b for b, c in enumerate(byte_symbols())}
    ids = {bytes(map(value.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merged = [bytes(map(value.__getitem__, "".join(m if isinstance(m, list) else m.split(" ")))) for m in spec["model"]["merges"]]
    order = [ids[m] for m in merged]
    if order != sorted(order) or spec["normalizer"] is not None or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    texts = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
    for t, i in ids.items():
        texts[i] = t
    return ids, texts


def chunk_patterns(pattern: str, neighbours: set[str]) -> tuple[re.Pattern, re.Pattern] | None:
    """What finds the chunks of a text, and what finds a place (after its match's first character) where one ends; None for
    a pattern that is not known to cut chunks as it cuts the text.

    A chunk ends before white space that follows something else, except such as stands behind something else in a piece
    of B (``neighbours``). No chunk ends inside a run of white space: how that is cut depends on what follows. An empty chunk ends a text."""
    if pattern not in APART:
        return None
    inside = "".join(c for c in SPACES if any(p[1] == c and p[0] not in SPACES for p in neighbours))
    front = "".join(c for c in SPACES if c not in inside)
    more = f"(?:[{inside}][{front}]*+[^{SPACES}]*+)*+" if inside else ""
    return re.compile(f"[{front}]*+[^{SPACES}]*+{more}"), re.compile(f"[^{SPACES}][{front}]")


class Side:
    """The byte lengths of a vocabulary's tokens, and each id's decimal text with each of the marks that may follow it."""

    def __init__(self, texts: list[bytes], marks: tuple[str, ...]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.written = [f"{i}{mark}" for i in range(len(texts)) for mark in marks]


class Chunks(Table):
    """Distinct chunks with their ids of A and then those of B, raised by the size of A's vocabulary, as 32-bit numbers.

    With ``apart``, punctuation behind a word is a chunk of its own where no piece of B reaches over the border: its ids of both follow
    the word's ids of both."""

    def __init__(self, first, encoder: Encoder, ids_a: int, apart: bool):
        super().__init__(encoder, lambda ids: array("i", [ids_a + i for i in ids]).tobytes(), b"", CHUNKS, CHUNK_CHARS)
        self.first, self.second, self.apart = first, Table(encoder, self.form, b"", PARTS), apart

    def made(self, chunk: str) -> bytes:
        if self.apart:
            word = chunk.rstrip(punctuation)
            n = len(word)
            if 0 < n < len(chunk) and word[-1].isalpha() and chunk[n - 1:n + 1] not in self.encoder.neighbours:
                return self[word] + self[chunk[n:]]
        a = array("i", self.first.encode_ordinary(chunk)).tobytes()
        marked = chunk.replace(MARK, " ")
        if len(marked) <= SHORT:
            return a + self.form(self.encoder.segment(marked))
        return a + b"".join([b"".join(map(self.second.__getitem__, part)) for part in self.encoder.chunks(marked.encode())])


class Aligner:
    def __init__(self, pattern: str, ids_a: dict[bytes, int], texts_a: list[bytes], model_b: Model):
        import tiktoken

        encoder = Encoder(model_b)
        self.a, self.b = Side(texts_a, (",", "|")), Side(model_b.texts, (",", ";", ""))
        self.ids_a, self.ids_b = len(texts_a), len(model_b.texts)
        self.patterns = chunk_patterns(pattern, encoder.neighbours)
        first = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ids_a, special_tokens={})
        self.table = Chunks(first, encoder, self.ids_a, self.patterns is not None)
        self.pieces = pa.array(self.a.written + self.b.written)

    def chunks(self, text: str):
        """The chunks of a text, in blocks of about ``BLOCK`` characters that end between two chunks."""
        if self.patterns is None:
            yield [text]
            return
        chunk, border = self.patterns
        at = 0
        while at < len(text):
            cut = border.search(text, at + BLOCK)
            end = cut.start() + 1 if cut else len(text)
            yield chunk.findall(text, at, end)
            at = end

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids of A and those of B, and the number of each one's text; a text has none where either's bytes
        are not the text's with a space in front.

        Both cut what they are given and drop nothing: A is given the text with the space, B the same with a space for every
        marker. The bytes differ where the lengths do: a marker has three bytes, its space one."""
        known, n = self.table.__getitem__, len(texts)
        found = [b"".join([b"".join(map(known, part)) for part in self.chunks(" " + t.decode())]) if t else b"" for t in texts]
        code = np.frombuffer(b"".join(found), np.int32)
        doc = np.repeat(np.arange(n), [len(x) // 4 for x in found])
        of_b = code >= self.ids_a
        a, b, doc_a, doc_b = code[~of_b].astype(np.int64), code[of_b].astype(np.int64) - self.ids_a, doc[~of_b], doc[of_b]
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        whole = (np.bincount(doc_a, self.a.size[a], n) == size) & (np.bincount(doc_b, self.b.size[b], n) == size)
        if not whole.all():
            in_a, in_b = whole[doc_a], whole[doc_b]
            a, b, doc_a, doc_b = a[in_a], b[in_b], doc_a[in_a], doc_b[in_b]
        return a, b, doc_a, doc_b

    def align(self, texts: list[bytes | None]) -> dict[str, list]:
        """One entry per text and output of ``align``."""
        n = len(texts)
        a, b, doc_a, doc_b = self.tokens(texts)
        many = [np.bincount(doc, minlength=n) for doc in (doc_a, doc_b)]
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])  # all texts in one row of bytes
        on_a, on_b = common_ends(ends_a, ends_b)
        common = ends_a[on_a]
        left, right = overlap_links(ends_a, ends_b, common)
        links = np.bincount(doc_a[left], minlength=n)
        # distinct pairs of ids of each text with their number of links
        width = len(self.a.size) * self.ids_b
        cell, times = np.unique(doc_a[left] * width + a[left] * self.ids_b + b[right], return_counts=True)
        border = np.searchsorted(cell, np.arange(n + 1) * width)
        pair = cell % width
        # groups: tokens up to each common end; the factors of the shared-group product
        group_a, group_b = np.cumsum(on_a) - on_a, np.cumsum(on_b) - on_b
        in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        of = np.zeros(len(common), np.int64)
        of[group_a] = doc_a
        shared = np.zeros(n, np.int64)
        np.add.at(shared, of, in_a * in_b)
        return {"n_a": many[0], "n_b": many[1], "n_groups": np.bincount(of, minlength=n), "n_links": links, "n_shared": shared,
                "groups": self.written(a, b, (group_a, in_a, on_a), (group_b, in_b, on_b), *many), "pairs": np.split(pair, border[1:-1]),
                "times": np.split(times, border[1:-1])}

    def written(self, a, b, of_a, of_b, many_a, many_b) -> list[str]:
        """Every text's groups as ``a1,a2|b1;a3|b2,b3``: groups hold neighbours, so A's and B's tokens are merged by group.

        ``of_a`` and ``of_b`` are the groups of the tokens, their numbers of tokens, and which token is a group's last;
        ``many_a`` and ``many_b`` are the texts' numbers of tokens."""
        (group_a, in_a, last_a), (group_b, in_b, last_b) = of_a, of_b
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]  # behind B's tokens of the groups before
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a] = a * 2 + last_a                              # "," or, behind the group's last one, "|"
        of_b = len(self.a.written) + b * 3 + last_b                 # "," or ";"
        of_b[(np.cumsum(many_b) - 1)[many_b > 0]] += 1              # nothing behind the text's last one
        code[place_b] = of_b
        borders = np.concatenate(([0], np.cumsum(many_a + many_b)))
        return pc.binary_join(pa.LargeListArray.from_arrays(borders, self.pieces.take(pa.array(code))), "").to_pylist()


FIELDS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_shared": "bigint", "groups": "string",
          "pairs": "array<bigint>", "times": "array<bigint>"}


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Align the tokens of every text, as ``path_a`` (byte-level BPE) and ``path_b`` (SentencePiece) cut it.

    Adds ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlap links), ``n_shared`` (links of tokens in one group),
    ``groups`` (``a1,a2|b1;a3|b2,b3``), and ``pairs`` with ``times``: the distinct pairs of linked ids (a's id times the size of B's
    vocabulary plus b's) and how often each is linked. ``pattern`` cuts texts into A's words. Texts are used whole;
    those that are null, empty, or not given back by the tokens' bytes have no tokens: zeros, '' and empty lists.
    Repeated rows are aligned each; an input column named like an output is replaced.
    """
    ids_a, texts_a = read_byte_level(path_a)
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (pattern, ids_a, texts_a, read_model(path_b))})

    def make():
        held = shared.value
        if "aligner" not in held:  # kept by the Python worker for its next tasks
            held["aligner"] = Aligner(*held["parts"])
        aligner = held["aligner"]

        def work(texts, _):
            out, at, size = [], 0, 0
            for end, t in enumerate(texts, 1):  # some texts at a time, so that the arrays stay small
                size += len(t or b"")
                if size >= BLOCK or end == len(texts):
                    out.append(aligner.align(texts[at:end]).values())
                    at, size = end, 0
            return [[x for part in column for x in part] for column in zip(*out)] if out else [[] for _ in FIELDS]

        return work

    return map_texts(docs, make, FIELDS, text, keep)


# ---- counts over the corpus -----------------------------------------------------------------------
def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): links of each pair of ids in the corpus, and whether no other pair of its B id has more."""

    def run(batches):
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            keys, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
            added = np.zeros(len(keys), np.int64)
            np.add.at(added, back, np.concatenate((sums, times)))
            sums = added
            if len(keys) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    counts = stage(aligned.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("pair", F.lit(ids_b))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most one row per id of B
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, path_b: str, common: int = COMMON) -> DataFrame:
    """What ``align`` returns (``path_b`` as there), with ``pairs`` and ``times`` replaced by ``n_best``, the links whose
    pair is linked most of all pairs of its B id in the corpus (ties included), and ``count_sum``, the corpus-wide numbers of
    links of the pairs, summed over the links. A text without tokens has zeros.

    Eager: ``aligned`` is written once. The most frequent pairs, at most ``common``, are broadcast; a document's other
    pairs meet their counts in a join. None of those is frequent, so no key is hot.
    """
    spark, ids_b = aligned.sparkSession, len(read_model(path_b).texts)
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = stage(aligned.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"),
                                "pairs", "times"), "aligned")
    counts = stage(pair_counts(rows, ids_b), "pair-counts")
    # the smallest power of two that no more than ``common`` pairs reach
    power = F.floor(F.log2("n")).cast("int").alias("power")
    limit, total = 64, 0
    for r in counts.groupBy(power).count().orderBy(F.col("power").desc()).collect():
        total += r["count"]
        if total > common:
            break
        limit = r["power"]
    often = F.col("n") >= F.lit(2.0) ** F.lit(limit)
    table = counts.filter(often).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast({c: table.column(c).to_numpy() for c in ("pair", "n", "best")})

    def run(batches):
        pair, n, best = (shared.value[c] for c in ("pair", "n", "best"))
        for batch in batches:
            ends = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            own = batch.column("pairs").values.to_numpy()[ends[0]:ends[-1]]
            times = batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[found], times[found] * n[at[found]])
            np.add.at(sums[1], row[found], times[found] * best[at[found]])
            borders = pa.array(np.searchsorted(row[~found], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(borders, pa.array(x[~found])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("kept"), pa.array(sums[0]), pa.array(sums[1]), *rest], names=names)

    names = ["row", "kept", "count_sum", "n_best", "pairs", "times"]
    schema = T.StructType([rows.schema["row"], rows.schema["kept"], T.StructField("count_sum", T.LongType()), T.StructField("n_best", T.LongType()),
                           rows.schema["pairs"], rows.schema["times"]])
    known = stage(rows.mapInArrow(run, schema), "common-links")
    # both sides grow with the input, so neither is ever broadcast
    rest = (known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), "e.times")
            .join(counts.filter(~often).hint("merge"), "pair")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rest_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("rest_best")))
    both = known.select("row", "kept", "count_sum", "n_best").join(rest.hint("merge"), "row", "left")
    return both.select("kept.*", (F.col("n_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
                       (F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"))
