"""Language-model scoring with class-based bigrams.

P(word | word before) = P(class | class before) x P(word | class). The classes come from exchange clustering of
the most frequent words. Every other word seen in training joins the class that explains its neighbours best: the neighbours
of each word are counted once, grouped by word, and words are placed in rounds, each by the classes of the round
before. Words never seen go by their endings. All counts are over the whole training corpus.

The most frequent words and their classes are broadcast (a bounded number); a text's other words are looked up by
a join with the vocabulary. As neighbours of others, those others count as one class of their own while words are placed.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.llm.common import Scratch, map_texts, raw_texts, release, slices, stage

CLASSES = 48
#: Words that are clustered by exchange, words that are then added one by one, and words whose counts are broadcast.
CORE, MIDDLE, HOT = 512, 10_000, 100_000
#: Longer words are never broadcast.
HOT_BYTES = 64
ROUNDS = 12
#: Rounds in which words outside the core are placed at most, and the share of their occurrences that may move in the last one.
PLACE_ROUNDS, STABLE = 4, 0.01
#: Added to the counts of words and of class transitions.
WORD_ADD, CLASS_ADD = 0.5, 0.1
FLUSH = 250_000
#: Words outside the hot ones whose endings' classes a task remembers; all are forgotten when there are so many.
ENDING_MEMORY = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


@dataclass
class Model:
    """What scoring needs: ``hot`` words by id, the class of each, the classes by ending, totals and matrices.

    Class ``CLASSES`` is the end of a text, which also stands before its first word.
    """

    hot: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    endings: dict[bytes, int]
    tokens: int
    distinct: int
    docs: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    steps: np.ndarray       # log10 of class transitions

    def base(self, count) -> np.ndarray:
        return np.log10((np.asarray(count, float) + 1) / (self.tokens + self.distinct + 1))


class Classes(dict):
    """Id of a hot word, or the number of hot words plus the class of any other."""

    def __init__(self, hot: list[bytes], endings: dict[bytes, int]):
        super().__init__(zip(hot, range(len(hot))))
        self.endings, self.n, self.others = endings, len(hot), []

    def __missing__(self, word: bytes) -> int:
        if len(self.others) >= ENDING_MEMORY:
            for w in self.others:
                del self[w]
            self.others = []
        got = self[word] = self.n + by_ending(word, self.endings)
        self.others.append(word)
        return got


def by_ending(word: bytes, endings: dict[bytes, int]) -> int:
    for n in (3, 2, 1, 0):
        got = endings.get(word[len(word) - n:] if n <= len(word) else word)
        if got is not None:
            return got
    return 0


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts``.text; a task adds its own counts up first."""

    def run(batches):
        held: Counter = Counter()
        for b in slices(batches):
            for t in raw_texts(b.column("text")):
                held.update(words_of(t))
            if len(held) > FLUSH:
                yield _counted(held)
                held.clear()
        yield _counted(held)
        del held
        release()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word, in order of frequency: words move to the class with the greatest likelihood of the class bigrams until none
    moves. ``pairs`` counts word bigrams; the last two rows and columns are all other words and
    the end of a text, which stay in classes of their own."""
    n = len(pairs) - 2
    total = classes + 2
    # the most frequent words begin with a class each; the others come from the class of all other words
    own = np.concatenate([np.where(np.arange(n) < classes, np.arange(n), classes), [classes, classes + 1]])
    one = np.eye(total)[own]
    table = one.T @ pairs @ one
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            onto = np.bincount(own, pairs[w], total)
            into = np.bincount(own, pairs[:, w], total)
            self_n, k = pairs[w, w], own[w]
            onto[k] -= self_n
            into[k] -= self_n
            table[k] -= onto
            table[:, k] -= into
            table[k, k] -= self_n
            c = np.arange(classes)
            gain = (_xlogx(table[c] + onto) - _xlogx(table[c])).sum(1) + (_xlogx(table[:, c] + into[:, None]) - _xlogx(table[:, c])).sum(0)
            diagonal = table[c, c]
            gain += _xlogx(diagonal + onto[c] + into[c] + self_n) + _xlogx(diagonal) - _xlogx(diagonal + onto[c]) - _xlogx(diagonal + into[c])
            left, right = table.sum(1)[c], table.sum(0)[c]
            gain -= _xlogx(left + pairs[w].sum()) - _xlogx(left) + _xlogx(right + pairs[:, w].sum()) - _xlogx(right)
            best = int(gain.argmax())
            if k < classes and gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            own[w] = best
            table[best] += onto
            table[:, best] += into
            table[best, best] += self_n
        if not moved:
            break
    return own[:n]


def contexts(texts: DataFrame, listed: list[bytes], core: int) -> DataFrame:
    """(word, id, next, n, codes, counts): what stands beside each word of ``texts``.text, and how often.

    A code is twice a listed word's number, plus one for a neighbour on the right; ``len(listed)`` is the end of a text (the word
    b"" here) and the number behind it any unlisted word, as is an id. The first ``core`` words and the end have their right
    neighbours among themselves and unlisted neighbours only; the other words have the rest. ``next`` is null but in rows
    that count two unlisted words side by side (``n`` times, 0 elsewhere). Codes and counts are packed into bytes, as
    Spark handles arrays number by number. A task adds its own counts up first; a word's rows are added up where they meet,
    and what is listed per word is bounded by twice the listed words.
    """
    n = len(listed)
    end, rare = n, n + 1
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def count(batches):
        ids = Numbers(shared.value)
        names = [*shared.value, b"", None]
        parts, pairs, held = [], [], 0

        def rows():
            word_of = [*names, *ids.unlisted]
            key, many = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64),) * 2
            word = key // (2 * rare + 2)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(key) else np.empty(0, np.int64)
            which, borders = word[first], np.append(first, len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array([word_of[w] for w in which.tolist()], pa.binary()), pa.array(np.minimum(which, rare).astype(np.int32)), pa.nulls(len(which), pa.binary()),
                 pa.array(np.zeros(len(which), np.int64)), packed((key % (2 * rare + 2)).astype(np.int32), borders), packed(many.astype(np.int64), borders)],
                names=CONTEXT)
            x, y = np.concatenate([np.empty((2, 0), np.int64), *pairs], 1)
            key, many = np.unique(x * len(word_of) + y, return_counts=True)
            nothing = packed(np.empty(0, np.int64), np.zeros(len(key) + 1, np.int64))
            x, y = (pa.array([word_of[w] for w in side.tolist()], pa.binary()) for side in (key // len(word_of), key % len(word_of)))
            yield pa.RecordBatch.from_arrays(
                [x, pa.array(np.full(len(key), rare, np.int32)), y, pa.array(many.astype(np.int64)), nothing, nothing], names=CONTEXT)

        for b in slices(batches):
            number = ids.__getitem__
            tokens = [end]
            for t in raw_texts(b.column("text")):
                tokens += map(number, words_of(t))
                tokens.append(end)
            if b.num_rows:
                a = np.array(tokens, np.int64)
                near, top = np.minimum(a, rare), (a < core) | (a == end)
                x, y = a[:-1], a[1:]
                right, left = ~top[:-1] | top[1:] | (y > end), ~top[1:] | (x > end)
                parts += [x[right] * (2 * rare + 2) + near[1:][right] * 2 + 1, y[left] * (2 * rare + 2) + near[:-1][left] * 2]
                both = (x > end) & (y > end)
                pairs.append(np.stack((x[both], y[both])))
                held += len(parts[-1]) + len(parts[-2])
            if held > 16 * FLUSH:
                yield from rows()
                ids.forget()
                parts, pairs, held = [], [], 0
        yield from rows()
        release()

    def add_up(batches):
        late = None  # the last word's rows: more may come
        for b in batches:
            t = pa.Table.from_batches([b])
            if late is not None:
                t = pa.concat_tables([pa.Table.from_batches([late]).cast(b.schema), t]).combine_chunks()
            new = np.zeros(max(0, t.num_rows - 1), bool)
            for c in ("word", "next"):
                x = pc.fill_null(t.column(c), b"")  # no word
                new |= pc.not_equal(x.slice(1), x.slice(0, len(new))).to_numpy()
            if t.num_rows:
                first = [0, *(np.flatnonzero(new) + 1).tolist()]
                yield _added(t.slice(0, first[-1]), first[:-1], 2 * rare + 2)
                late = _added(t.slice(first[-1]), [0], 2 * rare + 2)
        if late is not None:
            yield late
        release()

    raw = texts.select("text").mapInArrow(count, CONTEXT_SCHEMA).repartition("word").sortWithinPartitions("word", "next")
    return raw.mapInArrow(add_up, CONTEXT_SCHEMA)


CONTEXT = ["word", "id", "next", "n", "codes", "counts"]
CONTEXT_SCHEMA = "word binary, id int, next binary, n bigint, codes binary, counts binary"


def packed(numbers: np.ndarray, borders: np.ndarray) -> pa.Array:
    """A row of bytes for the numbers between each two borders."""
    at = pa.py_buffer((borders * numbers.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(numbers))])


def unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row of ``packed`` has, and all of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, kind)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    numbers = np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind) if at[-1] > at[0] else np.empty(0, kind)
    return np.diff(at) // numbers.itemsize, numbers


class Numbers(dict):
    """Numbers of listed words, and numbers given to others as they come."""

    def __init__(self, listed: list[bytes]):
        super().__init__(zip(listed, range(len(listed))))
        self.free, self.unlisted = len(listed) + 2, []

    def __missing__(self, word: bytes) -> int:
        got = self[word] = self.free + len(self.unlisted)
        self.unlisted.append(word)
        return got

    def forget(self) -> None:
        for word in self.unlisted:
            del self[word]
        self.unlisted = []


def _entries(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of all entries of some rows of ``contexts``."""
    many, codes = unpacked(rows.column("codes"), np.int32)
    return np.repeat(np.arange(rows.num_rows), many), codes, unpacked(rows.column("counts"), np.int64)[1]


def _added(rows: pa.Table, first: list[int], width: int) -> pa.RecordBatch:
    """Rows of equal words, which begin at ``first``, made one each."""
    row, codes, counts = _entries(rows)
    group = np.searchsorted(first, row, "right") - 1
    key, back = np.unique(group * width + codes, return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, back, counts)
    borders = np.searchsorted(key, np.arange(len(first) + 1) * width)
    heads = [rows.column(c).combine_chunks().take(pa.array(first, pa.int64())) for c in ("word", "id", "next")]
    n = np.add.reduceat(rows.column("n").to_numpy(), first) if first else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([*heads, pa.array(n), packed((key % width).astype(np.int32), borders), packed(sums, borders)], names=CONTEXT)


@dataclass
class Placing:
    """What tells a word's class by its neighbours.

    ``of`` is the class of every listed word, then that of the end and that of all unlisted words; a class of
    ``classes`` is not known yet. ``table`` counts class bigrams."""

    of: np.ndarray
    table: np.ndarray | None
    classes: int
    endings: dict[bytes, int] | None = None  # if given, unlisted words go by them

    def __post_init__(self):
        self.total, k = self.classes + 2, self.classes
        if self.table is None:
            return
        self.forward = np.log((self.table + CLASS_ADD) / (self.table + CLASS_ADD).sum(1, keepdims=True))
        self.size = self.table.sum(0)[:k]

    def best(self, rows) -> np.ndarray:
        """The class that explains each row's neighbours best."""
        row, codes, counts = _entries(rows)
        cell = (row * 2 + (codes & 1)) * self.total + self.of[codes >> 1]
        near = np.bincount(cell, counts, rows.num_rows * 2 * self.total).reshape(-1, 2, self.total)
        k = self.classes
        fit = near[:, 0] @ self.forward[:, :k] + near[:, 1] @ self.forward[:k].T - near[:, 0].sum(1, keepdims=True) * np.log(np.maximum(self.size, 1))
        fit[:, self.size <= 0] = -np.inf
        return fit.argmax(1)

    def own(self, rows) -> np.ndarray:
        """The class of each row's word: as listed, or, for an unlisted word, told now."""
        number = rows.column("id").to_numpy()
        out, other = self.of[number], number == len(self.of) - 1
        if other.any():
            if self.endings is None:
                out[other] = self.best(rows.filter(pa.array(other)))
            else:
                out[other] = [by_ending(w, self.endings) for w in rows.column("word").filter(pa.array(other)).to_pylist()]
        return out

    def bigrams(self, rows, core: int, own: np.ndarray | None = None) -> np.ndarray:
        """Counts of class bigrams, each taken from one of its two words. Given the rows' ``own`` classes the rows and classes of
        unlisted words count; without, they are of no known class. Two of them side by side are left out."""
        end, rare = len(self.of) - 2, len(self.of) - 1
        number = rows.column("id").to_numpy()
        unlisted = own is not None
        k = own if unlisted else self.of[number]
        row, codes, counts = _entries(rows)
        near, right, of_rare = codes >> 1, (codes & 1) == 1, number[row] == rare
        # two listed words outside the core are counted by the left one; a listed and an unlisted one by the latter, if its row is there
        use = np.where(near == rare, not unlisted, right | of_rare | (near < core) | (near == end))
        a, b = np.where(right, k[row], self.of[near]), np.where(right, self.of[near], k[row])
        return np.bincount((a * self.total + b)[use], counts[use], self.total ** 2).astype(np.int64)


def _bigram_counts(frequent: DataFrame, placing: Placing, core: int, total: int) -> np.ndarray:
    """Class bigrams of listed words' rows; all others, of ``total``, are of no known classes."""
    shared = frequent.sparkSession.sparkContext.broadcast(placing)

    def run(batches):
        held, out = shared.value, 0
        for b in slices(batches):
            out = out + held.bigrams(b, core)
        on = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(np.atleast_1d(out)[on], pa.int64())], names=["k", "n"])
        release()

    out = _summed(frequent.mapInArrow(run, "k bigint, n bigint"), placing.total)
    out[placing.classes, placing.classes] += total - out.sum()
    return out


def _summed(counts: DataFrame, total: int) -> np.ndarray:
    """Counts (k, n) of class bigrams as a matrix; k is the left class times ``total`` plus the right one."""
    rows = counts.groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(total ** 2)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(total, total)


def _best_of_listed(beside: DataFrame, placing: Placing, core: int, upto: int) -> np.ndarray:
    """Classes by their neighbours of the listed words from number ``core`` up to ``upto``."""
    shared = beside.sparkSession.sparkContext.broadcast(placing)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.best(b), pa.int32())], names=["id", "k"])
        release()

    got = beside.filter((F.col("id") >= core) & (F.col("id") < upto)).mapInArrow(run, "id int, k int").toPandas()
    out = placing.of[core:upto].copy()
    out[got["id"].to_numpy() - core] = got["k"].to_numpy()
    return out


def _placed(beside: DataFrame, placing: Placing, core: int) -> DataFrame:
    """(word, n, k) of all words that have all their right neighbours in ``beside``: those outside the core; rows without
    a word count the class bigrams (as in ``_summed``) of all rows but those of two unlisted words."""
    shared = beside.sparkSession.sparkContext.broadcast(placing)
    names = ["word", "n", "k"]

    def run(batches):
        held, out = shared.value, np.zeros(placing.total ** 2, np.int64)
        inside = len(held.of) - 2  # the end of a text
        for b in slices(batches):
            row, codes, counts = _entries(b)
            own, number = held.own(b), b.column("id").to_numpy()
            out += held.bigrams(b, core, own)
            on = (codes & 1) == 1
            n = np.bincount(row[on], counts[on], b.num_rows).astype(np.int64)
            use = pa.array((number >= core) & (number != inside))
            yield pa.RecordBatch.from_arrays([b.column("word").filter(use), pa.array(n).filter(use), pa.array(own, pa.int64()).filter(use)], names=names)
        on = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(on), pa.binary()), pa.array(out[on]), pa.array(on, pa.int64())], names=names)
        release()

    return beside.mapInArrow(run, "word binary, n bigint, k bigint")


def train(texts: DataFrame, classes: int = CLASSES, core: int = CORE, middle: int = MIDDLE, hot: int = HOT,
          place_all: bool = False) -> tuple[Model, DataFrame]:
    """The model and the vocabulary (word, n, k: its class), from all rows of ``texts``.text; nulls count as empty texts.

    Words outside the ``hot`` most frequent ones go by their endings, or, with ``place_all``, get their classes by
    their neighbours as the others do. To the driver come: the ``hot`` words, their classes, counts of
    pairs of ``core`` words and of classes - all of bounded size. Two passes over the texts and a count of them. What is written
    on the way is deleted at the end, but for the vocabulary with its classes.
    """
    with Scratch(texts.sparkSession) as scratch:
        return _train(texts, classes, core, middle, hot, place_all, scratch)


def _train(texts: DataFrame, classes: int, core: int, middle: int, hot: int, place_all: bool, scratch: Scratch) -> tuple[Model, DataFrame]:
    spark = texts.sparkSession
    words = scratch.stage(vocabulary(texts), "vocabulary")
    docs = texts.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    octave = F.floor(F.log2("n") * 16)
    short = words.filter(F.octet_length("word") <= HOT_BYTES)
    sizes = sorted(((r["o"], r["k"]) for r in short.groupBy(octave.alias("o")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, got = None, 0
    for o, k in sizes:
        if got + k > hot:
            break
        least, got = o, got + k
    top = short.filter(octave >= least).collect() if least is not None else []
    top = sorted(((int(r["n"]), bytes(r["word"])) for r in top), key=lambda r: (-r[0], r[1]))
    listed, counts = [w for _, w in top], np.array([c for c, _ in top], np.int64)
    core = min(core, len(listed))
    middle = min(middle, len(listed) - core)

    near = scratch.stage(contexts(texts, listed, core), "contexts")
    beside, two = near.filter("next is null"), near.filter("next is not null")
    frequent = scratch.stage(beside.filter(F.col("id") <= len(listed)), "listed-contexts")  # few rows, read every round
    alone = np.concatenate([np.arange(core), np.full(len(listed) - core, core), [core + 1, core]])
    pairs = _bigram_counts(frequent, Placing(alone, None, core), core, int(n) + docs)
    own = exchange(pairs, classes)
    # the classes of the core tell those of the next words, these and theirs all others, until few words move
    of = np.concatenate([own, np.full(len(listed) - core, classes), [classes + 1, classes]]).astype(np.int64)
    one = np.eye(classes + 2)[np.concatenate([own, [classes, classes + 1]])]
    table = one.T @ pairs @ one
    for turn in range((PLACE_ROUNDS if place_all else 1) if len(listed) > core else 0):
        upto = len(listed) if turn else core + middle
        new = _best_of_listed(frequent, Placing(of, table, classes), core, upto)
        moved = counts[core:upto][new != of[core:upto]].sum()
        of = np.concatenate([of[:core], new, of[upto:]])
        table = _bigram_counts(frequent, Placing(of, None, classes), core, int(n) + docs)
        if turn and moved < STABLE * counts[core:upto].sum():
            break

    votes: dict[bytes, np.ndarray] = {}
    for w, c, k in zip(listed, counts, of):
        for m in range(min(3, len(w)) + 1) if k < classes else ():
            votes.setdefault(w[len(w) - m:], np.zeros(classes))[k] += c
    endings = {e: int(x.argmax()) for e, x in votes.items()}
    of[:len(listed)] = [by_ending(w, endings) if k == classes else k for w, k in zip(listed, of)]

    placing = Placing(of, table, classes, None if place_all else endings)
    top = spark.createDataFrame(pa.table({"word": pa.array(listed[:core], pa.binary()), "n": pa.array(counts[:core], pa.int64()), "k": pa.array(of[:core], pa.int64())}))
    placed = stage(_placed(beside, placing, core).unionByName(top), "classes")
    words = placed.filter("word is not null")
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for k, t, d in words.groupBy("k").agg(F.sum("n"), F.count("*")).collect():
        class_tokens[k], class_words[k] = t, d

    steps = _summed(placed.filter("word is null"), placing.total)
    known = words.select("word", "k")
    # words that are not frequent: neither side is broadcast
    pairs = two.select("word", "next", "n").join(known.withColumnRenamed("k", "a").hint("merge"), "word") \
        .join(known.select(F.col("word").alias("next"), F.col("k").alias("b")).hint("merge"), "next")
    for a, b, m in pairs.groupBy("a", "b").agg(F.sum("n")).collect():
        steps[a, b] += m
    kept = [*range(classes), classes + 1]
    steps = steps[np.ix_(kept, kept)]
    overall = (steps.sum(0) + CLASS_ADD) / (steps.sum() + CLASS_ADD * (classes + 1))
    steps = (steps + 5 * overall) / (steps.sum(1, keepdims=True) + 5)
    end = 1 if docs else 0
    return Model(listed, counts, of[:len(listed)], endings, int(n) + docs, int(v) + end, docs, class_tokens, class_words, np.log10(steps)), words


def score(docs: DataFrame, model: Model, words: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10
    probabilities of the whole text: unigrams with one added to each count, and the class bigrams) and ``perplexity``.

    A null or empty text is the end alone. Repeated rows are scored each.
    """
    outs = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outs and c != text]
    new = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double",
           "_rare": "array<binary>", "_ending": "binary", "_of": "binary", "_left": "binary", "_right": "binary"}
    classes = len(model.class_tokens)
    spread = model.class_tokens + WORD_ADD * (model.class_words + 1)
    hot_base, end_base = model.base(model.counts), float(model.base(model.docs))
    hot_emit = np.log10((model.counts + WORD_ADD) / spread[model.classes]) if len(model.hot) else np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.hot, model.classes, model.endings, model.steps, hot_base, hot_emit, end_base, int(model.docs > 0)))

    def make():
        hot, of, endings, steps, base, emit, end, end_known = shared.value
        n_hot, ids = len(hot), Classes(hot, endings)
        # the class of an unlisted word is looked up later
        k_of, rest = np.concatenate([of, np.full(classes, -1)]).astype(np.int64), np.zeros(classes)
        base, emit = np.concatenate([base, rest]), np.concatenate([emit, rest])

        def work(texts, _):
            words, size = [words_of(t) for t in texts], len(texts)
            many = np.array([len(w) for w in words], np.int64)
            tokens = [w for text in words for w in text]
            a, row = np.array(list(map(ids.__getitem__, tokens)), np.int64), np.repeat(np.arange(size), many)
            # one end before, between and behind the texts
            k = np.full(len(a) + size + 1, classes)
            k[np.arange(len(a)) + row + 1] = k_of[a]
            left, right = k[:-1], k[1:]
            step = np.where((left >= 0) & (right >= 0), steps[left, right], 0.0)
            at = np.flatnonzero(a >= n_hot)
            left, right = (k[at + row[at] + i].astype(np.int32) for i in (0, 2))
            lists = [[], [], [], [], []]
            borders = np.searchsorted(row[at], np.arange(size + 1)).tolist()
            rare, ending = [tokens[i] for i in at.tolist()], (a[at] - n_hot).astype(np.int32)
            for x, y in zip(borders, borders[1:]):
                place = dict.fromkeys(rare[x:y])
                for i, w in enumerate(place):
                    place[w] = i
                of = np.array([place[w] for w in rare[x:y]], np.int32)
                own = np.empty(len(place), np.int32)
                own[of] = ending[x:y]
                for held, got in zip(lists, (list(place), own.tobytes(), of.tobytes(), left[x:y].tobytes(), right[x:y].tobytes())):
                    held.append(got)
            return [many + 1, many - np.diff(borders) + end_known, np.bincount(row, base[a], size) + end,
                    np.bincount(row, emit[a], size) + np.bincount(np.repeat(np.arange(size), many + 1), step, size), *lists]

        return work

    part = stage(map_texts(docs, make, new, text, keep).withColumn("_row", F.monotonically_increasing_id()), "scored")
    found = part.select("_row", F.posexplode("_rare").alias("j", "word")).join(words.select("word", "n", "k"), "word") \
        .groupBy("_row").agg(F.collect_list(F.struct("j", "n", "k")).alias("f")) \
        .select("_row", F.col("f.j").alias("_j"), F.col("f.n").alias("_n"), F.col("f.k").cast("array<int>").alias("_k"))
    joined = part.drop("_rare").join(found, "_row", "left")
    steps, whole = model.steps, model.tokens + model.distinct + 1
    done = ["n_tokens", "n_known", "base_score", "score"]

    def add_rare(batches):
        for b in batches:
            rows = np.arange(b.num_rows)
            (endings, ending), (many, of), (_, left), (_, right) = (unpacked(b.column(c), np.int32) for c in ("_ending", "_of", "_left", "_right"))
            j, n_of, k_of = (pc.list_flatten(b.column(c)).to_numpy() for c in ("_j", "_n", "_k"))
            start = np.cumsum(endings) - endings
            n, k = np.zeros(len(ending), np.int64), ending.astype(np.int64)  # words never seen
            at = np.repeat(start, pc.fill_null(pc.list_value_length(b.column("_j")), 0).to_numpy()) + j
            n[at], k[at] = n_of, k_of
            row, at = np.repeat(rows, many), np.repeat(start, many) + of
            n, k = n[at], k[at]
            left, before = left.astype(np.int64), np.concatenate([[0], k[:-1]]) if len(k) else k
            left = np.where(left < 0, before, left)  # an unlisted word before it is the last one listed here
            last = right >= 0
            score = np.log10((n + WORD_ADD) / spread[k]) + steps[left, k]
            score[last] += steps[k[last], right[last]]
            adds = [np.bincount(row, n > 0, b.num_rows).astype(np.int64), np.bincount(row, np.log10((n + 1) / whole), b.num_rows),
                    np.bincount(row, score, b.num_rows)]
            old = [b.column(c) for c in done]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), old[0], *(pc.add(x, pa.array(y)) for x, y in zip(old[1:], adds))], names=[*keep, *done])

    schema = T.StructType([joined.schema[c] for c in [*keep, *done]])
    out = joined.mapInArrow(add_rare, schema).select(
        *[F.col(f"`{c}`") for c in keep], "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
