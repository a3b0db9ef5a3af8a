"""Benchmark decontamination with an Aho-Corasick automaton over windows of the test items' words.

Texts are normalised to words, and every word of an item is one symbol; an item is cut into windows of consecutive
words, and every window is one pattern of as many symbols. A document's words become symbols too (one that no item
has stands for all others), it is scanned once, and hits are mapped back to its
word numbers and, where wanted, to character offsets in its original text.
"""

from __future__ import annotations

from itertools import islice

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts

WINDOW = 10
#: Item text that one automaton may hold; more items are scanned for by further automata in turn. A byte of text makes at most
#: WINDOW / 2 nodes (of about 55 bytes), as a word and its space take two bytes and a window one node per word; with words
#: of five letters it is 1.7 nodes, and 2 MiB are about 200 MB in a Python worker.
SHARD_BYTES = 2 << 20
#: Code points from which symbols are taken; those between are no characters.
_FIRST, _GAP, _AFTER = 1, 0xD800, 0xE000

#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes of 128 and more are kept.
_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words; none for a null text."""
    return [] if text is None else text.translate(_TABLE).split()


def windows(words: list, size: int) -> list[list]:
    """An item's windows, or the whole of a shorter item; none without words."""
    if not words:
        return []
    return [words] if len(words) < size else [words[i:i + size] for i in range(len(words) - size + 1)]


class Symbols(dict):
    """A character for each word of the items; one more for all other words."""

    def __init__(self, words: list[bytes]):
        numbers = (c for c in range(_FIRST + 1, 0x110000) if not _GAP <= c < _AFTER)
        super().__init__(zip(words, map(chr, islice(numbers, len(words)))))
        if len(self) < len(words):
            raise ValueError("more different words than symbols: use a smaller shard_bytes")

    def line(self, words: list[bytes]) -> str:
        get, other = self.get, chr(_FIRST)
        return "".join([get(w, other) for w in words])


def automaton(items: list[tuple[str, bytes]], size: int) -> tuple[ahocorasick.Automaton | None, Symbols]:
    """Patterns with (words, numbers of the items they belong to), None without patterns; and the symbols."""
    split = [words_of(text) for _, text in items]
    symbols = Symbols(sorted(set().union(*split)))
    owners: dict[str, set[int]] = {}
    for number, words in enumerate(split):
        for w in windows(words, size):
            owners.setdefault(symbols.line(w), set()).add(number)
    if not owners:
        return None, symbols
    a = ahocorasick.Automaton()
    for w, own in owners.items():
        a.add_word(w, (len(w), tuple(own)))
    a.make_automaton()
    return a, symbols


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def scan(a: ahocorasick.Automaton | None, symbols: Symbols, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word spans that patterns cover, and the numbers of the items they belong to."""
    if a is None or not words:
        return [], set()
    hits = list(a.iter(symbols.line(words)))
    return merged([(end - n + 1, end + 1) for end, (n, _) in hits]), {i for _, (_, own) in hits for i in own}


def byte_ranges(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where word spans stand in the original UTF-8 text."""
    inside = np.frombuffer(b" " + text.translate(_TABLE) + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  size: int = WINDOW, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence), ``n_items``, ``item_ids`` (sorted
    strings, comma-joined) and ``hit_bytes`` (start and end of each hit in the UTF-8 text, alternating).

    A null or empty text has no words; an item without words is no pattern; equal items count each under
    its own id (ids may hold commas; ``n_items`` counts ids), repeated rows of one id once; items with a null id or text are left out. One automaton
    holds up to about ``shard_bytes`` of item text; more items are dealt to further automata by a hash of the
    id, and the documents are scanned for them in turn, without a shuffle.
    """
    spark = docs.sparkSession
    usable = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")) \
        .filter("item is not null and text is not null")
    total = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    keep = docs.columns if keep is None else keep
    # what is kept travels as one column, so that no name can clash with those of the scans
    others = [c for c in keep if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    out = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    for k in range(shards):
        own = usable.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).collect()
        shared = spark.sparkContext.broadcast({"items": [(str(r["item"]), r["text"].encode()) for r in own]})
        before = () if k == 0 else (f"spans{k - 1}", f"items{k - 1}")
        if k < shards - 1:
            fields = {f"spans{k}": "array<bigint>", f"items{k}": "array<string>"}
            out = map_texts(out, _scanner(shared, size, before, False), fields, "text", ["row", "text"], before)
    fields = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "item_ids": "string", "hit_bytes": "array<bigint>"}
    out = map_texts(out, _scanner(shared, size, before, True), fields, "text", ["row", *(["text"] if text in keep else [])], before)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in keep if c not in fields], *fields)


def _scanner(shared, size: int, before: tuple[str, ...], last: bool):
    """Scan for one shard's items and add what earlier shards found; totals after the last one."""

    def make():
        held = shared.value  # stays with the Python worker, so the automaton is built once for many tasks
        if "automaton" not in held:
            held["automaton"] = automaton(held["items"], size)
        items, (a, symbols) = held["items"], held["automaton"]

        def work(texts, batch):
            n = len(texts)
            spans0, items0 = [batch.column(c).to_pylist() for c in before] if before else ([[]] * n, [[]] * n)
            rows = []
            for t, s0, i0 in zip(texts, spans0, items0, strict=True):
                words = words_of(t)
                spans, numbers = scan(a, symbols, words)
                spans = merged(spans + list(zip(s0[::2], s0[1::2], strict=True)))
                ids = sorted({items[i][0] for i in numbers} | set(i0))
                flat = [x for span in spans for x in span]
                if last:
                    where = [x for r in byte_ranges(t, spans) for x in r] if spans else []
                    rows.append((len(words), sum(flat[1::2]) - sum(flat[::2]), len(ids), ",".join(ids), where))
                else:
                    rows.append((flat, ids))
            return list(zip(*rows, strict=True)) if rows else [[]] * (5 if last else 2)

        return work

    return make
