"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

A trie over the vocabulary gives the longest token at each position of a word that is asked for.
The encoder goes from left to right, taking the longest token whose pair with the token before it is
compatible (the merges would leave exactly these two side by side); where no token fits, it takes
the last one back and tries the next shorter. Positions that led nowhere are marked, so the work is
linear in the word's length, and the result is the one that the merges give.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex

from pyspark.sql import DataFrame

from shiftlens.llm.common import map_texts

#: Entries in a Python worker's memories of encoded pieces, of encoded words and of token pairs (about 200 bytes each).
MEMORY, WORD_MEMORY, PAIR_MEMORY = 400_000, 300_000, 300_000

#: Stands for the end of a word inside a word's symbols; it occurs in no symbol of a byte.
END = ""


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where Latin-1 has a visible
    character, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the encoder needs of a tokenizer file."""

    tokens: list[str]                          # by id; END for the end-of-word mark
    merges: dict[tuple[int, int], int]         # pair -> rank
    halves: dict[int, tuple[int, int]]         # token -> the pair it was merged from
    specials: dict[str, int]
    words: str                                 # pattern of a word
    lower: bool
    suffix: str


def read_vocabulary(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file: word-end BPE with byte-level symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    ids = model["vocab"]
    tokens = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
    for t, i in ids.items():
        tokens[i] = t[: -len(suffix)] + END if t.endswith(suffix) else t
    merges, halves = {}, {}
    for rank, (a, b) in enumerate(model["merges"]):
        pair = (ids[a], ids[b])
        merges[pair] = rank
        halves.setdefault(ids[a + b], pair)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(tokens, merges, halves, specials, split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"),
                      "Lowercase" in kinds, suffix)


class Memory(dict):
    """What ``make`` gives for a key, each made when first asked for. ``size`` keys are held in two halves: when the newer one is
    full it becomes the older one, and what was in that and was not asked for since is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.older, self.some_empty = make, size // 2, {}, False

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            self.some_empty |= not got
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


@dataclass
class Encoder:
    vocabulary: Vocabulary

    def __post_init__(self):
        self.pieces, self.words = Memory(self.encode_piece, MEMORY), Memory(self.encode_text_word, WORD_MEMORY)
        self.pairs = Memory(self.compatible, PAIR_MEMORY)  # the compatibility table, filled as pairs come up
        v = self.vocabulary
        self.length = [len(t) for t in v.tokens]
        self.finder = ahocorasick.Automaton()
        by_text = {}
        special = set(v.specials.values())
        for i, t in enumerate(v.tokens):
            if t and i not in special:
                by_text.setdefault(t, i)
        for t, i in by_text.items():
            self.finder.add_word(t, i)
        self.by_text, self.most = by_text, max(map(len, by_text), default=0)
        self.shorter = [self.longest_in(t[:-1]) for t in v.tokens]  # the longest token that is a proper prefix of each
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.word = regex.compile(v.words, regex.V0)
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True)))) if v.specials else None
        # decoding: the token texts, cut from one string of bytes by a table of offsets
        texts = [t.replace(END, v.suffix) for t in v.tokens]
        for t, i in v.specials.items():
            texts[i] = t
        encoded = [t.encode() for t in texts]
        blob = b"".join(encoded)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).tolist()
        self.token_text = {str(i).encode(): blob[a:b] for i, (a, b) in enumerate(zip(offsets, offsets[1:]))}

    def longest_in(self, text: str) -> int | None:
        """The longest token that the text begins with."""
        by_text = self.by_text
        for n in range(self.finder.longest_prefix(text[:self.most]), 0, -1):
            token = by_text.get(text[:n])
            if token is not None:
                return token
        return None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the token's left (0) or right (1) edge while it is merged, each with the rank of the
        merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            halves = self.vocabulary.halves.get(token)
            if halves is None:
                return out
            ends = self.vocabulary.merges[halves]
            token = halves[side]

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Do the merges leave the two tokens side by side? No, if some merge joins what stands left and
        right of the border while both exist; of equal merges the left one comes first."""
        right = self._edge(pair[1], 0)
        for x, x_ends in self._edge(pair[0], 1):
            for y, y_ends in right:
                rank = self.vocabulary.merges.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte symbols with END behind it."""
        length, pairs, shorter, longest_in, most, n = self.length, self.pairs, self.shorter, self.longest_in, self.most, len(word)
        # the end mark is no token of its own: no token may end before it
        usable, out, at, last, token = [True] * (n - 1) + [False, True], [], 0, None, longest_in(word)
        while at < n:
            while token is not None and not (usable[at + length[token]] and (last is None or pairs[last, token])):
                token = shorter[token]
            if token is None:
                usable[at] = False
                if not out:
                    raise ValueError(f"the vocabulary has no tokens for {word!r}")
                token = out.pop()
                last = out[-1] if out else None
                at -= length[token]
                token = shorter[token]
            else:
                out.append(token)
                last = token
                at += length[token]
                token = longest_in(word[at:at + most]) if at < n else None
        return out

    def encode_text_word(self, word: str) -> bytes:
        """The ids of one normalised word, as text."""
        return " ".join(map(str, self.encode_word(word.encode().decode("latin-1").translate(self.symbols) + END))).encode()

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of a piece without ASCII white space, as text.

        Words never reach over white space, so pieces can be encoded and remembered one by one."""
        if piece.isascii():
            text = piece.decode()
            text = text.lower() if self.vocabulary.lower else text
        else:
            text = unicodedata.normalize("NFC", piece.decode())
            text = "".join(map(str.lower, text)) if self.vocabulary.lower else text
        return b" ".join(map(self.words.__getitem__, self.word.findall(text)))

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, as text joined by spaces."""
        if self.special is not None and b"<|" in text:
            parts, at, line = [], 0, text.decode()
            for m in self.special.finditer(line):
                parts += map(self.pieces.__getitem__, line[at:m.start()].encode().split())
                parts.append(str(self.vocabulary.specials[m[0]]).encode())
                at = m.end()
            parts += map(self.pieces.__getitem__, line[at:].encode().split())
        else:
            parts = list(map(self.pieces.__getitem__, text.split()))
        return b" ".join(filter(None, parts) if self.pieces.some_empty else parts)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts joined by spaces, as decoding does without a decoder in the tokenizer file."""
        return b" ".join(map(self.token_text.__getitem__, ids.split()))


def tokenise(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (decimal, joined by spaces) and ``decoded``.

    ``path`` is a tokenizer file on the driver; what it holds is broadcast (a fixed size). Texts are encoded
    whole; a null text counts as empty and has no ids; special tokens are recognised in a text. Repeated
    rows are encoded each.
    """
    v = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (v.tokens, v.merges, v.halves, v.specials, v.words, v.lower, v.suffix)})

    def make():
        held = shared.value
        if "encoder" not in held:  # kept by the Python worker for its next tasks
            held["encoder"] = Encoder(Vocabulary(*held["parts"]))
        encoder = held["encoder"]

        def work(texts, _):
            ids = [encoder.encode(t or b"") for t in texts]
            return [x.count(b" ") + bool(x) for x in ids], [x.decode() for x in ids], [encoder.decode(x).decode() for x in ids]

        return work

    return map_texts(docs, make, {"n_tokens": "bigint", "token_ids": "string", "decoded": "string"}, text, keep)
