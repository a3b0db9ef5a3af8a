"""SentencePiece encoding by a table of distinct chunks, and decoding.

In a model whose pieces hold whitespace markers only at their front (or nothing else), no merge reaches from
the end of a word over the marker of the next one. A text is therefore cut before each run of markers, and at characters
that stand in no piece beside another character; the merges of a chunk depend on nothing around it. Every Python
worker keeps a table of the distinct chunks it met, each segmented once; a text's ids are the table's entries in the
order of its chunks. The table is bounded: what was not met for long is forgotten, which costs time and changes no result.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shiftlens.llm.common import map_texts

# ---- fixed values of the model format -------------------------------------------------------------
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

#: Chunks in each half of a worker's table (about 200 bytes each), and the length up to which a chunk is kept there.
TABLE, CHUNK_BYTES = 500_000, 64
#: Characters up to which a chunk's best neighbours are looked for by a plain minimum.
SHORT = 64
#: Bytes of a text that are cut into chunks at a time.
BLOCK = 1 << 20

INF = float("inf")


@dataclass
class Model:
    """What encoding and decoding need of a model file; a space stands for the marker."""

    pieces: dict[str, tuple[float, int]]  # piece -> (-score, id)
    texts: list[bytes]                    # by id: the piece's bytes
    bytes_: list[int]                     # by byte: the id of its piece
    is_byte: list[bool]                   # by id


def read_model(path: str) -> Model:
    """Read a BPE model with byte fallback whose normalisation only adds the marker in front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm, train = spec.normalizer_spec, spec.trainer_spec
    if train.model_type != BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a BPE model with byte fallback and markers in front")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError(f"{path}: its normalisation does more than to mark white space")
    if strange := {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: pieces of kinds {sorted(strange)}")
    if crossing := [p.piece for p in spec.pieces if p.type == NORMAL and MARK in p.piece.lstrip(MARK)]:
        raise ValueError(f"{path}: pieces cross a whitespace marker, such as {crossing[0]!r}")
    pieces, texts, bytes_, is_byte = {}, [], [0] * 256, []
    for i, p in enumerate(spec.pieces):
        is_byte.append(p.type == BYTE)
        if p.type == BYTE:
            value = int(p.piece[3:5], 16)
            bytes_[value] = i
            texts.append(bytes([value]))
        elif p.type == NORMAL:
            plain = p.piece.replace(MARK, " ")
            pieces[plain] = (-p.score, i)
            texts.append(plain.encode())
        else:
            texts.append(train.unk_surface.encode() if p.type == UNKNOWN else b"")
    return Model(pieces, texts, bytes_, is_byte)


class Table(dict):
    """Distinct chunks, each segmented when it is first met and stored in the form that ``form`` gives its ids.

    When the table holds ``size``, its entries become the older half; those that are met again are taken over. Chunks
    longer than ``longest`` are not kept."""

    def __init__(self, encoder: Encoder, form, join: bytes, size: int = TABLE, longest: int = CHUNK_BYTES):
        super().__init__()
        self.encoder, self.form, self.join, self.size, self.longest, self.older = encoder, form, join, size, longest, {}

    def made(self, chunk: bytes) -> bytes:
        parts = self.encoder.parts(chunk.decode())
        return self.form(self.encoder.segment(parts[0])) if len(parts) == 1 else self.join.join([self[p.encode()] for p in parts])

    def __missing__(self, chunk: bytes):
        got = self.older.get(chunk)
        if got is None:
            got = self.made(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        joined = {c for p in model.pieces if len(p) > 1 for c in p}
        alone = "".join(chr(c) for c in range(128) if chr(c) not in joined and c != 32)
        lonely = re.escape(alone).encode()
        self.chunk = re.compile(rb"[%b]| *[^ %b]+| +" % (lonely, lonely)) if alone else re.compile(rb" *[^ ]+| +")
        self.border = re.compile(rb"[^ ] ")
        self.token_text = {str(i).encode(): t for i, t in enumerate(model.texts)}
        self.neighbours = {p[i:i + 2] for p in model.pieces for i in range(len(p) - 1)}
        self.cost = {p: cost for p, (cost, _) in model.pieces.items() if len(p) > 1}  # of joining the two parts of a piece
        self.ids = {p: i for p, (_, i) in model.pieces.items()}

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut between neighbours that stand side by side in no piece: no merge reaches over them."""
        known = self.neighbours
        cuts = [i + 1 for i in range(len(chunk) - 1) if chunk[i:i + 2] not in known]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])] if cuts else [chunk]

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: of all neighbours that make a piece, those of the best score are joined first, the
        leftmost first where scores are equal; characters without a piece become their bytes."""
        part = self._merged(list(chunk)) if len(chunk) <= SHORT else self._merged_by_queue(list(chunk))
        ids = [*map(self.ids.get, part)]
        if None not in ids:
            return ids
        return [x for i, p in zip(ids, part) for x in ([self.model.bytes_[b] for b in p.encode()] if i is None else [i])]

    def _merged(self, part: list[str]) -> list[str]:
        get = self.cost.get
        cost = [get(a + b, INF) for a, b in zip(part, part[1:])]
        while cost:
            best = min(cost)
            if best == INF:
                break
            i = cost.index(best)
            new = part[i] = part[i] + part.pop(i + 1)
            del cost[i]
            if i < len(cost):
                cost[i] = get(new + part[i + 1], INF)
            if i:
                cost[i - 1] = get(part[i - 1] + new, INF)
        return part

    def _merged_by_queue(self, part: list[str]) -> list[str]:
        """The same in n log n steps."""
        get, gone, n = self.cost.get, None, len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(cost, i, p) for i, p in enumerate(map(str.__add__, part, part[1:])) if (cost := get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if part[i] is gone or j >= n or part[i] + part[j] != new:
                continue  # one of the two is gone or has grown
            part[i] = new
            part[j] = gone
            j, h = after[j], before[i]
            after[i] = j
            for left, right in ((i, j), (h, i)):
                if left >= 0 and right < n:
                    before[right] = left
                    p = part[left] + part[right]
                    if p in self.cost:
                        heapq.heappush(queue, (self.cost[p], left, p))
        return [p for p in part if p is not gone]

    def chunks(self, text: bytes):
        """The chunks of a marked text, in blocks of about ``BLOCK`` bytes that end between two chunks."""
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + BLOCK)
            end = cut.start() + 1 if cut else len(text)
            yield self.chunk.findall(text, at, end)
            at = end

    @staticmethod
    def marked(text: bytes | None) -> bytes:
        """The text with a space for every marker and one in front; an empty text stays empty."""
        return b" " + text.replace(MARK.encode(), b" ") if text else b""

    def encode(self, text: bytes | None, table: Table, join: bytes) -> bytes:
        """A whole text's table entries, joined."""
        return join.join([join.join(map(table.__getitem__, part)) for part in self.chunks(self.marked(text))])

    def decode(self, ids: bytes) -> bytes:
        """The text of decimal ids joined by commas; the marker in front is dropped, bytes that are no
        UTF-8 become U+FFFD each."""
        if not ids:
            return b""
        tokens = ids.split(b",")
        out = b"".join(map(self.token_text.__getitem__, tokens))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = self._patched(tokens)
        return out[1:] if out[:1] == b" " and not self.model.is_byte[int(tokens[0])] else out

    def _patched(self, tokens: list[bytes]) -> bytes:
        out, run = [], bytearray()
        for t in [*tokens, None]:
            if t is not None and self.model.is_byte[int(t)]:
                run += self.token_text[t]
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if len(run) >= n and _is_character(bytes(run[:n]))), 0)
                out.append(bytes(run[:size]) if size else "�".encode())
                del run[:size or 1]
            if t is not None:
                out.append(self.token_text[t])
        return b"".join(out)


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def decimal(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def tokenise(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (decimal, joined by commas) and ``decoded``.

    ``path`` is a model file on the driver; what it holds is broadcast (a fixed size). Texts are encoded whole,
    without begin and end ids; a null text counts as empty and has no ids. Repeated rows are encoded each; an
    input column named like an output is replaced, all others of ``keep`` (all, if None) stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"model": read_model(path)})

    def make():
        held = shared.value
        if "encoder" not in held:  # kept by the Python worker for its next tasks
            held["encoder"] = Encoder(held["model"])
            held["table"] = Table(held["encoder"], decimal, b",")
        encoder, table = held["encoder"], held["table"]

        def work(texts, _):
            ids = [encoder.encode(t, table, b",") for t in texts]
            return [x.count(b",") + bool(x) for x in ids], [x.decode() for x in ids], [encoder.decode(x).decode() for x in ids]

        return work

    return map_texts(docs, make, {"n_tokens": "bigint", "token_ids": "string", "decoded": "string"}, text, keep)
