"""Quality classifier: a small convolutional network over bytes, trained and run with numpy.

Learned filters slide over the bytes of a text; their largest responses in overlapping chunks, averaged
and maximised over all chunks of the text, are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts

FILTERS, WIDTH = 16, 5
#: Chunks of 128 bytes overlap by half.
HALF = 64
#: The network is trained on the labelled texts with the smallest hashes of key, at most so many ...
SAMPLE = 2_500
#: ... and of those with up to this many characters (so at most 2,500 x 20,000 x 4 bytes).
SAMPLE_CHARS = 20_000
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Bytes that are convolved at once; a longer text is worked through in pieces of whole half chunks.
PIECE = 4096 * HALF

Params = dict[str, np.ndarray]


def new_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    return {"tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
            "mean": rng.normal(0, 0.3, FILTERS).astype(np.float32), "most": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "out": np.zeros(1, np.float32)}


def _responses(raw: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses by (half chunk, byte, filter) of bytes padded with zeros, and these bytes."""
    size = max(1, -(-len(raw) // HALF)) * HALF
    padded = np.zeros(size + WIDTH - 1, np.uint8)
    padded[:min(len(raw), size + WIDTH - 1)] = raw[:size + WIDTH - 1]
    act = tables[0][padded[:size]]
    for j in range(1, WIDTH):
        act += tables[j][padded[j:size + j]]
    return act.reshape(-1, HALF, FILTERS), padded


def half_maxima(text: bytes, p: Params) -> np.ndarray:
    """Largest responses in each half chunk of the whole text."""
    raw = np.frombuffer(text, np.uint8)
    parts = []
    for at in range(0, max(1, len(raw)), PIECE):
        piece = raw[at:at + PIECE + WIDTH - 1]
        halves = _responses(piece, p["tables"])[0].max(1)
        parts.append(halves[:max(1, -(-min(PIECE, len(raw) - at) // HALF))])
    return np.concatenate(parts)


def pooled(halves: np.ndarray) -> np.ndarray:
    """Maxima of the overlapping chunks, each made of two neighbouring halves."""
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


def probability(text: bytes, p: Params) -> float:
    c = np.maximum(pooled(half_maxima(text, p)) + p["bias"], 0)
    z = float(c.mean(0) @ p["mean"] + c.max(0) @ p["most"] + p["out"][0])
    return 1 / (1 + np.exp(-min(60.0, max(-60.0, z))))


def _add_gradients(text: bytes, label: float, p: Params, g: Params) -> None:
    act, padded = _responses(np.frombuffer(text, np.uint8), p["tables"])
    where = act.argmax(1)                                                   # (half, filter)
    halves = np.take_along_axis(act, where[:, None], 1)[:, 0]
    at = where + HALF * np.arange(len(halves))[:, None]
    if len(halves) > 1:
        right = halves[1:] > halves[:-1]
        chunks, at = np.where(right, halves[1:], halves[:-1]), np.where(right, at[1:], at[:-1])
    else:
        chunks = halves
    pre = chunks + p["bias"]
    c = np.maximum(pre, 0)
    top = c.argmax(0)
    mean, most = c.mean(0), c[top, np.arange(FILTERS)]
    z = float(mean @ p["mean"] + most @ p["most"] + p["out"][0])
    d = 1 / (1 + np.exp(-min(60.0, max(-60.0, z)))) - label
    g["mean"] += d * mean
    g["most"] += d * most
    g["out"] += d
    dc = np.repeat((d * p["mean"] / len(c))[None], len(c), 0)
    dc[top, np.arange(FILTERS)] += d * p["most"]
    dc *= pre > 0
    g["bias"] += dc.sum(0)
    flat, filters = dc.ravel(), np.tile(np.arange(FILTERS), len(c))
    for j in range(WIDTH):
        code = padded[at.ravel() + j].astype(np.int64) * FILTERS + filters
        g["tables"][j] += np.bincount(code, flat, 256 * FILTERS).reshape(256, FILTERS)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Params:
    """Adam on the logistic loss. Without texts, or with a single label, the score is that share."""
    p = new_params()
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    p["out"][0] = np.log(share / (1 - share))
    if not len(texts) or share in (0.02, 0.98):
        p["mean"][:] = p["most"][:] = 0
        return p
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(11), 0
    # the smaller class counts as much as half of the larger one
    rare = labels == (0 if share > 0.5 else 1)
    weight = np.where(rare, max(1.0, 0.5 * (~rare).sum() / max(1, rare.sum())), 1.0)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(x, dtype=np.float64) for k, x in p.items()}
            batch = order[at:at + BATCH]
            for i in batch:
                own = {k: np.zeros_like(x) for k, x in g.items()} if weight[i] != 1 else g
                _add_gradients(texts[i], float(labels[i]), p, own)
                if own is not g:
                    for k in g:
                        g[k] += weight[i] * own[k]
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, x in p.items():
                grad = g[k] / len(batch) + 1e-5 * x
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                x -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return p


def fit(rows: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Params:
    """Train on a sample of labelled rows, which comes to the driver (bounded by ``SAMPLE`` and ``SAMPLE_CHARS``).

    Rows with a null text, label or key are not learned from.
    """
    usable = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    n = usable.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 20))
    got = usable.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")) \
        .limit(2 * sample).collect()
    got.sort(key=lambda r: (str(r["key"]), r["text"]))
    return train([r["text"].encode() for r in got], np.array([float(r["label"]) for r in got]))


def classify(docs: DataFrame, params: Params, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on).

    The chunks cover the whole text; a null text is scored like an empty one, as one chunk of zero bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def make() -> Callable:
        p = shared.value

        def work(texts, _):
            score = [probability(t or b"", p) for t in texts]
            return score, [int(s >= 0.5) for s in score]

        return work

    return map_texts(docs, make, {"score": "double", "predicted": "int"}, text, keep)
