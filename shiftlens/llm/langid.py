"""Language identification by the nearest of several TF-IDF centroids per language.

A text is its vector of byte 1- to 3-grams (hashed to ``DIMS`` dimensions, 1 + log of the count
times the inverse document frequency, length one). Spherical k-means gives a few centroids for each
language; a text gets the language of the centroid with the greatest cosine, and is rejected where
even that cosine is lower than held-out texts of that language with about as many different n-grams reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts

DIMS = 1 << 14
CENTROIDS = 4
#: The model is fitted on at most so many texts of one language, those with the smallest hash of key.
SAMPLE = 400
#: The most frequent languages that are learned, and the texts of all of them together (fewer of each, if there are many).
LANGUAGES, SAMPLE_TEXTS = 512, 6_400
#: Of texts up to this many characters, so that the sample is at most 400 x 20,000 x 4 bytes a language.
SAMPLE_CHARS = 20_000
#: A text is rejected below ``REJECT_SHARE`` of this quantile of the held-out cosines of its language and size.
REJECT_QUANTILE, REJECT_SHARE = 0.005, 0.8
#: Parts of the sample that are held out in turn, and held-out texts that a size needs for a bound of its own.
FOLDS, LEAST_HELD = 4, 20
#: Sizes are told apart by the number of bits of their number of different n-grams.
OCTAVES = DIMS.bit_length() + 1
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Centroids:
    names: list[str]       # language of each centroid
    vectors: np.ndarray    # DIMS x centroids, columns of length one
    idf: np.ndarray
    least: np.ndarray      # centroids x OCTAVES, smallest cosine that is accepted


def gram_ids(text: bytes) -> np.ndarray:
    """Dimensions of all byte 1-, 2- and 3-grams of the lower-cased text between two spaces."""
    b = np.frombuffer(b" " + text.decode("utf-8", "replace").lower().encode() + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] | (b[1:] << 8)
    three = two[:-1] | (b[2:] << 16)
    ids = np.concatenate([b, two + np.uint32(1 << 24), three + np.uint32(1 << 25)])
    return (ids * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)


def vector(text: bytes, idf: np.ndarray | None = None) -> np.ndarray:
    tf = np.bincount(gram_ids(text), minlength=DIMS).astype(np.float32)
    on = tf > 0
    tf[on] = 1 + np.log(tf[on])
    if idf is not None:
        tf *= idf
    return tf / max(float(np.linalg.norm(tf)), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are chosen farthest first, so the result is deterministic."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def has_letter(text: bytes | None) -> bool:
    return text is not None and _LETTER.search(text.decode("utf-8", "replace")) is not None


def _bits(v: np.ndarray) -> int:
    return int(np.count_nonzero(v)).bit_length()


def _bounds(own: list[bytes], x: np.ndarray, idf: np.ndarray, centroids: int) -> np.ndarray:
    """Smallest accepted cosine of one language for each size, from texts (vectors ``x``) held out of the clusters.

    A text stands for its own size and, cut, for smaller ones. Cosines grow with the size, so each size also counts the
    texts of the one below it, and a size of few texts takes the bound of that one.
    """
    held: list[list[float]] = [[] for _ in range(OCTAVES)]
    for fold in range(min(FOLDS, len(own)) if len(own) > 1 else 0):
        out = np.arange(len(own)) % FOLDS == fold
        c = _cluster(x[~out], centroids)
        for i in np.flatnonzero(out):
            found: dict[int, float] = {}
            for b in range(1, len(own[i]).bit_length()):
                part = own[i][:1 << (b - 1)].decode("utf-8", "ignore").encode()
                if has_letter(part):
                    v = vector(part, idf)
                    found.setdefault(_bits(v), float((c @ v).max()))
            found.setdefault(_bits(x[i]), float((c @ x[i]).max()))
            for b, cos in found.items():
                held[b].append(cos)
    least = np.zeros(OCTAVES)
    for b in range(1, OCTAVES):
        near = held[b - 1] + held[b]
        least[b] = REJECT_SHARE * np.quantile(near, REJECT_QUANTILE) if len(held[b]) >= LEAST_HELD else least[b - 1]
    return least


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE,
        centroids: int = CENTROIDS) -> Centroids:
    """Fit on labelled rows: at most ``sample`` texts a language, and ``SAMPLE_TEXTS`` in all, come to the driver.

    Rows with a null language or text, without a letter or with more than ``SAMPLE_CHARS`` characters
    are not learned from; of more than ``LANGUAGES`` languages the most frequent ones are learned. Without any usable row the model knows no language and rejects every text.
    """
    usable = rows.filter(F.col(lang).isNotNull() & (F.length(text) <= SAMPLE_CHARS)) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    # a language's sample is cut by a hash bound first, so no task sorts all rows of a language
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    sample = min(sample, max(1, SAMPLE_TEXTS // max(1, len(sizes))))
    if not sizes:
        return Centroids([], np.zeros((DIMS, 0), np.float32), np.ones(DIMS, np.float32), np.zeros((0, OCTAVES)))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 1.5 * sample / n))])
    part = usable.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    chosen: dict[str, list[bytes]] = {}
    for r in sorted(part.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(got := chosen.setdefault(r["lang"], [])) < sample and has_letter(raw := r["text"].encode()):
            got.append(raw)
    chosen = {k: v for k, v in chosen.items() if v}
    if not chosen:
        return Centroids([], np.zeros((DIMS, 0), np.float32), np.ones(DIMS, np.float32), np.zeros((0, OCTAVES)))
    texts = [t for v in chosen.values() for t in v]
    df = sum((np.bincount(np.unique(gram_ids(t)), minlength=DIMS) for t in texts), np.zeros(DIMS))
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    names, found, least = [], [], []
    for name, own in sorted(chosen.items()):
        x = np.stack([vector(t, idf) for t in own])
        c = _cluster(x, centroids)
        names += [name] * len(c)
        found.append(c)
        least += [_bounds(own, x, idf, centroids)] * len(c)
    return Centroids(names, np.concatenate(found).T.astype(np.float32), idf, np.stack(least))


def predict(docs: DataFrame, model: Centroids, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (greatest cosine, 0 to 1) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Every other text gets
    the language of its nearest centroid (the first in order of name on a tie); ``rejected`` tells
    that it is further from it than texts of that language and size are. The whole text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.vectors, model.idf, model.least))

    def make():
        names, vectors, idf, least = shared.value

        def work(texts, _):
            langs, scores, out = [], [], []
            for t in texts:
                if not has_letter(t) or not names:
                    got, cos, bound = UNKNOWN, 0.0, 1.0
                else:
                    v = vector(t, idf)
                    cosines = v @ vectors
                    at = int(cosines.argmax())
                    got, cos, bound = names[at], float(min(1.0, max(0.0, cosines[at]))), least[at, _bits(v)]
                langs.append(got)
                scores.append(cos)
                out.append(bool(cos < bound))
            return langs, scores, out

        return work

    return map_texts(docs, make, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, text, keep)
