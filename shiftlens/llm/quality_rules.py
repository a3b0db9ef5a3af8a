"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded sample, with monotonic constraints on chosen features,
and flattened into node arrays; scoring walks all rows of a batch down all trees at once with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import map_texts

#: The trees are grown on the labelled texts with the smallest hashes of key, at most so many ...
SAMPLE = 4_000
#: ... and of those with up to this many characters.
SAMPLE_CHARS = 40_000
TREES, DEPTH, BINS, RATE, L2 = 40, 3, 64, 0.3, 1.0
MIN_ROWS = 8

#: Direction in which a statistic may move the score: 1 up, -1 down, 0 either way.
FEATURES = {"words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "dup_line_char_share": -1, "repeat_word_share": -1,
            "distinct_share": 1, "upper_share": -1, "digit_share": 0, "punctuation_share": 0, "top_word_share": -1, "words_per_line": 0,
            "next_same_share": -1}
SYMBOLS = b"#*$%&|<>"

_KIND = np.zeros(256, np.int8)
_KIND[np.frombuffer(SYMBOLS, np.uint8)] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:!?\"'()-"]] = 4


def statistics(text: bytes | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of ``FEATURES``."""
    if not text:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=5)
    spaces = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)).sum()
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(spaces)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = dup_chars = filled = 0
    for line in lines:
        if not line or line.isspace():
            continue
        filled += 1
        if line in seen:
            dup += 1
            dup_chars += len(line)
        else:
            seen.add(line)
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    repeats = repeated_window_words(w, len(ids))
    top = int(np.bincount(w).max()) if n else 0
    per = max(n, 1)
    values = [float(np.log1p(n)), chars / per, kinds[1] / per, dup / max(filled, 1), dup_chars / len(text), repeats / per, len(ids) / per,
              kinds[2] / max(chars, 1), kinds[3] / max(chars, 1), kinds[4] / per, top / per, float(np.log1p(n / max(filled, 1))),
              float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0]
    return (n, chars, int(kinds[1]), dup, repeats), [float(v) for v in values]


def repeated_window_words(w: np.ndarray, distinct: int, size: int = 3) -> int:
    """Words inside a window of ``size`` words that occurs twice or more."""
    if len(w) < size:
        return 0
    code = w[:len(w) - size + 1]
    for j in range(1, size):
        code = code * distinct + w[j:len(w) - size + 1 + j]
        if j < size - 1 and distinct > 1_000_000:  # keep the codes within 63 bits
            code = np.unique(code, return_inverse=True)[1]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    covered = np.zeros(len(w), bool)
    for j in range(size):
        covered[j:len(w) - size + 1 + j] |= again
    return int(covered.sum())


@dataclass
class Trees:
    """All trees' nodes in arrays; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray     # go left where value <= limit
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Grower:
    codes: np.ndarray
    edges: list[np.ndarray]
    signs: np.ndarray
    nodes: list[list] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        i = len(self.nodes)
        self.nodes.append([0, np.inf, i, i, value])
        return i

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        """Best-gain split on histograms; a constrained feature splits only in its direction, and the
        children's values stay on their sides of the middle (``low`` and ``high`` are inherited)."""
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + L2), low, high))
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * MIN_ROWS:
            for f, sign in enumerate(self.signs):
                if not len(self.edges[f]):
                    continue
                c = self.codes[rows, f]
                size = len(self.edges[f]) + 1
                gl = np.cumsum(np.bincount(c, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=size))[:-1]
                vl = np.clip(-gl / (hl + L2), low, high)
                vr = np.clip(-(total_g - gl) / (total_h - hl + L2), low, high)
                gain = gl ** 2 / (hl + L2) + (total_g - gl) ** 2 / (total_h - hl + L2) - total_g ** 2 / (total_h + L2)
                gain[(nl < MIN_ROWS) | (len(rows) - nl < MIN_ROWS) | (sign * (vr - vl) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, (vl[k] + vr[k]) / 2))
        if best[1] is None:
            return self.leaf(RATE * own)
        f, k, middle = best[1]
        go = self.codes[rows, f] <= k
        at = self.leaf(0.0)
        sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(self.signs[f])]
        left = self.grow(rows[go], g, h, depth + 1, *sides[0])
        right = self.grow(rows[~go], g, h, depth + 1, *sides[1])
        self.nodes[at] = [f, self.edges[f][k], left, right, 0.0]
        return at


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting; with no rows or a single label the score is a constant."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.empty(0) for f in range(len(signs))]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(signs)), int)
    grower, roots, margin = _Grower(codes, edges, signs), [], np.full(len(x), start)
    for _ in range(trees if len(x) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grower.grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        margin += _flat(grower.nodes, [roots[-1]], 0.0).margin(x)
    return _flat(grower.nodes, roots or [grower.leaf(0.0)], start)


def _flat(nodes: list[list], roots: list[int], start: float) -> Trees:
    f, limit, left, right, value = zip(*nodes)
    return Trees(np.array(f), np.array(limit, float), np.array(left), np.array(right), np.array(value, float), np.array(roots), start)


def fit(rows: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Grow the trees on a sample of labelled rows: at most ``sample`` rows of statistics come to the driver.

    Rows with a null text or label are left out.
    """
    usable = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    n = usable.count()
    if not n:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0), np.array(list(FEATURES.values())))
    share = int(min(1.0, sample / n) * (1 << 20))
    part = usable.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).select(text, F.col(label).alias("label"))
    got = with_statistics(part, text, ["label"]).select("label", "features").limit(2 * sample).collect()
    x = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES))
    y = np.array([float(r["label"]) for r in got])
    order = np.lexsort([*x.T, y])  # the rows' order must not depend on the tasks'
    return boost(x[order], y[order], np.array(list(FEATURES.values())))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the five counts of ``statistics`` and the array ``features``. A null or empty text has zeros."""

    def make():
        def work(texts, _):
            got = [statistics(t) for t in texts]
            return [*([r[0][i] for r in got] for i in range(5)), [r[1] for r in got]]

        return work

    return map_texts(docs, make, _COUNTS | {"features": "array<double>"}, text, keep)


_COUNTS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}


def apply_rules(docs: DataFrame, model: Trees, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5,
                min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` (too few words or too many repeated ones), ``score`` (the trees'
    probability) and ``kept`` (base passed and score of ``threshold`` or more).

    The whole text counts. A null or empty text has no words and fails the base rules.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.feature, model.limit, model.left, model.right, model.value, model.roots, model.start))

    def make():
        trees = Trees(*shared.value)

        def work(texts, _):
            got = [statistics(t) for t in texts]
            score = trees.score(np.array([r[1] for r in got]).reshape(-1, len(FEATURES)))
            failed = [r[0][0] < min_words or 100 * r[0][4] > max_repeat_percent * r[0][0] for r in got]
            return [*([r[0][i] for r in got] for i in range(5)), failed, score,
                    [not f and bool(s >= threshold) for f, s in zip(failed, score)]]

        return work

    return map_texts(docs, make, _COUNTS | {"base_failed": "boolean", "score": "double", "kept": "boolean"}, text, keep)
