"""Plain-Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def near_duplicates(rows, percent=85):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}; all pairs that share a shingle are compared."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(A_Z))
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def substring(rows, size=20):
    """[(doc_id, text)] -> {doc_id: (n_words, n_removed, kept words)}."""
    first, gone = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        flags = [False] * len(w)
        for at in range(len(w) - size + 1):
            key = tuple(w[at:at + size])
            if key in first:
                flags[at:at + size] = [True] * size
            else:
                first[key] = (i, at)
        gone[i] = (len(w), sum(flags), [x for x, f in zip(w, flags) if not f])
    return gone


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def base_scores(rows, mod=7, rest=2):
    """[(doc_id, text)] -> {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    words = {i: WORD.findall((t or "").translate(A_Z)) + [None] for i, t in rows}
    counts = Counter(x for i, w in words.items() if fold(i, mod) != rest for x in w)
    n, v = sum(counts.values()), len(counts)
    return {i: (fold(i, mod) == rest, len(w), sum(counts[x] > 0 for x in w), n,
                sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in words.items()}


def decontaminated(docs, items, size=10):
    """{doc_id: (n_words, n_hit, sorted item ids)}."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(A_Z))
    out = {}
    patterns = defaultdict(set)
    for i, t in items:
        w = split(t)
        for at in range(max(1, len(w) - size + 1) if w else 0):
            patterns[tuple(w[at:at + size])].add(str(i))
    sizes = {len(p) for p in patterns}
    for i, t in docs:
        w, hit, own = split(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (p := tuple(w[at:at + n])) in patterns:
                    hit.update(range(at, at + n))
                    own |= patterns[p]
        out[i] = (len(w), len(hit), sorted(own))
    return out
