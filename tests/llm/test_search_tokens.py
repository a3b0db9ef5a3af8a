"""Ranked search, SentencePiece and token alignment against plain versions and the tokenizer libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shiftlens.llm import alignment, pieces, queries, ranked

SMALL = "/root/testdata/sf0.001"
PIECES, BYTES = queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b ", "\n \n", "<|endoftext|> <s> <0x41>", "▁▁x ▁", "é" * 60, "漢字かな 🎉🎉", "the " * 3000,
       "x" * 3000, " " * 50, "\x00\x01 12 345", "A1b-c_d", "Ünï ÜNÏ", "tie one", "tie one"]


def made_up(n, seed=3):
    r = random.Random(seed)
    parts = [*" \n\tab1th éñe🎉<>.,_▁", "  ", "the ", " and", "ción"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd and made-up texts, repeated rows, a null id, and columns named like the operators' own."""
    rows = [(i, t, "q", 1, 0, "x") for i, t in enumerate(ODD + made_up(150))] + [(3, ODD[3], "q", 1, 0, "x"), (4, "a  b ", "q", 1, 0, "x"), (None, "the and", "q", 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, rank int, score long, row string").repartition(3)


# ---- ranked search ----------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    held = [(i, c) for i, c in counted if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(A_Z)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_search_equals_plain_version(spark, docs, block_bytes):
    items = [(1, "the THE and b"), (2, "ción a1b"), (3, None), (4, ""), (5, "nowhere"), (6, "tie"), (6, "tie"), (None, "é one"), (7, "th e ab " * 9)]
    table = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, doc_id int").repartition(2)
    got = [tuple(r) for r in ranked.search_items(docs, table, k=4, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == plain_search([(r.doc_id, r.text) for r in docs.collect()], items, 4)
    assert [r for r in got if r[0] == 6 and r[1] <= 2] and {r[2] for r in got if r[0] == 6} == {16, 17}


def test_search_of_many_tasks_and_small_pieces(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted([tuple(r) for r in ranked.search_items(docs.repartition(9), items).collect()], key=str) == want
    monkeypatch.setattr(ranked, "CELLS", 100)
    assert sorted([tuple(r) for r in ranked.search_items(docs, items).collect()], key=str) == want


def test_search_of_empty_tables(docs, spark):
    items = spark.createDataFrame([(1, "the")], "item_id int, text string")
    assert ranked.search_items(docs.limit(0), items).count() == 0
    assert ranked.search_items(docs, items.limit(0)).count() == 0
    assert ranked.search_items(docs.filter("text is null"), items).count() == 0


# ---- SentencePiece ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(spark, docs, library):
    got = pieces.tokenise(docs, PIECES).collect()
    assert len(got) == docs.count() and set(docs.columns) < set(got[0].asDict())
    for r in got:
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.token_ids, r.decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), r.text
    assert pieces.tokenise(docs.limit(0), PIECES).count() == 0


def test_pieces_query(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in queries.op12_sentencepiece(spark, SMALL).collect()} == want


def test_pieces_in_blocks_with_a_small_table_and_by_queue(library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 7)
    monkeypatch.setattr(pieces, "TABLE", 3)
    monkeypatch.setattr(pieces, "SHORT", 1)
    encoder = pieces.Encoder(pieces.read_model(PIECES))
    table = pieces.Table(encoder, pieces.decimal, b",")
    for t in [t for t in ODD if t is not None and len(t) < 4000] + made_up(300, 5):
        assert encoder.encode(t.encode(), table, b",") == pieces.decimal(library.encode(t)), t


def test_decoding_any_ids(library):
    encoder, r = pieces.Encoder(pieces.read_model(PIECES)), random.Random(2)
    for _ in range(2000):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259), r.randrange(130, 259), 29871]) for _ in range(r.randint(1, 12))]
        assert encoder.decode(pieces.decimal(ids)).decode() == library.decode(ids), ids


# ---- alignment --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def first():
    import tokenizers
    t = tokenizers.Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


def plain_alignment(text, first, library):
    """(ids of A, ids of B, groups text, links as pairs of ids) of one text."""
    from shiftlens.llm.bpe import byte_symbols
    value = {c: b for b, c in enumerate(byte_symbols())}
    nothing = ([], [], "", [])
    if not text:
        return nothing
    a, b = first.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
    in_a = [bytes(value[c] for c in first.id_to_token(i)) for i in a]
    in_b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(library.id_to_piece, b))]
    if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
        return nothing
    ends_a, ends_b = ([sum(map(len, s[:i + 1])) for i in range(len(s))] for s in (in_a, in_b))
    links = [(x, y) for x, s, e in zip(a, [0, *ends_a], ends_a) for y, u, v in zip(b, [0, *ends_b], ends_b) if u < e and s < v]
    groups, low = [], 0
    for cut in sorted({*ends_a} & {*ends_b}):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
        low = cut
    return a, b, ";".join(groups), links


def plain_scores(texts, first, library):
    parts = [plain_alignment(t, first, library) for t in texts]
    count = Counter(x for p in parts for x in p[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(a), len(b), g.count(";") + bool(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), g)
            for a, b, g, links in parts]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("common", [1 << 19, 40, 0])
def test_alignment_equals_plain_version(spark, docs, first, library, common):
    import public_tokenizers
    short = docs.filter("length(text) < 500 or text is null")
    rows = short.collect()
    got = alignment.score_links(alignment.align(short, BYTES, PIECES, public_tokenizers.PATTERN), PIECES, common).collect()
    want = plain_scores([r.text for r in rows], first, library)
    assert sorted([(r.doc_id, r.text, *(r[c] for c in COLUMNS)) for r in got], key=str) == sorted([(r.doc_id, r.text, *w) for r, w in zip(rows, want)], key=str)
    assert all(r["n_shared"] == sum(len(a.split(",")) * len(b.split(",")) for a, b in (g.split("|") for g in r["groups"].split(";"))) for r in got if r["groups"])
    assert alignment.score_links(alignment.align(short.limit(0), BYTES, PIECES, public_tokenizers.PATTERN), PIECES).count() == 0


def test_alignment_query(spark, first, library, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 900")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = documents.collect()
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in
            zip(rows, plain_scores([r.text for r in rows], first, library))}
    got = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    assert {r.doc_id: (*(r[c] for c in COLUMNS[:6]), r.groups_sha256) for r in got} == want


def test_products_of_incidence_matrices():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 2, (5, 7)), rng.integers(0, 2, (6, 7))
        csr = lambda m: (np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1])
        row, col, n = alignment.multiply(csr(a), alignment.transpose(csr(b), 7), 6)
        dense = np.zeros((5, 6), int)
        dense[row, col] = n
        assert (dense == a @ b.T).all()


def test_links_in_small_blocks(monkeypatch):
    import numpy as np
    ends_a, ends_b = np.array([2, 3, 7, 9, 12]), np.array([1, 3, 5, 9, 10, 12])
    want = [x.tolist() for x in alignment.overlap_links(ends_a, ends_b)]
    monkeypatch.setattr(alignment, "BLOCK", 1)
    assert [x.tolist() for x in alignment.overlap_links(ends_a, ends_b)] == want


def test_common_ends_of_two_cuts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40):
        a, b = (np.unique(np.append(rng.integers(1, 60, n), [60] * (n > 0))).astype(np.int64) for _ in range(2))
        on_a, on_b = alignment.common_ends(a, b)
        assert (a[on_a] == np.intersect1d(a, b)).all() and (b[on_b] == a[on_a]).all() and len(a[on_a]) == len(np.intersect1d(a, b))


def aligner(pattern=None):
    import public_tokenizers
    return alignment.Aligner(pattern or public_tokenizers.PATTERN, *alignment.read_byte_level(BYTES), pieces.read_model(PIECES))


def test_alignment_encodes_each_chunk_once(monkeypatch):
    import tiktoken
    given = []
    for name in ("encode_ordinary", "encode_to_numpy"):
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, *a, f=getattr(tiktoken.Encoding, name), **b: given.append(text) or f(self, text, *a, **b))
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ing", "tion", "ment", "ness")]
    texts = [" ".join(w + mark for w in words).encode() for mark in ("", ",", ".", ";", ",") for _ in range(50)]
    out = aligner().align(texts)
    assert len(set(out["groups"])) == 4 and out["groups"][50] == out["groups"][200]
    assert sum(map(len, given)) < len(texts[0]) + 99


def test_alignment_in_chunks_equals_whole_texts(first, library):
    rng = np.random.default_rng(11)
    words = ["foo", "Foo's", "don't,", "12a", "über", "日本語", "🙂", "...", "'s", "́", "½", "\x00", "▁", "a,\r", "{\r", "</s>", "<|endoftext|>", "ﬁ", "_", "a_", "x" * 70]
    spaces = ["", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "\r \n", "\x0b", "\x85", "\xa0", "\xa0 ", "　", "　  ", " \n ", " "]
    texts = ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.integers(0, 14))) for _ in range(400)] + [None]
    got = aligner().align([t if t is None else t.encode() for t in texts])
    want = [plain_alignment(t, first, library) for t in texts]
    assert got["groups"] == [w[2] for w in want]
    assert got["n_links"].tolist() == [len(w[3]) for w in want] and got["n_a"].tolist() == [len(w[0]) for w in want]


def test_alignment_by_another_pattern_takes_whole_texts():
    import tiktoken
    ids, _ = alignment.read_byte_level(BYTES)
    pattern = r"\s*\S+\s*"  # words reach over white space behind them
    whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
    texts = ["one, two  three", "a\n\nb. c"]
    got = aligner(pattern).align([t.encode() for t in texts])
    assert got["n_a"].tolist() == [len(whole.encode_ordinary(" " + t)) for t in texts]


def test_segments_by_list_and_by_queue(library):
    encoder = pieces.Encoder(pieces.read_model(PIECES))
    rng = np.random.default_rng(2)
    for n in [*range(1, 40), 200]:
        chunk = " " + "".join(rng.choice([*"aeinorstldhg,.é語"], n))
        by_list, by_queue = encoder._merged(list(chunk)), encoder._merged_by_queue(list(chunk))
        assert by_list == by_queue and "".join(by_list) == chunk
        assert encoder.segment(chunk) == library.encode(chunk[1:])
