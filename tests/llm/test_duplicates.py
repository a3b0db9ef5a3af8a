"""Near duplicates, repeated passages, components and the pipeline against plain versions."""

import os
import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from shiftlens.llm import langid, minhash, queries, stages, substring
from shiftlens.llm.common import Scratch, fold_is
from shiftlens.llm.components import connected_components
from shiftlens.session import checkpoint_dir

SMALL = "/root/testdata/sf0.001"


def rows_of(spark, sf=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def planted(seed=3):
    """Copies, near copies around a base, chains, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    text = lambda n: [word() for _ in range(n)]
    rows, base = [], text(160)
    for _ in range(60):  # near copies with one to eight other words
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    chain = text(150)
    for _ in range(12):  # each differs a little from the one before
        chain = list(chain)
        chain[rng.randrange(len(chain))] = word()
        rows.append("\n".join(chain))
    passage = text(45)
    for _ in range(40):
        rows.append(" ".join(text(rng.randrange(0, 30)) + passage + text(rng.randrange(0, 30))))
    rows += [" ".join(passage * 3), "one two three", "One TWO three", "one two", "", None, "  \n ", "tie tie tie tie tie tie " * 20]
    rows += rows[:5] + [" ".join(text(80)) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # 8: groups are dealt out in many block pairs
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    want = brute.near_duplicates(rows)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_of_the_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_minhash(spark, SMALL).collect()}
    assert got == brute.near_duplicates(rows_of(spark))


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string, sig string, component_id int, id int"
    rows = [(1, "a b c d e f", "x", 0, 0), (1, "a b c d e f", "x", 0, 0), (1, "other words stand here now ok", "x", 0, 0), (0, "other words stand here now ok", "x", 0, 0),
            (None, "a b c d e f", "x", 0, 0), (5, None, "x", 0, 0)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, None, True), (0, 0, True), (1, 0, False), (1, 0, False), (1, 0, False), (5, 5, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85):
        x = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
        both = int(2000 * share)
        other = np.concatenate([x[:both], rng.integers(0, 1 << 62, 2000 - both, dtype=np.uint64)])
        a, b = (np.frombuffer(minhash.signature(minhash.minima(np.unique(s))), np.uint8) for s in (x, other))
        assert abs((a == b).mean() - both / (4000 - both)) < 0.17


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("limits", [{}, {"shard_words": 60, "anchor_segments": 2}])
def test_repeated_words_match_a_plain_version(spark, limits):
    """With small limits, shards hold few anchors and crowded anchors are settled by their windows."""
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_digests(df, **limits).collect()}
    assert got == {i: (n, g, brute.sha(" ".join(k))) for i, (n, g, k) in brute.substring(rows).items()}


def test_repeated_words_of_the_documents(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, SMALL).collect()}
    assert got == {i: (n, g, brute.sha(" ".join(k))) for i, (n, g, k) in brute.substring(rows_of(spark)).items()}


def test_repeated_words_of_odd_tables(spark):
    schema = "doc_id long, text string, h int, starts string, packed int"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(2, long, 1, "a", 0), (2, long, 1, "a", 0), (None, long, 1, "a", 0), (3, long, 1, "a", 0), (4, None, 1, "a", 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_digests(df).collect())
    assert got == [(-1, 30, 0), (2, 30, 0), (2, 30, 0), (3, 30, 30), (4, 0, 0)]
    texts = substring.dedup_texts(df)
    assert texts.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in texts.collect()) == sorted([("2", long), ("2", long), ("None", long), ("3", ""), ("4", None)])
    assert substring.dedup_digests(df.limit(0)).count() == 0 and substring.dedup_texts(df.limit(0)).count() == 0


def test_cut_texts_keep_their_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(22))
    rows = [(1, f"start here\n{shared}\nend"), (2, f"  my own\twords\n{shared}\n\nstay here ")]
    got = {r.doc_id: r.text for r in substring.dedup_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "  my own\twords\nstay here "}


def test_suffix_automaton_statistics():
    rng = random.Random(0)
    seqs = [[rng.choice("ab") for _ in range(30)] for _ in range(6)]
    a, place, first = substring.SuffixAutomaton(), 0, {}
    for s in seqs:
        a.add(s, place)
        for i in range(len(s) - 4):
            first.setdefault(tuple(s[i:i + 5]), place + i + 4)
        place += len(s)
    for s in seqs + [[rng.choice("abc") for _ in range(40)]]:
        want = [first.get(tuple(s[i - 4:i + 1]), -1) if i >= 4 else -1 for i in range(len(s))]
        assert list(a.matches(s, 5)) == want


def test_near_dedup_stage_drops_copies_of_similarity_080_to_085(spark):
    rows = []
    for g, changed in enumerate((3, 4, 5, 6, 7)):  # each changed word takes five shingles: similarity 0.86 to 0.71
        base = [f"g{g}w{i}" for i in range(204)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join("other" if i % 20 == 10 and i < 20 * changed else w for i, w in enumerate(base)))]
    at_80, at_85 = ({i for i, (_, c) in brute.near_duplicates(rows, percent=p).items() if i == c} for p in (80, 85))
    assert len(at_85) - len(at_80) == 1
    got = stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in got.collect()} == at_80


def test_near_dedup_stage_on_the_documents_at_80(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {i for i, (_, c) in brute.near_duplicates(rows_of(spark), percent=80).items() if i == c}
    assert {r.doc_id for r in stages.near_dedup(spark, docs, SMALL).select("doc_id").collect()} == want


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    one = stages.language_id(spark, docs, SMALL)
    assert one.columns == docs.columns
    model = langid.fit(docs.filter(~fold_is("doc_id", 4, 2)))
    keep = {r.doc_id for r in langid.predict(docs, model).filter("not rejected").collect()}
    assert set(texts(one)) == keep and len(keep) > 0.97 * docs.count()
    two = stages.near_dedup(spark, one, SMALL)
    groups = brute.near_duplicates(list(texts(one).items()), percent=80)
    assert set(texts(two)) == {i for i, (_, c) in groups.items() if i == c} and two.columns == docs.columns
    three = stages.substring_dedup(spark, two, SMALL)
    plain = brute.substring(list(texts(two).items()))
    assert {i: t.split() for i, t in texts(three).items()} == {i: k for i, (_, _, k) in plain.items()} and three.columns == docs.columns
    four = stages.decontamination(spark, three, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = brute.decontaminated(list(texts(three).items()), items)
    assert set(texts(four)) == {i for i, v in found.items() if not v[1]} and four.columns == docs.columns
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SMALL)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-bpe-")  # all tables on the way are gone
    assert {r.doc_id for r in out.collect()} == set(texts(four)) and names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]


CLASHING = ("doc_id long, text string, lang string, source string, n_chars int, score double, n_words int, n_hit string, lang_pred string, rejected int, row string, number long, "
            "key string, h string, doc string, _h string, _doc string, starts int, counts int, cut string, item_ids string, kept string, component_id int, o int, hit_bytes int")
EXTRA = (7, 0.25, -3, "hit", "lp", 5, "row", 9, "key", "h", "doc", "_h", "_doc", 1, 2, "cut", "ids", "kept", 4, 6, 8)


@pytest.fixture(scope="module")
def strange(spark):
    """Documents with repeated rows, null ids, null and empty texts, near copies, passages of the benchmark, and columns named like the operators' own."""
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect() if r.text and 60 < len(r.text.split()) < 400][:40]
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 25)
    rows = [(r.doc_id, r.text, r.lang) for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], "en"), (None, rows[2][1] + " more", "en"), (None, "", None), (900_000, None, None), (900_001, "", "en"),
             (900_002, f"{rows[3][1]}\n{item}\n{rows[4][1]}", rows[3][2])]
    w = rows[5][1].split()
    rows += [(None, " ".join(w[10:50]) + " " + rows[6][1], rows[6][2])]
    return spark.createDataFrame([(i, t, g, "src", *EXTRA) for i, t, g in rows], CLASHING).repartition(3)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_columns_and_treat_rows_alike(spark, strange):
    rest = lambda df: {tuple(r)[3:] for r in df.collect()}
    one = stages.language_id(spark, strange, SMALL)
    assert one.columns == strange.columns and rest(one) == {("src", *EXTRA)}
    assert {r.text for r in one.collect()} == {r.text for r in strange.collect() if r.text}
    two = stages.near_dedup(spark, strange, SMALL)
    rows = [tuple(r)[:2] for r in strange.collect()]
    groups = brute.near_duplicates([(i, t) for i, (_, t) in enumerate(rows)], percent=80)
    want = []
    for g in {c for _, c in groups.values()}:
        own = [rows[i] for i, (n, c) in groups.items() if c == g]
        want.append(min(own, key=lambda r: (r[0] is None, r[0] or 0))[0])
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in two.collect()) and two.columns == strange.columns and rest(two) == {("src", *EXTRA)}
    three = stages.substring_dedup(spark, two, SMALL)
    assert three.columns == strange.columns and rest(three) == {("src", *EXTRA)}
    order = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in two.collect() if r.text is not None)
    plain = brute.substring([(i, t) for i, (_, _, t) in enumerate(order)])
    # rows without an id are in no stated order among themselves; here only one of them repeats a passage
    assert sorted(" ".join(k) for _, _, k in plain.values()) == sorted(" ".join((r.text or "").split()) for r in three.collect() if r.text is not None)
    four = stages.decontamination(spark, three, SMALL)
    assert four.columns == strange.columns and rest(four) == {("src", *EXTRA)}
    assert {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()} == {900_002}
    assert stages.bpe(spark, four, SMALL).count() == four.count()


def test_stages_on_an_empty_table(spark, strange):
    docs = strange.limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL)
        assert docs.columns == strange.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_hashes_of_words_do_not_depend_on_where_they_stand():
    sp = substring.Splitter()
    long = b"x" * 70 + b" " + b"y" * 3000
    h, start, end = sp.words(b"one two\tthree " + long + b" one\x0btwo three " + long + b"\n")
    assert len(h) == 10 and h[:5].tolist() == h[5:].tolist() and len(set(h[:5].tolist())) == 5 and (end - start)[:5].tolist() == [3, 3, 5, 70, 3000]
    words = [f"w{i}".encode() for i in range(200_000)]
    h, _, _ = sp.words(b" ".join(words))  # more than one block
    assert len(set(h.tolist())) == len(words) and h[150_000] == sp.words(words[150_000])[0][0]


def test_tables_on_the_way_are_deleted_when_nothing_needs_them(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, text + " y")], "doc_id long, text string")
    with Scratch(spark) as scratch:
        found = substring.find_repeats(docs, scratch, corpus_again=False)
        names = [t.inputFiles()[0] for t in scratch.tables if t.inputFiles()]
        assert not any("/anchors-" in n or "/corpus-" in n for n in names)
        assert {r.doc: sorted(zip(r.starts, r.counts)) for r in found.spans(20).collect()}.keys() == {2, 3}
    with Scratch(spark) as scratch:
        assert substring.find_repeats(docs, scratch).corpus.count() == 3  # it is read again for digests
