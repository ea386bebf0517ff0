"""Embedding links, near-duplicate documents and line dedup against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from ferrule.llm import minhash
from ferrule.llm.common import components
from ferrule.llm.embedding_dedup import link_embeddings
from ferrule.llm.line_dedup import drop_boilerplate_lines
from ferrule.llm.minhash import near_duplicates
from pyspark.sql import functions as F


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    plain = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == classes({x for e in plain for x in e}, plain)


def vectors():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(30):
            base = rng.standard_normal(64)
            for _ in range(rng.integers(1, 6)):
                rows.append((n, (base + rng.normal(0, rng.choice([0.1, 0.3, 0.45]), 64)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + k, rows[3][1], 1) for k in range(5)]
    return rows


def test_links_match_brute_force_with_blocks(spark, monkeypatch):
    from ferrule.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rows = vectors()
    edges, count = [], dict.fromkeys((r[0] for r in rows), 0)
    for (i, v, y), (j, w, z) in itertools.combinations(rows, 2):
        a, b = np.array(v, float), np.array(w, float)
        if y == z and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
            edges.append((i, j))
            count[i] += 1
            count[j] += 1
    want = classes(count, edges)
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(edges) > 60 and len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (count[i], want[i]) for i in count}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_that_cannot_link(spark):
    one = [1.0] + [0.0] * 7
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0] * 8, 1), (7, [float("nan")] + one[1:], 1), (8, [None] + one[1:], 1),
        (9, one, 2), (None, one, 1), (10, [float("inf")] + one[1:], 1), (11, one[:5], 1), (12, [1e-30] + [0.0] * 7, 1),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, rep string, mult int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect()), key=str)
    linked = [(1, 3, 1, True), (12, 3, 1, False), (2, 3, 1, False), (2, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 0, None, True)]
    assert got == sorted(linked + alone, key=str)
    assert link_embeddings(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_have_the_links_of_their_own_vector(spark):
    a, near, other = [1.0, 0.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(1, a, 1), (1, other, 1), (0, near, 1), (1, a, 2)], f"vec_id long, embedding array<{kind}>, label int")
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in link_embeddings(df).collect()) == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (1, 1, 0)]


def test_pairs_at_the_threshold_share_a_filter():
    from ferrule.llm import embedding_dedup

    rng = np.random.default_rng(8)
    for code, n in ((512, 3000), (4096, 500)):
        a, b = rng.standard_normal((2, n, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        x, y = embedding_dedup.filters_of(a, code), embedding_dedup.filters_of(b, code)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]) >= 0.998
    assert embedding_dedup.code_for(10**5) == 512 < embedding_dedup.code_for(10**8) < embedding_dedup.code_for(10**10) == embedding_dedup.CODES[1]


def sets(text, k):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def documents():
    rng, rows = random.Random(3), []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append(" ".join(words))
    hub = [f"h{i}" for i in range(60)]
    for i in range(40):  # one large group of near copies, not all of which are near each other
        words = list(hub)
        for _ in range(3):
            words[rng.randrange(60)] = f"y{i}"
        rows.append(" ".join(words))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("shingle", "block"), [(2, 512), (2, 6), (5, 512)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, shingle, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = documents()
    own = {i: sets(t, shingle) for i, t in rows}
    edges = [(i, j) for i, j in itertools.combinations(own, 2) if own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])]
    want = classes(own, edges)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle).collect()
    assert len(edges) > 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(own[i]), want[i]) for i in own}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "A b\tc"), (2, "a B\nc "), (3, None), (4, ""), (5, " \t"), (6, "one"), (7, "ONE"), (None, "a b c"), (2, "a b c"), (8, "a b c"), (9, "w " * 30000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, rep int, n string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=2).collect()), key=str)
    assert got == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 2, None, True), (8, 1, 8, True), (9, 1, 9, True)], key=str
    )
    assert near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_a_doc_id_with_another_text(spark):
    w, z = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    df = spark.createDataFrame([(0, w), (1, w + " tail"), (1, z), (1, z), (3, z.upper())], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept, r.first) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True, True), (1, 0, False, False), (1, 1, True, True), (1, 1, True, True), (3, 1, False, False)]


@pytest.mark.parametrize("size", [12, 60, 400])
def test_share_of_similar_pairs_that_meet(size):
    """Sets at 80 to 90 %, short ones with borrowed registers included: they share a band, and the estimate lets them through."""
    rng, met, passed, tried = np.random.default_rng(size), 0, 0, 300
    for _ in range(tried):
        extra = int(rng.integers(0, max(1, size // 5) + 1))
        pool = np.unique(rng.integers(0, 1 << 62, size + extra, dtype=np.uint64) << np.uint64(2))
        a, b = pool, np.sort(rng.permutation(pool)[: len(pool) - extra]) if extra * 5 <= len(pool) else pool
        ra, rb = minhash.registers(a)[None], minhash.registers(b)[None]
        met += bool((minhash.band_keys(ra) == minhash.band_keys(rb)).any())
        passed += bool(minhash.estimated(ra, rb)[0] >= minhash._floor(np.array([len(b)]), 0.8)[0])
    assert met >= 0.99 * tried and passed >= 0.99 * tried


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common, own = int(2000 * share), int(2000 * (1 - share) / 2)
        pool = np.unique(rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, common + 2 * own, dtype=np.uint64))
        pool = rng.permutation(pool)
        a, b = np.sort(pool[: common + own]), np.sort(np.r_[pool[:common], pool[common + own :]])
        got = minhash.estimated(minhash.registers(a)[None], minhash.registers(b)[None])[0]
        assert abs(got - share) < 0.15


def test_lines_that_a_host_repeats(spark):
    rows = [(i, "a", f"menu \nstory {i}\n\nmenu") for i in range(6)] + [(10, "a", "story 1\nlast"), (11, "b", "menu\nonly"), (12, None, "menu"), (13, "a", None), (14, "a", ""), (15, "a", "menu")]
    rows += [(16, "c", "same text\nagain")] * 5
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, source string, text string, n_lines int, c string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate_lines(df, max_ratio=0.5).collect()}
    assert got[0] == ("story 0\n", 4, 2)
    assert got[10] == ("story 1\nlast", 2, 0) and got[11] == ("menu\nonly", 2, 0) and got[12] == ("menu", 1, 0)
    assert got[13] == (None, 0, 0) and got[14] == ("", 1, 0) and got[15] == ("", 1, 1)
    assert got[16] == ("same text\nagain", 2, 0)  # five copies are one page
    out = drop_boilerplate_lines(df)
    assert out.count() == len(rows) and out.columns == ["doc_id", "source", "text", "c", "n_lines", "n_dropped"]
    assert drop_boilerplate_lines(df.limit(0)).count() == 0
    odd = df.select("doc_id", F.col("source").alias("h"), F.col("text").alias("te.xt"), F.lit(1).alias("t"), F.lit(2).alias("row"), F.lit(3).alias("gone"), F.lit(4).alias("page"))
    got = drop_boilerplate_lines(odd, text="te.xt", host="h", max_ratio=0.5)
    assert got.columns == ["doc_id", "h", "te.xt", "t", "row", "gone", "page", "n_lines", "n_dropped"] and {(r.t, r.row, r.gone, r.page) for r in got.collect()} == {(1, 2, 3, 4)}


def test_hot_lines_hosts_and_texts_give_the_same(spark, monkeypatch):
    from ferrule.llm import common, line_dedup

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "b", None]), "\n".join(rng.choice(["menu", "foot", f"own {i}", "x", "", " menu "]) for _ in range(4))) for i in range(120)]
    rows += [(200 + i, "a", "menu\nsame") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(str, drop_boilerplate_lines(df, max_ratio=0.4).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    for hot in (1, 10, 1000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert sorted(map(str, drop_boilerplate_lines(df, max_ratio=0.4).collect())) == want
    assert any("n_dropped=2" in r for r in want)
