"""Windows that earlier documents hold: against brute force, with odd rows, hot passages and filters that are full."""

import random

import numpy as np
import pytest
from ferrule.llm import substring_dedup
from ferrule.llm.substring_dedup import levels, remove_repeated_windows

SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def brute(rows, window):
    """{id: [(n_words, n_removed, kept)]} of rows (id, text)."""
    first = {}
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), None if text is None else " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed, n=60, words=40):
    r = random.Random(seed)
    passages = [[f"p{k}_{r.randrange(9)}" for _ in range(r.choice([6, 7, 12, 13, 14, 30, 60]))] for k in range(12)]
    rows = []
    for i in range(n):
        w = []
        while len(w) < words:
            w += r.choice(passages) if r.random() < 0.4 else [r.choice("abcdefghij")] * r.randrange(1, 20) if r.random() < 0.2 else [str(r.randrange(10**6)) for _ in range(r.randrange(1, 12))]
        rows.append((i * 3 - 40, r.choice(SPACE).join(w) + r.choice(["", " ", "\n\n"])))
    return rows


def test_levels_double_up_to_the_window():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(12) == [6, 12] and levels(2) == [1, 2] and levels(1) == [1]
    for w in range(1, 300):
        chain = levels(w)
        assert chain[-1] == w and all(b in (2 * a, 2 * a - 1) for a, b in zip(chain, chain[1:]))


@pytest.mark.parametrize("window", [1, 2, 5, 13, 26, 50])
def test_removal_equals_brute_force(spark, window):
    rows = corpus(window)
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, rows[3][1]), (1005, rows[3][1]), (1005, rows[4][1]), (1006, " ".join("abcdefghijklmnop")), (1007, "é x " * 40)]
    got = remove_repeated_windows(spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(5), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == brute(rows + odd, window)


def test_full_filters_small_pieces_and_hot_windows_change_nothing(spark, monkeypatch):
    rows = corpus(3, 80) + [(5000 + k, f"{k} " + " ".join(f"hot{j}" for j in range(20))) for k in range(40)]
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 64)
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", 50)
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == brute(rows, 13)


def test_nothing_repeats_null_ids_clashing_names_and_empty_tables(spark):
    alone = spark.createDataFrame([(k, " ".join(f"{k}-{j}" for j in range(30))) for k in range(5)], "doc_id int, text string")
    assert {r.n_removed for r in remove_repeated_windows(alone).collect()} == {0}
    long = " ".join(map(str, range(20)))
    rows = [(None, long, 1, "x", 7), (4, long, 2, "y", 8), (None, None, 3, None, None), (4, long, 2, "y", 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, key int, gone string, n_words int")
    got = remove_repeated_windows(df)
    assert got.columns == ["doc_id", "text", "key", "gone", "n_words", "n_removed"]
    assert sorted((r.key, r.gone or "", r.text, r.n_words, r.n_removed) for r in got.where("text is not null").collect()) == [(1, "x", "", 20, 20), (2, "y", long, 20, 0), (2, "y", long, 20, 0)]
    assert got.where("text is null").select("n_words", "n_removed").collect() == [(0, 0)]
    assert remove_repeated_windows(df.limit(0)).collect() == []
    dotted = spark.createDataFrame([(1, long), (2, long)], ["a.id", "the.text"])
    assert sorted(r.n_removed for r in remove_repeated_windows(dotted, text="the.text", doc_id="a.id").collect()) == [0, 20]


def test_the_least_name_is_found_at_its_first_place():
    x = np.random.default_rng(2).integers(0, 5, 200)
    for n in range(1, 20):
        at = substring_dedup._least_ahead(x, n)
        assert all(at[i] == i + int(np.argmin(x[i : i + n])) for i in range(len(x) - n))
