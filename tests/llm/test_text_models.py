"""Toxicity, quality and decontamination."""

import random

import pytest
from ferrule.llm import decontam
from ferrule.llm.decontam import codes, compared, find_contamination, tile, tokens
from ferrule.llm.quality import LABELLERS, LabelModel, score_quality
from ferrule.llm.toxicity import FEATURES, Reader, score_toxicity
from pyspark.sql import functions as F


def prose(rng, n, extra=()):
    made = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    words = [rng.choice(["the", "of", "you", "and"]) if rng.random() < 0.3 else made() for _ in range(n)]
    for e in extra:
        words.insert(rng.randrange(len(words)), e)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        bad = i % 6 == 0
        bad_words = rng.sample(["zorkling", "zorkish", "zorker", "zorks", "idiot"], 3) if bad else ()
        rows.append((i, prose(rng, rng.randrange(20, 80), bad_words), "en"))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxic_documents_held_out(labelled):
    docs, labels = labelled
    got = score_toxicity(docs, labels).join(labels, "doc_id")
    held = got.where("held_out").collect()
    assert 100 < len(held) < 250
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    assert got.where("held_out").join(docs, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).isEmpty()


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "you zorker", "q"), (1, None, "q"), (3, "x " * 50_000, "q")], "doc_id long, text string, score string")
    got = score_toxicity(odd, labels.limit(0)).collect()
    assert sorted(r.score for r in got) == [0.0] * 5 and {r.predicted for r in got} == {0}
    assert score_toxicity(docs.limit(0), labels).count() == 0
    only = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (None, 0, 1), (5, 0, 7)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(odd, only).collect()} == {1.0}


def test_features_of_words():
    f = dict(zip(FEATURES, Reader({"zork*": 6.0}).features("Hey YOU st00pid zorkling!! soooo b@d")))
    assert f["lexicon_hits"] == 1 and f["near_you"] >= 1
    assert f["shouted"] > 0 and f["stretched"] > 0 and f["obfuscated"] > 0 and f["exclaim"] > 0
    assert Reader({}).features(None) == Reader({}).features("") == Reader({}).features(" \n") == [0.0] * len(FEATURES)


def test_label_model_finds_the_good_labellers():
    rng = random.Random(4)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        vote = [("2" if good else "0") if rng.random() < 0.9 else "1" for _ in LABELLERS[:-1]] + [rng.choice("02")]
        counts["".join(vote)] = counts.get("".join(vote), 0) + 1
    model = LabelModel(counts, trust=0.0)
    accuracy = list(model.accuracies().values())
    assert abs(model.prior - 0.8) < 0.05 and min(accuracy[:-1]) > 0.9 > 0.75 > accuracy[-1]
    assert LabelModel({}).posterior([1] * len(LABELLERS)) > 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 60) + ".") for i in range(150)]
    bad = [(1000 + i, " ".join(["word"] * 40 + ["other"] * 40)) for i in range(20)] + [(1100 + i, prose(rng, 40).upper().replace(" ", "!! ")) for i in range(20)] + [(1200 + i, prose(rng, 40).replace(" ", "%%% ###")) for i in range(10)]
    odd = [(1, None), (2, ""), (3, " \n"), (None, prose(rng, 60)), (4, "x"), (4, "x")]
    df = spark.createDataFrame([(*r, 1.0, "s") for r in good + bad + odd], "doc_id long, text string, quality_score double, p string")
    got = score_quality(df)
    assert got.columns == ["doc_id", "text", "p", "weak_posterior", "quality_score", "quality_keep"] and got.count() == len(good) + len(bad) + len(odd)
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(by[i][-1].quality_keep for i, _ in good[5:]) >= 0.98 * len(good[5:])
    assert sum(by[i][0].quality_keep for i, _ in bad) <= 0.1 * len(bad)
    empty = [r for r in rows if r.text is None or not r.text.strip()]
    assert len(empty) == 3 and all(r.quality_score == 0 and not r.quality_keep for r in empty)
    assert score_quality(df.limit(0)).count() == 0


def test_tiles_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(3, 14))]
        doc = [rng.randrange(-1, 6) for _ in range(rng.randrange(3, 30))]
        found = tile(item, doc, 3)
        assert all(n >= 3 and item[i : i + n] == doc[d : d + n] for i, d, n in found)
        ci, cd = [x for i, _, n in found for x in range(i, i + n)], [x for _, d, n in found for x in range(d, d + n)]
        assert len(ci) == len(set(ci)) and len(cd) == len(set(cd))
        free_i, free_d = set(range(len(item))) - set(ci), set(range(len(doc))) - set(cd)
        left = [(a, b) for a in free_i for b in free_d if all(a + k in free_i and b + k in free_d and item[a + k] == doc[b + k] for k in range(3))]
        assert not left  # nothing of the least length remains
        longest = max((n for a in range(len(item)) for b in range(len(doc)) for n in [next((k for k in range(len(item)) if a + k >= len(item) or b + k >= len(doc) or item[a + k] != doc[b + k]), len(item) - a)]), default=0)
        assert max((n for _, _, n in found), default=0) == (longest if longest >= 3 else 0)


def test_reordered_passages_are_caught():
    assert compared("a b c d e f g h i j", "f g h i j and A, b c d e!", 3, 0.6) == (1.0, 2)
    assert compared("a b c d e f g h i j", "a b c d e zz", 3, 0.6) == (0.0, 0) and compared("x y", "q x y q", 3, 0.6) == (1.0, 1)
    assert compared("", "a", 3, 0.6) == (0.0, 0) and compared("a", "", 3, 0.6) == (0.0, 0)
    assert compared("a " * 60 + "b", "a " * 20_000, 3, 0.6)[0] >= 0.9  # very repetitive texts end


def plainly(docs, items, least, threshold):
    """Every pair tiled, whatever it shares."""
    out = {}
    for d, text in docs:
        for i, passage in items:
            a, b = codes(passage).tolist(), codes(text).tolist()
            if a and b:
                found = tile(a, b, min(least, len(a)))
                if sum(n for _, _, n in found) >= threshold * len(a):
                    out[d, i] = (round(sum(n for _, _, n in found) / len(a), 9), len(found))
    return out


def test_hits_are_those_of_tiling_every_pair(spark, monkeypatch):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 7, 16, 16, 40])))) for i in range(30)]
    items += [(30, items[10][1]), (31, "the the the the the the the the")]
    docs = []
    for d in range(80):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            own = tokens(rng.choice(items)[1])
            size = rng.choice([3, 4])
            pieces = [own[k : k + size] for k in range(0, len(own), size)]
            rng.shuffle(pieces)
            kept = pieces[: max(1, round(len(pieces) * rng.choice([0.5, 0.7, 1])))]
            for piece in kept:
                at = rng.randrange(len(body) + 1)
                body[at:at] = ["x"] + piece
        docs.append((d, " ".join(body)))
    docs += [(80, docs[3][1]), (81, "the " * 300)]
    want = plainly(docs, items, 3, 0.6)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for rows, bits in ((decontam.BROADCAST_ROWS, decontam.FILTER_BITS), (0, 1 << 16)):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontam, "FILTER_BITS", bits)
        got = {(r.doc_id, h.item_id): (round(h.coverage, 9), h.tiles) for r in find_contamination(a, b).collect() for h in r.hits}
        assert got == want and len(want) > 60


def test_contamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(i, " ".join(f"t{i}w{k}" for k in range(20)), "k") for i in range(12)] + [(50, None, "k"), (51, "", "k"), (None, "null id passage of several words here", "k")], "item_id long, text string, hits string")
    docs = spark.createDataFrame(
        [(1, "before " + " ".join(f"t3w{k}" for k in [*range(10, 20), *range(10)]) + " after", 0, 1, "a"), (2, "clean text", 0, 1, "a"), (3, None, 0, 1, "a"), (4, "", 0, 1, "a"), (5, " ".join(f"t4w{k}" for k in range(9)), 0, 1, "a"),
         (1, "clean", 0, 1, "a"), (6, "null id passage of several words here " * 400, 0, 1, "a")],
        "doc_id long, text string, hits int, key int, found string",
    )
    out = find_contamination(docs, bench)
    assert out.columns == ["doc_id", "text", "key", "found", "hits"]
    got = sorted(((r.doc_id, [h.item_id for h in r.hits]) for r in out.collect()), key=str)
    assert got == sorted([(1, [3]), (1, []), (2, []), (3, []), (4, []), (5, []), (6, [None])], key=str)
    assert find_contamination(docs, bench.limit(0)).where(F.size("hits") > 0).isEmpty()
    assert find_contamination(docs.limit(0), bench).count() == 0
