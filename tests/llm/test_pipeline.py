"""The pipeline: its stages hold against plain versions, each on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ferrule.llm.common import WORD


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    out = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs = []
    for i in range(160):
        docs.append([i, "\n".join(" ".join(word() for _ in range(15)) + "." for _ in range(4)), "en", f"s{i % 3}", 0])
    docs += [[200 + i, docs[i][1].replace(" ", "  ", 1), "en", "s1", 0] for i in range(10)]  # copies
    docs += [[300 + i, docs[20 + i][1] + "\n" + bench[i % 5][1], "en", "s0", 0] for i in range(5)]  # leaks
    docs += [[400 + i, " ".join(["spam"] * 60), "en", "s2", 0] for i in range(5)] + [[500, None, "en", None, 0], [501, "", "en", "s1", 0], [None, docs[50][1] + " tail of its own here", "en", "s2", 0]]
    for d in docs[:60]:
        d[1] = "Home | About | Contact us now\n" + d[1]
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_dedup", "benchmark_decontamination", "mixing"]
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    assert not {400, 401, 500, 501} & set(ids["quality_classifier"]) and len(ids["quality_classifier"]) >= 170
    lines = kept["line_dedup"]
    assert sorted(ids["line_dedup"], key=str) == sorted(ids["quality_classifier"], key=str)
    assert not any(r.text.startswith("Home") for r in lines) and all(r.n_chars == len(r.text) for r in lines)
    assert not set(range(200, 210)) & set(ids["minhash_dedup"]) and set(range(10)) <= set(ids["minhash_dedup"]) and None in ids["minhash_dedup"]
    assert not set(range(300, 305)) & set(ids["benchmark_decontamination"]) and set(ids["minhash_dedup"]) - set(ids["benchmark_decontamination"]) == set(range(300, 305))
    assert sorted(ids["mixing"], key=str) == sorted(ids["benchmark_decontamination"], key=str)
    taken, target = sum(r.taken for r in kept["mixing"]), {r.target for r in kept["mixing"]}
    assert abs(taken - sum(target)) < 0.02 * sum(target)


def test_repeated_rows_are_copies(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30")
    out = corpus_pipeline.minhash_dedup(spark, docs.union(docs), folder)
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))


def test_run_gives_the_mix(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    words = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.regexp_count("text", F.lit(WORD)).alias("n"))
    assert out.count() > 150 and out.join(words, "doc_id").where("size > n").isEmpty()


def test_stages_with_clashing_columns_and_odd_rows(spark, folder):
    """Columns named like what the operators make or use inside come through with their values; repeated ids, nulls and long texts too."""
    w = " ".join(f"word{i} goes here." for i in range(40))
    z = " ".join(f"other{i} text stands there." for i in range(40))
    rows = [(0, w), (1, w + " tail"), (1, z), (1, z), (2, None), (3, ""), (None, z), (4, "Long lines of words. " * 20_000)]
    extra = {"hits": 1, "quality_keep": 2, "n_lines": 3, "body": 4, "key": 5, "row": 6, "size": 7, "first": 8, "h": 9}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got and all(r[k] == v for r in got for k, v in extra.items()), name
        if name == "minhash_dedup":
            assert sorted(((r.doc_id, (r.text or "")[:8]) for r in got), key=str) == sorted([(0, "word0 go"), (1, "other0 t"), (2, ""), (3, ""), (None, "other0 t"), (4, "Long lin")], key=str)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mixed.count() == len(rows)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_a_step_of_the_mix_reads_its_state_once(spark, monkeypatch):
    """Each plan that is staged while the multipliers are sought holds a join and an aggregate for each of its three steps."""
    from ferrule.llm import mixing

    plans = []

    def kept(df, label, seen=mixing.staged_and_seen, **measures):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
        return seen(df, label, **measures)

    monkeypatch.setattr(mixing, "staged_and_seen", kept)
    docs = spark.createDataFrame([(k, " ".join(["w"] * (k % 17 + 1)), "abc"[k % 3]) for k in range(200)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, carry=[]).collect()
    assert len(rows) == 200 and all(abs(sum(r.taken for r in rows if r.target == t) - t) < 20 for t in {r.target for r in rows})
    assert {n for label, n in plans if label == "mix-dual"} == {3}
