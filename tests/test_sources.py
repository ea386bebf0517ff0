"""Files read by ranges with global lines and markers; folders that are seen whole or not at all."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ferrule.sources import committed, text


def test_a_large_file_is_read_by_many_tasks_with_the_same_lines(spark, tmp_path):
    r = random.Random(1)
    names, want = ("a.pl", "b.pl"), set()
    for name in names:
        said, rows = None, []
        for k in range(6000 if name == "a.pl" else 1):
            line = f"% S{r.randrange(99)}: x" if r.random() < 0.002 else "" if r.random() < 0.1 else "fact(" + "é" * r.randrange(40) + f"{k})."
            said = line[3:].split(":")[0] if line.startswith("%") else said
            rows.append((k + 1, line, said))
        (tmp_path / name).write_text("\n".join(x[1] for x in rows) + "\n", encoding="utf-8")
        want |= {(name, *x) for x in rows}
    (tmp_path / "empty.pl").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        marked = text.marked_lines(spark, str(tmp_path), F.nullif(F.regexp_extract("text", r"^% S(\d+):", 1), F.lit("")))
        assert text._ranges(spark, str(tmp_path)).select("start").distinct().count() > 10
        got = {(x.path.split("/")[-1], x.line, x.text, x.marker) for x in marked.collect()}
        plain = {(x.path.split("/")[-1], x.line, x.text) for x in text.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and plain == {x[:3] for x in want}


def test_a_failing_write_leaves_what_was_there(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "k long, v string"
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path, schema)
    first = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") > 3, "x").alias("v"))
    listed = committed.write_committed(first.repartition(3), path)
    assert listed.count() == 3 and sorted(committed.read_committed(spark, path, schema).collect()) == sorted(first.collect())
    broken = spark.range(20).repartition(4).select(F.col("id").alias("k"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("y").cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        committed.write_committed(broken, path)
    assert sorted(committed.read_committed(spark, path, schema).collect()) == sorted(first.collect())
    assert len([x for x in os.listdir(tmp_path / "out") if x.startswith("data-")]) == 1 and not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]
    second = first.where("k < 5")
    committed.write_committed(second.coalesce(1), path)
    assert sorted(committed.read_committed(spark, path, schema).collect()) == sorted(second.collect())
    empty = f"file://{tmp_path}/empty"
    committed.write_committed(first.limit(0).coalesce(1), empty)
    assert committed.read_committed(spark, empty, schema).collect() == []
    data = next(x for x in (tmp_path / "out").glob("data-*/part-*") if x.stat().st_size and not x.name.endswith(".crc"))
    for x in (tmp_path / "out").glob("data-*/part-*"):
        x.write_text('{"k":1,"v":"changed"}\n')
    for x in (tmp_path / "out").glob("data-*/.part-*.crc"):
        x.unlink()
    assert data.exists()
    with pytest.raises(ValueError, match="manifest"):
        committed.read_committed(spark, path, schema)


def test_a_committed_folder_has_data_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committed, "FILE_ROWS", 10, raising=False)
    path = f"file://{tmp_path}/bounded"
    listed = committed.write_committed(spark.range(25).coalesce(1), path)
    assert listed.count() == 3 and len(listed.inputFiles()) == 1
    assert sorted(x.id for x in committed.read_committed(spark, path, "id long").collect()) == list(range(25))
