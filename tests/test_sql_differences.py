"""Queries against their SQL on values where Spark's and the SQL's arithmetic part."""

import duckdb

from ferrule.plans.catalogue import ORACLES, QUERIES


def _both(spark, folder, table, name):
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    return sorted(map(tuple, got.select(*names).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_array_builtins_multiply_in_single_precision(spark, tmp_path):
    rows = [(1, [0.35, 0.15, -0.05], 1), (2, [0.7, 0.45], 2), (3, [0.5, None], None), (4, None, 3), (5, [0.1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = _both(spark, tmp_path, "embeddings", "kb_array_builtins")
    assert got == want


def test_projection_notes_round_halves_to_even(spark, tmp_path):
    rows = [(1, 2, "a", 9052.5), (2, 2, "b", 9053.5), (3, 0, "c", -0.5), (4, 0, "d", -175.5), (5, 1, "e", 12.49), (6, 1, "f", 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got, want = _both(spark, tmp_path, "supplier", "kb_projection_notes")
    assert got == want and ("d1", "n2", "a", "balance 9052") in got
