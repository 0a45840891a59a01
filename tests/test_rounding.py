"""Queries whose rows differ from their SQL by the sign of a rounded zero."""

import duckdb
import pytest

import __spark_entry__

E = [0.25, -1e-8, 1e-8, -0.0, 0.0, -0.3, -4e-7, -6e-7] * 8


@pytest.mark.parametrize("name", ["dry_wet_mix", "linear_resample"])
def test_negative_values_that_round_to_zero(spark, tmp_path, name):
    rows = [(0, E), (1, [x / 2 for x in E]), (2, [-x for x in E]), (3, [-1e-9] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(map(str, con.sql(__spark_entry__.oracle_sql()[name]).fetchall()))
    assert any("-0.0," in x for x in want)
    assert sorted(str(tuple(x)) for x in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == want
