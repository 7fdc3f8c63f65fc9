import duckdb
import numpy as np
import pytest

from loomstone.plans import registry


@pytest.mark.parametrize("name", ["fusion_kind", "rrf_offline", "rerank_fixture"])
def test_all_others_are_scored(spark, tmp_path, name):
    """More vectors than any list of best ones has: every pair of an asked one with another is in the result, as in SQL."""
    v = np.random.default_rng(2).normal(size=(230, 6)).round(3)
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query, r.id): r[2:] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[:2]: r[2:] for r in duckdb.sql(registry.oracle_sql()[name]).fetchall()}
    assert got.keys() == want.keys() and len({i for _, i in got}) > 150 and len(got) > 3 * 60
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)
