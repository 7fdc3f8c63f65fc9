import numpy as np

from loomstone.plans import registry


def test_every_hundredth_against_all(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2500, 8))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["dense_knn"](spark, str(tmp_path)).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 2500, 100):
        s = u @ u[q]
        s[q] = -2
        want |= {(q, int(k)) for k in np.argsort(-s)[:10]}
    assert {(r.query, r.id) for r in got} == want and len({q for q, _ in want}) == 25 and any(k < 20 for _, k in want)
