from loomstone.plans.base import BATCH_BYTES, BATCH_LIMIT, ship


def test_batches_are_small_unless_told(spark):
    """Workers hold what they make of a batch, so queries set a small limit where none is set, and leave one that is."""
    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        spark.conf.unset(BATCH_LIMIT)
        ship(spark)
        assert spark.conf.get(BATCH_LIMIT) == str(BATCH_BYTES)
        rows = spark.range(40_000, numPartitions=1).selectExpr("id", "repeat('x', 1000) AS text")
        sizes = [r.n for r in rows.mapInPandas(lambda it: (p.head(1).assign(n=p["text"].str.len().sum())[["n"]] for p in it if len(p)), "n long").collect()]
        assert sum(sizes) == 40_000_000 and max(sizes) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_LIMIT, "5000000")
        ship(spark)
        assert spark.conf.get(BATCH_LIMIT) == "5000000"
    finally:
        spark.conf.set(BATCH_LIMIT, before) if before else spark.conf.unset(BATCH_LIMIT)


def test_small_rows_share_a_frame():
    """Frames are of some bytes or rows, and lose nothing; a large row stands alone."""
    from loomstone.operators.parsing import grouped

    sizes = [3, 4, 50, 1, 1, 1, 1, 1]
    got = [f["id"].tolist() for f in grouped(((n, {"id": k}) for k, n in enumerate(sizes)), 7, 4)]
    assert got == [[0, 1], [2], [3, 4, 5, 6], [7]] and list(grouped(iter(()))) == []
