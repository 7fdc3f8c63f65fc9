from loomstone.operators import fingerprints as P


def test_equal_fingerprints_keep_their_links(spark):
    """Different texts with equal fingerprints, by brute force: each pair up to 3 bits apart follows from members and pairs."""
    prints = [(1, 5), (2, 5), (3, 7), (4, 1 << 50), (5, 7), (6, 5)]
    df = spark.createDataFrame(prints, "id long, simhash long")
    stands = {r.id: r.representative for r in P.members(df).collect()}
    assert stands == {1: 1, 2: 1, 6: 1, 3: 3, 5: 3, 4: 4}
    near = {(r.a, r.b) for r in P.near_pairs(df).collect()}
    for i, x in prints:
        for j, y in prints:
            a, b = sorted((stands[i], stands[j]))
            assert ((x ^ y).bit_count() <= 3) == (a == b or (a, b) in near)
