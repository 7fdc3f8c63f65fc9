import random

from loomstone.operators import guardrails as G
from loomstone.operators.graph import classes


def joined(ids, edges):
    root = {k: k for k in ids}
    for a, b in edges:
        x, y = sorted((root[a], root[b]))
        root = {k: x if r == y else r for k, r in root.items()}
    return root


def test_long_chain(spark):
    """A chain far longer than any fixed number of passes, beside loops, single nodes and repeated edges."""
    rnd = random.Random(2)
    order = list(range(60))
    rnd.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(70, 71), (71, 70), (72, 72)]
    ids = [*range(60), 70, 71, 72, 99]
    got = {r.id: r.cluster for r in classes(spark.createDataFrame([(k,) for k in ids], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined(ids, edges)


def test_claim_classes(spark):
    """Against all pairs, with a common term, contained claims and ties of weight."""
    rnd = random.Random(5)
    weight = {f"t{k}": rnd.choice([0.1, 0.5, 1.0, 2.0, 3.0]) for k in range(25)} | {"common": 0.01}
    claims = {k: {"common", *rnd.sample(sorted(weight), rnd.randint(2, 8))} for k in range(40)}
    for k in range(40, 55):
        claims[k] = set(claims[k - 20]) | {rnd.choice(sorted(weight))}
    edges = []
    for a in claims:
        for b in claims:
            both, least = sum(weight[t] for t in claims[a] & claims[b]), min(sum(weight[t] for t in claims[x]) for x in (a, b))
            if a < b and both / least >= 0.82:
                edges.append((a, b))
    df = spark.createDataFrame([(k, t, weight[t]) for k, own in claims.items() for t in own], "id long, term string, idf double")
    got = {r.id: r.cluster for r in G.claim_classes(df).collect()}
    assert got == joined(claims, edges) and 2 < len(set(got.values())) < 55
