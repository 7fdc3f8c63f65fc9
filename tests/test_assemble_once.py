"""Turns are measured once for a prompt, and folds over small groups need no frame for each."""

from loomstone.operators import folds
from loomstone.plans import registry


def test_texts_are_not_read_again(spark, sf):
    plan = registry.queries()["ctx_assemble"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "FlatMapGroupsInPandas" not in plan


def test_groups_in_order(spark):
    rows = [(g, i, 40 if i % 2 else 30, float(i % 3)) for g in range(30) for i in range(g % 7)]
    df = spark.createDataFrame(rows, "grp long, id long, tokens long, density double").repartition(5)
    want = {}
    for g in range(30):
        left = 100
        for _, i, n, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            want[g, i] = None if n <= left else "budget"
            left -= n if n <= left else 0
    assert {(r.grp, r.id): r.dropped_reason for r in folds.pack_context(df, 100).collect()} == want
