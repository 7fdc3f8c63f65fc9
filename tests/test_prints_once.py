from loomstone.plans import registry


def test_fingerprints_are_made_once(spark, sf):
    plan = registry.queries()["dedupe_ingest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
