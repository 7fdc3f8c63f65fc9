from loomstone.plans import registry


def test_markers_are_checked_once(spark, sf):
    """What uses the checked markers twice reads them from where they were written."""
    plan = registry.queries()["cite_extract"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
