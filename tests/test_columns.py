import random

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import parsing, pii


def test_checks_as_row_by_row(spark):
    rnd = random.Random(4)
    values = ["GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "GB82 WEST 1234 5698 7654 33", "DE89370400440532013000", "", None, "2363", "236-3", "2364", "x", "123456789012", "9" * 40]
    values += ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 20))) for _ in range(150)] + [f"FR{k:02d}20041010050500013M02606" for k in range(97)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.iban_ok("v").alias("i"), T.verhoeff_ok("v").alias("c")).collect()
    assert all(r.i == pii.iban(r.v or "") for r in got) and sum(r.i for r in got) >= 4
    assert all(r.c == pii.verhoeff(r.v or "") for r in got) and sum(r.c for r in got) > 10


def test_tables(spark):
    cases = [[["a", "b"], ["1 ", " x|y\nz"], ["", " "], ["only"]], [[" "]], [["h"], ["1", "2", "3"]]]
    got = spark.createDataFrame([(c,) for c in cases], "rows array<array<string>>").select(T.pipe_table(F.col("rows")).alias("t")).collect()
    assert [r.t for r in got] == [parsing.table(c) for c in cases]


def test_access_lists_from_outside(spark):
    """Groups as maps, files and permission objects declare them; what cannot be read declares nothing."""
    from pyspark.sql import functions as F

    from loomstone.operators import access as A

    rows = [(1, {"groups": "a, b;a"}, '{"allowed_groups": ["x", "x"]}', '[{"group":"g"},{"user":"9"},{}]'), (2, {"acl_groups": "[\"c\"]", "groups": " "}, "not json", '[{"group":"g","scope":"organization"}]'), (3, {}, None, "[]"), (4, None, "{}", "nonsense")]
    df = spark.createDataFrame(rows, "id long, m map<string,string>, side string, perms string")
    got = {r.id: r for r in df.select("id", A.from_map(F.col("m")).alias("m"), A.from_sidecar(F.col("side")).alias("side"), A.from_permissions(F.col("perms")).alias("perms"), A.resolved(A.from_sidecar(F.col("side")), A.from_map(F.col("m")), default=("all",)).alias("groups")).collect()}
    assert [got[k].m for k in (1, 2, 3, 4)] == [["a", "b"], [], None, None]
    assert [got[k].side for k in (1, 2, 3, 4)] == [["x"], None, None, None]
    assert [got[k].perms for k in (1, 2, 3)] == [["g"], [], []]
    assert [got[k].groups for k in (1, 2, 3, 4)] == [["x"], ["all"], ["all"], ["all"]]


def test_equal_filters_have_equal_fingerprints(spark):
    from pyspark.sql import functions as F

    from loomstone.operators import access as A

    fp = lambda **kw: spark.range(1).select(A.filter_fingerprint(A.Facets(**kw), F.lit("t"), F.lit(1))).first()[0]
    assert fp(doc_types=("a", "b")) == fp(doc_types=("b", "a")) != fp(doc_types=("a",))
    assert len({fp(), fp(nothing=True), fp(max_rank=1), fp(modified_from=1), fp(modified_to=1), fp(langs=("a",)), fp(document_ids=(1,))}) == 7
