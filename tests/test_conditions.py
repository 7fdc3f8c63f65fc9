"""Random condition trees against a row interpreter, and what of them reaches the scan."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomstone.operators import conditions as C

SCHEMA = "doc_id long, lang string, n long, score double, ok boolean, tags array<string>, at timestamp"


def table():
    rnd = random.Random(6)
    at = lambda d: datetime(2025, 1, d, tzinfo=UTC)
    pick = lambda *x: rnd.choice([None, *x])
    return [(k, pick("en", "de", "", "fr"), pick(1, 2, 3), pick(0.5, 1.0, float("nan"), 2.0), pick(True, False), pick([], ["a"], ["a", None, "b"], [None]), pick(at(1), at(5), at(9))) for k in range(120)]


def holds(tree, row):
    """The rule, row by row."""
    if not set(tree) - C.GROUP:
        return all(holds(x, row) for x in tree.get("must") or ()) and not any(holds(x, row) for x in tree.get("must_not") or ()) and (not tree.get("should") or any(holds(x, row) for x in tree["should"]))
    if "has_id" in tree:
        return any(row["doc_id"] == x and not isinstance(x, bool) for x in tree["has_id"])
    if "is_empty" in tree:
        return row[tree["is_empty"]] in (None, [], "")
    value = row[tree["key"]]
    if "match" in tree:
        (how, what), = tree["match"].items()
        values = [x for x in (value if isinstance(value, list) else [value]) if x is not None]
        asked = [what] if how == "value" else what
        same = any(type(a) is type(b) and a == b or {type(a), type(b)} == {int, float} and a == b for a in values for b in asked)
        return not same if how == "except" else same
    if value is None or isinstance(value, (list, str, bool)) or value != value:
        return False
    r = {k: v for k, v in tree["range"].items() if v is not None}
    if any(isinstance(v, datetime) != isinstance(value, datetime) or isinstance(v, (str, bool)) for v in r.values()):
        return False
    return all({"gte": value >= v, "gt": value > v, "lte": value <= v, "lt": value < v}[k] for k, v in r.items())


def tree(rnd, depth=3):
    if depth and rnd.random() < 0.6:
        return {k: [tree(rnd, depth - 1) for _ in range(rnd.randint(0, 3))] for k in rnd.sample(sorted(C.GROUP), rnd.randint(0, 3))}
    key, day = rnd.choice(["lang", "n", "score", "ok", "tags", "at"]), datetime(2025, 1, rnd.choice((1, 5, 7)), tzinfo=UTC)
    value = lambda: rnd.choice(["en", "", "a", "b", 1, 2, 2.0, True, day])
    return rnd.choice([
        {"key": key, "match": {"value": value()}}, {"key": key, "match": {"any": [value() for _ in range(rnd.randint(0, 3))]}}, {"key": key, "match": {"except": [value() for _ in range(rnd.randint(0, 3))]}},
        {"key": key, "range": {k: rnd.choice([1, 2.5, day, None]) for k in rnd.sample(sorted(C.BOUNDS), rnd.randint(0, 2))}}, {"is_empty": key}, {"has_id": [rnd.randrange(130) for _ in range(3)]},
    ])


def test_random_trees(spark):
    df = spark.createDataFrame(table(), SCHEMA).cache()
    rows = [dict(zip(df.columns, r, strict=True)) for r in table()]
    rnd, compiler, sizes = random.Random(9), C.Compiler(df.schema), set()
    trees = [tree(rnd) for _ in range(160)]
    for k in range(0, len(trees), 40):
        some = trees[k : k + 40]
        got = df.select("doc_id", *(F.coalesce(compiler.compile(t), F.lit(False)).alias(f"t{n}") for n, t in enumerate(some))).collect()
        for n, t in enumerate(some):
            want = {r["doc_id"] for r in rows if holds(t, r)}
            assert {r.doc_id for r in got if r[f"t{n}"]} == want, t
            sizes.add(len(want))
    assert len(sizes) > 20
    for t in trees[:10]:
        assert {r.doc_id for r in C.matching(df, t).collect()} == {r["doc_id"] for r in rows if holds(t, r)}


def test_what_reaches_the_scan(spark, sf, capsys):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = {"must": [{"key": "lang", "match": {"value": "en"}}, {"key": "n_chars", "range": {"gte": 100}}], "must_not": [{"key": "source", "match": {"any": ["src1", "src2"]}}], "should": [{"has_id": [1, 2, 3, 7]}, {"key": "n_chars", "range": {"gt": 500}}]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    C.matching(d, t).select("doc_id").explain()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :]
    for x in ("EqualTo(lang,en)", "GreaterThanOrEqual(n_chars,100)", "Or(IsNull(source),Not(In(source, [src1,src2])))", "Or(In(doc_id, [1,2,3,7])"):
        assert x.replace(" ", "") in pushed.replace(" ", "")


@pytest.mark.parametrize("bad", [{"key": "none", "match": {"value": 1}}, {"near": 1}, {"key": "lang", "match": {"like": "e"}}, {"key": "n", "range": {"over": 1}}, {"must": ["x"]}, {"has_id": "12"}, {"key": "lang", "match": {"any": "en"}}, {"key": "lang", "match": {}}, 5])
def test_what_is_not_known_is_an_error(spark, bad):
    with pytest.raises(C.ConditionError):
        C.Compiler(spark.createDataFrame([], SCHEMA).schema).compile(bad)


def test_arguments():
    base = {"must": [{"key": "lang", "match": {"value": "en"}}]}
    assert C.from_arguments({}) is None and C.from_arguments({"doc_types": [], "tags": "x", "date_from": "soon", "other": [1]}) is None
    assert C.from_arguments({}, base=base) == {"must": [base]}
    got = C.from_arguments({"doc_types": ["faq", 3], "date_to": "2025-01-02Z", "date_from": "2025-01-01", "section_prefix": "A"}, base=base)
    assert got["must"][0] == base and got["must"][1] == {"key": "doc_type", "match": {"any": ["faq", "3"]}} and got["must"][2] == {"key": "section", "match": {"value": "A"}}
    assert got["must"][3]["range"]["gte"] == datetime(2025, 1, 1, tzinfo=UTC)
