"""Hostile answers give defined plans: against a reader in Python, field by field."""

import json
import random
import re
from datetime import UTC, datetime, timedelta

import pytest

from loomstone.operators import planning as P

WORDS = P.Vocabulary(("faq", "policy"), ("web",))
HOSTILE = [
    None, "", "null", "[]", "5", '"text"', "{", "{}", '{"rewritten": null}', '{"rewritten": {"a": 1}, "sub_questions": "x", "confidence": "high"}', '{"a":' * 50 + "1" + "}" * 50, '{"rewritten": "\\ud800"}',
    '{"sub_questions": {"0": "a"}, "tool_hints": [[["x"]]], "needs_tools": "maybe", "needs_retrieval": 0}', '{"confidence": 1e400}', '{"confidence": -3}', '{"rewritten": "' + "x" * 100_000 + '"}', '{"rewritten": "a"} trailing', "<script>", "\x00", '{"rewritten": "a", "rewritten": "b"}',
]


def strip(x):
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x)


def texts(o, k):
    out, seen = [], set()
    for x in o.get(k) if isinstance(o.get(k), list) else []:
        if isinstance(x, (dict, list)) or x is None:
            continue
        x = strip(x if isinstance(x, str) else json.dumps(x))
        if x and x.lower() not in seen:
            seen.add(x.lower())
            out.append(x)
    return out


def day(x, end):
    for pattern, span in (("%Y", "y"), ("%Y-%m", "m"), ("%Y-%m-%d", None), ("%Y/%m/%d", "d"), ("%Y-%m-%dT%H:%M:%S", None)):
        try:
            at = datetime.strptime(x, pattern).replace(tzinfo=UTC)
        except ValueError:
            continue
        if not re.fullmatch({"%Y": r"\d{4}", "%Y-%m": r"\d{4}-\d\d", "%Y-%m-%d": r"\d{4}-\d\d-\d\d", "%Y/%m/%d": r"\d{4}/\d\d/\d\d"}.get(pattern, ".*"), x):
            continue
        if end and span == "y":
            return at.replace(year=at.year + 1) - timedelta(seconds=1)
        if end and span == "m":
            return (at + timedelta(days=31)).replace(day=1)
        return at + timedelta(days=1, seconds=-1) if end and span == "d" else at
    return None


def slow(message, o):
    """The plan of an answer that is an object."""
    text = lambda k: strip(o[k]) if isinstance(o.get(k), str) else ""
    rewritten = text("rewritten") or strip(message)
    low, high = day(text("filter_date_from"), False), day(text("filter_date_to"), True)
    if low and high and low > high:
        low = high = None
    c = o.get("confidence")
    c = float(c) if isinstance(c, (int, float)) and not isinstance(c, bool) else 0.0
    return {
        "rewritten": rewritten, "sub_questions": [x for x in texts(o, "sub_questions") if x.lower() != rewritten.lower()][:3], "tool_hints": texts(o, "tool_hints")[:4], "intent": text("intent")[:200],
        "doc_types": [x.lower() for x in texts(o, "filter_doc_types") if x.lower() in WORDS.doc_types], "tags": texts(o, "filter_tags"), "section": text("filter_section"), "confidence": min(1.0, max(0.0, c)),
        "needs_tools": o["needs_tools"] if isinstance(o.get("needs_tools"), bool) else False, "date_from": low and low.timestamp(), "date_to": high and high.timestamp(),
    }


def value(rnd, depth=2):
    kind = rnd.randrange(9)
    if kind < 4:
        return rnd.choice(["", " a ", "A", "faq", " Policy", "what", "ä\n", 'q"uote', "2024", "2024-02", "2024-02-30", "2024/02/03", "2024-02-03", "2024-02-03T04:05:06", "20245", "1999"])
    if kind == 4:
        return rnd.choice([3, -1, 0.25, 7.5])
    if kind == 5:
        return rnd.choice([True, False, None])
    if depth == 0:
        return None
    return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 6))] if kind < 8 else {"x": value(rnd, depth - 1)}


FIELDS = ["rewritten", "sub_questions", "tool_hints", "intent", "filter_doc_types", "filter_tags", "filter_section", "filter_date_from", "filter_date_to", "confidence", "needs_tools", "other"]


def test_random_answers(spark):
    rnd = random.Random(5)
    made = [{f: value(rnd) for f in rnd.sample(FIELDS, rnd.randint(0, 10))} for _ in range(300)]
    for o in made:
        if isinstance(o.get("confidence"), str) or isinstance(o.get("needs_tools"), (str, int, float)) and not isinstance(o.get("needs_tools"), bool):
            del o["confidence" if isinstance(o.get("confidence"), str) else "needs_tools"]
        if isinstance(o.get("needs_tools"), (str, int, float)) and not isinstance(o["needs_tools"], bool):
            del o["needs_tools"]
        if isinstance(o.get("confidence"), bool):
            del o["confidence"]
    df = spark.createDataFrame([(k, " Message ", json.dumps(o)) for k, o in enumerate(made)], "id long, message string, payload string")
    got = {r.id: r.asDict() for r in P.plan(df, vocabulary=WORDS, keep=("id",)).collect()}
    for k, o in enumerate(made):
        want = slow(" Message ", o)
        mine = {f: got[k][f] for f in want}
        for f in ("date_from", "date_to"):
            mine[f] = mine[f] and mine[f].replace(tzinfo=UTC).timestamp()
        assert mine == want, o


def test_hostile_answers(spark):
    df = spark.createDataFrame([(k, " What? ", p) for k, p in enumerate(HOSTILE)], "id long, message string, payload string")
    got = {HOSTILE[r.id]: r for r in P.plan(df, vocabulary=WORDS, keep=("id",)).collect()}
    assert len(got) == len(HOSTILE)
    for p in (None, "", "null", "[]", "5", '"text"', "{", "<script>", "\x00"):
        assert got[p].degraded and got[p].rewritten == "What?" and got[p].needs_retrieval, p
    for r in got.values():
        assert 0 <= r.confidence <= 1 and len(r.sub_questions) <= 3 and len(r.tool_hints) <= 4 and r.needs_tools is False
    assert got['{"rewritten": "a"} trailing'].rewritten == "a"
    assert not got["{}"].degraded and got["{}"].rewritten == "What?"
    assert len(got[HOSTILE[15]].rewritten) == 100_000


@pytest.mark.parametrize(("message", "retrieve"), [(None, False), ("  ", False), ("x", True)])
def test_without_an_answer(spark, message, retrieve):
    r = P.plan(spark.createDataFrame([(message, None)], "message string, payload string")).first()
    assert r.degraded and r.needs_retrieval is retrieve and r.rewritten == (message or "").strip()
