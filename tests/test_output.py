"""The output guard by cases, and the assembly of prompts against a fold in Python."""

import math
import random

import pytest

from loomstone.operators import assemble as A
from loomstone.operators import output as O

SECRET = "the merger with the northern company closes in the second week of march as planned"
GOOD = "Travel is paid for by the day, as the document on travel says [1]."
ANSWERS = {
    1: (GOOD, "clerk", 1.0), 2: (GOOD, "clerk", 0.5), 3: (GOOD, "clerk", 0.1), 4: ("Mail jane.doe@example.com about it.", "clerk", 0.9), 5: ("Sorry, no.", "clerk", 0.0),
    6: ("Sorry, I have no information on that; the document on travel may help, or ask your manager.", "clerk", 0.0), 7: (GOOD, "outsider", 1.0), 8: (f"It is known that {SECRET}, they say.", "clerk", 1.0), 9: (None, "clerk", None), 10: (GOOD, "clerk", None),
    11: (f"{GOOD}\n\n{O.NOTICE}", "clerk", 0.4), 12: ("Nobody asked for sources.", "clerk", None), 13: ("Mail jane.doe@example.com, half known.", "clerk", 0.3),
}
WHO = {"clerk": ("t1", "u1", ["user"], ["g1"], 1), "outsider": ("t2", "u9", ["user"], [], 3)}


def sources():
    rows = [(a, 100, "Travel is paid for by the day.", True, "t1", 0, [], [], [], []) for a in ANSWERS if a != 12]
    rows += [(8, 101, "Minutes: " + SECRET + ".", False, "t1", 3, [], [], [], []), (1, 102, "Open to g1", True, "t1", 1, ["g1"], [], [], [])]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame([(k, t, *WHO[w], g) for k, (t, w, g) in ANSWERS.items()], "answer_id long, answer string, tenant string, user string, roles array<string>, groups array<string>, clearance int, groundedness double")
    s = spark.createDataFrame(sources(), "answer_id long, source_id long, text string, cited boolean, tenant_id string, classification_rank int, allowed_groups array<string>, allowed_roles array<string>, allowed_users array<string>, denied_users array<string>")
    return a, s


def test_actions(tables):
    got = {r.answer_id: r for r in O.output_guard(*tables).collect()}
    assert {k: (r.action, r.reasons) for k, r in got.items()} == {
        1: ("allow", []), 2: ("warn", ["groundedness:0.50"]), 3: ("block", ["groundedness:0.10"]), 4: ("redact", ["pii:EMAIL_ADDRESS"]), 5: ("allow", ["refusal:unhelpful"]), 6: ("allow", []),
        7: ("block", ["classification:chunk+citation"]), 8: ("block", ["classification:chunk+span"]), 9: ("block", ["groundedness:0.00"]), 10: ("block", ["groundedness:0.00"]), 11: ("warn", ["groundedness:0.40"]), 12: ("allow", []), 13: ("redact", ["pii:EMAIL_ADDRESS", "groundedness:0.30"]),
    }
    assert got[1].text == got[1].stored == GOOD and got[2].text == f"{GOOD}\n\n{O.NOTICE}" and got[11].text == ANSWERS[11][0]
    assert got[4].text == "Mail <EMAIL_ADDRESS> about it." and got[13].text.endswith(O.NOTICE) and "jane" not in got[13].stored
    assert {k: got[k].text for k in (3, 7, 8)} == {3: O.BLOCKED["groundedness"], 7: O.BLOCKED["clearance"], 8: O.BLOCKED["clearance"]}
    assert (got[7].lost_citations, got[8].lost_citations, got[1].lost_citations) == (1, 0, 0) and got[8].pii_types == []
    assert got[12].groundedness is None and got[5].groundedness is None and got[3].groundedness == 0.1


def test_switches(tables):
    got = {r.answer_id: r for r in O.output_guard(*tables, ignore=("EMAIL_ADDRESS",), enforce=False).collect()}
    assert got[4].action == "allow" and got[4].text == ANSWERS[4][0] and got[4].stored == "Mail <EMAIL_ADDRESS> about it."
    assert got[7].action == "allow" and got[7].reasons == ["classification:chunk+citation"] and got[7].lost_citations == 0
    got = {r.answer_id: r for r in O.output_guard(*tables, block_pii=True).collect()}
    assert got[4].action == "block" and got[4].text == O.BLOCKED["pii"] == got[4].stored


def slow(asked, turns, sources, memories, room):
    """One prompt at a time."""
    out = {}
    for grp, fixed, summary in asked:
        own = lambda rows: [r for r in rows if r[0] == grp]  # noqa: B023, E731
        kept, used = {}, fixed + (summary or 0)
        left = int(room * A.SOURCES)
        for density, i, n in sorted((-round(max(0.0, v or 0.0) / max(1, n), 9), i, n) for _, i, n, v in own(sources)):
            kept["source", i] = density < 0 and n <= left
            left -= n if kept["source", i] else 0
        total = 0
        for _, i, _, n in sorted(own(memories), key=lambda r: (r[2], r[1])):
            total += n
            kept["memory", i] = total <= int(room * A.MEMORIES)
        size = {("source", i): n for _, i, n, _ in own(sources)} | {("memory", i): n for _, i, _, n in own(memories)} | {("turn", i): n for _, i, n, _ in own(turns)}
        left = room - used - sum(size[k] for k, ok in kept.items() if ok)
        order = sorted(own(turns), key=lambda r: -r[1])
        must = {i for k, (_, i, _, p) in enumerate(order) if p or k < A.LIVE}
        left -= sum(size["turn", i] for i in must)
        for _, i, n, _ in order:
            kept["turn", i] = i in must or n <= left
            left -= n if kept["turn", i] and i not in must else 0
        if summary:
            kept["summary", 0], size["summary", 0] = True, summary
        need = fixed + sum(size[k] for k, ok in kept.items() if ok) - room
        value = {i: v or 0.0 for _, i, _, v in own(sources)}
        weak = sorted((i for k, i in kept if k == "source" and kept[k, i]), key=lambda i: (value[i], -i))
        pinned = {i for _, i, _, p in own(turns) if p}
        line = {i: p for _, i, p, _ in own(memories)}
        go = [("source", i) for i in weak[:-2]] + [("memory", i) for i in sorted((i for k, i in kept if k == "memory" and kept[k, i]), key=lambda i: (-line[i], i))] + [("source", i) for i in weak[-2:]]
        go += [("turn", i) for i in sorted(i for k, i in kept if k == "turn" and kept[k, i] and i not in pinned)] + [k for k in kept if k[0] == "summary"]
        for k in go:
            if need <= 0:
                break
            kept[k] = False
            need -= max(1, size[k])
        out[grp] = (fixed + sum(size[k] for k, ok in kept.items() if ok), {k for k, ok in kept.items() if ok})
    return out


def test_assembly(spark):
    rnd = random.Random(3)
    asked = [(g, rnd.choice((20, 60, 500)), rnd.choice((None, 0, 30))) for g in range(12)]
    turns = [(g, k, rnd.randint(1, 60), rnd.random() < 0.1) for g in range(12) for k in range(rnd.choice((0, 3, 15)))]
    sources = [(g, k, rnd.randint(1, 90), rnd.choice((None, -1.0, 0.2, 0.9, 0.5))) for g in range(12) for k in range(rnd.choice((0, 1, 12)))]
    memories = [(g, k, rnd.randint(0, 9), rnd.randint(1, 30)) for g in range(12) for k in range(rnd.choice((0, 6)))]
    out = A.assemble(spark.createDataFrame(asked, "grp long, fixed long, summary long"), spark.createDataFrame(turns, "grp long, id long, tokens long, pinned boolean"), spark.createDataFrame(sources, "grp long, id long, tokens long, value double"), spark.createDataFrame(memories, "grp long, id long, pos long, tokens long"), 500, 100)
    want = slow(asked, turns, sources, memories, 400)
    items, stats = out["items"].collect(), {r.grp: r for r in out["stats"].collect()}
    for g, (tokens, kept) in want.items():
        assert {(r.kind, r.id) for r in items if r.grp == g and r.dropped_reason is None} == kept, g
        assert stats[g].tokens == tokens and stats[g].turns == sum(k == "turn" for k, _ in kept)
    assert {r.dropped_reason for r in items} == {None, "budget", "no_value", "memory_budget", "history_budget", "shed"}
    assert all(r.tokens <= 400 or g in {g for g, f, _ in asked if f == 500} or any(p for gg, _, _, p in turns if gg == g) for g, r in stats.items())
    assert len(stats) == 12 and math.isclose(stats[0].utilisation, stats[0].tokens / 400, abs_tol=1e-6)


def test_queries(spark, sf):
    from loomstone.plans import registry

    g = registry.queries()["output_guard"](spark, sf).collect()
    assert {"allow", "block"} <= {r.action for r in g} and len({r.answer_id for r in g}) == len(g)
    a = registry.queries()["ctx_assemble"](spark, sf).collect()
    assert len({r.grp for r in a}) == len(a) and all(r.tokens <= 600 for r in a)
