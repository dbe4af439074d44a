from voxelloom.llm import preferences as P

from tests.llm import helpers as H

TURNS = "pair_id long, turn long, role string, text string"


def brute(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1

    def side(turns):
        body, mask = "", []
        for role, text in turns:
            start = len(body) + len(f"<|{role}|>\n")
            body += f"<|{role}|>\n{text}<|end|>\n"
            if role == "assistant":
                mask.append(f"{start}:{len(body)}")
        return body, ",".join(mask)

    prompt, (c, cm), (r, rm) = side(chosen[:k])[0], side(chosen[k:]), side(rejected[k:])
    return k, prompt, c, r, cm, rm


CASES = {
    1: ([("user", "hi"), ("assistant", "yes é")], [("user", "hi"), ("assistant", "no")]),
    2: ([("user", "hi")], [("user", "hi")]),
    3: ([("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r")], [("system", "s"), ("user", "q"), ("assistant", "a")]),
    4: ([("user", "x")], [("assistant", "x")]),
    5: ([], [("assistant", "only one side")]),
    6: ([("user", "")], []),
    7: ([("assistant", "a" * 200_000)], [("assistant", "a" * 199_999)]),
}


def long(spark, side):
    return spark.createDataFrame([(p, n, r, t) for p, both in CASES.items() for n, (r, t) in enumerate(both[side])], TURNS)


def test_pairs_match_brute_force(spark):
    got = P.format_preferences(long(spark, 0), long(spark, 1)).collect()
    assert {r["pair_id"] for r in got} == set(CASES)
    for r in got:
        assert tuple(r)[1:] == brute(*CASES[r["pair_id"]])


def test_masks_mark_assistant_texts(spark):
    r = P.format_preferences(long(spark, 0).where("pair_id = 1"), long(spark, 1).where("pair_id = 1")).first()
    start, end = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][start:end] == "yes é<|end|>\n"


def test_nulls_repeats_and_clashing_names(spark):
    chosen = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a")], TURNS).selectExpr("*", "1 AS prompt", "2 AS turns", "3 AS is_chosen")
    got = {r["pair_id"]: r for r in P.format_preferences(chosen, chosen.limit(0)).collect()}
    assert got[None]["chosen"] == "<|user|>\n<|end|>\n"
    assert got[1]["chosen"] == "".join(f"<|user|>\n{t}<|end|>\n" for t in "abb")
    assert P.format_preferences(chosen.limit(0), chosen.limit(0)).count() == 0


def test_last_reply_pairs(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (3, 0, "user", "u3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: ([tuple(x) for x in r["chosen"]], [tuple(x) for x in r["rejected"]]) for r in P.last_reply_pairs(df).collect()}
    assert got[0] == ([("user", "q0"), ("assistant", "a0"), ("user", "more")], [("user", "q0"), ("assistant", "a1")])
    assert got[1] == ([("user", "q1"), ("assistant", "a1")], [("user", "q1"), ("assistant", "a0")])
    assert got[2] == ([("user", "alone")], [("user", "alone")])


def test_native_plan(spark):
    plan = P.format_preferences(long(spark, 0), long(spark, 1))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert H.rows(P.format_preferences(long(spark, 0), long(spark, 1)), "pair_id") == [(k,) for k in sorted(CASES)]
