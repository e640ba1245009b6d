import itertools
import random

import pytest

from voltide.llm import chat


def cheapest(roles):
    """Least cost by trying all labellings with all merge choices."""
    best = 10**9
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        base = sum(0 if a == b else chat.UNKNOWN if a == 0 else chat.RELABEL for a, b in zip(roles, labels))
        for merges in itertools.product((0, 1), repeat=len(roles)):
            state, cost = 0, base
            for t, m in zip(labels, merges):
                if m:
                    cost += chat.MERGE if state == t else 10**6
                else:
                    bridge = chat.BRIDGE[state, t]
                    cost += 10**6 if bridge is None else chat.INSERT * len(bridge)
                state = t
            best = min(best, cost + chat.INSERT * len(chat.CLOSE[state]))
    return best


def legal(names):
    body = names[1:] if names[:1] == ["system"] else names
    return body and len(body) % 2 == 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(body))


def outputs(rows):
    names = [r[3] for r in rows if r[4] not in ("merge", "relabel_merge")]
    return names, sum(r[5] for r in rows), "".join(r[6] for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_least_cost(n):
    names = {0: "x", 1: "system", 2: "user", 3: "assistant"}
    for roles in itertools.product(range(4), repeat=n) if n < 5 else random.Random(1).sample(list(itertools.product(range(4), repeat=5)), 60):
        turns = [(i, names[r], f"t{i}") for i, r in enumerate(roles)]
        got, cost, text = outputs(chat.rows_of(turns, 0, None, True, 0))
        assert legal(got) and cost == cheapest(roles)
        assert [x for x in text.replace("<|end|>", " ").split() if x[0] == "t"] == [t[2] for t in turns]
        for cut in range(1, n):
            a, b = list(roles[:cut]), list(roles[cut:])
            states = chat.boundary_states([chat.run_matrix(a), chat.run_matrix(b)])
            parts = chat.rows_of(turns[:cut], 0, states[1], False, 0) + chat.rows_of(turns[cut:], states[1], None, True, 9)
            assert outputs(parts)[1] == cost and legal(outputs(parts)[0])


def test_repair(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "Human", "tool", None]
    rows = [(conv if conv else None, turn, rng.choice(roles), f"w{conv}-{turn}", "x") for conv in range(20) for turn in range(rng.randrange(1, 9))]
    rows += [(99, turn // 3, "user", "same", "x") for turn in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Seq string").repartition(5)
    whole = {}
    for most in (512, 3):
        by = {}
        for r in sorted(chat.repair(df, most=most).collect(), key=lambda r: r.seq):
            by.setdefault(r.conv_id, []).append(r)
        assert set(by) == {r[0] for r in rows}
        for conv, got in by.items():
            names = [r.role_out for r in got if "merge" not in r.action]
            text = "".join(r.rendered for r in got)
            assert legal(names) and text.endswith("<|end|>\n") and text.count("<|end|>") == len(names)
            assert [r.turn for r in got if r.action != "insert"] == sorted(r[1] for r in rows if r[0] == conv)
            assert whole.setdefault(conv, sum(r.cost for r in got)) == sum(r.cost for r in got)
    assert chat.repair(df.limit(0)).count() == 0


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [r.action for r in out] == ["keep"] * 3
    assert "".join(r.rendered for r in out) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n<|end|>\n"
