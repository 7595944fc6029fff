"""Merged hints against the fold in arrival order."""

import random

from webplan.operators import quality as Q


def fold(hints):
    """hints in order: (source, event_name, confidence, note, parameters)."""
    state = None
    for h in hints:
        if state is None:
            state = h
            continue
        worth = lambda x: (x[2] or 0.0, Q.HINT_RANK.get(x[0], 0))
        win, lose = (state, h) if worth(state) >= worth(h) else (h, state)
        note = " | ".join(x for x in (win[3], lose[3]) if x)
        state = (win[0], win[1] if win[1] is not None else lose[1], win[2], note, win[4] or lose[4])
    return (state[0], state[1], state[2], state[3] or None, state[4] or None)


def test_merged_hints_equal_the_fold(spark):
    rng, rows, want = random.Random(6), [], {}
    for tag in range(300):
        hints = [(rng.choice([*Q.HINT_RANK, "other"]), rng.choice([None, "a", "b"]), rng.choice([None, 0.2, 0.5, 0.9]), rng.choice([None, "", "n1", "n2"]), rng.choice([None, [], ["p"], ["q", "r"]]))
                 for _ in range(1 if tag % 7 == 0 else rng.randrange(1, 12))]
        rows += [(1, tag, *h, k) for k, h in enumerate(hints)]
        want[tag] = fold(hints)
    hot = [("other", None, 0.1, None, None)] * 20000 + [("other", "late", 0.1, "x", ["p"])]
    rows += [(2, 0, *h, k) for k, h in enumerate(hot)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id int, tag_id int, source string, event_name string, confidence double, note string, parameters array<string>, seq int").repartition(7)
    got = {(r["page_id"], r["tag_id"]): (r["source"], r["event_name"], r["confidence"], r["note"], r["parameters"] or None) for r in Q.merge_hints(df).collect()}
    assert got.pop((2, 0)) == ("other", "late", 0.1, "x", ["p"])
    assert {k[1]: v for k, v in got.items()} == want
