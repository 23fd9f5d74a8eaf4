"""Scores at the border of a tier."""

from itertools import permutations

from tracewell.operators import routing as R


def test_a_tier_does_not_depend_on_the_order_of_its_points(spark):
    """0.35 and the points 0.175, 0.15 and 0.125 are 0.8 or a bit less, by the order in which they are added."""
    orders = list(permutations([0.5, 0.6, 0.7]))
    table = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    state = table([("s", f"x/{i}.ts", 0.5, 0) for i in range(len(orders))], "session string, path string, score double, streak long")
    act = table([("s", p, 1.0) for p in "abc"], "session string, path string, relevance double")
    changed = table([(p, f"x/{i}.ts", s) for i, o in enumerate(orders) for p, s in zip("abc", o, strict=True)], "src string, dst string, strength double")
    none, nowhere = table([], "src string, dst string"), table([], "path string")
    got = R.attention_turn(state, act, none, none, changed, nowhere, nowhere).where("path LIKE 'x/%'").collect()
    assert len(got) == len(orders)
    assert {(r["score"], r["streak"], r["tier"]) for r in got} == {(0.8, 1, "WARM")}
