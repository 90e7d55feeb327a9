"""Paths of the graph operators."""

from itertools import product

from loomspark.operators import graph


def test_three_hop_paths_skip_starts_that_only_lead_back(spark):
    steps = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "B"), ("C", "C"), ("D", "B"), ("E", "F"), ("F", "G"), ("G", "H"), ("G", "E"), ("I", "J"), ("J", "K"), ("J", "I"), ("K", "I"), ("K", "J"), ("K", "L"), ("I", "I"), (None, "B"), ("C", None)]
    first = spark.createDataFrame([("s", *x) for x in steps] + [("t", "A", "B"), ("t", "E", "F")], "section string, n0 string, n1 string")
    second, third = (spark.createDataFrame(steps, f"{a} string, {b} string") for a, b in (("n1", "n2"), ("n2", "n3")))
    for limit in (1, 2, 3, 100):
        want = set()
        for section, some in (("s", steps), ("t", [("A", "B"), ("E", "F")])):
            paths = {(a, b, c, d) for (a, b), (x, c), (y, d) in product(some, steps, steps) if b == x and c == y and None not in (a, b, c, d) and d not in (a, b, c)}
            want |= {(section, *p, k) for k, p in enumerate(sorted(paths)[:limit], 1)}
        got = graph.three_hop_paths(first, second, third, limit).select("section", "n0", "n1", "n2", "n3", "path_rank").collect()
        assert {tuple(r) for r in got} == want
