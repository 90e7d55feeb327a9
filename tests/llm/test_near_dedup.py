import random

from loomspark.llm import minhash


def brute(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(find(k), []).append(i)
    return [(rows[k][0], len(sets[k]), min(names[find(k)])) for k in range(len(rows))]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = minhash.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_with_misses_and_cases(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d"), (8, "a b c d"), (9, "long " * 30_000)]
    for i in range(70):  # some near the base, some near each other only, some near none
        w = list(base)
        for _ in range(rng.choice((0, 1, 3, 5, 9, 14))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    common = " ".join(base[:12])
    for i in range(60):  # a passage in common, nothing else
        rows.append((300 + i, common + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(20))))
    check(spark, rows)


def test_empty(spark):
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
