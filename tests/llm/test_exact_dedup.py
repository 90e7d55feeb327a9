import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import exact_dedup as m


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), 2**63 if i is None else i, k))
    out = {}
    for g in groups.values():
        best = min(g)
        for _, _, k in g:
            out[k] = (rows[best[2]][0], len(g))
    return sorted(str((rows[k][0], *out[k])) for k in out)


def check(spark, rows, parts=3, **limits):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, rep string, kind int").repartition(parts)
    got = m.exact_dedup(docs, **limits).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "a b"), (None, "ab"), (2, "ab"), (10, "É")]
    check(spark, rows)


def test_spill_and_hot_group(spark):
    rows = [(i, "same text " * 50) for i in range(300)] + [(1000 + i, f"text {i % 150} " * 40) for i in range(400)]
    check(spark, rows, table_bytes=4000, max_members=7)
    check(spark, rows + [(None, " same" + " text same" * 49 + " text")] * 3, parts=9, table_bytes=4000, max_members=7, hot=3)  # heads are folded


def test_empty(spark):
    assert m.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.binary(max_size=3))))
def test_table_is_exact_under_colliding_hashes(items):
    t, seen = m.ContentTable(2), {}
    for h, c in items:
        e, new = t.find(h, c)
        assert new == ((h, c) not in seen)
        assert seen.setdefault((h, c), e) == e
