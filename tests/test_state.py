"""Retries, stored vectors and state files."""

import time

from loomspark.operators import judge as J
from loomspark.operators import vectors as V
from loomspark.sources import scratch, settings
from loomspark.streaming import state as B


class Status(Exception):
    def __init__(self, status):
        self.status = status


def test_retryable_errors():
    assert all(map(J.retryable, [ConnectionError(), TimeoutError(), Status(503), ValueError("Rate limit: slow down"), OSError("SSL: EOF")]))
    assert not any(map(J.retryable, [Status(404), ValueError("bad key"), KeyError("x")]))
    assert [J.delay(k) for k in (1, 2, 3, 4)] == [2, 4, 8, 12]


def test_remote_retries_and_reports(spark):
    p = J.with_hash(spark.createDataFrame([("ok",), ("bad",)], "payload STRING")).coalesce(1)

    def ask(xs, seen=[]):
        seen.append(1)
        if len(seen) < 3:
            raise ConnectionError("connection error")
        return [x.upper() for x in xs]

    assert sorted(r["response"] for r in J.remote(p, ask, wait=lambda s: None).collect()) == ["BAD", "OK"]

    def never(xs):
        raise ValueError("no key")

    out = J.remote(p, never, wait=lambda s: None)
    assert {r["response"] for r in out.collect()} == {"API Error: no key"}
    assert J.verdicts(out).filter("valid").count() == 0


def test_top_k_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k % 5), k / 100]) for k in range(200)]
    v = spark.createDataFrame(rows, "vec_id LONG, v ARRAY<FLOAT>")
    q = v.filter("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "v AS q")
    tidy = lambda t: sorted(map(tuple, t.collect()))
    assert tidy(V.top_k(q, v, 3)) == tidy(V.top_k(q, v, 3, block_bytes=300)) and V.top_k(q.limit(0), v, 3).count() == 0
    assert V.top_k(q, v, 1, but_itself=True).filter("query_id = vec_id").count() == 0


def test_cleanup_and_settings(spark):
    path = scratch.folder(spark, "old")
    B.save(spark.createDataFrame([("b", "p", "pending", None, None, 1)], B.STATES), path)
    now = int(time.time() * 1000)
    assert B.cleanup(spark, path, now) == 0
    assert B.cleanup(spark, path, now + 8 * 86_400_000) >= 1 and B.load(spark, path + "-none").count() == 0
    assert settings.expand("${A:-x}/${B}/$A", {"A": "1"}) == "1//$A"
    assert settings.expand_shell("${A}/$B/$A/${C:-x}", {"A": "1"}) == "1/$B/1/${C:-x}"


def test_many_vectors_added(spark):
    n = 20_000  # more than the ranges' bounds are drawn from
    e = spark.range(n, numPartitions=3).selectExpr("id AS vec_id", "'n' || (id * 7919 % 20000) AS name", "transform(sequence(0, 15), k -> CAST(id * 16 + k AS FLOAT)) AS v")
    index, new = e.filter("vec_id % 10 = 0"), e.filter("vec_id % 10 != 0")
    got = {r["vec_id"]: (r["name"], r["v"]) for r in V.added(index, new.select("name", "v")).collect()}
    row = lambda k: (f"n{k * 7919 % n}", [float(16 * k + j) for j in range(16)])
    want = {k: row(k) for k in range(0, n, 10)} | dict(enumerate(sorted(row(k) for k in range(n) if k % 10), n - 9))
    assert got == want
    twice = V.added(V.empty(spark), new.select("name", "v").union(new.select("name", "v")))
    assert twice.count() == 36_000 and sorted(r["vec_id"] for r in twice.collect()) == list(range(36_000))
