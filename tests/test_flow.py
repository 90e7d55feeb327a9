"""Model answers as tables, and claims as a stream."""

from pyspark.sql import functions as F

from loomspark.operators import judge as J
from loomspark.streaming import ingest as S

CLAIM = "claim_ord LONG, subject STRING, relation STRING, object STRING, subject_id STRING, object_id STRING, claim_type STRING, evidence STRING, source_paper_id STRING, status STRING"


def test_decoding(spark):
    c = '{"subject": "a", "relation": "r", "object": "b"}'
    rows = [("fence", '```json\n{"ontology": [%s], "instances": [%s, 3]}\n```' % (c, c)), ("flat", '{"data": [%s]}' % c), ("list", "[%s]" % c), ("tail", "```[%s]" % c), ("bad", "no json"), ("none", None), ("empty", "{}"), ("wrong", '{"ontology": "x"}')]
    got = J.decoded_claims(spark.createDataFrame(rows, "prompt_hash STRING, response STRING")).filter("subject = 'a'").groupBy("prompt_hash").agg(F.array_sort(F.collect_list("claim_type")).alias("t"))
    assert {r["prompt_hash"]: r["t"] for r in got.collect()} == {"fence": ["instance", "ontology"], "flat": ["instance"], "list": ["instance"], "tail": ["instance"]}


def test_validation(spark):
    c = spark.createDataFrame([(1, "a b", "treats", "c d", "x", "y"), (2, "a b", "treats", "A B", "x", "z"), (3, "a b", "treats", "e f", "x", "x"), (4, "a b", "treats", "g h", "x", "w")], "claim_ord LONG, subject STRING, relation STRING, object STRING, subject_id STRING, object_id STRING")
    v = spark.createDataFrame([(1, '{"valid": true, "type": "support", "confidence": 1.5}'), (2, '{"valid": true}'), (4, "oops")], "claim_ord LONG, response STRING")
    out = lambda t: {r["claim_ord"]: (r["status"], r["validation_type"], r["confidence"]) for r in t.collect()}
    assert out(J.validated(c, v)) == {1: ("validated", "support", 1.0), 2: ("rejected", "same_entity", 0.0), 3: ("rejected", "self_loop", 0.0), 4: ("rejected", "format_error", 0.0)}
    assert out(J.validated(c))[4] == ("validated", "new", 1.0)


def test_providers(spark):
    p = J.with_hash(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "payload STRING"))
    answers = J.remote(p, lambda xs: [None if x is None else x.upper() for x in xs])
    assert sorted(str(r["response"]) for r in answers.collect()) == ["A", "B", "None"]
    assert sorted(str(r["response"]) for r in J.replay(p, answers.filter("response = 'A'")).collect()) == ["A", "None", "None"]


def test_stream_keeps_the_first_claim_once(spark, tmp_path):
    row = lambda n, o, status="validated": (n, "gene one", "treats", o, "s", o, "ontology", f"e{n}", "p", status)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    seen = []
    for rows in ([row(1, "b x"), row(2, "b x"), row(3, "c x", "rejected")], [row(4, "b x"), row(5, "d x")]):
        spark.createDataFrame(rows, CLAIM).coalesce(1).write.mode("append").parquet(src)
        q = S.claims_to_graph(spark.readStream.schema(CLAIM).parquet(src), out, ck)
        q.awaitTermination()
        assert q.exception() is None
        seen.append(sorted((r["dst"], r["evidence"]) for r in spark.read.parquet(f"{out}/edges").collect()))
    assert seen == [[("b x", "e1")], [("b x", "e1"), ("d x", "e5")]]


def test_stage_timings_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    s = S.stage_timings(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(src))
    q = s.writeStream.format("memory").queryName("timings").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {(r["start"], r["event_type"]): r["calls"] for r in spark.table("timings").collect()}
    want = S.stage_timings(spark.read.parquet(f"{src}/events.parquet"))
    assert got and got == {(r["start"], r["event_type"]): r["calls"] for r in want.collect()}


def test_workflow(spark):
    t = spark.createDataFrame([("a", 1, 5.0, None), ("a", 2, 8.0, None), ("b", 1, 5.0, None), ("c", 1, 1.0, None), ("c", 2, 1.0, None), ("c", 3, 1.0, None), ("d", 1, None, "x"), ("d", 2, None, "x"), ("d", 3, None, "x")], "paper_id STRING, attempt INT, score DOUBLE, error STRING")
    got = {r["paper_id"]: (r["status"], r["gate_passed"]) for r in S.workflow_state(t).collect()}
    assert got == {"a": ("completed", True), "b": ("retry", False), "c": ("completed", False), "d": ("failed", False)}
    assert [r["paper_id"] for r in S.pending(t.select("paper_id").distinct(), t.filter("paper_id != 'b'")).collect()] == ["b"]
    assert [r["batch_id"] for r in S.with_batches(spark.range(3).withColumnRenamed("id", "ord"), 2).orderBy("ord").collect()] == [0, 0, 1]
