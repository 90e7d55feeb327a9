"""Predicate forms, Turtle counts, seeded samples and taxonomy rounds on small rows."""

from pyspark.sql import functions as F

from loomspark.functions import predicates as R
from loomspark.operators import reports as P
from loomspark.operators import taxonomy as T
from loomspark.sources import turtle as U


def test_forms(spark):
    table = {"a_form": ("One", "two"), "b_form": ("two", "three_long")}
    rows = [(" ONE ", "a_form"), ("two", "b_form"), ("long", "b_form"), ("xtwox", "b_form"), ("", "unknown"), (None, "unknown"), ("　", "unknown"), ("zzz", "unknown"), ("one two", "a_form")]
    t = spark.createDataFrame(rows, "predicate STRING, want STRING").withColumn("got", R.standard_predicate(F.col("predicate"), table))
    assert [(r["predicate"], r["got"]) for r in t.collect()] == rows
    assert [r["predicate"] for r in P.unknown_predicates(t.filter("predicate is not null"), table).collect()] == ["", "zzz", "　"]
    assert P.predicate_changes(t, table).first().asDict() == {"total": 9, "unknown": 4, "unchanged": 0, "normalized": 5}
    assert P.predicate_changes(t.limit(0), table).first().asDict() == {"total": 0, "unknown": 0, "unchanged": 0, "normalized": 0}


def test_turtle_counts(spark):
    text = "outside .\n```turtle\n# c .\n:A rdf:type :Model ;\n:A a :X .\n:B a :X\n```\n# ===== SECTION: out =====\n  ```turtle  \n:C :p :D ;\n :sourceSection \"s\" ;\n# ===== SECTION: in =====\n```\n"
    t = spark.createDataFrame([("f", text), ("e", ""), ("n", None)], "path STRING, text STRING")
    assert {tuple(r) for r in U.turtle_counts(t).collect()} == {("f", 4, 2, 2), ("e", 0, 0, 0), ("n", 0, 0, 0)}
    got = {r["path"]: r.asDict() for r in U.extraction_counts(t).collect()}
    want = lambda x: (x.count(" ;") + x.count(" .") - x.count("# "), x.count("rdf:type :Model"))
    assert (got["f"]["total_triples"], got["f"]["n_model"]) == want(text) and got["f"]["sections_covered"] == 1
    assert got["n"]["total_triples"] == 0


def test_samples(spark):
    t = spark.range(1000).withColumn("g", F.col("id") % 7)
    ids = lambda x: sorted(r["id"] for r in x.collect())
    for n in (0, 1, 10, 999, 1000, 2000):
        assert len(ids(P.sample(t, "id", 3, n=n))) == min(n, 1000)
    assert ids(P.sample(t, "id", 3, n=10)) == ids(P.sample(t.repartition(5), "id", 3, n=10)) != ids(P.sample(t, "id", 4, n=10))
    assert len(ids(P.sample(t, "id", 3, share=0.015))) == 15 and len(ids(P.sample(t, "id", 3, share=0.0))) == 1
    assert ids(P.sample(t.limit(0), "id", 3, share=0.5)) == []
    each = P.sample_each(t, "g", "id", 1, 5)
    assert {r["count"] for r in each.groupBy("g").count().collect()} == {5}


def test_round(spark):
    c = spark.createDataFrame([("New Field", "candidate"), ("old  field", "candidate"), ("done", "merged")], "name STRING, status STRING")
    s = spark.createDataFrame([("Target", "Top", "confirmed", 1), ("Top", None, "confirmed", 1)], "name STRING, parent STRING, status STRING, taxonomy_version INT")
    g = spark.createDataFrame([("p1", "new field"), ("p2", "Old Field."), ("p3", "done"), ("p4", None)], "paper_id STRING, candidate STRING")
    d = spark.createDataFrame([("New Field", "promote", "New Field", "Fresh"), ("Old Field", "merge", "target", "x"), ("Done", "promote", "Done", "Top")], "candidate STRING, action STRING, target_subdomain STRING, parent_domain STRING")
    out = {k: {tuple(r) for r in v.collect()} for k, v in T.apply_round(c, s, g, d, 2).items()}
    assert out["candidates"] == {("New Field", "promoted"), ("old  field", "merged"), ("done", "merged")}
    assert out["subdomains"] == {("target", "Top", "confirmed", 2), ("Top", None, "confirmed", 1), ("New Field", "Fresh", "confirmed", 2), ("Fresh", None, "confirmed", 2)}
    assert out["links"] == {("new field", "PROMOTED_TO", "New Field"), ("old field", "MERGED_INTO", "target")}
    assert out["papers"] == {("p1", "New Field", "Fresh"), ("p2", "target", "Top")}


def test_report(spark):
    t = spark.range(30).withColumn("v", F.lit(0.5))
    text = P.run_report(t, t, t, t, top=3)
    assert text.count("\n- ") == 12 and "- id: 0, v: 0.5" in text
