"""Readers on small hand-written files."""

import json

import pytest

from loomspark.sources import papers as P
from loomspark.sources import turtle as T
from loomspark.sources import writers as W

TTL = """# head
:Early :is :Lost ;
# ===== SECTION: Results_2 (CHUNK 3) =====
```turtle
:Gene-A :activates :Protein_B ;
    :sourceChunk "7" ;
    :sourceSection "Findings" ;
    :contextText "A activates B" .
:Gene-A rdf:type :Gene ;
    :contextText "A is a gene" .
    :contextText "stray" .
:X :says "literal" ;
:Y :open :Z ;
```
# ===== SECTION: Methods =====
:P :uses :Q ;
  :contextText "P uses Q" .
"""
GOLD = """# note
:MultiHead :hasPart :SubLayer ;
    :trainedOn "WMT data" ;
    :contextText "x" .
:Other :contextText "y" .
"""


@pytest.fixture
def folder(tmp_path):
    listed = [{"id": "title", "text": " A Title "}, {"id": "abstract", "text": "Short."}, None, "loose", 3, {"id": "s1", "metadata": {"section_title": "Results"}, "text": "Found."}]
    mapped = {"title": " ", "metadata": {"paper_title": "Named", "year": 2020}, "keywords": "a; b|c", "authors": ["X", "Y"], "sections": []}
    (tmp_path / "p1.json").write_text(json.dumps(listed))
    (tmp_path / "p2.json").write_text(json.dumps(mapped))
    (tmp_path / "p3.json").write_text("{broken")
    (tmp_path / "p4.json").write_text("")
    return str(tmp_path)


def test_papers(spark, folder):
    got = {r["id"]: r for r in P.read_papers(spark, folder).collect()}
    assert sorted(got) == ["p1", "p2"]
    assert got["p1"]["title"] == "A Title" and got["p1"]["abstract"] == "Short." and got["p1"]["section_count"] == 3
    assert got["p1"]["content"].endswith("## Results\n\nFound.")
    assert got["p2"]["title"] == got["p2"]["content"] == "Named" and got["p2"]["keywords"] == ["a", "b", "c"]
    assert got["p2"]["authors"] == ["X", "Y"] and got["p2"]["year"] == "2020"
    assert [r["id"] for r in P.read_papers(spark, folder, ["p2.json"]).collect()] == ["p2"]
    assert P.unreadable(T.files(spark, f"{folder}/*.json")).count() == 1  # a file of no bytes is no row


def test_chunks_and_markers(spark, folder):
    c = P.chunks(T.files(spark, f"{folder}/p1.json"))
    assert [r["section_id"] for r in c.orderBy("chunk_index").collect()] == ["title", "abstract", "s1"]
    back = P.from_markers(P.marked(c)).orderBy("chunk_id").collect()
    assert [(r["name"], r["chunk_id"], r["content"]) for r in back] == [("title", 1, "A Title"), ("abstract", 2, "Short."), ("s1", 3, "Found.")]


def test_extraction_turtle(spark):
    rows = T.extraction_triples(spark.createDataFrame([("f", TTL), ("g", None), ("h", "")], "path STRING, text STRING")).orderBy("ord").collect()
    assert [tuple(r)[1:3] + tuple(r)[4:] for r in rows] == [
        ("Findings", "7", "Gene-A", "activates", "Protein_B", "A activates B"),
        ("Results", "", "Gene-A", "type", "Gene", "A is a gene"),
        ("Methods", "", "P", "uses", "Q", "P uses Q"),
    ]


def test_gold_turtle(spark):
    rows = T.gold_triples(spark.createDataFrame([("f", GOLD), ("g", None)], "path STRING, text STRING")).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [("Multi Head", "has Part", "Sub Layer"), ("Multi Head", "trained On", "WMT data")]


def test_turtle_round_trip(spark):
    t = spark.createDataFrame([("S", "1", "a", "uses", "b", 'say "x"')], "section STRING, chunk STRING, subject STRING, predicate STRING, object STRING, context STRING")
    text = "# ===== SECTION: S =====\n" + T.turtle_lines(t).first()["value"]
    r = T.extraction_triples(spark.createDataFrame([("f", text)], "path STRING, text STRING")).first()
    assert (r["subject"], r["predicate"], r["object"], r["chunk"], r["context"]) == ("A", "uses", "B", "1", "say 'x'")


def test_relation_rows(spark):
    rows = [("关系", "A | b | C", "p", "位置: Intro / chunk 4 | 证据: seen"), ("关系", "A|b", "p", ""), ("实体", "A|b|C", "p", None), ("关系", "A|b|C", "p", None)]
    got = P.relation_rows(spark.createDataFrame(rows, "`类型` STRING, `名称` STRING, `出处` STRING, `片段` STRING")).collect()
    assert [tuple(r) for r in got] == [("A", "b", "C", "Intro", "4", "seen"), ("A", "b", "C", "Unknown", "0", "")]


def test_run_log(spark):
    log = ">>> [2] Paper Summary:\n - Claims extracted: 9\n - Claims grounded: 8\n - Claims validated: 7\n - Claims written: 6\n[x] ✓ Written: A -[R]-> " + "b" * 50 + "\nFinal Graph Statistics\n==\nStats: 5 nodes, 4 relationships\n"
    t = P.run_log(spark.createDataFrame([("f", log), ("g", None)], "path STRING, text STRING"))
    assert tuple(t["papers"].first())[1:] == (2, 9, 8, 7, 6)
    assert t["written"].first()["object"] == "b" * 40
    assert tuple(t["graph"].first())[1:] == (5, 4) and t["totals"].count() == 0


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "It's", ["Entity"], None), ("a", "A", ["Entity", "Concept"], True)], "id STRING, name STRING, labels ARRAY<STRING>, is_concept BOOLEAN")
    edges = spark.createDataFrame([("a", "b", "TREATS", False, "e" * 600)], "src STRING, dst STRING, rel_type STRING, is_ontology BOOLEAN, evidence STRING")
    assert [r["labels"] for r in W.node_rows(nodes).collect()] == ["Entity;Concept", "Entity"]
    assert len(W.edge_rows(edges, nodes).first()["evidence"]) == 503
    text = [r["value"] for r in W.cypher_lines(nodes, edges).collect()]
    assert "CREATE (:Entity {id: 'b', name: 'It\\'s'});" in text and len(text) == 3
    W.write_csv(W.node_rows(nodes), str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "n"), header=True).count() == 2
    old, new = [spark.createDataFrame(r, "paper_id STRING, question STRING, model STRING, ok BOOLEAN") for r in ([("1", "q", "m", False), ("2", "q", "m", True)], [("1", "q", "m", True)])]
    assert sorted((r["paper_id"], r["ok"]) for r in W.merge_results(old, new).collect()) == [("1", True), ("2", True)]


def test_natural_order_of_many_names(spark):
    n = 40_000  # more than the ranges' bounds are drawn from, in rows so wide that ranges are joined otherwise without their notes
    t = spark.range(n, numPartitions=3).selectExpr("CASE WHEN id % 2 = 0 THEN 'paper_' || (id * 7919 % 40000) || '.json' ELSE 'q' || id END AS name", "array_join(transform(sequence(1, 4), k -> sha2('' || (id * 4 + k), 512)), '') AS note")
    got = [(r["ord"], r["name"]) for r in P.natural_order(t).filter("length(note) = 512").select("ord", "name").orderBy("ord").collect()]
    names = sorted((f"paper_{k * 7919 % n}.json" if k % 2 == 0 else f"q{k}" for k in range(n)), key=lambda x: (x[0] == "q", int(x[6:-5]) if x[0] == "p" else 0, x))
    assert got == list(enumerate(names))
    assert P.natural_order(t.limit(0)).count() == 0
