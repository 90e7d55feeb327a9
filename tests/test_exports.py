"""Grounding, page layout, settings and export rows on small rows."""

import json

from loomspark.operators import grounding as N
from loomspark.sources import pdf, settings
from loomspark.sources import writers as W


def test_resolve(spark):
    index = spark.createDataFrame([(1, "Alpha", "a", [0.0, 0.0]), (2, "Beta", "b", [0.5, 0.0]), (3, "Gamma", "c", [10.0, 0.0]), (4, "Gamma ray bursts", "d", [20.0, 0.0])], "vec_id LONG, name STRING, entity_id STRING, v ARRAY<DOUBLE>")
    names = spark.createDataFrame([(1, "BETA", [0.0, 0.0]), (2, "x", [0.1, 0.0]), (3, "y", [10.1, 0.0]), (4, "Gamma ray", [20.0, 0.0]), (5, "z", [99.0, 0.0]), (6, None, [99.0, 0.0])], "query_id LONG, name STRING, q ARRAY<DOUBLE>")
    got = {r["query_id"]: (r["how"], r["entity_id"]) for r in N.resolve_names(names, index).collect()}
    assert got[1] == ("exact", "b") and got[3] == ("strong", "c")
    assert [got[k][0] for k in (2, 4, 5, 6)] == ["new"] * 4 and got[2][1].startswith("ent_") and got[5][1] != got[2][1]
    said = spark.createDataFrame([(2, "merge", "b"), (5, "merge", "b"), (4, "new", "d")], "query_id LONG, decision STRING, entity_id STRING")
    got = {r["query_id"]: (r["how"], r["entity_id"]) for r in N.resolve_names(names, index, said).collect()}
    assert got[2] == ("judged", "b") and got[5][0] == got[4][0] == "new"
    assert {r["how"] for r in N.resolve_names(names, index.limit(0)).collect()} == {"new"}


def test_ground(spark):
    c = spark.createDataFrame([(1, "A", "b"), (2, "A", "none"), (3, None, "b")], "claim_ord LONG, subject STRING, object STRING")
    e = spark.createDataFrame([("a", "2"), ("A", "1"), ("B", "3"), (None, "4")], "name STRING, entity_id STRING")
    got = {r["claim_ord"]: (r["subject_id"], r["object_id"], r["grounded_ids"], r["status"]) for r in N.ground_claims(c, e).collect()}
    assert got == {1: ("1", "3", ["1", "3"], "grounded"), 2: ("1", None, None, "extracted"), 3: (None, "3", None, "extracted")}


def _line(page, x, y, text):
    return [(page, 600.0, x + 7 * k, x + 7 * k + 6, y, ch) for k, ch in enumerate(text)]


def test_pages(spark, tmp_path):
    two = _line(1, 20, 700, "left one") + _line(1, 400, 700, "right one") + _line(1, 20, 680, "left two") + _line(1, 400, 681.5, "right two")
    one = _line(2, 200, 700, "one column over the middle") + [(2, 600.0, 500.0, 506.0, 702.0, "X"), (2, 600.0, 509.0, 515.0, 702.0, "Y")]
    (tmp_path / "a.pdf").write_bytes(json.dumps(two + one).encode())
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"[]")

    def parse(content):
        try:
            return [tuple(x) for x in json.loads(content)]
        except ValueError:
            return []

    chars = pdf.characters(spark, str(tmp_path), parse)
    assert {r["page"]: r["two_columns"] for r in pdf.layout(chars).collect()} == {1: True, 2: False}
    got = {r["page"]: r["text"] for r in pdf.page_texts(chars).collect()}
    assert got == {1: "left one\nleft two\n\nright one\nright two", 2: "one column over the middle  X Y"}
    assert pdf.page_texts(chars.limit(0)).count() == 0


def test_settings():
    env = {"A": "1", "B": ""}
    assert settings.expand("${A} ${B} ${C} ${C:-x y} ${A:-z}", env) == "1   x y 1"
    assert settings.load('{"k": "${A}"}', env) == {"k": "1"} and settings.load(" ", env) == {}
    assert settings.examples('{"Cat": [{"text": "t"}, 3], "Bad": 4}', []) == [{"category": "Cat", "text": "t"}]
    assert settings.examples('[{"text": "论五脏"}]', [{"text": "d"}]) == settings.examples("", [{"text": "d"}]) == [{"text": "d"}]


def test_model_answers(spark):
    t = spark.createDataFrame([("a", '```json\n{"final_score": 7.5, "summary_advice": "ok", "top_fixes": ["1", "2", "3", "4"]}\n```'), ("b", "oops"), ("c", None)], "path STRING, response STRING")
    got = {r["path"]: tuple(r)[1:] for r in W.evaluation_rows(t, 7.0).collect()}
    assert got["a"] == (7.5, True, "ok", ["1", "2", "3"]) and got["b"][:2] == got["c"][:2] == (None, False)
    q = '{"question": "q", "options": {"A": "x"}, "correct_answer": "A", "explanation": "e"}'
    t = spark.createDataFrame([("s", q), ("s", '{"question": "q"}'), ("s", "oops"), ("s", None)], "section STRING, response STRING")
    assert [tuple(r) for r in W.question_rows(t).collect()] == [("s", "q", {"A": "x"}, "A", "e")]


def test_representatives(spark):
    r = spark.createDataFrame([("a b", "r", "c", "short", 1, "S1", "1", "p"), ("a b", "r", "c", "longer", 3, "S2", "2", "p"), ("a b", "r", "c", "larger", 2, "S3", "3", "p")], "subject STRING, predicate STRING, object STRING, context STRING, ord LONG, section STRING, chunk STRING, paper STRING")
    sel = spark.createDataFrame([("a b", "r", "c"), ("n", "r", "c")], "subject STRING, predicate STRING, object STRING")
    got = {x["subject"]: (x["source_section"], x["context_text"], x["frequency"]) for x in W.representative_rows(sel, r).collect()}
    assert got == {":A_B": ("S3", "larger", 3), ":N": ("", "", 0)}


def test_stage_files(spark, tmp_path):
    t = spark.createDataFrame([("p1", 1), ("p2", 2)], "paper_id STRING, n INT")
    W.write_stages({"01": t, "02": t.limit(0)}, str(tmp_path / "out"))
    assert {(r["stage"], r["paper_id"], r["n"]) for r in spark.read.option("basePath", str(tmp_path / "out")).json(str(tmp_path / "out" / "stage=01")).collect()} == {(1, "p1", 1), (1, "p2", 2)}
    W.write_report(t, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
