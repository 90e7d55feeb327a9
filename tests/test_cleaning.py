"""Cleaning of extracted lines."""

from pyspark.sql import functions as F

from loomspark.functions import cleaning as L


def run(spark, f, *rows):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k INT, x STRING").coalesce(1).select(f(F.col("x"))).collect()]


def test_artifacts(spark):
    assert run(spark, L.artifacts, "a\r\nb\rc", "exam-\nple x -\ny", "鈥 (cid:0)| \t\nb", "a\n\n\n\nb", None) == ["a\nb\nc", "example x -\ny", "-  |\nb", "a\n\nb", ""]


def test_headings(spark):
    lines = ["Abstract", " 3.1) METHODS: ", "IV. Results and Discussion of it", "Results: we saw", "2 Conclusion, final", "Section 4: Funding", "References", "resultsx", "3. resultsy", "", None, "Mix results"]
    want = [("Abstract", False, ""), ("Methods", False, ""), ("Results", False, "and Discussion of it"), ("Results", False, "we saw"), ("Conclusion", False, ", final"), ("Funding", True, ""), ("References", True, ""), None, None, None, None, ("Results", False, "")]
    got = run(spark, L.heading, *lines)
    assert [g and tuple(g) for g in got] == want


def test_blocks(spark):
    text = "Received 3 May\r\nSome Title\n1. Introduction\nA long exam-\nple line that\nwraps here.\nFigure 3 A caption\nof two lines\nThis is a line of body text with more than eight words.\nREFERENCES\nSmith, J."
    assert run(spark, L.clean_block, text)[0] == "Introduction\nA long example line that wraps here.\nThis is a line of body text with more than eight words.\nREFERENCES\nSmith, J."
    assert run(spark, L.clean_lines, text, "", None, "References\nX") == ["Introduction\nA long example line that wraps here.\nThis is a line of body text with more than eight words.", "", "", ""]
    assert run(spark, lambda x: L.clean_block(x, F.array(F.lit("head #"))), "Head 7\nText.\nHead 8") == ["Text."]


def test_references_and_titles(spark):
    assert run(spark, L.without_references, "a\nReference list\nb", "a\n[1] x\ny\n[2] z", "a\n[1] x\ny", "see references in the appendix of it\nb") == ["a", "a", "a\n[1] x\ny", "see references in the appendix of it\nb"]
    t = lambda f, title: lambda x: f(x, F.lit(title))
    assert run(spark, t(L.after_title, "2. Data  Sets"), "head\n2 Data Sets used\nbody", "no such") == ["body", "no such"]
    assert run(spark, t(L.before_title, "3 Results"), "a\nour results follow\nb", "a\nReferences\nb", "a") == ["a", "a", "a"]


def test_records(spark):
    lines = lambda *xs: F.array(*map(F.lit, xs))
    body = "This is a line of body text with more than eight words."
    one = spark.range(1)
    got = lambda section, *xs: one.select(L.record_lines(lines(*xs), F.lit(section))).first()[0]
    assert got("Results", body, "", "Figure 1 x", "of it", body, "Jane Doe", "short", body, "Funding", "no") == [body, body, body]
    assert got("Abstract", "Jane Doe and John Roe", body, "Keywords: a, b", "c d", "e f", "g h", body) == [body, "Keywords: a, b", "c d", "e f"]
    assert got("Results", "seen doi: 10.1/x here; ", "ask me@x.org") == ["seen here"]


def test_inline_noise_and_keys(spark):
    assert run(spark, L.strip_inline, "Seen doi: 10.1/x here © The Author(s) 2020", " - a  b; ") == ["Seen here", "a b"]
    assert run(spark, L.boundary_key, " Vol 12,  p 3 ") == ["vol # p #"]
