"""Chunks against plain Python."""

import re

from pyspark.sql import functions as F

from loomspark.functions import chunking as K


def plain(text, size):
    text = (text or "").strip()
    if len(text) <= size:
        return [text]
    heads = list(re.finditer(r"(?m)^##[ \t]+(.+?)\n", text))
    ends = [m.start() for m in heads[1:]] + [len(text)]
    blocks = [f"Section: {m[1].strip()}\n{text[m.end():e].strip()}".strip() for m, e in zip(heads, ends)] or [text]
    out = []
    for b in blocks:
        if len(b) <= size:
            out.append(b)
            continue
        pieces = []
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", b))):
            pieces += [p] if len(p) <= size else [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", p) if s.strip()]
        now = ""
        for p in pieces:
            if now and len(now) + 2 + len(p) > size:
                out.append(now)
                now = p
            else:
                now = f"{now}\n\n{p}" if now else p
        out += [now] if now else []
    return out


def test_chunks(spark):
    texts = [None, "", "short", "lost\n## One\nBody a. Body b.\n\nMore text here.\n## Two\n" + "Long sentence here! " * 12, "no heading ## inline. " * 9, "x" * 150, "## Empty\n## Next\n" + "para\n\n" * 40]
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for size, rows in ((60, texts), (500, docs)):
        t = spark.createDataFrame([(n, x) for n, x in enumerate(rows)], "n INT, x STRING").select("n", K.chunks(F.col("x"), size).alias("c"))
        assert {r["n"]: r["c"] for r in t.collect()} == {n: plain(x, size) for n, x in enumerate(rows)}


def test_titles_and_evidence(spark):
    chunk = "one\n\ntwo words\n\nthree"
    t = spark.createDataFrame([(None, chunk), ("words", chunk), ("words", None), ("s\n\nthree", "x" * 400 + " s\n\nthree"), ("none", "y" * 600)], "e STRING, c STRING")
    got = [r[0] for r in t.select(K.evidence_with_context(F.col("e"), F.col("c"))).collect()]
    assert got[0] == "" and got[1] == f"证据句：words\n上下文：{chunk}" and got[2] == "words"
    assert got[3].endswith("three") and got[4] == "证据句：none\n上下文：" + "y" * 520
    titles = spark.createDataFrame([("Section: A b \nx",), ("x",), (None,)], "c STRING").select(K.section_title(F.col("c")))
    assert [r[0] for r in titles.collect()] == ["A b", "", ""]
