"""Documents cut into sections and chunks, and their records cleaned, against plain Python."""

import random

from pyspark.sql import functions as F

from loomspark.functions import sections as S

MAX = 120


def cut(unit):
    out, at = [], 0
    while at < len(unit):
        end = min(at + MAX, len(unit))
        if end < len(unit):
            best = max(unit[at:end].rfind(p) for p in ("\n\n", "\n", ". ", "。", " "))
            end = at + best + 1 if best > int(MAX * 0.6) else end
        out.append(unit[at:end].strip())
        at = end
    return [x for x in out if x]


def chunks(text):
    import re

    filled = lambda xs: [x.strip() for x in xs if x.strip()]
    units = []
    for p in filled(re.split(r"\n\s*\n+", text.strip())):
        units += [p] if len(p) <= MAX else filled(re.split(r"(?<=[.!?。！？])\s+", p))
    units = [x for u in units for x in ([u] if len(u) <= MAX else cut(u))]
    done, cur = [], ""
    for u in units:
        if cur and len(cur) + 2 + len(u) > MAX:
            done.append(cur)
            cur = u
        else:
            cur = f"{cur}\n\n{u}" if cur else u
    done += [cur] if cur else []
    out, start = [], 0
    for k, c in enumerate(done):
        out.append(("t" if k == 0 else f"t{k + 1}", c, start, start + len(c), len(c.split())))
        start += len(c)
    return out


def test_chunks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12)))
    texts = ["", "  ", "x" * 400, "a. b! c", None]
    for _ in range(60):
        texts.append("".join(word() + rng.choice([" ", " ", " ", ". ", "! ", "\n", "\n\n", "。 "]) for _ in range(rng.randrange(1, 120))))
    t = spark.createDataFrame(list(enumerate(texts)), "k INT, x STRING")
    got = {r["k"]: [tuple(c) for c in r["c"]] for r in t.select("k", S.chunks(F.col("x"), F.lit("t"), MAX).alias("c")).collect()}
    assert got == {k: chunks(x or "") for k, x in enumerate(texts)}


LINE = "This is a line of body text with more than eight words."


def body(tag, n=7):
    return "\n".join(f"This is line {tag}{k} of a body with more than eight words." for k in "abcdefg"[:n])


def test_documents(spark):
    pages = [
        ("a", 1, f"Journal of X 1\nA Title\nAbstract\n{body('p')}\nand more of\nit.\nJournal of X 2"), ("a", 2, f"Journal of X 3\n2. Methods: we did\n{body('q')}\nFigure 1 A caption\nof it\nJournal of X 4"),
        ("a", 3, f"Results were good\n{body('r')}\nReferences\nNo.\nDiscussion"), ("b", 1, f"No heading here at all.\n{body('s')}"), ("b", 2, f"{body('t')}\nFunding\nNo."), ("c", 1, ""), ("d", 1, f"Introduction\nMethods\n{body('u')}"),
    ]
    got = S.split_documents(spark.createDataFrame(pages, "path STRING, page INT, text STRING"), 5000).collect()
    rows = {(r["path"], r["section_no"]): (r["title"], r["content"], r["page_start"], r["page_end"]) for r in got}
    assert rows == {
        ("a", 1): ("Abstract", f"{body('p')}\nand more of it.", 1, 2), ("a", 2): ("Methods", f"we did\n{body('q')}", 2, 3), ("a", 3): ("Results", f"were good\n{body('r')}", 3, 3),
        ("b", 1): ("Chunk 1", f"No heading here at all.\n{body('s')}\n\n{body('t')}", 1, 2), ("d", 1): ("Methods", body("u"), 1, 1),
    }
    recs = S.records(spark.createDataFrame([("p", 1, "2. My Title", "x" * 30, 1, 2), ("p", 2, "!", "y", 3, 3)], "path STRING, section_no INT, title STRING, content STRING, page_start INT, page_end INT"))
    assert [(r["id"], r["text"]) for r in recs.orderBy("pos").collect()] == [("mytitle", "x" * 30), ("section", "y")]


def test_records(spark):
    long = "\n".join([LINE] * 3)
    rows = [
        (0, "s0", "Funding", 1, long), (1, "s1", "Results", 1, f"{long}\nReferences\nNo."), (2, "s2", "Chunk 2", 3, f"Methods\n{long}"), (3, "s3", "Results", 1, LINE), (4, "s4", "Chunk 1", 1, "a few words and some more of them\nand not one line\nof the many here is long enough\nto be a body line of\nthe text at all"),
        (5, "s5", "", 2, "References\nx"), (6, "s6", None, 2, None), (7, "s7", "Abstract", 1, f"Jane Doe and John Roe\n{long}\nKeywords: a, b"),
    ]
    t = spark.createDataFrame([("p", *r) for r in rows], "path STRING, pos INT, id STRING, section_title STRING, page_start INT, text STRING")
    got = {r["id"]: (r["section_title"], r["text"], r["tail_truncated"]) for r in S.clean_records(t, spark.createDataFrame([], "path STRING, line STRING")).collect()}
    assert got == {"s1": ("Results", long, True), "s2": ("Methods", long, False), "s7": ("Abstract", f"{long}\nKeywords: a, b", False)}
    assert S.clean_records(t.limit(0)).count() == 0
