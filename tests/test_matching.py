"""Loose matching and the taxonomy against plain Python over all pairs."""

import itertools
import re

from pyspark.sql import functions as F

from loomspark.functions import names as N
from loomspark.operators import matching as M
from loomspark.operators import taxonomy as T

NAMES = ["Self Attention", "self-attn", "KISA", "Knowledge Informed Self Attention", "BERT model", "bert", "NLP task", "Natural Language Processing", "ab", "AB", "a", "", None, "Graph Conv Encoder", "graph conv", "Entire System", "tire", "Cardiac output volume", "cardiac volume test", "漢字", "POS", "position", "zz", "Si", "x-SI", "Score"]


def test_pairs_are_those_of_the_predicate(spark):
    t = spark.createDataFrame([("p", n) for n in NAMES], "paper_id STRING, name STRING")
    got = {(r["gold"], r["pred"]) for r in M.name_pairs(t, t).collect()}
    v = t.select("name", N.name_variants(F.col("name")).alias("v")).distinct()
    every = v.toDF("a", "va").crossJoin(v.toDF("b", "vb")).filter(N.names_match(F.col("a"), F.col("b"), F.col("va"), F.col("vb")))
    assert got == {(r["a"], r["b"]) for r in every.collect()}
    assert ("KISA", "Knowledge Informed Self Attention") in got and ("bert", "BERT model") in got and ("tire", "Entire System") in got
    assert ("ab", "AB") in got and ("zz", "ab") not in got and not any(None in p or "" in p or "漢字" in p for p in got)


def test_greedy_pairs_are_one_to_one(spark):
    t = spark.createDataFrame([("p", "a", "x"), ("p", "a", "y"), ("p", "b", "x"), ("q", "a", "x")], "paper_id STRING, gold STRING, pred STRING")
    assert sorted(tuple(r) for r in M.greedy_pairs(t).collect()) == [("p", "a", "x"), ("q", "a", "x")]


def test_triple_hits_and_scores(spark):
    gold = spark.createDataFrame([("p", "bert", "graph conv"), ("p", "bert", "zz"), ("q", "bert", "graph conv")], "paper_id STRING, subject STRING, object STRING")
    pred = spark.createDataFrame([("p", "BERT model", "Graph Conv Encoder")], "paper_id STRING, subject STRING, object STRING")
    hits = M.triple_hits(gold, pred)
    assert [tuple(r) for r in hits.collect()] == [("p", "bert", "graph conv")]
    one = lambda t: t.agg(F.count("*"))
    r = M.scores(one(gold), one(pred), one(hits)).first()
    assert (r["n_gold"], r["n_pred"], r["n_hit"], r["precision"]) == (3, 1, 1, 1.0) and abs(r["f1"] - 0.5) < 1e-9


LABELS = ["Breast Cancer", "breast cancer therapy", "Cancer", "RNA sequencing analysis", "drug", "Drug Delivery", "a", "an", "banana", "", "...", "study of tumors", "Clinical study", "clinical"]


def test_best_label_like_brute_force(spark):
    a = spark.createDataFrame([(x,) for x in LABELS + [None]], "label STRING")
    b = spark.createDataFrame([(x, n) for n, x in enumerate(LABELS)], "name STRING, ord INT")
    got = {r["label"]: (r["name"], round(r["score"], 9)) for r in T.best_label(a, b).collect()}
    norm = lambda x: re.sub(r"\s+", " ", x.lower().replace("_", " ")).strip(" .;:,")

    def score(x, y):
        p, q = set(re.findall("[a-z0-9]+", x)), set(re.findall("[a-z0-9]+", y))
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        if x in y or y in x:
            return min(len(x), len(y)) / max(len(x), len(y))
        return max(len(p & q) / len(p | q), len(p & q) / min(len(p), len(q))) if p and q else 0.0

    want = {}
    for x, (n, y) in itertools.product(LABELS, enumerate(LABELS)):
        s = score(norm(x), norm(y))
        if s > 0 and s > want.get(x, ("", 0))[1]:
            want[x] = (y, s)
    assert got == {k: (v[0], round(v[1], 9)) for k, v in want.items()}


def test_refinement(spark):
    known = spark.createDataFrame([("Biomedicine", 0), ("Breast Cancer", 1), ("Clinical Medicine", 2)], "name STRING, ord INT")
    d = [("Lymphoma care", "promote", "Lymphoma care"), ("Decision making", "promote", "Decision making"), ("workflow", "promote", "workflow"), ("clinical study", "promote", "clinical study"),
         ("genomic platform medicine", "promote", "g"), ("genomic breast study", "promote", "g"), ("Melanoma", "merge", "Breast Cancer"), ("Neurology", "promote", "Neurology"), ("", "merge", "x"), ("x", "keep", "x"), (None, None, None)]
    t = spark.createDataFrame([(*r, "") for r in d], "candidate STRING, action STRING, target_subdomain STRING, parent_domain STRING")
    got = {r["candidate"]: (r["action"], r["target_subdomain"], r["rule"]) for r in T.post_filter(t, known, "Biomedicine").collect()}
    assert got == {
        "Lymphoma care": ("promote", "Lymphoma care", "keep_specialty"), "Decision making": ("merge", "Biomedicine", "force_merge"), "workflow": ("merge", "Biomedicine", "force_merge"),
        "clinical study": ("merge", "Biomedicine", "force_merge"), "genomic platform medicine": ("dropped", "g", "dropped"),
        "genomic breast study": ("dropped", "g", "dropped"), "Melanoma": ("promote", "Melanoma", "force_promote"), "Neurology": ("promote", "Neurology", "as_decided"),
    }
    papers = spark.createDataFrame([("1", "WORKFLOW", "x", "candidate", 1), ("2", "other", "y", "candidate", 1)], "id STRING, subdomain STRING, parent_domain STRING, subdomain_status STRING, taxonomy_version INT")
    out = {r["id"]: tuple(r)[1:] for r in T.propagate(papers, T.post_filter(t, known, "Biomedicine"), 2).collect()}
    assert out == {"1": ("Biomedicine", "Biomedicine", "confirmed", 2), "2": ("other", "y", "candidate", 1)}


def test_fallback_and_classify(spark):
    known = spark.createDataFrame([("Breast Cancer", 1)], "name STRING, ord INT")
    c = spark.createDataFrame([("breast  cancer", ""), ("Neuro", "Brain"), ("", "")], "name STRING, suggested_parent STRING")
    assert sorted(tuple(r) for r in T.fallback_decisions(c, known, "R").collect()) == [("Neuro", "promote", "Neuro", "Brain"), ("breast  cancer", "merge", "Breast Cancer", "R")]
    p = spark.createDataFrame([("1", "breast cancers", None, 1.4), ("2", None, "Q", None)], "paper_id STRING, label STRING, parent STRING, confidence DOUBLE")
    assert sorted(tuple(r) for r in T.classify(p, known, "R").collect()) == [("1", "Breast Cancer", "R", 1.0, "confirmed"), ("2", None, "Q", 0.0, "candidate")]
