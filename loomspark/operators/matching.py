"""Gold against predictions: loose name matches by equi-joins on keys, greedy pairs, precision and recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X


def name_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(paper_id, gold, pred) for the distinct names of a paper that match. Inputs: paper_id, name; null and empty names match nothing."""

    def keyed(t: DataFrame, as_: str, flipped: bool) -> DataFrame:
        t = t.select("paper_id", F.col("name").alias(as_)).filter(F.col(as_).isNotNull()).distinct()
        t = t.withColumn(f"v_{as_}", N.name_variants(F.col(as_)))
        return t.withColumn("_k", F.explode(F.array_distinct(N.match_keys(F.col(as_), F.col(f"v_{as_}"), flipped))))

    met = keyed(gold, "gold", False).join(keyed(pred, "pred", True), ["paper_id", "_k"])
    sure = met.filter(N.names_match(F.col("gold"), F.col("pred"), F.col("v_gold"), F.col("v_pred")))
    return sure.select("paper_id", "gold", "pred").distinct()


def triple_hits(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The gold triples (paper_id, subject, object) with a prediction whose two ends match; one prediction may serve many."""
    ends = {}
    for end in ("subject", "object"):
        side = lambda t: t.select("paper_id", F.col(end).alias("name"))  # noqa: B023, E731
        ends[end] = name_pairs(side(gold), side(pred)).select("paper_id", F.col("gold").alias(end), F.col("pred").alias(f"p_{end}"))
    p = pred.select("paper_id", F.col("subject").alias("p_subject"), F.col("object").alias("p_object")).distinct()
    met = p.join(ends["subject"], ["paper_id", "p_subject"]).join(ends["object"], ["paper_id", "p_object"])
    return gold.join(met.select("paper_id", "subject", "object").distinct(), ["paper_id", "subject", "object"], "left_semi")


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of a paper: gold names in order take their first free prediction in order.

    The order is that of the names, so reruns agree. A group is the matches of one paper.
    """

    def take(g: pd.DataFrame) -> pd.DataFrame:
        used, done, rows = set(), set(), []
        for gold, pred in sorted(zip(g["gold"], g["pred"])):
            if gold not in done and pred not in used:
                done.add(gold), used.add(pred), rows.append((gold, pred))
        return pd.DataFrame({"paper_id": [g["paper_id"].iloc[0]] * len(rows), "gold": [r[0] for r in rows], "pred": [r[1] for r in rows]})

    return pairs.groupBy("paper_id").applyInPandas(take, pairs.select("paper_id", "gold", "pred").schema)


def scores(n_gold: DataFrame, n_pred: DataFrame, n_hit: DataFrame) -> DataFrame:
    """One row of sums over all papers with precision, recall and F1. Each input has one row and one column."""
    one = n_gold.toDF("n_gold").withColumn("_one", F.lit(1))
    for t, name in ((n_pred, "n_pred"), (n_hit, "n_hit")):
        one = one.join(t.toDF(name).withColumn("_one", F.lit(1)), "_one")
    out = one.drop("_one").withColumn("precision", X.ratio(F.col("n_hit"), F.col("n_pred"))).withColumn("recall", X.ratio(F.col("n_hit"), F.col("n_gold")))
    return out.withColumn("f1", X.f1(F.col("precision"), F.col("recall")))


def unmatched(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(paper_id, side, name) of the distinct gold and predicted names that no pair holds."""
    left = lambda t, c: t.select("paper_id", F.col("name")).distinct().join(pairs.select("paper_id", F.col(c).alias("name")), ["paper_id", "name"], "left_anti").select("paper_id", F.lit(c).alias("side"), "name")
    return left(gold, "gold").union(left(pred, "pred"))


def once(t: DataFrame, *keys: str) -> DataFrame:
    """One row for each key in any case: the smallest by text."""
    return t.groupBy(*[F.lower(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(*t.columns)).alias("r")).select("r.*")
