"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Each source has a weight and a size (words). A total is shared by weight, but no source gets more than ``MAX_EPOCHS`` times
its size; what is cut off is shared again by weight among the others until no source is above its cap. The level of the water
is found with one aggregate over ranges of sources in the order in which they fill up.

A source's target is reached with whole repetitions of all its documents and one fractional repetition: documents in the
order of a seeded hash until the words of the fraction are taken. That prefix is found through hash bins: sums by (source,
bin), then running sums over the bins of a source, then over the documents of the single bin in which the cut lies. So no
task sees a whole source, and a source's error is at most half of the document at the cut.

Null texts have size 0; null is a source of its own and sorts last. Rows with the same doc_id are independent documents. An
empty table gives an empty result. Reruns agree: the order depends on the seed, doc_id and size alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, apart, has_rid, materialize, numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20_240_601
BINS = 4096


def source_order(sources: DataFrame) -> DataFrame:
    """Add ``ord``, the global position of each source by code point, null last.

    The sources are sorted by range; a source's position is its position in its range plus the sizes of the ranges before.
    """
    s = sources.withColumn("_null", F.col("source").isNull().cast("int")).repartitionByRange("_null", "source").sortWithinPartitions("_null", "source")
    s = materialize(s.withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = s.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row a range: bounded by the number of shuffle partitions.
    s = s.join(F.broadcast(before.select("_part", "_before")), "_part")
    return s.withColumn("ord", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1).drop("_part", "_before", "_null")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` to (weight, cap): min(cap, level * weight), with the level at which the targets sum to ``total``.

    Sources fill up in the order of cap / weight. They are sorted by ranges of it; sums of the ranges, a row each, tell the driver in which
    range the level lies, and prefix sums inside that range alone tell where. Where the caps sum to less than the total, each
    target is its cap.
    """
    s = sources.withColumn("_r", F.col("cap") / F.col("weight")).repartitionByRange("_r").withColumn("_part", F.spark_partition_id())
    s = materialize(s, "mix-fill")
    parts = s.groupBy("_part").agg(F.min("_r").alias("lo"), F.max("_r").alias("hi"), F.sum("cap").cast("double").alias("cap"), F.sum("weight").cast("double").alias("weight")).orderBy("lo").collect()
    left, open_weight, level = float(total), sum(p.weight for p in parts), None
    for p in parts:
        rest = open_weight - p.weight
        if (left - p.cap) / rest >= p.hi if rest > 1e-9 else left >= p.cap:
            left, open_weight = left - p.cap, rest
            continue
        w = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one range of the order
        before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double")
        one = s.filter(F.col("_part") == p._part).select("_r", ((F.lit(left) - before("cap")) / (F.lit(open_weight) - before("weight"))).alias("level"))
        level = one.filter("level <= _r").agg(F.min_by("level", "_r")).first()[0]
        break
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", target).drop("_r", "_part")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """_rid, doc_id, size, source_size, target, times (repetitions of this document in the mix)."""
    sizes = docs.select(
        F.col("_rid") if has_rid(docs) else F.monotonically_increasing_id().alias("_rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{WS}]+")), F.lit(0)).cast("long").alias("size"),
    )
    sizes = materialize(sizes.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    sizes = sizes.withColumn("bin", F.pmod(F.col("u"), F.lit(BINS)))
    sources = source_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord"), F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", max_epochs * F.col("source_size"))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    targets = water_fill(sources, total).select("source", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("need", (rate - F.floor(rate)) * F.col("source_size"))
    targets = materialize(targets, "mix-targets")

    # The bin in which the fraction of each source ends, and the words before it.
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cut = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows a source
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(cut), F.lit(0)))
    t = targets.alias("t")
    bins = bins.alias("b").join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need")))
    cuts = materialize(targets.alias("t").join(bins.select("b.source", "bin", "before").alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", F.coalesce("bin", F.lit(BINS)).alias("cut"), F.coalesce("before", F.lit(0)).alias("before")), "mix-cuts")

    d = sizes.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select("_rid", "doc_id", "size", "u", "d.source", "bin", "source_size", "target", "whole", "need", "cut", "before")
    at_cut = d.filter("bin = cut")
    order = Window.partitionBy("source", "bin").orderBy("u", "doc_id", "_rid")
    run = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_cut = at_cut.withColumn("extra", (F.col("before") + run + F.col("size") / 2 <= F.col("need")).cast("int"))
    rest = d.filter("bin != cut").withColumn("extra", ((F.col("bin") < F.col("cut")) & (F.col("need") > 0)).cast("int"))
    return rest.unionByName(at_cut).select("_rid", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("times"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as often as the plan takes it, with the columns of ``docs``."""

    def repeat(docs: DataFrame) -> DataFrame:
        t = numbered(docs)
        take = plan(t, **options).filter("times > 0").select("_rid", F.col("times").alias("_times"))
        t = t.join(take, "_rid")
        return t.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)

    return apart(docs, repeat, "doc_id", "text", "source")
