"""Reports over runs, questions and relations, and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.predicates import standard_predicate


def standardised(triples: DataFrame, variants: dict[str, tuple[str, ...]]) -> DataFrame:
    """triples with the standard form in ``predicate`` and the text as it was in ``original_predicate``."""
    form = standard_predicate(F.col("predicate"), variants)
    return triples.withColumn("original_predicate", F.col("predicate")).withColumn("predicate", form)


def predicate_changes(triples: DataFrame, variants: dict[str, tuple[str, ...]]) -> DataFrame:
    """Total, unknown, unchanged and normalized triples. Each distinct predicate is looked up once."""
    p = triples.groupBy(F.coalesce("predicate", F.lit("")).alias("predicate")).agg(F.count("*").alias("n"))
    p = p.withColumn("form", standard_predicate(F.col("predicate"), variants))
    unknown = F.col("form") == "unknown"
    same = ~unknown & (F.lower("form") == F.lower("predicate"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return p.agg(total(F.lit(True)).alias("total"), total(unknown).alias("unknown"), total(same).alias("unchanged"), total(~unknown & ~same).alias("normalized"))


def unknown_predicates(triples: DataFrame, variants: dict[str, tuple[str, ...]]) -> DataFrame:
    """The distinct predicates without a standard form, sorted."""
    p = triples.select("predicate").distinct()
    return p.filter(standard_predicate(F.col("predicate"), variants) == "unknown").orderBy("predicate")


def run_totals(papers: DataFrame) -> DataFrame:
    """One row of totals over papers (batch_id, status, started, ended): success rate in percent, seconds, seconds a paper."""
    t = papers.agg(
        F.count("*").alias("total_papers"), F.count_if(F.col("status") == "completed").alias("total_completed"), F.count_if(F.col("status") == "failed").alias("total_failed"),
        F.count_distinct("batch_id").alias("total_batches"), F.min("started").alias("_a"), F.max("ended").alias("_b"),
    )
    seconds = F.coalesce(F.unix_micros("_b") - F.unix_micros("_a"), F.lit(0)) / 1e6
    return t.select("total_papers", "total_completed", "total_failed", "total_batches", (100 * X.ratio(F.col("total_completed"), F.col("total_papers"))).alias("success_rate"),
                    seconds.alias("duration_seconds"), X.ratio(seconds, F.col("total_papers")).alias("seconds_per_paper"))


def question_totals(counts: DataFrame) -> DataFrame:
    """From (paper_id, questions): papers with questions, and the total, average, largest and smallest number."""
    n = F.coalesce("questions", F.lit(0))
    with_some = F.count_if(n > 0)
    total = F.coalesce(F.sum(n), F.lit(0))
    return counts.agg(with_some.alias("papers_with_qa"), total.alias("total_questions"), (total / F.greatest(with_some, F.lit(1))).alias("average_questions"),
                      F.coalesce(F.max(n), F.lit(0)).cast("long").alias("most"), F.coalesce(F.min(n), F.lit(0)).cast("long").alias("fewest"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Number of clusters, and the average, largest and smallest size, from (cluster, member)."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.avg("n").alias("average_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


def sample(rows: DataFrame, key: str, seed: int, n: int | None = None, share: float | None = None) -> DataFrame:
    """``n`` rows, or ``max(1, int(count * share))``, first in the order of a seeded hash of the key: the same at each run.

    Counts by the 65,536 leading parts of the hash tell where the n-th row lies; all rows before that part are kept by a filter, and
    only the part itself is sorted. Rows that tie in hash and key are told apart by no column: any of them may stay.
    """
    if (n is None) == (share is None):
        raise ValueError("give either n or share")
    h = F.xxhash64(F.lit(seed), key)
    part = F.shiftright(h, 48)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    n = max(1, int(sum(c for _, c in counts) * share)) if n is None else n
    before = 0
    for cut, c in counts:
        if before + c >= n:
            return rows.filter(part < cut).union(rows.filter(part == cut).orderBy(h, key).limit(n - before))
        before += c
    return rows


def sample_each(rows: DataFrame, group: str, key: str, seed: int, n: int = 5) -> DataFrame:
    """At most ``n`` rows of each group in the order of a seeded hash; Spark cuts each group in the tasks before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def run_report(efficiency: DataFrame, relations: DataFrame, entities: DataFrame, papers: DataFrame, top: int = 10) -> str:
    """A text of the four analyses; each is one row or the ``top`` rows of a ranking, so the driver holds little."""
    out = []
    for title, rows in (("Pipeline efficiency", efficiency), ("Relation types", relations), ("Entity coverage", entities), ("Papers", papers)):
        out += [f"## {title}", ""]
        out += ["- " + ", ".join(f"{k}: {v:.4g}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()) for r in rows.limit(top).collect()]
        out.append("")
    return "\n".join(out)


# ---- runs, relations, entities and papers

STEPS = ("extracted", "grounded", "validated", "written")


def efficiency(counters: DataFrame, *keys: str) -> DataFrame:
    """The rates from step to step and over all of (keys, extracted, grounded, validated, written), 0 where the base is 0."""
    t = counters.groupBy(*keys).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STEPS])
    rate = lambda a, b: X.ratio(F.col(a), F.col(b))
    return t.select(*keys, F.lit(1.0).alias("extraction_rate"), rate("grounded", "extracted").alias("grounding_rate"), rate("validated", "grounded").alias("validation_rate"), rate("written", "validated").alias("writing_rate"), rate("written", "extracted").alias("overall_success_rate"))


def most_common(rows: DataFrame, value: str, n: int, order: str) -> DataFrame:
    """The n most frequent values with their counts; of equal counts the first by ``order`` comes first."""
    t = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return t.orderBy(F.desc("n"), "_first", value).limit(n).drop("_first")


def relation_distribution(relations: DataFrame, kind: str = "relation") -> DataFrame:
    """One row: relations, distinct types, and types a relation."""
    t = relations.groupBy(kind).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_relations"), F.count("*").alias("unique_relation_types"))
    return t.withColumn("relation_diversity", X.ratio(F.col("unique_relation_types"), F.col("total_relations")))


def entity_coverage(relations: DataFrame, ends: tuple[str, str] = ("subject", "object")) -> DataFrame:
    """One row: entities, relations, relations an entity (both ends count), entities of one and of several relations."""
    f = relations.select(F.explode(F.array(*ends)).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    t = f.agg(F.count("*").alias("total_unique_entities"), (F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("long").alias("total_relationships"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))
    return t.withColumn("avg_relationships_per_entity", X.ratio(2 * F.col("total_relationships"), F.col("total_unique_entities")))


def paper_contribution(counters: DataFrame) -> DataFrame:
    """A10: written claims, validation rate and percentage of all written claims of each paper (paper_id, extracted, validated, written)."""
    total = counters.agg(F.sum("written").alias("_t"))
    t = counters.join(F.broadcast(total))  # one row
    return t.select("paper_id", F.col("written").alias("claims_per_paper"), X.ratio(F.col("validated"), F.col("extracted")).alias("validation_rate"), (100 * X.ratio(F.col("written"), F.col("_t"))).alias("contribution_percentage"))


def stage_counters(claims: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Extracted, grounded, validated and written claims of each paper, with the seconds of its stages if timings (paper_id, seconds) are given.

    claims: source_paper_id, status (a later status implies the earlier ones; rejected claims were grounded), written.
    """
    later = lambda *xs: F.count_if(F.col("status").isin(*xs))
    t = claims.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.count("*").alias("extracted"), later("grounded", "validated", "rejected").alias("grounded"), later("validated").alias("validated"), F.count_if(F.col("written")).alias("written"))
    return t if timings is None else t.join(timings.groupBy("paper_id").agg(F.sum("seconds").alias("total_time")), "paper_id", "left")


def timing_rollup(timings: DataFrame) -> DataFrame:
    """Seconds, calls and seconds a call by agent and paper, by agent, and in all, of (agent, paper, seconds); ``level`` is paper, agent or total."""
    t = timings.rollup("agent", "paper").agg(F.sum("seconds").alias("total"), F.count("*").alias("calls"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "paper").when(F.col("_g") == 1, "agent").otherwise("total")
    return t.select(level.alias("level"), "agent", "paper", "total", "calls", (F.col("total") / F.col("calls")).alias("avg"))


def model_accuracy(answers: DataFrame) -> DataFrame:
    """For each model total, answered, correct and accuracy of (model, extracted_answer, correct_answer); no answer is a wrong one."""
    right = F.coalesce(F.col("extracted_answer") == F.col("correct_answer"), F.lit(False))
    t = answers.groupBy("model").agg(F.count("*").alias("total"), F.count("extracted_answer").alias("answered"), F.count_if(right).alias("correct"))
    return t.withColumn("accuracy", X.ratio(F.col("correct"), F.col("total")))


def batch_summary(papers: DataFrame) -> DataFrame:
    """For each batch papers, completed, failed, in progress, success rate, mean score (unscored ones apart), and whether it is complete."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    t = papers.groupBy("batch_id").agg(F.count("*").alias("total_papers"), done.alias("completed"), failed.alias("failed"), F.avg("score").alias("average_score"))
    return t.withColumn("in_progress", F.col("total_papers") - F.col("completed") - F.col("failed")).withColumn("success_rate", X.ratio(F.col("completed"), F.col("total_papers"))).withColumn("is_complete", F.col("in_progress") == 0)


def relation_frequency(relations: DataFrame, n: int | None = None) -> DataFrame:
    """How often each (subject, predicate, object) stands; the n most frequent, of equal ones the first by ``ord``."""
    t = relations.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"), F.min("ord").alias("_first"))
    return (t if n is None else t.orderBy(F.desc("n"), "_first").limit(n)).drop("_first")


def transform_stats(rows: DataFrame) -> DataFrame:
    """One row of counters of a transformed exchange table (类型, 名称, 片段): rows, relations, rows cut short, names that are no triple, rows given."""
    relation = (F.col("类型") == "关系") & F.col("名称").isNotNull() & F.col("片段").isNotNull()
    short = F.col("类型").isNull() | F.col("名称").isNull() | F.col("片段").isNull()
    triple = X.split_triple(F.coalesce("名称", F.lit("")))
    bad = relation & ((triple["predicate"] == "") | (triple["object"] == ""))
    t = rows.agg(F.count("*").alias("total_rows"), F.count_if(relation).alias("relation_rows"), F.count_if(short).alias("skipped_rows"), F.count_if(bad).alias("parse_errors"))
    return t.withColumn("output_rows", F.col("relation_rows") - F.col("parse_errors"))


def cache_counters(lookups: DataFrame, *keys: str) -> DataFrame:
    """Lookups, hits, misses and hit rate of (keys, hit)."""
    t = lookups.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return t.withColumn("hit_rate", X.ratio(F.col("hits"), F.col("total")))


def validation_counters(claims: DataFrame) -> DataFrame:
    """One row: claims, validated and rejected ones, and the rejected ones by their reason."""
    t = claims.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "validated").alias("validated"), F.count_if(F.col("status") == "rejected").alias("rejected"), *[F.count_if(F.col("validation_type") == k).alias(k) for k in ("self_loop", "same_entity", "invalid_subject", "invalid_object", "format_error")])
    return t


def question_tasks(questions: DataFrame, models: list[str]) -> DataFrame:
    """Each question with each model of a list."""
    return questions.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
