"""State between runs: batches of papers with their status, checkpoints, entity caches and frozen taxonomies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

STATES = "batch_id STRING, paper STRING, status STRING, score DOUBLE, error STRING, updated BIGINT"
#: The states of a paper.
PENDING, DONE, FAILED = "pending", "completed", "failed"


def save(states: DataFrame, path: str) -> None:
    """The states of batches as a Parquet table by batch; a batch that is written again replaces itself."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored states; none where nothing was stored."""
    f, p = scratch.fs(spark, path)
    t = spark.read.schema(STATES).parquet(path) if f.exists(p) else spark.createDataFrame([], STATES)
    return t.select(*[c.split()[0] for c in STATES.split(", ")])


def cleanup(spark: SparkSession, path: str, now_ms: int, keep_days: float = 7) -> int:
    """Delete the files and folders directly below ``path`` that were last written more than ``keep_days`` before ``now_ms``; how many went."""
    f, p = scratch.fs(spark, path)
    old = [s.getPath() for s in f.listStatus(p) if s.getModificationTime() < now_ms - keep_days * 86_400_000]
    for one in old:
        f.delete(one, True)
    return len(old)


def updated(states: DataFrame, changes: DataFrame) -> DataFrame:
    """States with changes (same columns): the latest row of a paper of a batch by ``updated`` counts, a change before a stored row."""
    both = states.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in states.columns if c not in ("batch_id", "paper")]
    return both.groupBy("batch_id", "paper").agg(F.max_by(F.struct(*rest), F.struct("updated", "_new")).alias("r")).select("batch_id", "paper", *[f"r.{c}" for c in rest]).select(*states.columns)


def finalized(queue: DataFrame, found: DataFrame, results: DataFrame) -> DataFrame:
    """The status of each queued paper (batch_id, ord, paper): a missing file ends its batch, and the papers behind it stay pending.

    found: paper; results: paper, error. A paper with a result is completed, or failed with its error; the missing one is failed.
    """
    q = queue.join(found.select("paper").distinct().withColumn("_there", F.lit(True)), "paper", "left")
    stop = q.filter("_there is null").groupBy("batch_id").agg(F.min("ord").alias("_stop"))
    r = results.groupBy("paper").agg(F.max("error").alias("_error"), F.count("*").alias("_n"))
    t = q.join(stop, "batch_id", "left").join(r, "paper", "left")
    behind, at = F.coalesce(F.col("ord") > F.col("_stop"), F.lit(False)), F.coalesce(F.col("ord") == F.col("_stop"), F.lit(False))
    status = F.when(behind, PENDING).when(at | F.col("_error").isNotNull(), FAILED).when(F.col("_n") > 0, DONE).otherwise(PENDING)
    return t.select("batch_id", "ord", "paper", status.alias("status"), F.when(at, "file not found").when(~behind, F.col("_error")).alias("error"))


def cached_names(cache: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the names (name) with the entity_id of the cache (name, entity_id) in any case, and the distinct other ones in lower case."""
    c = cache.groupBy(F.lower("name").alias("_k")).agg(F.min("entity_id").alias("entity_id"))
    t = names.withColumn("_k", F.lower("name")).join(c, "_k", "left")
    return t.filter("entity_id is not null").drop("_k"), t.filter("entity_id is null").select(F.col("_k").alias("name")).distinct()


def grown(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with new entities (name, entity_id); a name that it has keeps its entity."""
    both = cache.select(F.lower("name").alias("name"), "entity_id", F.lit(0).alias("_n")).union(found.select(F.lower("name"), "entity_id", F.lit(1)))
    return both.groupBy("name").agg(F.min_by("entity_id", F.struct("_n", "entity_id")).alias("entity_id"))


def by_batch(papers: DataFrame, store: dict, classify: Callable[[DataFrame, dict], DataFrame], apply: Callable[[dict, DataFrame, int], dict]) -> dict:
    """The store after each batch of papers (batch_id) in turn: a batch is classified against the store as it was before it.

    Batches are the few steps that must follow each other; the rows of a batch are the engine's. ``apply(store, assignments, version)`` gives the next store.
    """
    for version, (batch,) in enumerate(papers.select("batch_id").distinct().orderBy("batch_id").collect(), 2):
        store = apply(store, classify(papers.filter(F.col("batch_id") == batch), store), version)
    return store


def benchmark(questions: DataFrame, done: DataFrame, models: list[str], ask: Callable[[DataFrame], DataFrame], extract: Callable) -> DataFrame:
    """The answers to the questions (paper_id, question, correct_answer) that no finished row has, by every model.

    ``ask`` maps (paper_id, question, model, ...) to the same with ``response``; ``extract`` takes the letter from a response column.
    """
    from ..operators.reports import question_tasks

    open_ = questions.join(done.select("paper_id", "question").distinct(), ["paper_id", "question"], "left_anti")
    a = ask(question_tasks(open_, models)).withColumn("extracted_answer", extract(F.col("response")))
    return a.withColumn("is_correct", F.coalesce(F.col("extracted_answer") == F.col("correct_answer"), F.lit(False)))
