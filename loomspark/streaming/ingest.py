"""Claims as a stream: gate, first-wins dedup, routed edges, resumable batches, and stage timings by window.

Every micro-batch writes a folder named by its number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import claims as C
from ..operators import store as S


def _stored(spark, path: str, before: int, schema) -> DataFrame:
    """Rows of the batches before this one; batches are folders ``batch=<n>``."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    t = spark.read.schema(schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", batch BIGINT").option("basePath", path).parquet(path)
    return t.filter(F.col("batch") < before).select(*schema.fieldNames())


def claims_to_graph(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of claims to ``path``/edges and ``path``/nodes as far as it is there, then stop.

    The first claim of a fingerprint (subject, relation, object, paper) counts, across batches too: new fingerprints are anti-joined with
    the stored ones, so state lies in the table and not in memory. Columns: claim_ord, subject, relation, object, subject_id, object_id,
    claim_type, evidence, source_paper_id, status. ``stored_nodes`` folds the node rows of all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = X.fingerprint(*[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "relation", "object", "source_paper_id")])
        first = C.first_of(S.gate(batch).withColumn("fingerprint", key), F.col("fingerprint"))
        rows = S.routed(first).select("fingerprint", "src", "dst", "rel_type", "route", "evidence")
        seen = _stored(spark, f"{path}/edges", number, rows.schema).select("fingerprint")
        new = first.join(seen, "fingerprint", "left_anti")
        S.routed(new).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        S.claim_nodes(new).write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")

    return claims.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_nodes(spark, path: str) -> DataFrame:
    """G02 over all batches of ``claims_to_graph``: one row an id; times are batch numbers."""
    t = spark.read.parquet(f"{path}/nodes")
    out = t.groupBy("id").agg(F.min_by("name", F.struct("batch", "ord", "name")).alias("name"), F.max("is_concept").alias("is_concept"), F.min("batch").cast("long").alias("created_at"), F.max("batch").cast("long").alias("updated_at"))
    return out


def stage_timings(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls and seconds of each event type by window of ``ts``; rows later than ``late`` are left out of closed windows."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("seconds"))
    return w.select(F.col("window.start").alias("start"), "event_type", "calls", "seconds")


def pending(inputs: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    """Inputs whose key no finished row has."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def workflow_state(attempts: DataFrame, threshold: float = 7.0, most: int = 3) -> DataFrame:
    """The state of each paper from its tries (paper_id, attempt, score, error).

    ``completed`` if the last try had no error; ``gate_passed`` tells whether it reached the threshold; a failed gate or an error
    is tried again while fewer than ``most`` tries were made (``retry``); else ``failed``.
    """
    last = attempts.groupBy("paper_id").agg(F.max(F.struct("attempt", "score", "error")).alias("l"), F.count("*").alias("tries"))
    passed = F.coalesce((F.col("l.score") >= threshold) & F.col("l.error").isNull(), F.lit(False))
    status = F.when(passed, "completed").when(F.col("tries") < most, "retry").when(F.col("l.error").isNull(), "completed").otherwise("failed")
    return last.select("paper_id", "tries", F.col("l.score").alias("score"), passed.alias("gate_passed"), status.alias("status"))


def with_batches(papers: DataFrame, size: int = 50) -> DataFrame:
    """``batch_id`` from 0, by the natural order ``ord`` of papers that are numbered from 0."""
    return papers.withColumn("batch_id", F.floor(F.col("ord") / size).cast("int"))
