"""Helpers shared by the corpus operators: scratch tables, row ids and text constants."""

from __future__ import annotations

import atexit
import re
import struct
import tempfile
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the ASCII controls tab to carriage return.
WS = "\\x20\\x09-\\x0D"
WORD = f"[^{WS}]+"

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset, and only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, fixes values that must not be computed twice
    (row ids), and gives the planner real sizes, so that it broadcasts only what is measured to be small.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/loomspark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables made so far. Call it once the results that read them are written."""
    jvm, keep = spark.sparkContext._jvm, []
    for s, path in _made:
        if s is spark:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        else:
            keep.append((s, path))
    _made[:] = keep


@atexit.register
def _release_all() -> None:
    for spark in {s for s, _ in _made}:
        if spark.sparkContext._jsc is not None and getattr(spark.sparkContext._jsc.sc(), "isStopped", lambda: True)() is False:
            release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_rid, doc_id, text, extra...) of every row, whatever other columns there are; null text is empty.

    ``_rid`` numbers rows by partition and position, unless ``docs`` has it from ``numbered``.
    """
    rid = F.col("_rid") if has_rid(docs) else F.monotonically_increasing_id().alias("_rid")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    return docs.select(rid, *cols, *[F.col(c) for c in extra])


_ROW = {"loomspark": "row"}  # tells the numbers of ``numbered`` from a column that just has their name


def has_rid(docs: DataFrame) -> bool:
    return "_rid" in docs.columns and docs.schema["_rid"].metadata == _ROW


def apart(docs: DataFrame, f: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """``f(docs)`` for an ``f`` that keeps the columns: all columns but ``used`` have other names meanwhile, so none meets a name of ``f``'s own."""
    return f(docs.toDF(*(c if c in used else f"_{k}_column" for k, c in enumerate(docs.columns)))).toDF(*docs.columns)


MOST_FILES = 50_000  # more leave no seed that keeps them apart
_FILE_ROWS = 1 << 31  # rows of one file that a number leaves room for


def _file_seed(files: list[str]) -> int | None:
    """A seed under which the files' hashes lie at least ``_FILE_ROWS`` apart; none if there are too many files for one."""
    for seed in range(64):
        start = xxhash.xxh64_intdigest(struct.pack("<q", seed), seed=42)  # what Spark's xxhash64(seed, path) begins with
        at = sorted(xxhash.xxh64_intdigest(f.encode(), seed=start) & (1 << 62) - 1 for f in files)
        if all(y - x >= _FILE_ROWS for x, y in zip(at, at[1:])):
            return seed
    return None


def files_of(docs: DataFrame) -> list[str]:
    """The Parquet files whose rows are those of ``docs``, none of them twice: a relation below projections and filters only; else none."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    relation = plan.relation() if plan.nodeName() == "LogicalRelation" else None
    if relation is None or not relation.getClass().getSimpleName() == "HadoopFsRelation" or "parquet" not in relation.fileFormat().toString().lower():
        return []
    found = relation.location().inputFiles()
    if len(found) > MOST_FILES:
        return []
    files = [re.sub("^([a-z0-9]+:)///", r"\1/", f) for f in found]  # as _metadata.file_path writes them
    return files if len(set(files)) == len(files) else []


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_rid``, a number that stays with its row: decisions can be joined back to their very row even where doc_id is
    null or repeated, and however the files are cut into splits at either reading.

    Rows of Parquet files are numbered by their file and their position in it, as an expression of the scan: nothing is copied.
    A file's rows begin at a hash of its path; the driver, which holds the list of files anyway, picks a seed that keeps them apart. Other
    frames, and tables of so many files that no seed does (some 50,000), are written once with their numbers. Numbering each
    reading by partition would not do: Spark sizes splits by the cores there are just then, so rows can move.
    """
    rest = [F.col(c) for c in docs.columns if c != "_rid"]
    seed = _file_seed(files) if (files := files_of(docs)) else None
    if seed is None:
        return materialize(docs.select(*rest, F.monotonically_increasing_id().alias("_rid", metadata=_ROW)), "numbered")
    meta = docs.metadataColumn("_metadata")
    row = F.when(meta["row_index"] < _FILE_ROWS, meta["row_index"]).otherwise(F.raise_error(F.lit("a file holds more rows than numbers")).cast("long"))
    return docs.select(*rest, (F.xxhash64(F.lit(seed).cast("long"), meta["file_path"]).bitwiseAND(F.lit((1 << 62) - 1)) + row).alias("_rid", metadata=_ROW))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` (a table of ``numbered``) whose ``_rid`` is in ``kept``, without ``_rid``."""
    return docs.join(kept.select("_rid"), "_rid", "left_semi").drop("_rid")


def words_col(text) -> F.Column:
    """The words of a text as an array, without Python."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def n_words_col(text) -> F.Column:
    """The number of words: starts of runs of characters that aren't white space."""
    return F.size(words_col(text)).cast("long")


def sha_hex_utf8(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)
