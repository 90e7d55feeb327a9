"""Turtle as extraction and annotation write it (S13, S14). A file is one row; lines are rows of windows over a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

SECTION = r"# ===== SECTION: (.+?) (?:\(CHUNK \d+\) )?====="
FENCE = r"(?s)```turtle\n(.*?)```"
#: A triple of the extraction dialect, and its type form.
TRIPLE = r"(?U):(\w+(?:-\w+)*)\s+:(\w+)\s+:(\w+(?:-\w+)*)\s*;"
TYPE = r"(?U):(\w+(?:-\w+)*)\s+rdf:type\s+:(\w+(?:-\w+)*)\s*;"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; each must fit a task. The reader passes over files of no bytes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, size_mb, modified_time) of the files of a folder; contents are not read."""
    t = spark.read.format("binaryFile").load(path)
    return t.select("path", F.col("length").alias("size_bytes"), F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), F.col("modificationTime").alias("modified_time"))


def _lines(blocks: DataFrame, *keep: str) -> DataFrame:
    t = blocks.select(*keep, F.posexplode(F.split("block", "\n")).alias("pos", "_raw")).withColumn("line", X.strip(F.col("_raw"))).drop("_raw")
    return t.filter("line != '' AND NOT startswith(line, '#')")


def _got(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def extraction_triples(texts: DataFrame) -> DataFrame:
    """(path, section, chunk, ord, subject, predicate, object, context) of texts (path, text).

    Only a triple that a ``:contextText`` follows counts; literal objects are no triples; ``:sourceSection`` replaces the section,
    whose trailing number goes. Text before the first section and null texts give no rows. ``ord`` orders the triples of a file.
    """
    names = F.regexp_extract_all("text", F.lit(SECTION), 1)
    bodies = F.slice(F.split("text", SECTION), 2, F.size(names) + 1)
    t = texts.filter(F.size(names) > 0).select("path", F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("part", "_s"))
    fenced = F.regexp_extract_all("_s.body", F.lit(FENCE), 1)
    t = t.select("path", "part", F.regexp_replace(X.strip(F.col("_s.name")), r"_\d+$", "").alias("named"), F.posexplode(F.when(F.size(fenced) > 0, fenced).otherwise(F.array("_s.body"))).alias("block_no", "block"))
    line = F.col("line")
    head = F.when(line.rlike(TRIPLE), F.struct(F.regexp_extract(line, TRIPLE, 1).alias("s"), F.regexp_extract(line, TRIPLE, 2).alias("p"), F.regexp_extract(line, TRIPLE, 3).alias("o")))
    head = F.coalesce(head, F.when(line.rlike(TYPE), F.struct(F.regexp_extract(line, TYPE, 1).alias("s"), F.lit("type").alias("p"), F.regexp_extract(line, TYPE, 2).alias("o"))))
    t = _lines(t, "path", "part", "named", "block_no").withColumn("head", head)
    only = lambda c: F.when(F.col("head").isNull(), c)
    t = t.withColumn("chunk", only(_got(line, r':sourceChunk\s+"(\d+)"'))).withColumn("sec", only(_got(line, r':sourceSection\s+"([^"]+)"'))).withColumn("ctx", only(_got(line, r':contextText\s+"([^"]+)"')))
    block = ("path", "part", "block_no")
    upto = Window.partitionBy(*block).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("no", F.count("head").over(upto)).filter("no > 0")
    before = Window.partitionBy(*block, "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("closed", F.count("ctx").over(before)).filter("closed = 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    g = t.groupBy(*block, "no").agg(F.min("named").alias("named"), F.min("pos").alias("pos"), F.max("head").alias("head"), last("chunk"), last("sec"), F.max("ctx").alias("context")).filter("context IS NOT NULL")
    order = F.col("part").cast("long") * (1 << 40) + F.col("block_no").cast("long") * (1 << 28) + F.col("pos")
    return g.select("path", F.coalesce("sec", "named").alias("section"), F.coalesce("chunk", F.lit("")).alias("chunk"), order.alias("ord"), F.col("head.s").alias("subject"), F.col("head.p").alias("predicate"), F.col("head.o").alias("object"), "context")


def gold_triples(texts: DataFrame) -> DataFrame:
    """Distinct (path, subject, predicate, object) in plain words, of the first fenced block or of the whole text.

    A line names a subject, predicate and object, or goes on with the last subject; objects may be literals; contexts are no triples.
    """
    first = F.regexp_extract("text", FENCE, 1)
    t = texts.select("path", F.when(F.col("text").rlike(FENCE), first).otherwise(F.col("text")).alias("block"))
    line = F.col("line")
    full, more = r"^:([A-Za-z0-9_]+)\s+:(\w+)\s+(.+?)(?:\s*[;.])?$", r"^:(\w+)\s+(.+?)(?:\s*[;.])?$"
    t = _lines(t, "path").withColumn("_s", _got(line, full))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("subject", F.last("_s", ignorenulls=True).over(w))
    own = F.col("_s").isNotNull()
    t = t.withColumn("predicate", F.when(own, _got(line, full, 2)).otherwise(_got(line, more, 1))).withColumn("_o", X.strip(F.when(own, _got(line, full, 3)).otherwise(_got(line, more, 2))))
    object_ = F.coalesce(_got(F.col("_o"), "^:([A-Za-z0-9_]+)"), _got(F.col("_o"), '^"([^"]*)"'))
    t = t.withColumn("object", object_).filter("subject IS NOT NULL AND object IS NOT NULL AND predicate != 'contextText'")
    return t.select("path", *[X.camel_to_words(F.col(c)).alias(c) for c in ("subject", "predicate", "object")]).distinct()


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One text ``value`` a triple (section, chunk, subject, predicate, object, context) in the extraction dialect, to be written as text."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    return triples.select(F.concat(
        X.to_uri(F.col("subject")), F.lit(" :"), F.col("predicate"), F.lit(" "), X.to_uri(F.col("object")), F.lit(" ;\n    :sourceChunk "), quoted("chunk"),
        F.lit(" ;\n    :sourceSection "), quoted("section"), F.lit(" ;\n    :contextText "), quoted("context"), F.lit(" .\n"),
    ).alias("value"))


def turtle_counts(texts: DataFrame) -> DataFrame:
    """n_triples, n_entities and n_sections of each file (path, text), null texts included, with a count of 0.

    A triple is a line of a fenced block that ends in a full stop or semicolon and is no comment; an entity is the first word of a
    line with a type; a section is a distinct name in a ``:sourceSection`` or a marker.
    """
    text = F.coalesce("text", F.lit(""))
    blocks = F.array_join(F.regexp_extract_all(text, F.lit("(?ms)^[ \\t]*```turtle[ \\t]*$(.*?)^[ \\t]*```[ \\t]*$"), F.lit(1)), "\n\n")
    lines = F.filter(F.transform(F.split(blocks, "\n"), X.strip), lambda x: (x != "") & ~x.startswith("#"))
    triples = F.filter(lines, lambda x: x.endswith(".") | x.endswith(";"))
    typed = F.filter(lines, lambda x: F.contains(x, F.lit(":")) & (F.contains(x, F.lit("rdf:type")) | F.contains(x, F.lit("a "))))
    entities = F.filter(F.transform(typed, lambda x: F.split(x, "\\s+")[0]), lambda x: x.startswith(":"))
    named = F.regexp_extract_all(blocks, F.lit(':sourceSection\\s+"([^"]+)"'), F.lit(1))
    marked = F.transform(F.regexp_extract_all(blocks, F.lit("# ===== SECTION: ([^=]+) ====="), F.lit(1)), X.strip)
    n = lambda x: F.size(x).cast("long")
    return texts.select("path", n(triples).alias("n_triples"), n(F.array_distinct(entities)).alias("n_entities"), n(F.array_union(named, marked)).alias("n_sections"))


def extraction_counts(texts: DataFrame, types: tuple[str, ...] = ("Model", "Dataset", "Metric", "Method")) -> DataFrame:
    """String statistics of each file (path, text): total_triples, n_<type> of each type, sections and chunks covered."""
    text = F.coalesce("text", F.lit(""))
    times = lambda part: (F.size(F.split(text, "\\Q" + part + "\\E")) - 1).cast("long")
    quoted = lambda mark: F.size(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(mark))), lambda x: F.get(F.split(x, '"'), F.lit(1))))).cast("long")
    total = times(" ;") + times(" .") - times("# ")
    return texts.select("path", total.alias("total_triples"), *[times(f"rdf:type :{t}").alias(f"n_{t.lower()}") for t in types], quoted(":sourceSection").alias("sections_covered"), quoted(":sourceChunk").alias("chunks_covered"))
