"""Export tables and files (K01–K23). Rows are built by functions; one call writes them, by all tasks, as a folder of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import to_uri
from ..operators.judge import cleaned
from . import scratch

ASSIGNMENT = ("paper_id", "paper_title", "subdomain", "parent_domain", "status", "is_new_subdomain", "batch_id", "taxonomy_version", "reason", "confidence", "new_relations")
CLAIM = ("paper_id", "paper_title", "subdomain", "parent_domain", "claim_type", "subject", "relation", "object", "confidence", "section_title", "evidence")
REFINEMENT = ("candidate", "action", "target_subdomain", "parent_domain", "reason", "applied_taxonomy_version")


def cut(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def _as(t: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The listed columns; absent ones are null texts, lists and structs become JSON."""
    have = dict(t.dtypes)
    one = lambda c: F.lit(None).cast("string") if c not in have else F.to_json(c) if have[c].startswith(("array", "struct", "map")) else F.col(c)
    return t.select(*[one(c).alias(c) for c in columns])


def assignment_rows(assignments: DataFrame) -> DataFrame:
    """K01."""
    return _as(assignments, ASSIGNMENT)


def claim_rows(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims with their paper's title and domains; claims of unknown papers stay."""
    p = papers.select(F.col("id").alias("source_paper_id"), F.col("title").alias("paper_title"), "subdomain", "parent_domain")
    mine = [c for c in claims.columns if c not in ("paper_title", "subdomain", "parent_domain")]
    return _as(claims.select(*mine).join(p, "source_paper_id", "left").withColumn("paper_id", F.col("source_paper_id")), CLAIM)


def refinement_rows(decisions: DataFrame) -> DataFrame:
    """K03."""
    return _as(decisions, REFINEMENT)


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes by id, labels joined by a semicolon."""
    return _as(nodes.withColumn("labels", F.array_join("labels", ";")), ("id", "name", "labels", "is_concept", "entity_type", "created_at", "updated_at")).orderBy("id")


def edge_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends (null for an end that is no node), in the order of the ends; evidence of at most 500 characters and a mark."""
    names = nodes.select("id", "name")
    for end, as_ in (("src", "source"), ("dst", "target")):
        edges = edges.withColumnRenamed(end, f"{as_}_id").join(names.toDF(f"{as_}_id", f"{as_}_name"), f"{as_}_id", "left")
    t = edges.withColumnRenamed("rel_type", "relation_type").withColumn("evidence", cut(F.col("evidence"), 500))
    return _as(t, ("source_id", "source_name", "target_id", "target_name", "relation_type", "is_ontology", "evidence", "source_paper_id", "source_paper")).orderBy("source_id", "target_id")


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A statement (``value``) for each node, then for each edge; evidence of at most 100 characters."""
    q = lambda x: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("CREATE (:"), F.array_join("labels", ":"), F.lit(" {id: "), q(F.col("id")), F.lit(", name: "), q(F.col("name")), F.lit("});")).alias("value"))
    e = edges.select(F.lit(1), F.concat(F.lit("MATCH (a {id: "), q(F.col("src")), F.lit("}), (b {id: "), q(F.col("dst")), F.lit("}) CREATE (a)-[:"), "rel_type", F.lit(" {evidence: "), q(F.left("evidence", F.lit(100))), F.lit("}]->(b);")))
    return n.union(e).orderBy("part", "value").select("value")


def json_lines(t: DataFrame, evidence: int | None = 200) -> DataFrame:
    """Each row as JSON, long evidence cut."""
    if evidence is not None and "evidence" in t.columns:
        t = t.withColumn("evidence", F.left("evidence", F.lit(evidence)))
    return t.select(F.to_json(F.struct(*t.columns)).alias("value"))


def mentor_rows(triples: DataFrame, per_paper: int = 40) -> DataFrame:
    """The first ``per_paper`` triples of each paper by ``ord`` in the four columns of the exchange format."""
    first = triples.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))).filter(F.col("_n") <= per_paper)
    name = F.concat_ws(" | ", "subject", "predicate", "object")
    note = F.concat(F.lit("位置: "), "section", F.lit(" / chunk "), "chunk", F.lit(" | 证据: "), "context")
    return first.select(F.lit("关系").alias("类型"), name.alias("名称"), F.col("paper_id").alias("出处"), note.alias("片段"))


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """All results, the new row where both hold a (paper_id, question, model); each side's rows of a key become one."""
    rest = [c for c in old.columns if c not in ("paper_id", "question", "model")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    row = F.struct("_new", *rest)
    return both.groupBy("paper_id", "question", "model").agg(F.max(row).alias("_r")).select("paper_id", "question", "model", *[f"_r.{c}" for c in rest])


def evaluation_rows(answers: DataFrame, threshold: float) -> DataFrame:
    """(path, final_score, passed, key_advice, priority_fixes) of answers (path, response); malformed ones score null and fail."""
    r = F.from_json(cleaned(F.col("response")), "STRUCT<final_score DOUBLE, summary_advice STRING, top_fixes ARRAY<STRING>>")
    t = answers.select("path", r.alias("r"))
    return t.select("path", F.col("r.final_score").alias("final_score"), F.coalesce(F.col("r.final_score") >= threshold, F.lit(False)).alias("passed"),
                    F.col("r.summary_advice").alias("key_advice"), F.slice("r.top_fixes", 1, 3).alias("priority_fixes"))


def question_rows(answers: DataFrame) -> DataFrame:
    """Section, question, options, correct_answer, explanation of answers (section, response); malformed ones and those without any of the four fields go."""
    q = F.from_json(cleaned(F.col("response")), "STRUCT<question STRING, options MAP<STRING, STRING>, correct_answer STRING, explanation STRING>")
    return answers.select("section", q.alias("q")).select("section", "q.*").dropna(subset=["question", "options", "correct_answer", "explanation"])


def representative_rows(selected: DataFrame, relations: DataFrame) -> DataFrame:
    """Each selected (subject, predicate, object) as identifiers, with its best place (longest context, then the first) and frequency; one without a place stays."""
    spo = ["subject", "predicate", "object"]
    place = F.struct(F.length("context").alias("n"), (-F.col("ord")).alias("o"), "section", "chunk", "context", "paper")
    known = relations.groupBy(*spo).agg(F.max(place).alias("b"), F.count("*").alias("frequency"))
    t = selected.select(*spo).distinct().join(known, spo, "left")
    text = lambda c: F.coalesce(f"b.{c}", F.lit(""))
    return t.select(*[to_uri(F.col(c)).alias(c) for c in spo], text("section").alias("source_section"), text("chunk").alias("source_chunk"), text("context").alias("context_text"), text("paper").alias("出处"), F.coalesce("frequency", F.lit(0)).alias("frequency"))


def nested_sections(chunks: DataFrame) -> DataFrame:
    """One row a paper section with its chunks in order, from (paper_id, section, ord, chunk_id, text); a section's chunks travel together."""
    one = F.struct("ord", "chunk_id", "text")
    t = chunks.groupBy("paper_id", "section").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(one)).alias("chunks"))
    return t.withColumn("content_length", F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.coalesce(F.length(c.text), F.lit(0))))


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """Each stage's rows (with paper_id) as JSON below stage=NAME/paper_id=ID; a rerun replaces the stages it writes."""
    for name, rows in stages.items():
        rows.write.mode("overwrite").partitionBy("paper_id").json(f"{path}/stage={name}")


def write_report(totals: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    totals.coalesce(1).write.mode("overwrite").json(path)


def write_csv(t: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, quotes doubled, nulls empty."""
    t.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="")


def write_text(t: DataFrame, path: str) -> None:
    """A folder of text files of a frame with one column."""
    t.write.mode("overwrite").text(path)


def write_named(texts: DataFrame, path: str) -> None:
    """One file for each ``name`` of (name, value) rows, below ``path``: tasks write them, then the driver gives each its name.

    The rows of a name are one task's and go into its file in no stated order, so a name is meant to have one row.
    """
    spark, part = texts.sparkSession, f"{path}/_parts"
    texts.repartition("name").write.mode("overwrite").partitionBy("name").text(part)
    f, root = scratch.fs(spark, part)
    to = spark._jvm.org.apache.hadoop.fs.Path
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for one in f.listStatus(root):
        if one.isDirectory():
            name = unescape(one.getPath().getName()[len("name=") :])
            for file in f.listStatus(one.getPath()):
                f.rename(file.getPath(), to(f"{path}/{name}"))
    f.delete(root, True)


def write_sorted(t: DataFrame, path: str, key: str) -> None:
    """A Parquet table in ranges of ``key``, sorted inside them, so that a search for a key reads few files and row groups."""
    t.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def turtle_files(papers: DataFrame) -> DataFrame:
    """(name, value) of two files a paper (paper_name, passed, suggestions, timestamp, turtle, metadata): the graph below its verdict, and the verdict as JSON."""
    base = F.regexp_replace("paper_name", r"\.json$", "")
    passed = F.when(F.col("passed"), "True").otherwise("False")
    more = F.when(F.coalesce("suggestions", F.lit("")) != "", F.concat(F.lit("# Improvement Suggestions: "), "suggestions", F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("# ===== EVALUATION RESULTS =====\n# Evaluation Passed: "), passed, F.lit("\n# Can Proceed to QA Generation: "), passed, F.lit("\n# Timestamp: "), "timestamp", F.lit("\n"), more, F.lit("# ===== KNOWLEDGE GRAPH =====\n\n"))
    note = F.to_json(F.struct("paper_name", F.col("passed").alias("evaluation_passed"), F.col("passed").alias("can_proceed_to_qa"), F.col("suggestions").alias("improvement_suggestions"), "timestamp", "metadata"))
    two = F.array(F.struct(F.concat(base, F.lit("_extraction.ttl")).alias("name"), F.concat(head, F.coalesce("turtle", F.lit(""))).alias("value")), F.struct(F.concat(base, F.lit("_metadata.json")).alias("name"), note.alias("value")))
    return papers.select(F.inline(two))


def question_statistics(questions: DataFrame) -> DataFrame:
    """(kind, value, n, percent): the questions in all, by section and by correct answer; percent of the answers only."""
    q = questions.select("section", "correct_answer")
    t = q.rollup("section").agg(F.count("*").alias("n")).select(F.when(F.col("section").isNull(), "total").otherwise("section").alias("kind"), F.coalesce("section", F.lit("")).alias("value"), "n", F.lit(None).cast("double").alias("percent"))
    a = q.groupBy("correct_answer").agg(F.count("*").alias("n"))
    total = q.agg(F.count("*").alias("_t"))
    a = a.join(F.broadcast(total)).select(F.lit("answer").alias("kind"), F.col("correct_answer").alias("value"), "n", (100 * X.ratio(F.col("n"), F.col("_t"))).alias("percent"))  # one row is broadcast
    return t.union(a)


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions in full and with their five fields as JSON, and their statistics as text."""
    questions.write.mode("overwrite").json(f"{path}/detailed")
    questions.select("section", "question", "options", "correct_answer", "explanation").write.mode("overwrite").json(f"{path}/simplified")
    s = question_statistics(questions)
    line = F.when(F.col("kind") == "total", F.concat(F.lit("Total QA Pairs Generated: "), "n")).when(F.col("kind") == "section", F.concat(F.lit("  "), "value", F.lit(": "), "n")).otherwise(F.concat(F.lit("  "), "value", F.lit(": "), "n", F.lit(" ("), F.format_number("percent", 1), F.lit("%)")))
    order = F.when(F.col("kind") == "total", 0).when(F.col("kind") == "section", 1).otherwise(2)
    s.orderBy(order, "value").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/stats")


def representative_report(rows: DataFrame) -> DataFrame:
    """The lines of a Markdown report over ``representative_rows``, by frequency; one entry a relation."""
    line = F.concat(F.lit("- **"), "subject", F.lit("** "), "predicate", F.lit(" **"), "object", F.lit("** (frequency "), "frequency", F.lit(")"), F.when(F.col("context_text") != "", F.concat(F.lit(": "), cut(F.col("context_text"), 200))).otherwise(""))
    return rows.orderBy(F.desc("frequency"), "subject", "predicate", "object").select(line.alias("value"))


def serialised(t: DataFrame, *columns: str) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return t.select(F.to_json(F.struct(*(columns or t.columns)), {"ignoreNullFields": "false"}).alias("value"))
