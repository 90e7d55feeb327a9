"""Papers as JSON files, question files, triple and graph tables, stage files and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import scratch
from .turtle import files

_META = "STRUCT<title STRING, paper_title STRING, document_title STRING, abstract STRING, keywords STRING, keyword STRING, mesh_terms STRING, pmid STRING, doi STRING, journal STRING, year STRING, authors STRING, section_title STRING, page_start INT, page_end INT, lang STRING>"
SECTION = f"STRUCT<id STRING, section_title STRING, title STRING, text STRING, content STRING, metadata {_META}>"
PAYLOAD = f"STRUCT<title STRING, paper_title STRING, document_title STRING, abstract STRING, summary STRING, keywords STRING, keyword STRING, mesh_terms STRING, pmid STRING, doi STRING, journal STRING, year STRING, authors STRING, metadata {_META}, sections STRING>"


def _filled(x: Column) -> Column:
    return F.nullif(X.strip(x), F.lit(""))


def keywords(x: Column) -> Column:
    """A JSON list, or a text with ; , or | between keywords; null without any."""
    listed = F.when(F.ltrim(x).startswith("["), F.from_json(x, "ARRAY<STRING>")).otherwise(F.split(x, "[;,|]"))
    kept = F.filter(F.transform(listed, X.strip), lambda k: k != "")
    return F.when(F.size(kept) > 0, kept)


def section_title(s: Column) -> Column:
    return F.coalesce(_filled(s["metadata"]["section_title"]), _filled(s["section_title"]), _filled(s["title"]), F.lit(""))


def papers(texts: DataFrame) -> DataFrame:
    """One row for each readable file of texts (path, text), in the list or the dict layout.

    Text that is no JSON gives no row (see ``unreadable``). Missing titles fall back to the sections and then to the file's name;
    an empty content falls back to the abstract, then to the title.
    """
    is_list = F.ltrim("text").startswith("[")
    t = texts.select("path", F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), F.when(is_list, F.col("text")).alias("_l"), F.when(~is_list, F.from_json("text", PAYLOAD)).alias("p"), F.try_parse_json("text").isNotNull().alias("_ok")).filter("_ok")
    t = t.withColumn("s", F.coalesce(X.json_maps(F.coalesce("_l", "p.sections"), SECTION), F.from_json(F.lit("[]"), f"ARRAY<{SECTION}>")))
    p, s = F.col("p"), F.col("s")
    text = lambda x: F.coalesce(X.strip(x["text"]), F.lit(""))
    low_id = lambda x: F.lower(X.strip(F.coalesce(x["id"], F.lit(""))))
    of = lambda *names: [_filled(p[n]) for n in names]
    meta = lambda *names: [_filled(p["metadata"][n]) for n in names]
    by_section = lambda x: F.coalesce(
        _filled(x["metadata"]["document_title"]), _filled(x["metadata"]["paper_title"]), F.when(low_id(x).isin("title", "paper_title", "document_title"), _filled(x["text"])),
        F.when(F.lower(section_title(x)).isin("title", "paper title", "document title"), section_title(x)),
    )
    first = lambda a: F.try_element_at(F.filter(a, lambda x: x.isNotNull()), F.lit(1))
    names = ("title", "paper_title", "document_title")
    title = F.coalesce(*of(*names), *meta(*names), first(F.transform(s, by_section)), F.col("id"))
    parts = F.filter(F.transform(F.filter(s, lambda x: (low_id(x) == "abstract") | (F.lower(section_title(x)) == "abstract")), text), lambda x: x != "")
    abstract = F.coalesce(*of("abstract"), *meta("abstract"), *of("summary"), F.array_join(parts, "\n"))
    holds = lambda x: low_id(x).contains("keyword") | F.lower(section_title(x)).contains("keyword")
    given = [keywords(p[c]) for c in ("keywords", "keyword")] + [keywords(p["metadata"][c]) for c in ("keywords", "keyword")] + [keywords(p["mesh_terms"]), keywords(p["metadata"]["mesh_terms"])]
    words = F.coalesce(*given, first(F.transform(F.filter(s, holds), lambda x: keywords(x["text"]))), F.array().cast("array<string>"))
    piece = lambda x: F.concat(F.when(section_title(x) != "", F.concat(F.lit("## "), section_title(x), F.lit("\n\n"))).otherwise(""), F.when(text(x) != "", F.concat(text(x), F.lit("\n\n\n"))).otherwise(""))
    content = X.strip(F.array_join(F.transform(s, lambda x: F.concat(piece(x), F.when(piece(x) != "", "\n").otherwise(""))), ""))
    t = t.withColumn("title", title).withColumn("abstract", abstract)
    rest = [F.coalesce(*of(c), *meta(c)).alias(c) for c in ("pmid", "doi", "journal", "year")] + [F.coalesce(keywords(p[c]), keywords(p["metadata"][c])).alias(c) for c in ("authors", "mesh_terms")]
    return t.select(
        "id", "title", F.coalesce(F.nullif(content, F.lit("")), F.nullif("abstract", F.lit("")), "title").alias("content"), "abstract", words.alias("keywords"), F.col("path").alias("source_path"),
        F.size(s).alias("section_count"), F.transform(s, lambda x: F.struct(F.coalesce(x["id"], F.lit("")).alias("id"), section_title(x).alias("section_title"))).alias("sections"), *rest,
    )


def read_papers(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The papers of a folder's ``*.json`` files, or of the named ones."""
    t = files(spark, f"{path}/*.json")
    return papers(t if names is None else t.filter(F.regexp_extract("path", "([^/]+)$", 1).isin(names)))


def unreadable(texts: DataFrame) -> DataFrame:
    """The paths of files that are no JSON."""
    return texts.filter(F.try_parse_json("text").isNull()).select("path")


def chunks(texts: DataFrame) -> DataFrame:
    """(path, chunk_index from 1, section_id, title, text) of list files or of a single section; text falls back to content."""
    one = F.when(F.ltrim("text").startswith("{"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    t = texts.select("path", F.posexplode(X.json_maps(one, SECTION)).alias("pos", "s"))
    s = F.col("s")
    return t.select("path", (F.col("pos") + 1).alias("chunk_index"), F.coalesce(s["id"], F.lit("")).alias("section_id"), section_title(s).alias("title"), F.coalesce(_filled(s["text"]), _filled(s["content"]), F.lit("")).alias("text"))


def marked(chunked: DataFrame) -> DataFrame:
    """One text a file, each chunk under its marker, in order."""
    part = F.concat(F.lit("=== SECTION: "), "section_id", F.lit(" (CHUNK "), F.col("chunk_index").cast("string"), F.lit(") ===\n"), "text")
    return chunked.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def from_markers(texts: DataFrame) -> DataFrame:
    """The inverse: (path, name, chunk_id, content)."""
    mark = r"=== SECTION: (.+?) \(CHUNK (\d+)\) ==="
    names, ids = F.regexp_extract_all("text", F.lit(mark), 1), F.regexp_extract_all("text", F.lit(mark), 2)
    bodies = F.slice(F.split("text", mark), 2, F.size(names) + 1)
    t = texts.filter(F.size(names) > 0).select("path", F.explode(F.arrays_zip(names.alias("name"), ids.alias("chunk_id"), bodies.alias("content"))).alias("s"))
    return t.select("path", "s.name", F.col("s.chunk_id").cast("int").alias("chunk_id"), X.strip(F.col("s.content")).alias("content"))


def questions(texts: DataFrame) -> DataFrame:
    """(paper_id, section, question, options, correct_answer, explanation) of files paper_<n>_QA_pair.json; others give no row."""
    schema = "ARRAY<STRUCT<section STRING, question STRING, options MAP<STRING, STRING>, correct_answer STRING, explanation STRING>>"
    paper = F.regexp_extract("path", r"paper_(\d+)_QA_pair\.json$", 1)
    return texts.filter(paper != "").select(paper.alias("paper_id"), F.explode(F.from_json("text", schema)).alias("q")).select("paper_id", "q.*")


def triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """A triple table with a header; all columns are texts and a byte order mark is no part of a name."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return t.toDF(*[c.lstrip("﻿") for c in t.columns])


def relation_rows(rows: DataFrame) -> DataFrame:
    """Mentor rows (类型, 名称, 出处, 片段) of relations whose name has exactly three parts, with location and evidence."""
    name, note = F.split("名称", r"\|"), F.coalesce(F.col("片段"), F.lit(""))
    t = rows.filter((F.col("类型") == "关系") & (F.size(name) == 3))
    got = lambda pattern, default: F.coalesce(_filled(F.regexp_extract(note, pattern, 1)), F.lit(default))
    return t.select(*[X.strip(name[k]).alias(c) for k, c in enumerate(("subject", "predicate", "object"))], got(r"位置:\s*(.*?)\s*/\s*chunk", "Unknown").alias("source_section"), got(r"/\s*chunk\s*(\d+)", "0").alias("source_chunk"), got(r"(?s)证据:\s*(.*)$", "").alias("context_text"))


def run_log(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables papers, written, graph and totals of run logs (path, text)."""
    count = r"\s*\n\s*- Claims "
    block = r">>> \[(\d+)\] Paper Summary:" + "".join(count + k + r": (\d+)" for k in ("extracted", "grounded", "validated", "written"))
    written = r"✓ Written: (.+?) -\[(.+?)\]-> (.+?)\n"
    graph = r"(?s)Final Graph Statistics.*?\n.*?Stats: (\d+) nodes, (\d+) relationships"
    overall = r"Papers processed: (\d+)\s*\n" + r"\s*\n".join(f"Total claims {k}: (\\d+)" for k in ("extracted", "grounded", "validated", "written to graph"))

    def table(pattern: str, columns: tuple[str, ...], first: bool = False) -> DataFrame:
        every = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), k + 1).alias(c) for k, c in enumerate(columns)])
        return texts.select("path", F.posexplode(F.slice(every, 1, 1) if first else every).alias("pos", "r")).select("path", "pos", "r.*")

    numbers = lambda t, cs: t.select("path", *[F.col(c).cast("long").alias(c) for c in cs])
    steps = ("extracted", "grounded", "validated", "written")
    w = table(written, ("subject", "relation", "object"))
    return {
        "papers": numbers(table(block, ("paper", *steps)), ("paper", *steps)),
        "written": w.select("path", "pos", X.strip(F.col("subject")).alias("subject"), X.strip(F.col("relation")).alias("relation"), F.left(X.strip(F.col("object")), F.lit(40)).alias("object")),
        "graph": numbers(table(graph, ("nodes", "relationships"), first=True), ("nodes", "relationships")),
        "totals": numbers(table(overall, ("papers", *steps), first=True), ("papers", *steps)),
    }


def prototype_papers(texts: DataFrame) -> DataFrame:
    """(id, title, content) in the older layout: a list of sections; the first section title, else the file's name, is the title; no metadata."""
    t = texts.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), X.json_maps(F.when(F.ltrim("text").startswith("["), F.col("text")), SECTION).alias("s")).filter("s is not null")
    title = lambda x: F.coalesce(x["metadata"]["section_title"], F.lit(""))
    text = lambda x: F.coalesce(X.strip(x["text"]), F.lit(""))
    none = F.array().cast("array<string>")
    lines = lambda x: F.concat(F.when(title(x) != "", F.array(F.concat(F.lit("## "), title(x), F.lit("\n")))).otherwise(none), F.when(text(x) != "", F.array(text(x), F.lit("\n\n"))).otherwise(none))
    first = F.try_element_at(F.filter(F.transform("s", title), lambda x: x != ""), F.lit(1))
    return t.select("id", F.coalesce(first, "id").alias("title"), F.array_join(F.flatten(F.transform("s", lines)), "\n").alias("content"))


def natural_order(names: DataFrame, name: str = "name") -> DataFrame:
    """``ord`` from 0: paper_<n> by number, then other names by text; names are files or their stems. They are written once."""
    number = F.expr(f"try_cast(regexp_extract({name}, '^paper_([0-9]+)([.]json)?$', 1) AS bigint)")
    return scratch.in_order(names, number.isNull(), number, F.col(name), name="ord", tag="names")


def graph_csv(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, entity_type) and triples (subject, predicate, object) of exported tables, each once whatever its case.

    Nodes with ``Ontology`` in their labels and IS_A relations go, and so do rows with an empty name; the first spelling by text stays.
    """
    text = lambda c: X.strip(F.coalesce(F.col(c), F.lit(""))).alias(c)

    def once(t: DataFrame) -> DataFrame:
        return t.groupBy(*[F.lower(c).alias(f"_{c}") for c in t.columns]).agg(F.min(F.struct(*t.columns)).alias("r")).select("r.*")

    e = nodes.select(text("name"), text("entity_type"), text("labels")).filter("name != '' and not contains(labels, 'Ontology')").drop("labels")
    r = relations.select(text("source_name"), text("relation_type"), text("target_name")).filter("source_name != '' and target_name != '' and relation_type != '' and relation_type != 'IS_A'")
    return once(e), once(r.toDF("subject", "predicate", "object"))


def predicted_papers(relations: DataFrame) -> DataFrame:
    """The distinct ``source_paper`` that begin with ``paper_``."""
    return relations.select(X.strip(F.col("source_paper")).alias("source_paper")).filter("startswith(source_paper, 'paper_')").distinct()


def stage_records(texts: DataFrame, schema: str) -> DataFrame:
    """(path, pos, record columns) of stage files: a list, or a map with ``sections``; other texts give no rows."""
    listed = F.when(F.ltrim("text").startswith("["), F.col("text")).otherwise(F.get_json_object("text", "$.sections"))
    return texts.select("path", F.posexplode(X.json_maps(listed, schema)).alias("pos", "r")).select("path", "pos", "r.*")


def newest_report(texts: DataFrame) -> DataFrame:
    """(path, text) of the last ``large_scale_report_*.json`` by name; no row without one."""
    t = texts.filter(F.regexp_extract("path", "([^/]+)$", 1).rlike(r"^large_scale_report_.*\.json$"))
    return t.agg(F.max_by(F.struct("path", "text"), F.regexp_extract("path", "([^/]+)$", 1)).alias("r")).filter("r is not null").select("r.*")
