"""What goes to a model, as columns and tables: classification texts, contexts, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sections as S
from . import text as X

#: Sections that a summary passes over.
IGNORED = ("references", "acknowledgements", "acknowledgments", "funding", "conflict of interest", "declarations", "author contributions", "supporting information", "supplementary information", "data availability")


def _text(c: str | Column) -> Column:
    return X.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _line(label: str, x: Column) -> Column:
    return F.when(x != "", F.concat(F.lit(label), x))


def identifier_like(title: Column) -> Column:
    """an empty title, or five digits and more between letters once blanks, dashes, colons and slashes are gone."""
    t = _text(title)
    return (t == "") | F.regexp_replace(t, r"(?U)[\s\-_:/]+", "").rlike(r"(?U)^[A-Za-z]*\d{5,}[A-Za-z]*$")


def content_summary(content: Column, sections: int = 2, size: int = 700) -> Column:
    """the beginnings of the first ``sections`` sections with 80 characters and more, else of the whole content; white space is single."""
    c = _text(content)
    mark = r"(?mU)^##\s+(.+?)\n+"
    one = lambda x: X.strip(F.regexp_replace(x, r"(?U)\s+", " "))
    named = F.zip_with(F.regexp_extract_all(c, F.lit(mark), 1), F.slice(F.split(c, mark), 2, F.length(c) + 1), lambda h, b: F.struct(one(h).alias("h"), one(F.coalesce(b, F.lit(""))).alias("b")))
    good = F.slice(F.filter(named, lambda s: (F.length(s.b) >= 80) & ~F.lower(s.h).isin(*IGNORED)), 1, sections)
    parts = F.array_join(F.transform(good, lambda s: F.concat(s.h, F.lit(": "), X.strip(F.left(s.b, F.lit(size))))), "\n")
    return X.let(parts, lambda p: F.when(p != "", p).otherwise(X.strip(F.left(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(sections * size)))))


def classification_text(title: Column, abstract: Column, keywords: Column, content: Column, subdomain: Column, parent: Column) -> Column:
    """title, abstract and keywords, a summary of the content where both are missing, and the assignment there is."""
    words = F.array_join(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), X.strip), lambda k: k != ""), ", ")
    label = F.when(identifier_like(title), "Content summary (fallback because title is identifier-like): ").otherwise("Content summary: ")
    none = (_text(abstract) == "") & (words == "")
    summary = X.let(content_summary(content), lambda s: F.when(none & (s != ""), F.concat(label, s)))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), _text(title)), _line("Abstract: ", _text(abstract)), _line("Keywords: ", words), summary, _line("Assigned subdomain: ", _text(subdomain)), _line("Parent domain: ", _text(parent)))


def extraction_context(title: Column, subdomain: Column, parent: Column, abstract: Column, keywords: Column, content: Column) -> Column:
    """what an extraction is told about the paper; the summary stands in for a missing abstract."""
    words = F.array_join(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), X.strip), lambda k: k != ""), ", ")
    summary = F.when(_text(abstract) == "", X.let(content_summary(content), lambda s: _line("Content summary: ", s)))
    note = "Use the assigned subdomain only as a soft prior for interpreting ambiguous terms. Do not invent any fact that is not explicitly supported by the chunk."
    return F.concat_ws("\n", F.concat(F.lit("Title: "), _text(title)), _line("Assigned subdomain: ", _text(subdomain)), _line("Parent domain: ", _text(parent)), _line("Abstract: ", _text(abstract)), _line("Keywords: ", words), summary, F.lit(note))


def claim_context(title: Column, subdomain: Column, parent: Column, section: Column) -> Column:
    """the lines of a claim's origin that are there."""
    return F.concat_ws("\n", _line("论文标题: ", F.coalesce(title, F.lit(""))), _line("论文子领域: ", F.coalesce(subdomain, F.lit(""))), _line("父领域: ", F.coalesce(parent, F.lit(""))), _line("章节: ", F.coalesce(section, F.lit(""))))


def entity_context(evidence: Column, title: Column, subdomain: Column, section: Column, claim_type: Column) -> Column:
    """the evidence and its origin in one line."""
    first = F.concat(F.lit("证据: "), F.left(F.coalesce(evidence, F.lit("")), F.lit(200)), F.lit("..."))
    return F.concat_ws(" | ", first, *[_line(n, F.coalesce(x, F.lit(""))) for n, x in (("论文标题: ", title), ("论文子领域: ", subdomain), ("章节: ", section), ("声明类型: ", claim_type))])


def claim_type_text(claim_type: Column) -> Column:
    return F.when(claim_type == "ontology", "本体").otherwise("实例")


def hierarchy_text(edges: DataFrame, root: str, most: int = 200) -> DataFrame:
    """One row ``text``: the first ``most`` edges (child, parent, source) in order as lines, else the root alone."""
    line = F.concat("child", F.lit(", rdfs:subClassOf, "), "parent", F.lit(", null, "), F.coalesce(F.nullif("source", F.lit("")), F.lit("graph")))
    few = edges.filter("child != '' and parent != ''").orderBy("child", "parent").limit(most)
    lines = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "parent", line.alias("l")))), lambda x: x.l), "\n").alias("t"))
    return lines.select(F.coalesce(F.nullif("t", F.lit("")), F.lit(f"{root}, rdfs:subClassOf, null, null, system")).alias("text"))


def classification_prompts(papers: DataFrame, hierarchy: DataFrame, root: str, allow_new: bool = True, most: int = 6000) -> DataFrame:
    """(paper_id, payload): the question for each paper (paper_id, text); texts are cut after ``most`` characters. The hierarchy is one bounded row."""
    text = F.when(F.length("text") > most, F.concat(F.rtrim(F.left("text", F.lit(most))), F.lit("..."))).otherwise(F.col("text"))
    head = f"[Top Domain] {root}\n[Allow New Subdomain] {'Yes' if allow_new else 'No'}\n[Given Hierarchy]\n"
    return papers.select("paper_id", text.alias("_t")).join(F.broadcast(hierarchy.select(F.col("text").alias("_h")))).select("paper_id", F.concat(F.lit(head), "_h", F.lit("\n\n[Given Text]\n"), "_t", F.lit("\n")).alias("payload"))


def mentor_prompts(chunked: DataFrame, rules: str, every: bool = False) -> DataFrame:
    """(path, payload): the rules and the selected chunks of each paper in order; a paper's selection is a few chunks."""
    where = S.location(F.col("title"), F.col("section_id"), F.col("chunk_index"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    block = F.concat(F.lit("[CHUNK "), "chunk_index", F.lit("] id="), "section_id", F.lit(" title='"), "title", F.lit("' loc="), where, F.lit("\n"), X.strip(F.col("text")))
    t = S.selected_chunks(chunked, every).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("picked", block.alias("b")))).alias("bs"))
    return t.select("path", F.concat(F.lit(rules + "\n\nPaper snippets:\n\n"), F.array_join(F.transform("bs", lambda x: x.b), "\n\n")).alias("payload"))


def section_prompts(chunked: DataFrame, rules: str, most: int = 40_000) -> DataFrame:
    """(path, chunk_index, payload): one question a section; a paper without sections asks once for its first ``most`` characters."""
    body = F.when(F.coalesce("section_id", F.lit("")) == "", F.left("text", F.lit(most))).otherwise(F.col("text"))
    return chunked.filter(X.strip(F.coalesce("text", F.lit(""))) != "").select("path", "chunk_index", F.concat(F.lit(rules + "\n\nSection: "), F.coalesce("section_id", F.lit("")), F.lit("\n"), body).alias("payload"))


def cluster_prompts(relations: DataFrame, rules: str, most: int = 150) -> DataFrame:
    """One row ``payload``: the rules and the ``most`` most frequent relations (subject, predicate, object, n, ord), numbered in order."""
    few = relations.orderBy(F.desc("n"), "ord").limit(most)
    rows = few.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "ord", "subject", "predicate", "object", "n"))).alias("rs"))
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r.subject, F.lit(" | "), r.predicate, F.lit(" | "), r.object, F.lit(" ("), r.n, F.lit(")"))
    return rows.select(F.concat(F.lit(rules + "\n"), F.array_join(F.transform("rs", line), "\n")).alias("payload"))
