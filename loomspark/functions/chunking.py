"""Papers into chunks, and evidence with its surroundings (F18–F25). All in a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

BLANK_LINE = r"(?U)\n\s*\n"
HEADING = r"(?m)^##[ \t]+(.+?)\n"
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, X.strip), lambda p: p != "")


def paragraphs(x: Column) -> Column:
    return _filled(F.split(x, BLANK_LINE))


def sentences(x: Column) -> Column:
    return _filled(F.split(x, SENTENCE_END))


def pack(pieces: Column, size: int) -> Column:
    """Neighbouring pieces joined by a blank line as long as they stay within ``size``; a longer piece stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    over = lambda s, p: (s["cur"] != "") & (F.length(s["cur"]) + 2 + F.length(p) > size)
    step = lambda s, p: F.struct(
        F.when(over(s, p), F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
        F.when(over(s, p) | (s["cur"] == ""), p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)).alias("cur"),
    )
    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def chunks(content: Column, size: int = 6000) -> Column:
    """one chunk if the content fits, else sections, cut at paragraphs and, where these are too long, at sentences.

    A section's first chunk begins with ``Section: <title>``; text before the first heading goes, as far as there is one. Null and
    empty contents give one empty chunk.
    """
    c = X.strip(F.coalesce(content, F.lit("")))
    titles = F.regexp_extract_all(c, F.lit(HEADING), 1)
    bodies = F.slice(F.split(c, HEADING), 2, F.greatest(F.size(titles), F.lit(0)))
    named = F.zip_with(titles, bodies, lambda t, b: X.strip(F.concat(F.lit("Section: "), X.strip(t), F.lit("\n"), X.strip(F.coalesce(b, F.lit(""))))))
    blocks = F.when(F.size(titles) > 0, named).otherwise(F.array(c))
    cut = lambda b: pack(F.flatten(F.transform(paragraphs(b), lambda p: F.when(F.length(p) > size, sentences(p)).otherwise(F.array(p)))), size)
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) <= size, F.array(b)).otherwise(cut(b)))))


def section_title(chunk: Column) -> Column:
    """of the first line ``Section: <title>``, else empty."""
    return X.strip(F.regexp_extract(F.coalesce(chunk, F.lit("")), r"^Section:[ \t]*([^\n]*)", 1))


def surroundings(evidence: Column, chunk: Column) -> Column:
    """The first paragraph that holds the evidence, or lies in it, with its neighbours; else 260 characters on both sides; else the first 520."""
    e, c = X.strip(F.coalesce(evidence, F.lit(""))), X.strip(F.coalesce(chunk, F.lit("")))
    ps = paragraphs(c)
    at = F.array_position(F.transform(ps, lambda p: p.contains(e) | e.contains(p)), True)
    near = F.array_join(F.slice(ps, F.greatest(at - 1, F.lit(1)).cast("int"), F.when(at > 1, 3).otherwise(2)), "\n\n")
    pos = F.position(e, c)
    first = F.greatest(pos - 260, F.lit(1))
    window = X.strip(F.substring(c, first, pos - first + F.length(e) + 260))
    return F.when(at > 0, near).when(pos > 0, window).otherwise(X.strip(F.left(c, F.lit(520))))


def evidence_with_context(evidence: Column, chunk: Column, most: int = 1200) -> Column:
    """the evidence and its surroundings, cut to ``most`` characters and a mark; without a chunk, the evidence alone."""
    e = X.strip(F.coalesce(evidence, F.lit("")))
    both = F.concat(F.lit("证据句："), e, F.lit("\n上下文："), surroundings(evidence, chunk))
    cut = F.when(F.length(both) > most, F.concat(F.left(both, F.lit(most)), F.lit("..."))).otherwise(both)
    return F.when((e == "") | (X.strip(F.coalesce(chunk, F.lit(""))) == ""), e).otherwise(cut)
