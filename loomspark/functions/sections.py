"""Papers as sections and chunks of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cleaning as L
from . import text as X

#: Words of a title line, and the outlines that are trusted.
TITLE_WORDS = ("learning", "model", "network", "algorithm")
FEWEST, MOST = 3, 20
_TEXTS = "array<string>"


# ---- chunks


def _last(x: Column, part: str) -> Column:
    """The position of the last ``part`` in x from 0, -1 without one."""
    back = F.position(F.lit(part[::-1]), F.reverse(x))
    return F.when(back > 0, F.length(x) - back - len(part) + 1).otherwise(-1)


def windows(unit: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters, cut at the last blank or stop if that lies beyond 60 per cent of the size."""
    def take(s: Column, _: Column) -> Column:
        window = F.left(s.rest, F.lit(size))
        best = lambda w: F.greatest(*[_last(w, p) for p in ("\n\n", "\n", ". ", "。", " ")])
        end = X.let(window, lambda w: F.when((F.length(s.rest) > size) & (best(w) > int(size * 0.6)), best(w) + 1).otherwise(F.length(w)))
        next_ = lambda e: F.struct(
            F.when(X.strip(F.left(s.rest, e)) != "", F.array_append(s.done, X.strip(F.left(s.rest, e)))).otherwise(s.done).alias("done"), F.substring(s.rest, e + 1, F.length(s.rest)).alias("rest"))
        return F.when(s.rest == "", s).otherwise(X.let(end, next_))

    steps = F.sequence(F.lit(0), F.ceil(F.length(unit) / (size * 0.6)).cast("int"))
    return F.aggregate(steps, F.struct(F.array().cast(_TEXTS).alias("done"), unit.alias("rest")), take, lambda s: s.done)


def units(text: Column, size: int, windowed: bool = True) -> Column:
    """Paragraphs, long ones as sentences, and longer ones in windows unless they are to stay whole."""
    filled = lambda xs: F.filter(F.transform(xs, X.strip), lambda x: x != "")
    parts = lambda x, pattern: filled(F.split(x, pattern))
    smaller = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(parts(p, r"(?U)(?<=[.!?。！？])\s+"))
    us = F.flatten(F.transform(parts(text, r"\n\s*\n+"), smaller))
    return F.flatten(F.transform(us, lambda u: F.when(F.length(u) <= size, F.array(u)).otherwise(windows(u, size)))) if windowed else us


def chunks(text: Column, prefix: Column, size: int = 5000, windowed: bool = True) -> Column:
    """(chunk_id, content, start_char, end_char, word_count) of a text: neighbouring units joined by a blank line as far as they fit.

    Ids are the prefix, then the prefix with 2, 3...; starts add up the lengths of the contents before. Blank texts have no chunk.
    Without ``windowed`` a sentence longer than the size stays whole, as a chunk of its own.
    """
    def fit(s: Column, u: Column) -> Column:
        over = (s.cur != "") & (F.length(s.cur) + 2 + F.length(u) > size)
        return F.struct(F.when(over, F.array_append(s.done, s.cur)).otherwise(s.done).alias("done"), F.when(over | (s.cur == ""), u).otherwise(F.concat(s.cur, F.lit("\n\n"), u)).alias("cur"))

    packed = F.aggregate(units(X.strip(F.coalesce(text, F.lit(""))), size, windowed), F.struct(F.array().cast(_TEXTS).alias("done"), F.lit("").alias("cur")), fit, lambda s: F.when(s.cur == "", s.done).otherwise(F.array_append(s.done, s.cur)))
    start = lambda xs, i: F.aggregate(F.slice(xs, 1, i), F.lit(0), lambda n, x: n + F.length(x))
    row = lambda xs, x, i: X.let(start(xs, i), lambda at: F.struct(
        F.when(i == 0, prefix).otherwise(F.concat(prefix, (i + 1).cast("string"))).alias("chunk_id"), x.alias("content"), at.alias("start_char"), (at + F.length(x)).alias("end_char"), X.n_words(x).alias("word_count")))
    return X.let(packed, lambda xs: F.transform(xs, lambda x, i: row(xs, x, i)))


def section_key(title: Column) -> Column:
    """the prefix of a section's chunks: its title in small letters and digits, else ``section``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(L.clean_title(title)), "[^a-z0-9]", ""), F.lit("")), F.lit("section"))


def records(sections: DataFrame, size: int = 5000) -> DataFrame:
    """(path, pos, id, section_title, page_start, page_end, text): the chunks of sections (path, section_no, title, content, page_start, page_end) in order."""
    t = sections.select("path", "section_no", "title", "page_start", "page_end", F.posexplode(chunks(F.col("content"), section_key(F.col("title")), size)).alias("k", "c"))
    return t.select("path", (F.col("section_no") * 100_000 + F.col("k")).alias("pos"), F.col("c.chunk_id").alias("id"), F.col("title").alias("section_title"), "page_start", "page_end", F.col("c.content").alias("text"))


# ---- pages to sections


def boundary_lines(pages: DataFrame) -> DataFrame:
    """(path, line, n): the normal forms, of 6 to 100 characters, that are among the first and last three filled lines of a document's pages at least twice."""
    lines = F.filter(F.transform(F.split(L.artifacts(F.col("text")), "\n"), X.strip), lambda x: x != "")
    ends = X.let(lines, lambda ls: F.concat(F.slice(ls, 1, 3), F.slice(ls, F.greatest(F.size(ls) - 2, F.lit(1)), 3)))
    t = pages.select("path", F.explode(ends).alias("_l")).select("path", L.boundary_key(F.col("_l")).alias("line")).filter(F.length("line").between(6, 100))
    return t.groupBy("path", "line").agg(F.count("*").alias("n")).filter("n >= 2")


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages (path, page, text) without noise, running heads, captions and front matter; a document's few running heads travel to its pages."""
    heads = boundary_lines(pages).groupBy("path").agg(F.collect_list("line").alias("_heads"))
    t = pages.join(heads, "path", "left").withColumn("_heads", F.coalesce("_heads", F.array().cast(_TEXTS)))
    return t.select("path", "page", L.clean_block(F.col("text"), F.col("_heads")).alias("text"))


def by_headings(pages: DataFrame) -> DataFrame:
    """Sections (path, section_no, title, content, page_start, page_end) of cleaned pages (path, page, text), cut at heading lines.

    In a page's first three lines a heading may go on without a colon. Text before the first heading goes; the first tail heading after
    it ends the document; a section ends on the page of the next heading. Sections without content are left out and not numbered.
    """
    line = F.col("line")
    t = pages.filter(X.strip(F.coalesce("text", F.lit(""))) != "").select("path", "page", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", X.strip(line)).filter("line != ''")
    names = L.names_literal({k: (v, False) for k, v in L.SECTION_NAMES.items()})
    rest = lambda a: X.strip(F.substring(line, F.length(a.k) + 1, F.length(line)))
    loose = F.get(F.filter(names, lambda a: F.startswith(F.lower(line), a.k) & ~F.substring(line, F.length(a.k) + 1, F.lit(1)).rlike(r"(?U)\w") & (rest(a) != "")), F.lit(0))
    h = F.coalesce(L.heading(line), F.when(F.col("i") < 3, X.let(F.struct(loose.alias("a")), lambda x: F.when(x.a.isNotNull(), F.struct(x.a.v.alias("name"), F.lit(False).alias("tail"), rest(x.a).alias("rest"))))))
    t = t.withColumn("h", h)
    upto = Window.partitionBy("path").orderBy("page", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("n", F.count(F.when(~F.col("h.tail"), 1)).over(upto)).filter("n > 0")
    t = t.withColumn("ended", F.max(F.coalesce("h.tail", F.lit(False))).over(upto))
    # The page of the next heading, or of the tail; else the document's last filled page.
    last = pages.groupBy("path").agg(F.max("page").alias("_last"))
    stop = t.filter("ended").groupBy("path").agg(F.min("page").alias("_stop"))
    body = F.when(F.col("h").isNull(), line).otherwise(F.nullif("h.rest", F.lit("")))
    s = t.filter("not ended").groupBy("path", "n").agg(F.max("h.name").alias("title"), F.min("page").alias("page_start"), F.array_sort(F.collect_list(F.struct("page", "i", body.alias("x")))).alias("ls"))
    s = s.withColumn("page_end", F.lead("page_start").over(Window.partitionBy("path").orderBy("n")))
    text = L.before_tail(F.array_join(L.merged(F.filter(F.transform("ls", lambda x: x.x), lambda x: x.isNotNull())), "\n"))["text"]
    s = s.join(last, "path").join(stop, "path", "left").select("path", "n", "title", text.alias("content"), "page_start", F.coalesce("page_end", "_stop", "_last").alias("page_end")).filter("content != ''")
    return s.select("path", F.row_number().over(Window.partitionBy("path").orderBy("n")).alias("section_no"), "title", "content", "page_start", "page_end")


def by_size(pages: DataFrame, size: int = 5000) -> DataFrame:
    """Sections ``Chunk n`` of documents without headings: the pages' text up to its tail, in chunks."""
    t = pages.filter("text != ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"), F.max("page").alias("page_end"))
    whole = L.before_tail(F.array_join(F.transform("ps", lambda p: p.text), "\n\n"))["text"]
    t = t.select("path", "page_end", F.posexplode(chunks(whole, F.lit("chunk"), size)).alias("k", "c"))
    return t.select("path", (F.col("k") + 1).alias("section_no"), F.concat(F.lit("Chunk "), F.col("k") + 1).alias("title"), F.col("c.content").alias("content"), F.lit(1).alias("page_start"), "page_end")


def split_documents(pages: DataFrame, size: int = 5000) -> DataFrame:
    """Each document by its headings, else in chunks."""
    clean = clean_pages(pages)
    s = by_headings(clean)
    rest = clean.join(s.select("path").distinct(), "path", "left_anti")
    return s.select("path", "section_no", "title", "content", "page_start", "page_end").unionByName(by_size(rest, size))


def batch_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counters over documents (path, error): total, successes, without an outline, with too many bookmarks, other failures."""
    e = F.coalesce("error", F.lit(""))
    none, many = e.contains("No bookmark structure found"), e.contains("Too many bookmarks")
    return outcomes.agg(F.count("*").alias("total_files"), F.count_if(e == "").alias("processed_successfully"), F.count_if(none).alias("skipped_no_bookmarks"), F.count_if(many & ~none).alias("skipped_too_many_bookmarks"), F.count_if((e != "") & ~none & ~many).alias("failed"))


# ---- outlines


def good_title(title: Column) -> Column:
    """Titles of CJK text, with a capital first letter after a number, without a letter, and abstracts in any case."""
    t = X.strip(F.coalesce(title, F.lit("")))
    letter = F.regexp_extract(t, r"^[\d.\s]*([a-zA-Z])", 1)
    return (t != "") & (t.rlike(r"(?i)^abstract\b") | t.rlike("^[一-鿿]") | (letter == "") | letter.rlike("[A-Z]"))


def outline(bookmarks: DataFrame, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """The bookmarks (path, ord, title, page, level) that cut a document: good titles, before the first that names references.

    Documents with fewer or more good titles than stated have no outline.
    """
    good = bookmarks.filter(good_title(F.col("title")))
    n = good.groupBy("path").agg(F.count("*").alias("_n")).filter(F.col("_n").between(fewest, most)).select("path")
    ref = F.lower(X.strip(F.col("title"))).rlike("|".join(L.REFERENCES))
    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return good.join(n, "path", "left_semi").withColumn("_ref", F.max(ref).over(w)).filter("not _ref").drop("_ref")


def page_ranges(outlined: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, section_no, title, page_start, page_end), from 1, of an outline with pages from 0; pages: path, total_pages.

    A section ends before the next bookmark of its level or above, on its own page if that one begins there, else with the document. An
    outline has at most ``MOST`` bookmarks, so it fits a row.
    """
    t = outlined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "level", "title"))).alias("bs")).join(pages, "path")
    def end(b: Column, i: Column) -> Column:
        later = F.get(F.filter(F.slice("bs", i + 2, F.size("bs")), lambda x: x.level <= b.level), F.lit(0))
        return X.let(F.struct(later.alias("x")), lambda n: F.when(n.x.isNull(), F.col("total_pages") - 1).when(n.x.page == b.page, b.page).otherwise(n.x.page - 1))

    t = t.select("path", F.posexplode(F.transform("bs", lambda b, i: F.struct(L.clean_title(b.title).alias("title"), (b.page + 1).alias("page_start"), (end(b, i) + 1).alias("page_end")))).alias("k", "s"))
    return t.select("path", (F.col("k") + 1).alias("section_no"), "s.*")


# ---- records (P11) and their selection


def clean_records(recs: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Records (path, pos, id, section_title, page_start, text) cleaned, with ``tail_truncated``; those that don't hold up are left out.

    Tail sections and records of fewer than 20 words go, and so do untitled chunks of the first page with fewer than 180 words and
    fewer than two lines of body text. A heading at the beginning gives an untitled record its title.
    """
    heads = boundary_lines(recs) if heads is None else heads
    h = heads.groupBy("path").agg(F.collect_list("line").alias("_heads"))
    filled = lambda x: F.filter(F.transform(F.split(x, "\n"), X.strip), lambda y: y != "")
    t = recs.join(h, "path", "left").withColumn("title0", X.strip(F.coalesce("section_title", F.lit(""))))
    t = _computed(t, _th=L.heading(F.col("title0"))).filter(~F.coalesce("_th.tail", F.lit(False)))
    t = _computed(t, _b=L.before_tail(L.clean_block(F.col("text"), F.coalesce("_heads", F.array().cast(_TEXTS)))))
    t = _computed(t, _ls=filled(F.col("_b.text"))).filter(F.size("_ls") > 0)
    t = _computed(t, _h=L.heading(F.get("_ls", F.lit(0)))).filter(~F.coalesce("_h.tail", F.lit(False)))
    untitled = (F.col("title0") == "") | F.lower("title0").startswith("chunk")
    named = F.col("_h").isNotNull() & untitled
    rest = F.when(F.col("_h.rest") != "", F.array("_h.rest")).otherwise(F.array().cast(_TEXTS))
    t = _computed(t, _ls2=F.when(named, F.concat(rest, F.slice("_ls", 2, F.size("_ls")))).otherwise(F.col("_ls")), section=F.when(named, F.col("_h.name")).otherwise(F.coalesce("_th.name", "title0")))
    t = _computed(t, _c=L.before_tail(F.array_join(L.record_lines(F.col("_ls2"), F.col("section")), "\n")))
    t = _computed(t, _ms=L.merged(filled(F.col("_c.text"))))
    t = _computed(t, _t=F.array_join("_ms", "\n"), _n=X.n_words(F.array_join("_ms", "\n"))).filter("_n >= 20")
    weak = F.lower("section").startswith("chunk") & (F.coalesce("page_start", F.lit(1)) == 1) & (F.col("_n") < 180) & (F.size(F.filter("_ms", L.is_body)) < 2)
    return t.filter(~weak).select("path", "pos", "id", F.col("section").alias("section_title"), "page_start", F.col("_t").alias("text"), (F.col("_b.cut") | F.col("_c.cut")).alias("tail_truncated"))


def _computed(t: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that no filter behind them is computed again from: they come out of a generator, which filters don't pass."""
    return t.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def is_abstract(title: Column) -> Column:
    t = F.lower(X.strip(F.coalesce(title, F.lit(""))))
    return t.rlike(r"(?U)\babstract\b") | t.isin("摘要", "中文摘要", "摘要：", "abstract:")


def is_intro(title: Column) -> Column:
    t = F.lower(X.strip(F.coalesce(title, F.lit(""))))
    return t.rlike(r"(?U)\bintroduction\b") | t.isin("引言", "前言", "背景")


def is_closing(title: Column) -> Column:
    t = F.lower(X.strip(F.coalesce(title, F.lit(""))))
    return t.rlike(r"(?U)\bdiscussion\b|\bconclusion\b") | t.isin("讨论", "结论", "总结")


def selected_chunks(chunked: DataFrame, every: bool = False) -> DataFrame:
    """Of the filled chunks (path, chunk_index, title, text) abstracts and introductions, else the first two; then discussions and conclusions. ``picked`` orders them."""
    t = chunked.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != "")
    if every:
        return t.withColumn("picked", F.row_number().over(Window.partitionBy("path").orderBy("chunk_index")))
    early = is_abstract(F.col("title")) | is_intro(F.col("title"))
    w = Window.partitionBy("path")
    t = t.withColumn("_any", F.max(early).over(w)).withColumn("_k", F.row_number().over(w.orderBy("chunk_index")))
    first = F.when(F.col("_any"), early).otherwise(F.col("_k") <= 2)
    t = t.withColumn("_group", F.when(first, 0).when(is_closing(F.col("title")), 1)).filter("_group is not null")
    return t.withColumn("picked", F.row_number().over(w.orderBy("_group", "chunk_index"))).drop("_any", "_k", "_group")


# ---- labels


def guessed_title(text: Column) -> Column:
    """the first of the first ten lines with 11 to 199 characters and a word of titles, else ``Unknown Title``."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10), X.strip)
    fits = lambda x: (F.length(x) > 10) & (F.length(x) < 200) & F.exists(F.array(*map(F.lit, TITLE_WORDS)), lambda w: F.contains(F.lower(x), w))
    return F.coalesce(F.get(F.filter(lines, fits), F.lit(0)), F.lit("Unknown Title"))


def location(title: Column, section_id: Column, index: Column, page_start: Column, page_end: Column) -> Column:
    """where a chunk stands: its section, its number, and its pages from 1."""
    name = F.when(F.coalesce(title, F.lit("")) == "", section_id).when(is_abstract(title), "摘要").when(is_intro(title), "前言").otherwise(title)
    several = page_end.isNotNull() & (page_end != page_start)
    pages = F.when(several, F.concat(F.lit("pages "), page_start + 1, F.lit("-"), page_end + 1)).when(page_start.isNotNull(), F.concat(F.lit("page "), page_start + 1))
    return F.concat_ws(" / ", name, F.concat(F.lit("chunk "), index), pages)


def file_name(template: str, paper: Column, stamp: Column) -> Column:
    """a template with {paper_name} (without .json) and {timestamp}."""
    t = F.replace(F.lit(template), F.lit("{paper_name}"), F.replace(paper, F.lit(".json"), F.lit("")))
    return F.replace(t, F.lit("{timestamp}"), stamp)


def duration(seconds: Column) -> Column:
    """0.0s, 59.9s, 2m 3.0s, 1h 2m 3.0s."""
    one = lambda x: F.concat(F.format_number(x, 1), F.lit("s"))
    part = lambda k: F.floor(seconds / k).cast("int").cast("string")
    minutes = F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("int").cast("string")
    return (
        F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "0.0s").when(seconds < 60, one(seconds)).when(seconds < 3600, F.concat(part(60), F.lit("m "), one(F.pmod(seconds, F.lit(60.0)))))
        .otherwise(F.concat(part(3600), F.lit("h "), minutes, F.lit("m "), one(F.pmod(seconds, F.lit(60.0)))))
    )
