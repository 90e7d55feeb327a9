"""Lines of extracted pages: noise, captions, headings, tails (F27–F32, P10, P11). A line is a column; a text is an array of lines in a row.

What depends on the lines before is a fold over the array, so a text stays one row of one task and nothing leaves the engine.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Beginnings of front matter, of captions, and of noise lines.
FRONT_MATTER = (r"^running title\b", r"^cite this\b", r"^open access\b", r"^received\b", r"^accepted\b", r"^published\b", r"^available online\b", r"^associate editor\b", r"^how to cite this article\b", r"^\*?correspondence\b", r"^corresponding author\b", r"^affiliations?\b", r"^authors?' contributions?\b", r"^author contributions?\b", r"^equal contribution\b", r"^contributed equally to this work\b", r"^license and terms\b", r"^copyright\b")
CAPTION = (r"^(fig(?:ure)?\.?)\s*\d+", r"^(table)\s*\d+", r"^(scheme)\s*\d+")
NOISE = (r"^biorxiv preprint doi\b", r"^\(which was not certified by peer review\)", r"^available under a[a-z\- ]+license\.?$", r"^open access\b", r"^running title\b", r"^contents lists available", r"^journal homepage\b", r"^available online\b", r"^received\b", r"^accepted\b", r"^published\b", r"^review began\b", r"^review ended\b", r"^how to cite this article\b", r"^corresponding author\b", r"^\*?correspondence\b", r"^affiliations?\b", r"^authors?' contributions?\b", r"^contributed equally to this work\b", r"^doi\s*:", r"^https?://doi\.org/", r"^page \d+", r"^\d+\s+of\s+\d+$", r"^(article|research article|case report|graphical abstract)$", r"^(a r t i c l e i n f o|article info|highlights)$")
#: The headings of sections and of tails with the name that each stands for, in the order in which they are tried.
SECTION_NAMES = {
    "abstract": "Abstract", "introduction": "Introduction", "background": "Background", "related work": "Related Work", "related works": "Related Work", "materials and methods": "Materials and Methods",
    "methods and materials": "Methods and Materials", "methods": "Methods", "methodology": "Methodology", "patients and methods": "Patients and Methods", "case presentation": "Case Presentation", "results": "Results",
    "results and discussion": "Results and Discussion", "discussion": "Discussion", "conclusion": "Conclusion", "conclusions": "Conclusions", "limitations": "Limitations",
}
TAIL_NAMES = {
    "references": "References", "reference": "References", "bibliography": "References", "acknowledgments": "Acknowledgments", "acknowledgements": "Acknowledgments", "funding": "Funding", "author contributions": "Author Contributions",
    "authors contributions": "Author Contributions", "authors contribution": "Author Contributions", "credit authorship contribution statement": "CRediT Authorship Contribution Statement",
    "declaration of competing interest": "Declaration of Competing Interest", "declaration of competing interests": "Declaration of Competing Interest", "conflict of interest": "Conflict of Interest",
    "conflicts of interest": "Conflict of Interest", "ethics statement": "Ethics Statement", "ethics approval": "Ethics Approval", "data availability": "Data Availability", "data availability statement": "Data Availability Statement",
    "disclosures": "Disclosures", "supplementary data": "Supplementary Data", "supplementary information": "Supplementary Information", "supplementary materials": "Supplementary Materials", "supporting information": "Supporting Information",
    "appendix": "Appendix", "orcid": "ORCID", "orcid ids": "ORCID iDs", "additional information": "Additional Information", "affiliations": "Affiliations",
}
#: The sections that end front matter, words of reference headings, broken characters and what they stand for.
BODY_STARTS = ("Abstract", "Introduction", "Background", "Methods", "Methodology", "Materials and Methods", "Results", "Results and Discussion", "Case Presentation")
REFERENCES = ("reference", "references", "bibliography")
BROKEN = {"鈥": "-", "铿": "", "卤": "", "æ¼": "©", "éˆ¥": "-", "éŠ†": ".", "åº": " ", "(cid:0)": " "}
NUMBERED = r"(?i)^(?:section\s+)?(?:\d+(?:\.\d+){0,3}|[ivxlcdm]+)[.)\-: ]+"


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def artifacts(text: Column) -> Column:
    """line ends, broken characters, words cut by a hyphen at a line's end, blanks before line ends, at most one blank line; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    for bad, good in BROKEN.items():
        t = F.replace(t, F.lit(bad), F.lit(good))
    t = F.regexp_replace(t, r"(?U)(\w)-\n(?=\w)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def boundary_key(line: Column) -> Column:
    """a line of a page's edge in lower case with single spaces, each run of digits as one sign, without other signs."""
    t = F.lower(X.strip(F.regexp_replace(artifacts(line), r"(?U)\s+", " ")))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\d+", "#"), "[^a-z0-9# ]", "")


def heading_key(line: Column) -> Column:
    """a heading in lower case without its number and the signs around it."""
    t = F.btrim(F.regexp_replace(artifacts(line), r"(?U)\s+", " "), F.lit(" :-\t"))
    return X.strip(F.lower(F.regexp_replace(t, NUMBERED + r"\s*", "")))


def names_literal(names: dict[str, tuple[str, bool]]) -> Column:
    """An array of (k, v, t) that is one constant for the planner."""
    rows = [{"k": k, "v": v, "t": t} for k, (v, t) in names.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<k:string,v:string,t:boolean>>")


def heading(line: Column) -> Column:
    """(name, tail, rest) of a heading line, null for other lines: a known heading alone, before a colon, or after a number.

    The first known heading in order counts, sections before tails; ``rest`` is the text that goes on after it.
    """
    known = names_literal({k: (v, tail) for names, tail in ((SECTION_NAMES, False), (TAIL_NAMES, True)) for k, v in names.items()})

    def found(t: Column, a: Column) -> Column:
        beyond = F.substring(t.after, F.length(a.k) + 1, F.length(t.after))
        by_number = (t.after != t.s) & F.startswith(F.lower(t.after), a.k) & ~F.left(beyond, F.lit(1)).rlike(r"(?U)\w")
        rest = F.when(t.key == a.k, "").when(F.startswith(t.key, F.concat(a.k, F.lit(":"))), X.strip(F.regexp_replace(t.s, "(?s)^[^:]*:", ""))).when(by_number, X.strip(beyond))
        return F.struct(a.v.alias("name"), a.t.alias("tail"), rest.alias("rest"))

    def search(t: Column) -> Column:
        # The long search runs only over known headings at the line's beginning or after a number.
        near = F.filter(known, lambda a: F.startswith(t.key, a.k) | F.startswith(F.lower(t.after), a.k))
        return F.when(t.key != "", F.get(F.filter(F.transform(near, lambda a: found(t, a)), lambda h: h["rest"].isNotNull()), F.lit(0)))

    return X.let(X.strip(F.coalesce(line, F.lit(""))), lambda s: X.let(F.struct(s.alias("s"), heading_key(s).alias("key"), F.regexp_replace(s, NUMBERED, "").alias("after")), search))


def is_tail(line: Column) -> Column:
    return F.coalesce(heading(line)["tail"], F.lit(False))


def is_noise(line: Column, repeated: Column | None = None) -> Column:
    """P10: blank lines, boilerplate, addresses, licences, e-mails in short lines, running heads, and lines whose ``boundary_key`` is one of ``repeated``."""

    def test(s: Column) -> Column:
        low = F.lower(s)
        out = (
            (s == "") | _any(s, NOISE) | low.rlike("^https?://") | low.contains("creativecommons") | low.contains("all rights reserved") | (s.contains("@") & (F.length(s) < 120))
            | s.rlike(r"(?i)^\d{4} .* doi ") | s.rlike(r"^[A-Z][a-z]+ et al\.$")
        )
        return out if repeated is None else out | F.coalesce(F.array_contains(repeated, boundary_key(s)), F.lit(False))

    return X.let(X.strip(F.coalesce(line, F.lit(""))), test)


def is_caption(line: Column) -> Column:
    """P10: the beginning of a caption or of a panel of a figure."""
    s = X.strip(F.coalesce(line, F.lit("")))
    return s.rlike(r"(?i)^(fig(?:ure)?\.?|table|scheme)\s*\d+") | s.rlike(r"^\([A-Z]\)\s")


def is_body(line: Column) -> Column:
    """P10: a section heading, a numbered heading, or eight words and more with a word of three letters."""
    test = lambda s: X.let(heading(s), lambda h: (h.isNotNull() & ~h["tail"])) | s.rlike(r"^\d+(?:\.\d+){0,3}\s+[A-Z]") | ((X.n_words(s) >= 8) & s.rlike("[A-Za-z]{3,}"))
    return F.coalesce(X.let(X.strip(F.coalesce(line, F.lit(""))), test), F.lit(False))


def is_author(line: Column) -> Column:
    """Two to six words of which all but one at most look like parts of a name."""
    words = F.filter(F.split(X.strip(F.translate(F.coalesce(line, F.lit("")), "‑–", "--")), r"(?U)\s+"), lambda w: w != "")
    bare = lambda ws: F.filter(F.transform(ws, lambda w: F.regexp_replace(w, r"^[*\d,.;:()]+|[*\d,.;:()]+$", "")), lambda w: ~F.lower(w).isin("and", "&"))
    names = lambda ws: F.size(F.filter(ws, lambda w: w.rlike(r"^[A-Z][A-Za-z'\-]+$|^[A-Z]\.$")))
    return X.let(words, lambda ws: F.size(ws).between(2, 6) & X.let(bare(ws), lambda b: (F.size(b) >= 2) & (names(b) >= F.greatest(F.lit(2), F.size(b) - 1))))


def is_front_matter(line: Column) -> Column:
    """Licences, addresses, contact and author lines before a text begins."""
    words = ("creativecommons", "all rights reserved", "licensee", "contributed equally to this work", "mail stop", "fax:", "tel:")

    def test(s: Column) -> Column:
        low = F.lower(s)
        holds = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        place = low.rlike(r"(?U)\b(university|department|faculty|hospital|institute|school of)\b") & (X.n_words(s) <= 20)
        return (_any(s, FRONT_MATTER) | holds | is_author(s) | (s.contains("@") & (F.length(s) < 180)) | place | s.rlike(r"^[A-Z][A-Za-z.\-']+(?:,\s*[A-Z][A-Za-z.\-']+)?(?:\s+\d+[*,]*)?$")) & (s != "")

    return X.let(X.strip(F.coalesce(line, F.lit(""))), test)


def line_kind(line: Column) -> Column:
    """Blank, tail, heading, noise, front_matter, caption or body."""
    kind = lambda s, h: (
        F.when(s == "", "blank").when(h["tail"], "tail").when(h.isNotNull(), "heading").when(is_noise(s), "noise")
        .when(_any(s, FRONT_MATTER), "front_matter").when(is_caption(s), "caption").otherwise("body")
    )
    return X.let(X.strip(F.coalesce(line, F.lit(""))), lambda s: X.let(F.struct(heading(s).alias("h")), lambda t: kind(s, t.h)))


def strip_inline(line: Column) -> Column:
    """F32: DOIs, copyright and licence notes inside a line go, with the signs around what is left."""
    t = F.coalesce(line, F.lit(""))
    for p in (r"(?i)https?://doi\.org/\S+", r"(?iU)\bdoi\s*:?\s*\S+", r"(?i)©\s*the author\(s\).*", r"(?i)creative\s+commons.*", r"(?i)license and terms:.*"):
        t = F.regexp_replace(t, p, "")
    return F.btrim(F.regexp_replace(t, r"(?U)\s{2,}", " "), F.lit(" -;\t"))


_NO_LINES = "array<string>"


def without_captions(lines: Column) -> Column:
    """from a caption on, lines go until one that looks like body text."""
    start = F.struct(F.array().cast(_NO_LINES).alias("out"), F.lit(False).alias("skip"))

    def step(acc: Column, x: Column) -> Column:
        caption = is_caption(x)
        skip = caption | (acc.skip & ~is_body(x))
        return F.struct(F.when(skip, acc.out).otherwise(F.array_append(acc.out, x)).alias("out"), skip.alias("skip"))

    return F.aggregate(lines, start, step, lambda acc: acc.out)


def merged(lines: Column) -> Column:
    """wrapped lines joined: after a hyphen before a small letter, and where a line without an end is followed by a small letter, digit or bracket."""

    def joined(out: Column, x: Column, last: Column) -> Column:
        first, two = F.left(x, F.lit(1)), F.left(x, F.lit(2))
        small = first.rlike(r"^\p{Ll}$")
        low = small | first.rlike(r"(?U)^\d$") | first.isin("(", "[") | (two.rlike(r"\p{L}") & (two == F.lower(two)) & (two != F.upper(two)))
        one = F.when(F.endswith(last, F.lit("-")) & small, F.concat(F.left(last, F.length(last) - 1), x)).when(~F.right(last, F.lit(1)).isin(*".!?;:") & low, F.concat(last, F.lit(" "), x))
        rest = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(x == "", out).when(F.size(out) == 0, F.array(x)).otherwise(X.let(F.struct(one.alias("one")), lambda t: F.when(t.one.isNotNull(), F.array_append(rest, t.one)).otherwise(F.array_append(out, x))))

    return F.aggregate(F.transform(lines, X.strip), F.array().cast(_NO_LINES), lambda out, x: joined(out, x, F.try_element_at(out, F.lit(-1))))


def without_front(lines: Column) -> Column:
    """what stands before the first heading of a body section, if one is among the first 80 lines; the heading gets its name, its rest a line."""
    starts = lambda x: X.let(heading(x), lambda h: F.coalesce(h["name"].isin(*BODY_STARTS) & ~h["tail"], F.lit(False)))

    def cut(ls: Column, at: Column) -> Column:
        rest = lambda h: F.when(h["rest"] != "", F.array(h["name"], h["rest"])).otherwise(F.array(h["name"]))
        return F.when(at > 0, F.concat(X.let(heading(F.get(ls, F.greatest(at, F.lit(1)) - 1)), rest), F.slice(ls, F.greatest(at, F.lit(1)) + 1, F.greatest(F.size(ls) - at, F.lit(0))))).otherwise(ls)

    return X.let(lines, lambda ls: X.let(F.coalesce(F.array_position(F.transform(F.slice(ls, 1, 80), starts), True), F.lit(0)).cast("int"), lambda at: cut(ls, at)))


def clean_block(text: Column, repeated: Column | None = None) -> Column:
    """a page's text without noise, front matter and captions, wrapped lines joined."""
    lines = F.filter(F.transform(F.split(artifacts(text), "\n"), X.strip), lambda x: ~is_noise(x, repeated))
    return X.strip(F.array_join(merged(without_captions(without_front(lines))), "\n"))


def before_tail(text: Column) -> Column:
    """(text, cut): the lines before the first tail heading, and whether there was one."""
    cut = lambda ls, at: F.struct(X.strip(F.array_join(_until(ls, at), "\n")).alias("text"), (at > 0).alias("cut"))
    return X.let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda ls: X.let(_first(F.transform(ls, is_tail)), lambda at: cut(ls, at)))


def _first(flags: Column) -> Column:
    """The position of the first true flag, 0 without one."""
    return F.array_position(F.transform(flags, lambda f: F.coalesce(f, F.lit(False))), True).cast("int")


def _until(lines: Column, at: Column) -> Column:
    return F.when(at > 0, F.slice(lines, 1, F.greatest(at, F.lit(1)) - 1)).otherwise(lines)


def clean_lines(text: Column) -> Column:
    """a cleaned text up to its first tail heading."""
    return before_tail(clean_block(text))["text"]


def without_references(text: Column) -> Column:
    """the lines before the tail, a short line that names references, or two of five lines that begin with [n]."""
    def stops(cited: Column, x: Column, i: Column) -> Column:
        low = F.lower(x)
        named = F.exists(F.array(*map(F.lit, REFERENCES)), lambda k: (low == k) | (F.startswith(low, k) & (F.length(x) < 30)) | (F.contains(low, k) & (F.length(x) < 20)))
        return named | (F.get(cited, i) & (F.size(F.filter(F.slice(cited, i + 1, 5), lambda c: c)) >= 2))

    def cut(ls: Column) -> Column:
        cited = F.transform(ls, lambda x: X.strip(x).rlike(r"^\[\d+\]"))
        return F.array_join(X.let(cited, lambda c: _until(ls, _first(F.transform(ls, lambda x, i: stops(c, X.strip(x), i))))), "\n")

    return X.let(F.split(before_tail(text)["text"], "\n"), cut)


def clean_title(title: Column) -> Column:
    """a title without its number, with single spaces."""
    return X.strip(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^[\d.]+\s*", ""), r"(?U)\s+", " "))


def after_title(text: Column, title: Column) -> Column:
    """the lines after the first that holds the title or lies in it (both longer than five characters); all without one."""
    has = lambda t, x: (F.length(t) > 5) & (F.length(x) > 5) & (F.contains(x, t) | F.contains(t, x))

    def cut(ls: Column) -> Column:
        flags = X.let(F.lower(clean_title(title)), lambda t: F.transform(ls, lambda x: X.let(F.lower(clean_title(x)), lambda y: has(t, y))))
        return X.let(_first(flags), lambda at: F.when(at > 0, F.array_join(F.slice(ls, F.greatest(at, F.lit(1)) + 1, F.size(ls)), "\n")).otherwise(text))

    return X.let(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def before_title(text: Column, title: Column) -> Column:
    """the lines before the next title, or before a short line that names references."""
    stops = lambda t, low: ((t != "") & F.contains(low, t)) | ((F.length(low) < 50) & F.exists(F.array(*map(F.lit, REFERENCES)), lambda k: F.contains(low, k)))
    flags = lambda ls: X.let(F.lower(clean_title(title)), lambda t: F.transform(ls, lambda x: X.let(F.lower(X.strip(x)), lambda low: stops(t, low))))
    return X.let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda ls: F.array_join(_until(ls, _first(flags(ls))), "\n"))


def record_lines(lines: Column, section: Column) -> Column:
    """The lines of a record without inline noise, captions and front matter, up to a tail heading.

    In an abstract a keyword line and at most two short lines after it stay, and then the text ends. Lines of front matter at the
    beginning of the first sections go.
    """
    abstract = section == "Abstract"
    start = F.struct(F.array().cast(_NO_LINES).alias("out"), *[F.lit(False).alias(k) for k in ("caption", "front", "words", "stop")], F.lit(0).alias("n"))

    seen = F.transform(F.transform(lines, strip_inline), lambda x: F.struct(
        x.alias("x"), is_front_matter(x).alias("front"), is_caption(x).alias("caption"), is_body(x).alias("body"), is_tail(x).alias("tail"), (abstract & x.rlike(r"(?iU)^keywords?\b")).alias("named"), (X.n_words(x) <= 12).alias("few")))

    def flags(acc: Column, r: Column) -> Column:
        more = abstract & acc.words & ~r.named
        short = more & ~r.front & ~r.caption & r.few & (acc.n < 2)
        return F.struct(short.alias("short"), (acc.stop | ((r.x != "") & (r.tail | (more & ~short)))).alias("stop"), (r.caption | (acc.caption & ~r.body)).alias("caption"), (r.front | (acc.front & ~r.body)).alias("front"), (r.named | short).alias("as_is"))

    def after(acc: Column, r: Column, f: Column) -> Column:
        keep = (r.x != "") & ~f.stop & (f.as_is | (~f.caption & ~f.front))
        same = (r.x == "") | f.stop | f.as_is
        return F.struct(
            F.when(keep, F.array_append(acc.out, r.x)).otherwise(acc.out).alias("out"), F.when(same, acc.caption).otherwise(f.caption).alias("caption"), F.when(same | f.caption, acc.front).otherwise(f.front).alias("front"),
            (acc.words | (r.named & (r.x != ""))).alias("words"), f.stop.alias("stop"), F.when(r.named, 0).when(f.short, acc.n + 1).otherwise(acc.n).alias("n"),
        )

    out = F.aggregate(seen, start, lambda acc, r: X.let(flags(acc, r), lambda f: after(acc, r, f)), lambda acc: acc.out)

    def trimmed(ls: Column) -> Column:
        first = _first(F.transform(ls, lambda x: ~is_front_matter(x)))
        return X.let(first, lambda at: F.when(at > 0, F.slice(ls, F.greatest(at, F.lit(1)), F.size(ls))).otherwise(F.array().cast(_NO_LINES)))

    return X.let(out, lambda ls: F.when(section.isin("Abstract", "Introduction", "Background", "Chunk 1"), trimmed(ls)).otherwise(ls))
