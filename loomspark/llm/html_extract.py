"""Main text of web pages by tag-path ratios.

A page is read as text blocks, each with its root-to-leaf tag path. Elements that never hold an article by their tag or role
(scripts, ``nav``, ``footer``, forms and the like) are left out while reading. Then:

1. *Ratios*: text length (links apart) and punctuation are summed per tag path and divided by the path's blocks. Elements that hold
   blocks side by side (``div``, ``section``, ``article``...) carry their class in the path; paragraphs, headings and list items
   don't, so that a class on one of them sets nothing apart.
2. *Smoothing*: the blocks that share a container, whatever their own tags, give the container's ratios; a path's
   ratios are the mean of its own and its container's. So a heading among long paragraphs is not judged by its own length.
3. *Fusion*: text ratio x (1 + punctuation ratio) x share of text outside links, times ``ARTICLE`` inside ``article`` and ``main``.
4. *Threshold*: paths whose fused ratio reaches ``SHARE`` of the page's mean (by length) are content paths.
5. *Nodes*: the deepest container that holds ``HOLDS`` of the text of all content paths is the article. All its blocks
   are the text, short ones and headings too, but for containers inside it that are mostly links, and for those that running
   text can't tell from an article: an ``article`` inside an article (by the HTML standard its comments), and containers whose
   whole class or id is one of ``ASIDES``. A first or second heading right before the article belongs to it. Where no
   container holds that much, the blocks of the content paths and the headings beside them are the text.

White space inside a block becomes one space; character references are decoded; blocks are joined by one space in page order. Null
and empty pages, and pages without content, give an empty text. Broken markup is read leniently and in linear time: unclosed
elements end with their parents, end tags without a start are skipped, a tag that never ends is text. Pages are independent of each
other; repeated rows give repeated results, an empty table an empty one; other columns don't matter.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_ONLY = frozenset("script style title textarea".split())  # their content is no markup
RAW = TEXT_ONLY | frozenset("noscript template iframe svg math object".split())
NEVER = frozenset("head nav footer aside form button select option fieldset dialog menu canvas audio video map datalist".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no blocks side by side, or only their own parts: they belong to the container around them.
PARTS = frozenset("p li ul ol dl dd dt blockquote pre figure figcaption table caption thead tbody tfoot tr td th header hgroup address details summary center".split()) | HEADINGS
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDES = frozenset("ad ads advert advertisement banner sponsored promo comments comment-list respond disqus_thread cookie-notice newsletter sidebar".split())
SENTENCE = ".,;:!?。，！？"

SHARE = 0.2
HOLDS = 0.8
ARTICLE = 10.0
LINKS = 0.5  # a container with a larger share of its text in links is a menu

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Element:
    """``path`` numbers the tag path; ``container`` is the element whose blocks stand side by side with this one's."""

    __slots__ = ("tag", "path", "parent", "out", "in_article", "nested", "aside", "container", "text", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "_Element | None", paths: dict[tuple[int, str], int]):
        self.tag, self.parent = tag, parent
        name = " ".join((attrs.get("class", "") + " " + attrs.get("id", "")).lower().split())
        article = tag in ("article", "main")
        part = tag in PARTS and parent is not None
        self.in_article = article or parent is not None and parent.in_article
        self.nested = tag == "article" or parent is not None and parent.nested
        self.out = parent is not None and (parent.out or tag in NEVER or tag == "header" and not parent.in_article or attrs.get("role", "").lower() in OUT_ROLES or "hidden" in attrs
                                           or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")) and tag not in ("html", "body")
        self.aside = not part and parent is not None and (tag == "article" and parent.nested or bool(name) and not article and any(w in ASIDES for w in name.split()))
        label = tag if part or not name else tag + "." + _DIGITS.sub("0", attrs.get("class", "").lower())
        self.path = paths.setdefault((parent.path if parent else 0, label), len(paths) + 1)
        self.container = parent.container if part else self
        self.text, self.inside = 0, False


class _Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: _Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


class _Tags:
    """The tags of a page, in order; the position never goes back."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
        self.loose = False  # quotes were found not to pair up: from here on a tag ends at the first '>'

    def read(self, pos: int) -> tuple[str, str, dict[str, str], bool, int] | None:
        """('/' or '', name, attributes, whether it ends itself, end) of the tag at ``<``; none if that is no tag."""
        page, m = self.page, _NAME.match(self.page, pos + 1) if pos < self.last else None
        if m is None:
            return None
        attrs: dict[str, str] = {}
        at = m.end()
        if not self.loose:
            while True:
                a = _ATTRIBUTE.match(page, at)
                at, value = a.end(), ""
                if at >= len(page):
                    self.loose = True
                    break
                if a[2]:
                    q = page[at]
                    if q in "\"'" and at < self.quotes[q]:
                        end = page.index(q, at + 1)
                        value, at = page[at + 1 : end], end + 1
                    else:
                        end = _BARE.match(page, at).end()
                        value, at = page[at:end], end
                if a[1]:
                    attrs.setdefault(a[1].lower(), _html.unescape(value) if "&" in value else value)
                if at < len(page) and page[at] == ">":
                    return m[1], m[2].lower(), attrs, page[at - 1] == "/", at + 1
                if a.end() == a.start() and not a[2]:  # a sign that begins no attribute
                    at += 1
        end = page.index(">", m.end())
        return m[1], m[2].lower(), {}, page[end - 1] == "/", end + 1


def read(page: str) -> tuple[list[_Block], list[_Element]]:
    """The text blocks of a page that aren't out, in page order, and the elements, parents first."""
    paths: dict[tuple[int, str], int] = {}
    root = _Element("#root", {}, None, paths)
    stack, elements, found, parts, link_chars, links = [root], [root], [], [], 0, False
    open_tags: dict[str, int] = {}
    tags, lost, pos, n = _Tags(page), set(), 0, len(page)

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            if not stack[-1].out:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                if text:
                    found.append(_Block(stack[-1], text, min(link_chars, len(text))))
            parts, link_chars = [], 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            text = _html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                link_chars += len(text)

    def close(k: int) -> None:
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        add(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            pos = page.index(">", at) + 1 if at < tags.last else n
            continue
        t = tags.read(at)
        if t is None:
            add("<")
            pos = at + 1
            continue
        slash, tag, attrs, ends, pos = t
        if tag in INLINE:
            if tag == "a":
                links = not slash
            continue
        flush()
        if slash:
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW and not (ends and tag not in TEXT_ONLY) and tag not in lost:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            if end:
                after = page.find(">", end.end())
                pos = n if after < 0 else after + 1
                continue
            if tag in TEXT_ONLY:
                break
            lost.add(tag)  # never closed: from here on just a tag
        if tag in VOID or ends or tag in RAW:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p" or tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        while stack[-1].tag in _CLOSES.get(tag, ()):
            close(len(stack) - 1)
        links = False
        e = _Element(tag, attrs, stack[-1], paths)
        stack.append(e)
        elements.append(e)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return found, elements


def ratios(keys: list[int], blocks: list[_Block]) -> dict[int, tuple[float, float, float]]:
    """By key: text outside links and punctuation a block, and the share of the text in links."""
    sums: dict[int, list[int]] = {}
    for k, b in zip(keys, blocks):
        s = sums.setdefault(k, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += b.links
        s[2] += sum(map(b.text.count, SENTENCE))
        s[3] += 1
    return {k: ((s[0] - s[1]) / s[3], s[2] / s[3], s[1] / s[0]) for k, s in sums.items()}


def fused(text: float, punctuation: float, linked: float, in_article: bool) -> float:
    return text * (1 + punctuation) * (1 - linked) * (ARTICLE if in_article else 1.0)


def content_paths(blocks: list[_Block]) -> list[bool]:
    """For each block whether its tag path is one of content."""
    own = ratios([b.element.path for b in blocks], blocks)
    around = ratios([b.element.container.path for b in blocks], blocks)
    score = []
    for b in blocks:
        p, c = own[b.element.path], around[b.element.container.path]
        score.append(fused(*((x + y) / 2 for x, y in zip(p, c)), b.element.in_article))
    mean = sum(f * len(b.text) for f, b in zip(score, blocks)) / sum(len(b.text) for b in blocks)
    return [f >= SHARE * mean and not b.element.container.aside for f, b in zip(score, blocks)]


def content(blocks: list[_Block], elements: list[_Element]) -> list[_Block]:
    """The blocks of the article."""
    if not blocks:
        return []
    chosen = content_paths(blocks)
    if not any(chosen):
        return []
    for c, b in zip(chosen, blocks):
        b.element.text += len(b.text) * c
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.text += e.text
    total, holder = elements[0].text, elements[0]
    for e in elements:  # parents first: each step goes to the one child that holds enough
        if e.parent is not None and e.parent.inside and e.text >= HOLDS * total:
            e.inside = True
            if e.container is e and not (holder.tag == "article" and e.tag != "article"):
                holder = e
        elif e.parent is None:
            e.inside = True
    around = ratios([id(b.element.container) for b in blocks], blocks)
    menu = lambda b: around[id(b.element.container)][2] > LINKS
    if holder.tag in ("#root", "html", "body"):  # no element of its own: the ratios alone decide
        good = {id(b.element.container) for c, b in zip(chosen, blocks) if c}
        return [b for c, b in zip(chosen, blocks) if c or b.element.tag in HEADINGS and id(b.element.container) in good and not menu(b)]
    for e in elements:
        e.inside = e is holder or e.parent is not None and e.parent.inside and not e.aside
    out, title = [], []
    for b in blocks:
        if b.element.inside:
            if b.element.container is holder or not menu(b):
                out.append(b)
        elif not out and b.element.tag in ("h1", "h2") and b.element.parent is holder.parent:
            title.append(b)
    return title + out


def main_text(page: str) -> str:
    return " ".join(b.text for b in content(*read(page)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
