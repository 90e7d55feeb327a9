"""Main text against pages whose text is known, and the ratios against a plain version."""

import random
import time

import pytest

from loomspark.llm import html_extract as H

MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News and more</a><li><a href=/c>About us</a></ul>"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def sentence(rng, n):
    return words(rng, n // 2) + ", " + words(rng, n - n // 2) + "."


def plain_page(rng):
    """A page of nothing but div, h2, p, ul and table, and its text."""
    body, text = [], []
    for k in range(rng.randrange(3, 9)):
        if k % 3 == 0:
            text.append(words(rng, 3))
            body.append(f"<h2>{text[-1]}</h2>")
        text.append(" ".join(sentence(rng, rng.randrange(14, 30)) for _ in range(rng.randrange(2, 5))))
        body.append(f"<p>{text[-1].replace(' ', chr(10), 1)}" + "</p>" * rng.randrange(2))
    text.append("See b.")
    body.append("<p>See <b>b</b>.</p>")
    side = lambda: f"<div>{rng.choice([MENU, words(rng, 4), '<h2>' + words(rng, 2) + '</h2>' + MENU])}</div>"
    page = "<html><body>" + side() + side() + "<div><div>" + "".join(body) + "</div></div>" + side() + f"<div><p>{words(rng, 5)}</div></body></html>"
    return page, " ".join(text)


def test_pages_without_article_or_names(monkeypatch):
    rng = random.Random(3)
    pages = [plain_page(rng) for _ in range(200)]
    assert all(H.main_text(p) == t for p, t in pages)
    # Text and advert in the body itself, and equal boxes side by side: no element holds the article, so the paths decide alone.
    rng, bare = random.Random(4), []
    for _ in range(50):
        posts = [sentence(rng, 40) + " " + sentence(rng, 30) for _ in range(4)]
        bare.append(("<body><div>" + MENU + "</div>" + "".join(f"<section><h3>{words(rng, 2)}</h3></section><section><div><p>{p}</div></section>" for p in posts) + "<table><tr><td><a href=x>Next page</a></table></body>", " ".join(posts)))
    assert all(H.main_text(p) == t for p, t in bare)
    monkeypatch.setattr(H, "content_paths", lambda blocks: [True] * len(blocks))
    assert sum(H.main_text(p) != t for p, t in bare) == 50  # without the ratios all of it goes through


def brute_paths(page):
    """Each block scored by going over all blocks again, from path strings."""
    blocks, _ = H.read(page)

    def trail(e):
        return trail(e.parent) + [(e.tag, e.path)] if e else []

    def box(e):
        while e.tag in H.PARTS and e.parent:
            e = e.parent
        return trail(e)

    def measure(same):
        mine = [b for b in blocks if same(b)]
        size = sum(len(b.text) for b in mine)
        linked = sum(b.links for b in mine)
        return (size - linked) / len(mine), sum(b.text.count(c) for b in mine for c in H.SENTENCE) / len(mine), linked / size

    score = []
    for b in blocks:
        own, around = measure(lambda x: trail(x.element) == trail(b.element)), measure(lambda x: box(x.element) == box(b.element))
        t, p, k = ((x + y) / 2 for x, y in zip(own, around))
        score.append(t * (1 + p) * (1 - k) * (10 if any(tag in ("article", "main") for tag, _ in trail(b.element)) else 1))
    mean = sum(f * len(b.text) for f, b in zip(score, blocks)) / sum(len(b.text) for b in blocks)
    return [f >= 0.2 * mean for f in score]


def test_ratios_against_brute_force():
    rng = random.Random(5)
    for k in range(60):
        page, _ = plain_page(rng)
        page = page.replace("<div><div>", "<article><div class=c7>").replace("</div></div>", "</div></article>", 1) if k % 2 else page
        assert H.content_paths(H.read(page)[0]) == brute_paths(page)


TEXT = "Long text, with marks, and more of it. Yes, it is long enough."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), (" \n ", ""), ("<html><body><nav><a>x</a></nav><footer>f</footer></body></html>", ""),
        ("<body><header>Site</header><div class=ad>Buy!</div><article><h1>T&amp;t</h1><p>One,\n two.<p>Three <b>four</b><br>five</article><div id=comments><p>Nice, really nice.</p></div></body>", "T&t One, two. Three four five"),
        ("<body><div class='menu'><a>a</a></div><div><h2>H</h2><p>Long text, with marks, and more of it. Yes.</p><ul><li>x<li>y</ul></div><form><label>Name</label></form><script>var p='</p>';</script>", "H Long text, with marks, and more of it. Yes. x y"),
        # names of paragraphs and sections decide nothing
        (f"<article><p>{TEXT}</p><p class='notice-period'>Short one</p><p id='related-work'>Other</p><div class='shared-space'><p>Third.</p></div></article>", f"{TEXT} Short one Other Third."),
        # comments, adverts and menus inside an article
        (f"<article><h1>T</h1><p>{TEXT}</p><section class='comments'><p>{TEXT} {TEXT}</p></section><article><p>A reader, at length, says so.</p></article><div class=ad>Buy, now.</div><div><a href=x>Share it</a> <a href=y>Like</a></div></article>", f"T {TEXT}"),
        (f"<article><header><h1>T</h1><p>By A</p></header><p>{TEXT}</p><figure><img src=x><figcaption>Cap</figcaption></figure></article>", f"T By A {TEXT} Cap"),
        (f"<h1>Title</h1><div><p>{TEXT}</p><p>{TEXT}</p></div>", f"Title {TEXT} {TEXT}"),
        (f"<p>{TEXT} a < b &lt;i&gt; &nbsp; x<!-- <p>no --> y</p>", f"{TEXT} a < b <i> x y"),
        (f"<p title='a > b' data-x=\"<p>\">{TEXT}</p>", TEXT), (f"<div hidden>{TEXT}</div><div role=search>x</div><p>{TEXT}</p>", TEXT), (f"<div><p>{TEXT}</div><p", f"{TEXT}"),
        (f"<svg><p>{TEXT}", TEXT), (f"<p>{TEXT}<script>if (a<b) x('</p>')", TEXT), (f"<table><tr><td>{TEXT}<td>c<tr><td>d</table>", f"{TEXT} c d"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page or "") == text


@pytest.mark.parametrize("piece", ["<b ", "<a x='y ", "<a x=\"y' ", "<div>", "<p>", "</x>", "<svg>", "<", "&lt;<script", "<ul><li>", "<a href=x>", "<div class='a", "<!", "<!--", "<article><div class=ad>", "</div><div>", "<main><div><article></article>"])
def test_broken_markup_takes_linear_time(piece):
    for end in ("", ">x"):
        began = time.process_time()
        H.main_text(piece * (300_000 // len(piece)) + end)
        assert time.process_time() - began < 3


def test_long_page():
    rng = random.Random(6)
    paragraphs = [sentence(rng, 60) for _ in range(5_000)]
    assert H.main_text("<nav>x</nav><div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>") == " ".join(paragraphs)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, f"<p>é {TEXT}", 2)], "page_id long, url string, html string, text long")
    assert sorted(map(repr, map(tuple, H.extract(pages).collect()))) == sorted(map(repr, [(1, "u", "", 0)] * 2 + [(None, None, f"é {TEXT}", len(TEXT) + 2)]))
    assert H.extract(pages.limit(0)).count() == 0
