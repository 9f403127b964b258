import html as lib
import re

import pytest

from tidemill.llm import html, queries

P = "<p>A paragraph, with commas, and enough words to look like a part of an article.</p>"
T = "A paragraph, with commas, and enough words to look like a part of an article."

CASES = [
    (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{P}<p>Be.</p></article><footer>f</footer></body>", f"Title\n\n{T}\n\nBe."),
    (f"<body><div class='side-bar sidebar'>{P}{P}{P}</div><div id=main-content><h2>Head</h2>{P}<p>So.</p></div></body>", f"Head\n\n{T}\n\nSo."),
    (f"<body><div>{P}{P}</div><section id=comments><div class=comment>{P}{P}{P}{P}</div></section></body>", f"{T}\n\n{T}"),
    (f"<body><main>{P}<form><p>Subscribe, now, to our, letter</p><input></form><div class='ad-banner'>buy</div><ul><li>one</li><li>two</li></ul></main>", f"{T}\n\none\n\ntwo"),
    (f"<div role=navigation>{P}</div><div>{P}</div>", T),
    (f"<div><p><b>Bold.<br><p>Next, one &amp; two &lt;b&gt; &eacute;&#233;&#xe9; x.</p>{P}</div>", f"Bold.\n\nNext, one & two <b> ééé x.\n\n{T}"),
    ("<article><p>a\n b\t c <i>d</i>e</p><p>  </p></article>", "a b c de"),
    (f"<article>{P}<script>var x = '</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><aside>no</aside><noscript>no</noscript></article>", T),
    (f"<article><header><h1>Title</h1><div>by me</div></header>{P}<footer>no</footer></article>", f"Title\n\n{T}"),
    (f"<article>{P}<div class='cookieNotice'>no, no, no</div><div hidden>no</div><div style='display: none'>no</div></article>", T),
    ("", ""),
    (None, ""),
    ("<html><head><title>t</title></head><body></body></html>", ""),
    ("just text & more", "just text & more"),
    ("<p>unclosed <a href='x", "unclosed <a href='x"),
    ("<p>1 < 2</p>", "1 < 2"),
    ("<nav>only a menu</nav>", ""),
    (f"<table><tr><td>{P}</td></tr></table>", T),
    (f"<div class='layout has-sidebar'><div class=content>{P}</div><div class=sidebar>{P}{P}</div></div>", T),
    (f"<div class='noAds wide'>{P}<div class='ads no-border'>no</div></div>", T),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(case):
    page, want = CASES[case]
    assert html.main_text(page) == want


def test_whole_pages(spark, medium):
    """The bundled pages have one article, whose tags are known."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    out = queries.op2_html_extraction(spark, medium)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for r in out.collect():
        own = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(lib.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_long_and_odd_pages():
    long = "<article>" + "<p>word, word</p>" * 20_000 + "</article>"
    assert html.main_text(long).count("\n\n") == 19_999
    for odd in ('<a "' * 5000, "<" * 50_000, "<div>" * 20_000 + "x", "</p>" * 20_000, "<p>" * 20_000, "<b>" * 3000 + "<p>x"):
        html.main_text(odd)


def test_table_edges(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (None, None, None, "t"), (1, "u", P, "t")], "page_id bigint, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.extract(df).collect()) == [("", 0), ("", 0), (T, len(T))]
    assert html.extract(df.limit(0)).count() == 0


#: Class words on what holds the article, or on a part of it, are no verdict.
MARKED = [
    (f"<div class='layout sidebar-right'><article><h1>T</h1>{P}{P}</article><div class=sidebar>{P}</div></div>", f"T\n\n{T}\n\n{T}"),
    (f"<body><div class='ad-free'>{P}{P}</div></body>", f"{T}\n\n{T}"),
    (f"<body><form id=aspnetForm action=x><div id=top class=menu><a href=/>Home</a></div><div class=content><h1>T</h1>{P}{P}</div><div class=footer>f, f, f</div></form></body>", f"T\n\n{T}\n\n{T}"),
    (f"<article>{P}<p class='market-share'>Shares, of the market, rose.</p>{P}</article>", f"{T}\n\nShares, of the market, rose.\n\n{T}"),
    (f"<article><div class=entry-header><h1>T</h1><span>by me</span></div>{P}{P}</article>", f"T\n\n{T}\n\n{T}"),
    (f"<body><div class=post><div class=entry-header><h1>T</h1></div><div class=entry-content>{P}{P}</div></div></body>", f"T\n\n{T}\n\n{T}"),
    (f"<body><div class=content>{P}{P}{P}</div><section><p>So it ends.</p></section><div><a href=a>one</a> <a href=b>two</a></div></body>", f"{T}\n\n{T}\n\n{T}\n\nSo it ends."),
    (f"<body><div id=content><div class=widget>{P}{P}</div><div class=widget>{P}{P}</div></div></body>", "\n\n".join([T] * 4)),
    (f"<article>{P}{P}<div class='social-share'><p>Share, this, with friends.</p></div><div class='ad ad-300x250'><p>Buy, now.</p></div><section class=comments><article class=comment>{P}{P}{P}{P}</article></section></article>", f"{T}\n\n{T}"),
    (f"<body><div class=main>{P}{P}</div><section id=comments><article class=comment>{P}{P}</article><article>{P}{P}</article></section></body>", f"{T}\n\n{T}"),
    (f"<main><div class=sec>{P}</div><div class=sec>{P}</div><ul class=related-posts><li><a href=x>Another, story</a></li></ul></main>", f"{T}\n\n{T}"),
    (f"<body><ul><li><a href=a>one, two</a></li><li><a href=b>three</a></li></ul><div><h2>H</h2>{P}<ul><li>a</li><li>b</li></ul>{P}</div></body>", f"H\n\n{T}\n\na\n\nb\n\n{T}"),
    (f"<div class='visually-hidden'>{P}</div><div>{P}</div>", T),
    (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a> <a href=3>Three</a></td><td><h1>T</h1>{P}{P}<p>Short end.</p></td></tr></table>", f"T\n\n{T}\n\n{T}\n\nShort end."),
    (f"<body><div class=text><h1>T</h1><div class=body>{P}<div class=ad-slot><p>Advert, buy, now.</p></div>{P}</div><div id=disqus_thread>{P * 6}</div></div><div class='col-4 sidebar'>{P}</div></body>", f"T\n\n{T}\n\n{T}"),
    ("<body><div class=content><dl><dt>Term</dt><dd>What it means, in short.</dd><dt>Other</dt><dd>And this one, too.</dd></dl></div></body>", "Term\n\nWhat it means, in short.\n\nOther\n\nAnd this one, too."),
    (f"<article>{P}<ul><li><a href=1>A long title of a source that the article names</a></li><li><a href=2>Another title of a source that is as long as this</a></li><li><a href=3>The third title of a source, no shorter than those</a></li></ul></article>", f"{T}\n\nA long title of a source that the article names\n\nAnother title of a source that is as long as this\n\nThe third title of a source, no shorter than those"),
    (f"<body><article><p>Short, it is.</p></article><div>{P * 3}</div></body>", "Short, it is."),
    (f"<body><div>{P * 4}</div><article><h3>Other</h3><p>A teaser.</p></article><article><h3>More</h3><p>A teaser, too.</p></article></body>", "\n\n".join([T] * 4)),
    (f"<table><tr><td class=menu><a href=x>m</a></td><td>{P}<b>in</b> cell</td></tr></table>", f"{T}\n\nin cell"),
]


@pytest.mark.parametrize("case", range(len(MARKED)))
def test_marks_are_evidence(case):
    page, want = MARKED[case]
    assert html.main_text(page) == want


def test_time_is_linear():
    import time

    for part in ("<b>", "<div>x,", "<a href=x>", "<p>x<b>", "<td>", "</b>", "<li>", "<b><div></b>", "<div></i>"):
        began = time.perf_counter()
        html.main_text(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 8, part


def plain(page):
    """The container with the most points by the rule as it is told, on a tree of Python's own parser: (its tag and id, text of its paragraphs)."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.at = {"tag": "#", "kids": [], "up": None, "mark": 1.0, "id": None}

        def handle_starttag(self, tag, attrs):
            names = dict(attrs)
            new = {"tag": tag, "kids": [], "up": self.at, "mark": 0.1 if names.get("class") in html.NOISE else 1.0, "id": names.get("id")}
            self.at["kids"].append(new)
            self.at = new

        def handle_endtag(self, tag):
            self.at = self.at["up"]

        def handle_data(self, data):
            self.at["kids"].append(data)

    tree = Tree()
    tree.feed(page)

    def texts(n):
        return [n.strip()] if isinstance(n, str) else [t for k in n["kids"] for t in texts(k)]

    def size(n):
        return sum(map(len, texts(n)))

    def links(n):
        return 0 if isinstance(n, str) else size(n) if n["tag"] == "a" else sum(map(links, n["kids"]))

    def every(n):
        return [n] + [x for k in n["kids"] if not isinstance(k, str) for x in every(k)]

    points = {}
    for p in every(tree.root):
        if p["tag"] == "p" and size(p):
            worth, up = 1.0, p
            while up:
                worth, up = worth * up["mark"], up["up"]
            own = (0.2 + min(size(p) / 100, 3) + sum(t.count(",") for t in texts(p))) * (1 - links(p) / size(p)) * worth
            up, level = p["up"], 1
            while up and up["up"] and level <= 5:
                points[up["id"]] = points.get(up["id"], 0) + own / level
                up, level = up["up"], level + 1
    nodes = {n["id"]: n for n in every(tree.root)}
    final = {i: x * (1 - links(nodes[i]) / size(nodes[i])) for i, x in points.items()}
    return final


def test_points_equal_the_plain_rule():
    """Random trees without article tags: all containers have the points of the plain version, and the best one is read."""
    import random

    rng = random.Random(12)
    for _ in range(150):
        n = 0

        def grow(depth):
            nonlocal n
            out = ""
            for _ in range(rng.randint(1, 3)):
                if depth and rng.random() < 0.6:
                    n += 1
                    mark = " class=comments" if rng.random() < 0.15 else ""
                    out += f"<div id=d{n}{mark}>{grow(depth - 1)}</div>"
                else:
                    words = " ".join(rng.choice(["word,", "long", "a", "text"]) for _ in range(rng.randint(1, 40)))
                    out += f"<p>{words}{' <a>link to it</a>' if rng.random() < 0.3 else ''}</p>"
            return out

        page = f"<div id=d0>{grow(4)}</div>"
        want = plain(page)
        root = html.parse(page)
        order = html._in_order(root)
        best = html._best(order, html._measure(order))
        got = [round(x.points, 6) for x in order if x.tag == "div"]
        assert got == [round(want.get(f"d{i}", 0), 6) for i in range(n + 1)]
        assert round(best.points, 6) == round(max(want.values()), 6)
        own = [x for x in best.kids if x.tag == "p"]
        text = html.main_text(page)
        assert all(" ".join("".join(k if isinstance(k, str) else "".join(k.kids) for k in p.kids).split()) in text for p in own)
