import html as entities
import re

from pyspark.sql import functions as F

from lodestream.llm import html as h
from lodestream.llm.common import read

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>First   line<br>goes on<p>Second <b>bold</b> one.<div class="ad">Buy!</div>
<ul><li>item one<li>item two</ul><form><input><label>Name</label></form><section id="comments"><p>Nice post!</p></section></article>
<aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_article():
    assert h.main_text(PAGE, []) == "A & B\n\nFirst line goes on\n\nSecond bold one.\n\nitem one\n\nitem two"


def test_comments_and_headers_around_the_article():
    page = """<body><div class="site-header"><p>The Site</p></div><main><article><h2>T</h2><p>Body.</p>
    <ol class="comment-list"><li><article class="comment"><p>A very long comment of a reader that is longer than all the rest of it.</p></article></li></ol></article>
    <article class="comment"><p>Another very long comment of a reader that is longer than all the rest of it here.</p></article></main>
    <div id="newsletter-signup"><form><p>Join</p></form></div><div role="complementary">side</div></body>"""
    assert h.main_text(page, []) == "T\n\nBody."
    named = '<body><div class="header">H</div><div id="content" class="post"><p>One.</p><p>Two &lt;3</p><div class="user_comments">c</div></div><div class="sidebar">s</div></body>'
    assert h.main_text(named, []) == "One.\n\nTwo <3"


def page(title, paragraphs, links="a b c"):
    items = "".join(f"<li><a href=x>{x}</a></li>" for x in links.split())
    return f"<html><body><div><ul>{items}</ul></div><div>Menu of the site that never changes</div><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>All rights reserved by the site.</div></body></html>"


def test_wrapper_without_any_names():
    long = "some sentence of this very page that goes on for a while "
    one, two = page("One", [long + "1", long + "2"]), page("Two", [long * 2 + "3"], "d e f")
    assert h.main_text(one, [h.parse(two)]) == f"One\n\n{long}1\n\n{long}2"
    assert h.main_text(two, [h.parse(one)]) == f"Two\n\n{(long * 2).strip()} 3"
    assert "One" in h.main_text(one, [h.parse(one)])  # an equal page is no reference


def test_matching_counts_nodes():
    a, b = h.parse("<div><p>x</p><p>y</p><ul><li>1</ul></div>"), h.parse("<div><p>x</p><ul><li>2<li>3</ul></div>")
    h.match(a, b, constant := set())
    assert len(constant) == 1  # the first paragraph


def test_alignments():
    """Against the heaviest one by trying all; in a band it is still in order and of equal kinds."""
    import random

    def heaviest(x, y):
        if not x or not y:
            return 0
        best = max(heaviest(x[1:], y), heaviest(x, y[1:]))
        return max(best, 1 + heaviest(x[1:], y[1:])) if x[0] == y[0] else best

    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        runs = [[(k, i, i + 1) for i, k in enumerate(z)] for z in (x, y)]
        pairs = h._aligned(*runs)
        assert all(x[i] == y[j] for i, j in pairs) and pairs == sorted(set(pairs))
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == heaviest(x, y)
    long = [[(rng.choice("abcdef"), i, i + 1) for i in range(n)] for n in (3000, 2500)]
    pairs = h._aligned(*long)
    assert all(long[0][i][0] == long[1][j][0] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:])) and len(pairs) > 500


def test_long_and_deep_pages_take_linear_time():
    import time

    began = time.time()
    page = "".join(f"<h3>t{i}</h3><p>para {i}</p>" for i in range(20_000))
    other = h.parse("<div>" + "".join(f"<h3>x{i}</h3><p>other {i}</p>" for i in range(15_000)) + "</div>")
    assert len(h.main_text(f"<div>{page}</div>", [other]).split("\n\n")) == 40_000
    nested = "<div>" * 20_000 + "<nav>menu</nav><form>field</form><p>Text.</p>" + "</div>" * 20_000
    assert h.main_text(nested, [h.parse(nested.replace("Text.", "Other words."))]) == "Text."
    assert time.time() - began < 60


def test_references_decide():
    """What several pages of another text share is template; what a single one shares is content."""

    def of(*blocks):
        return "<html><body><div class='a'>" + "".join(blocks) + "</div></body></html>"

    one = of("<h2>Sources</h2>", "<p>Five six seven eight and more of that.</p>", "<p>Shared but real sentence.</p>", "<p>menu words</p>")
    two = of("<h2>Sources</h2>", "<p>One two three four and five.</p>", "<p>Shared but real sentence.</p>", "<p>menu words</p>")
    three = of("<h2>Links</h2>", "<p>Nine ten eleven twelve thirteen.</p>", "<p>Another sentence is here now.</p>", "<p>menu words</p>")
    content = "Sources\n\nFive six seven eight and more of that.\n\nShared but real sentence."
    assert h.main_text(one, [h.parse(two), h.parse(three)]) == content
    assert h.main_text(one, []) == content + "\n\nmenu words"


def test_classes_inside_the_article():
    inner = '<div class="related-work"><p>kept one</p></div><section class="discussion"><p>kept two</p></section><div class="legal-history">kept three</div>'
    gone = '<div class="comments">no</div><div class="ad-slot">no</div><div class="related-links">no</div><div class="newsletter-signup">no</div>'
    assert h.main_text(f"<body><article><p>a b c</p>{inner}{gone}</article></body>", []) == "a b c\n\nkept one\n\nkept two\n\nkept three"


def test_broken_pages():
    assert h.main_text("<article><p>text <b>cut off &amp; here", []) == "text cut off & here"
    assert h.main_text("<article><p>text</p><p cla", []) == "text"
    assert h.main_text("no markup at all", []) == "no markup at all"
    assert h.main_text("<script>never ends", []) == ""
    assert h.main_text("<article><!-- open <p>x</p>", []) == ""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert h.main_text(deep, [h.parse(deep + " ")]) == "x"


def plain(page):
    """The article of the test tables' pages, by pattern."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    body = re.sub(r"<[^>]*(>|$)", "\0", re.sub(r"</?(b|br)>", " ", m[1] if m else ""))
    return "\n\n".join(" ".join(entities.unescape(x).split()) for x in body.split("\0") if x.strip())


def test_whole_table(spark, small):
    want = {r.page_id: (r.url, plain(r.html)) for r in read(spark, small, "pages").collect()}
    got = h.op8_main_text(spark, small).collect()
    assert len(got) == len(want)
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_edges_and_joined_references(spark, monkeypatch):
    rows = [(1, None, PAGE), (2, "http://a/x", None), (3, "http://a/y", ""), (None, "http://a/z", PAGE), (5, "http://a/z", "<p>" + "word " * 100_000), (5, "http://a/z", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("clash"), "refs": F.lit("x")})
    want = sorted((r.page_id or 0, r.text) for r in h.extract(pages).collect())
    assert len(want) == len(rows) and want[2] == (2, "") and want[3] == (3, "")
    assert h.extract(pages.limit(0)).count() == 0
    monkeypatch.setattr(h, "MOST_BYTES", 0)
    assert sorted((r.page_id or 0, r.text) for r in h.extract(pages).collect()) == want


def test_names_around_the_article():
    """What the elements around the text are called drops nothing of it."""
    article = "<article><p>One.</p><p>Two.</p></article>"
    for name in ("no-sidebar", "has-sidebar", "comments-open", "page-with-banner", "search-page"):
        assert h.main_text(f"<html><body class='{name}'><nav>n</nav>{article}</body></html>", []) == "One.\n\nTwo.", name
        assert h.main_text(f"<body><div class='{name}'><div class='sidebar'>s</div>{article}</div></body>", []) == "One.\n\nTwo.", name
    assert h.main_text(f"<body><form id='aspnetForm'><input><nav>n</nav>{article}</form></body>", []) == "One.\n\nTwo."
    assert h.main_text("<body><form><div><p>One that is long enough.</p><p>Two.</p></div></form></body>", []) == "One that is long enough.\n\nTwo."
    related = "<div class='related'><article><p>x</p></article></div>"
    assert h.main_text(f"<body>{article}{related}</body>", []) == "One.\n\nTwo."
    comments = f"<div class='comments'><div class='content'>{'long ' * 99}</div></div>"
    assert h.main_text(f"<body><div class='post'><p>One.</p></div>{comments}</body>", []) == "One."


def test_template_inside_the_article():
    """A box of all pages goes, a near copy's paragraphs stay, and all parts of a story are kept."""

    def story(*paragraphs):
        return "<body><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class='x'><p>Get our letter.</p></div></article></body>"

    one, two, copy = story("The first story is told here.", "It goes on."), story("Quite another tale stands there.", "And ends."), story("The first story is told here.", "It goes off.")
    want = "The first story is told here.\n\nIt goes on."
    assert h.main_text(one, [h.parse(two)]) == h.main_text(one, [h.parse(two), h.parse(copy)]) == want
    assert h.main_text(one, [h.parse(copy)]) == want + "\n\nGet our letter."
    assert h.main_text("<body><article><p>Part one.</p></article><article><p>The second part.</p></article></body>", []) == "Part one.\n\nThe second part."
    bold = [f"<body><article><p>{x} <b>bold</b> {y}.</p></article></body>" for x, y in (("A first", "word"), ("Some other", "tale"))]
    assert h.main_text(bold[0], [h.parse(bold[1])]) == "A first bold word."
