import itertools
import random
import re
import time
from html import unescape

import pyarrow.parquet as pq

from proofline.llm import html_extract as H


def test_article_without_boilerplate():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x(1<2);</script></head><body>
    <header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now, a long advert text that goes on and on, as adverts do, for more than a line.</div>
    <div class='cookie-notice'>We use cookies &amp; more</div>
    <article><header><h1>A  title &amp; more</h1></header><p><b>First para&shy;graph.<br><p>Second\n &lt;b&gt; caf&eacute; &#8364;5</p><p>Sh.</p>
    <aside>Related: things</aside><ul><li>point one</li><li>point two</li></ul><form><label>Mail</label><input><button>Go</button></form>
    <section id="comments"><p>I disagree with this entirely, said a reader at length, again and again and again.</p></section></article>
    <footer>&copy; me &middot; Words</footer></body></html>"""
    assert H.main_text(page) == "A title & more First para\xadgraph. Second <b> café €5 Sh. point one point two"


def test_edges():
    assert H.main_text(None) == H.main_text("") == H.main_text("<html><body></body></html>") == H.main_text("<script>x") == ""
    assert H.main_text("<article><p>a</p></div></p></b><p>b") == "a b"
    assert H.main_text("<article><p>1 &lt; 2 &amp;lt; 3<p>a < b") == "1 < 2 &lt; 3 a < b"
    assert H.main_text("<article>" + "<p>word</p>" * 20_000) == " ".join(["word"] * 20_000)
    assert H.main_text("<div>" * 3000 + "<p>deep text</p>") == "deep text"


def test_elements_without_end_tags():
    for head in ("<datalist><option value=a><option value=b></datalist>", "<datalist><option value=a/><option value=b/></datalist>", "<div><select><option>a<option>b</div>", "<div><button>Go</div>", "<div><iframe src=x></div>", "<noscript>x", "<div><button>Go<button>Go</button></div>"):
        for tail in ("", "<select><option>z</option></select><button>y</button><noscript>x</noscript><iframe></iframe>"):
            assert H.main_text(f"<body>{head}<article><p>First text.</p><p>Second.</p></article>{tail}") == "First text. Second.", (head, tail)
    assert H.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object data=y>fallback</object> so.</p>") == "Let x=1 be fallback so."
    assert H.main_text("<article><p>a <span><button>Go</span> b <svg><path d='1'/><title>t</title><text>no</text></svg>c <button><i>x</i><div>y</div></button>d</p><p>e") == "a b c d e"


def test_slug_ids():
    for slug in ("search-trees", "related-work", "legal-background", "social-impact", "sharing-memory", "meta-analysis", "search"):
        page = f'<article><h1>A title</h1><p>Opening words.</p><h2 id="{slug}">Head</h2><p id="{slug}-1">Words.</p><div><p>More.</p></div></article>'
        assert H.main_text(page) == "A title Opening words. Head Words. More.", slug
    for slug in ("search-trees", "related-work", "legal-background", "social-impact"):
        for tag in ("section", "div"):
            assert H.main_text(f'<article><h1>T</h1><p>One.</p><{tag} id="{slug}"><h2>H</h2><p>Two.</p><p>Three, at more length than that.</p></{tag}></article>') == "T One. H Two. Three, at more length than that.", slug
    for box in ('section id="comments"', 'div id="related-posts"', 'div id="share_buttons"', 'div class="social-share-x"', 'section class="side-bar"'):
        assert H.main_text(f"<article><p>One.</p><p>Two.</p><{box}><p>Not prose of it.</p></{box.split()[0]}></article>") == "One. Two.", box
    assert H.main_text('<article><p>One.</p><p>Two.</p><div id="related-reading"><ul><li><a href=x>A link to elsewhere</a></ul></div></article>') == "One. Two."


def test_cut_decides_without_article():
    """Pages without an article: the labels of some blocks are not the signs of their own costs."""
    long = "A paragraph of prose that goes on for a while, as paragraphs of an article do, with clauses and a full stop."
    page = f"""<body><div><a href=/>Home</a></div><div><a href=/n>News</a></div>
    <div><h1>Of cuts</h1><p>{long}</p><p>Short.</p><p>{long}</p><div>Note</div><p>{long}</p><p><a href=x>A link</a></p><p>{long}</p></div>
    <div class="footer"><p>{long} It is about the makers of this site and not about the matter.</p></div></body>"""
    found = H.blocks(page)
    labels, costs = H.labelled(found), H._costs(found)
    moved = [b.text for b, kept, w in zip(found, labels, costs) if kept != (w > 0)]
    assert {"A link", "Note"} <= set(moved)
    assert H.main_text(page) == f"Of cuts {long} Short. {long} Note {long} A link {long}"


def test_articles_of_all_pages():
    """The whole table against the text of its article elements, and the cut against the signs of the costs."""
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pydict()["html"]
    moved = 0
    for html in table:
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        text = unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|br|/?h1)>", " ", article)))
        assert H.main_text(html) == " ".join(re.split(r"[ \t\n\v\f\r]+", text.strip(" \t\n\v\f\r")))
        found = H.blocks(html)
        moved += sum(kept != (w > 0) for kept, w in zip(H.labelled(found), H._costs(found)))
    assert moved > 0


def test_hostile_markup_takes_linear_time():
    for part in ('<a "', "<a '", "<a \"'", "<!", "<p title='", "<b>", "</i", "<button>", "<![CDATA[", "<div a=\"'>"):
        began = time.monotonic()
        H.main_text(part * 20_000)
        assert time.monotonic() - began < 20, part


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda x: sum(max(0, -w) if on else max(0, w) for w, on in zip(odds, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(H.minimum_cut(odds, edges)) - best) < 1e-6


def test_frame(spark):
    rows = [(1, "u", "<article><p>x y</p></article>", "old"), (1, "u", "<article><p>x y</p></article>", "old"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()) == [(1, "x y", 3), (1, "x y", 3), (2, "", 0)]
    assert H.extract(df.limit(0)).count() == 0


def test_cut_of_long_pages_is_near_linear():
    """Four times the blocks take about four times the time, and the cut is the cheapest one."""

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = [round(rng.gauss(0, 2), 2) for _ in range(n)]
        edges = [(a, b, round(rng.random() * 2, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        price = lambda side: sum(-min(w, 0) if kept else max(w, 0) for w, kept in zip(odds, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        least = min(price(side) for side in itertools.product((False, True), repeat=n))
        assert abs(price(H.minimum_cut(odds, edges)) - least) < 1e-6

    def seconds(blocks: int) -> float:
        page = "<html><body>" + "".join(f"<div class='c{i % 7}'><p>{'word ' * rng.randint(1, 9)}</p><a href=x>{'l ' * rng.randint(1, 4)}</a></div>" for i in range(blocks)) + "</body></html>"
        began = time.perf_counter()
        H.main_text(page)
        return time.perf_counter() - began

    short, long = min(seconds(1500) for _ in range(3)), min(seconds(6000) for _ in range(3))
    assert long < 12 * short, (short, long)
