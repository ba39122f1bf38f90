"""Main text: hand-labelled pages in layouts of their own, the tokenizer on broken pages, the labeller on unseen pages."""

import random
import time

import numpy as np
import pytest

from ledgerloom.llm import html_extract

# Page and main text, labelled by hand.
PAGES = [
    ("<article><p title=it's>Text one stays.</p><p>Text two doesn't go.</p></article>", "Text one stays.\n\nText two doesn't go."),
    ("<html><body><div id=main><p>First paragraph of the text here.</p><p>Second paragraph of the text.</p></div></body></html>", "First paragraph of the text here.\n\nSecond paragraph of the text."),
    ("<body><p>Bare paragraph one with several words.</p><p>And another paragraph with words.</p></body>", "Bare paragraph one with several words.\n\nAnd another paragraph with words."),
    (
        "<html><body><article><h1>Title</h1><p>Some words here.</p><table><tr><td>Cell one</td><td>Cell two</td></tr></table><figure><img src=x><figcaption>A caption</figcaption></figure><ul><li>Point a</li><li>Point b</li></ul></article><footer>(c)</footer></body></html>",
        "Title\n\nSome words here.\n\nCell one\n\nCell two\n\nA caption\n\nPoint a\n\nPoint b",
    ),
    ("<html><body><div class=header>Site</div><div class=content><h2>Head</h2><p>One two three four five.</p></div><div class=sidebar><h3>Related</h3><ul><li><a href=x>foo bar</a></ul></div></body></html>", "Head\n\nOne two three four five."),
    ("a < b and 5 <6 text", "a < b and 5 <6 text"),
    ("<p>one<!-- c --> two<!-->three</p>", "one twothree"),
    ("<nav><ul><li><a>Only</a></li></ul></nav>", ""),
    ('<main><h1>T</h1><p>Para with <a href="x>y">link</a> inside.</p><blockquote>Quote text</blockquote><pre>code  here</pre></main><section id="comments"><h3>Comments</h3><p>nice post thanks</p></section>', "T\n\nPara with link inside.\n\nQuote text\n\ncode here"),
    ("<table><tr><td width=100><a href=a>Home</a><td><h1>Old page</h1><p>Main text of an old table page, with words.<p>More text.</table>", "Old page\n\nMain text of an old table page, with words.\n\nMore text."),
    ('<article><h1>X</h1><div class="newsletter">Subscribe now</div><p>Text body here.</p><form><button>Send</button></form><aside>Also read this</aside></article>', "X\n\nText body here."),
    ("<p>plain &amp; &lt;b&gt; &#8212; x</p>", "plain & <b> — x"),
    ("<body><p>Hi.</p><p>Short one.</p></body>", "Hi.\n\nShort one."),
    ("<html><body><div class=wrapper><div class=menu><a href=a>Home</a> <a href=b>News</a></div><div class=post><h1>T</h1><p>aa bb cc dd</p><ul><li>x one</li><li>y two</li></ul></div><div class=footer>Copyright 2020 All rights reserved</div></div></body></html>", "T\n\naa bb cc dd\n\nx one\n\ny two"),
    ("<body><header><a href=/>Logo</a></header><section id=content><h1>A</h1><div>Div text without a paragraph tag, which goes on.</div></section><footer>f</footer></body>", "A\n\nDiv text without a paragraph tag, which goes on."),
    (
        "<html><body><div id=header><h1>My site</h1></div><div id=nav><ul><li><a href=1>One</a></li></ul></div><div id=main><h2>Story</h2><p>It was a dark night. And it rained.</p><p>Then it stopped.</p></div><div id=cookie-banner>We use cookies <button>OK</button></div><div id=footer>(c)</div></body></html>",
        "Story\n\nIt was a dark night. And it rained.\n\nThen it stopped.",
    ),
    ("<article><h1>X</h1><p>a b c</p><table><thead><tr><th>K</th><th>V</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table></article>", "X\n\na b c\n\nK\n\nV\n\n1\n\n2"),
    ("<main><article><p>One para.</p><figure><img><figcaption>Cap of it</figcaption></figure><p>Two para.</p></article></main><aside><p>Other stories you may like</p></aside>", "One para.\n\nCap of it\n\nTwo para."),
    ('<!doctype html><html><head><title>How to bake bread - Baker\'s Blog</title></head><body class="single postid-12"><div id="page"><header id="masthead" class="site-header"><a href="/" class="custom-logo">Baker\'s Blog</a><p class="site-description">Bread and more</p></header><nav id="site-navigation" role="navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div id="content"><div class="entry-content"><h1 class="entry-title">How to bake bread</h1><p>Mix flour, water and salt in a bowl.</p><p>Let the dough rest for one hour, then <a href="/fold">fold it</a> twice.</p><h2>Baking</h2><p>Bake at 230 degrees.</p><ul><li>20 minutes with steam</li><li>15 minutes without</li></ul></div><div class="sharedaddy"><h3>Share this:</h3><ul><li><a href="#">Twitter</a></li><li><a href="#">Facebook</a></li></ul></div></div><div id="comments"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Great recipe, thanks!</p></li><li class="comment"><p>Mine burned.</p></li></ol><form id="commentform"><label>Name</label><button>Post comment</button></form></div><aside id="secondary" class="widget-area"><h2>Recent posts</h2><ul><li><a href="/x">Rolls</a></li></ul></aside><footer id="colophon"><p>Proudly powered by WordPress</p></footer></div></body></html>', 'How to bake bread\n\nMix flour, water and salt in a bowl.\n\nLet the dough rest for one hour, then fold it twice.\n\nBaking\n\nBake at 230 degrees.\n\n20 minutes with steam\n\n15 minutes without'),
    ('<html><body><main role=main><section><h1>Docs</h1><p>Install the package first.</p><pre>pip install x\n  --user</pre><table><caption>Options</caption><tr><th>Flag</th><th>Meaning</th></tr><tr><td>-v</td><td>verbose</td></tr></table></section></main><footer><small>© 2021 Acme</small></footer></body></html>', 'Docs\n\nInstall the package first.\n\npip install x --user\n\nOptions\n\nFlag\n\nMeaning\n\n-v\n\nverbose'),
    ('<body><center><h1>My homepage</h1><p>Welcome to my page about cats. I have two cats and they are lazy.<p>They eat fish.<hr><p>Second topic: dogs. I have none.</center></body>', 'My homepage\n\nWelcome to my page about cats. I have two cats and they are lazy.\n\nThey eat fish.\n\nSecond topic: dogs. I have none.'),
    ('<html><body><div class=nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div class=story><p>First.</p><blockquote>Quoted words here.</blockquote><ol><li>Step one</li><li>Step two</li></ol><p>Last.</p></div></body></html>', 'First.\n\nQuoted words here.\n\nStep one\n\nStep two\n\nLast.'),
    ('<html><body><article><header><h1>Report title</h1></header><p>Intro text of the report.</p><footer>Posted in News</footer></article></body></html>', 'Report title\n\nIntro text of the report.'),
    ('<html><body><div id=wrapper><div id=top>Logo</div><div id=left><a href=1>Link one</a><br><a href=2>Link two</a></div><div id=maincontent><b>Bold heading</b><br>Text straight in a div, with line breaks<br>and more text.</div><div id=bottom>Contact us | Imprint</div></div></body></html>', 'Bold heading Text straight in a div, with line breaks and more text.'),
    ("<html><body><article><p>Das ist ein Satz mit Umlauten: äöü.</p><p>Noch ein Absatz.</p></article><div class='newsletter-signup'><p>Abonnieren Sie unseren Newsletter</p><form><input><button>OK</button></form></div></body></html>", 'Das ist ein Satz mit Umlauten: äöü.\n\nNoch ein Absatz.'),
    ('<article><h1>A</h1><p>One.</p><script>x<y</script><style>p{}</style><p>Two.</p><noscript>Enable JS</noscript></article>', 'A\n\nOne.\n\nTwo.'),
    ("<div class='content'><p>Only this paragraph is the text of the page, with enough words.</p></div><div class='comments'><p>nice</p></div>", 'Only this paragraph is the text of the page, with enough words.'),
    ('<p>a</p>', 'a'),
    ('<body>Just text in a body, nothing else at all.</body>', 'Just text in a body, nothing else at all.'),
    ('just plain text, no tags at all', 'just plain text, no tags at all'),
]


@pytest.fixture(scope="module")
def labeller():
    weights = html_extract.trained()
    return html_extract.BiLSTM(list(weights)), html_extract.Vectors(weights[8])


@pytest.mark.parametrize("page, text", PAGES)
def test_hand_labelled_pages(labeller, page, text):
    assert html_extract.main_texts([page], *labeller) == [text]


def test_tags_are_read_as_html_reads_them():
    texts = lambda page: [t for t, *_ in html_extract.blocks(page)]
    assert texts("<p>a<script>var x='<p>no</p>';</script>b<style>p{}</style>c</p>") == ["abc"]
    assert texts("<P CLASS='x' DATA=\"a>b\">one</P ><p a=b/c d>two") == ["one", "two"]
    assert texts("<p x=\"never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("<svg><text>no</text></svg><template><p>no</p></template>yes<textarea><p>no</textarea>") == ["yes"]
    assert texts("</><!doctype html><?x y?></ p>a<b>b</b><br>c &nbsp; d") == ["ab c d"]
    assert texts("<p>cut <a href='") == ["cut"] and texts("<!-- open <p>no</p>") == [] and texts("<") == ["<"]
    assert html_extract.blocks('<div class="A-b1" id=Main><p>x')[0][1] == ("<div", "a", "b", "main", "<p")
    assert html_extract.blocks("<ul><li>a<li>b</ul><p>c<p>d")[3][1] == ("<p",)


@pytest.mark.parametrize("deep", [0, 60, 64, 70, 200, 1500])
@pytest.mark.parametrize("classes", ["", "c " * 40 + "row"])
def test_deep_articles_come_out_whole(labeller, deep, classes):
    """Elements around an article's paragraphs, however many and however named, take nothing from it; nor from what is no article."""
    words = "Many words of a paragraph that tells something, in sentences. And it goes on."
    inside = f'<div class="{classes}">' * deep + f"<p>{words}</p><p>Second: {words}</p>" + "</div>" * deep
    foot = '<footer class="footer">' + "<div>" * deep + "<p>© 2024 Some site. All rights reserved.</p>" + "</div>" * deep + "</footer>"
    nav = "<nav>" + "<div>" * deep + "<ul><li><a>Home</a></li><li><a>News</a></li></ul>" + "</div>" * deep + "</nav>"
    page = f"<html><body>{nav}<article><h1>A headline</h1>{inside}</article>{foot}</body></html>"
    assert html_extract.main_texts([page], *labeller) == [f"A headline\n\n{words}\n\nSecond: {words}"]


def test_paths_lose_no_step():
    page = "<main>" + "".join(f'<div class="n{chr(97 + k % 26)}{chr(97 + k // 26)}">' for k in range(300)) + "<p>x"
    path = html_extract.blocks(page)[0][1]
    row = html_extract.Vectors().path(path)
    steps = ["<main", "<div", "<p", *[f"n{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]]
    assert len(path) == html_extract.STEPS + 1
    assert {int(k) for k in np.flatnonzero(row)} == {html_extract._hash(s, html_extract.PATH, seed) for s in steps for seed in (0, 1)}


def test_broken_pages_take_time_in_proportion():
    for unit in ("<a ", "<p ", '<a href="', "<", "</", "<!--", "<script>", "<p x='", '<i a=">', "&", "<td><li>", "</div>", "<div class='a b c d'>"):
        began = time.perf_counter()
        html_extract.blocks(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 8, unit  # seconds of a busy machine; the square would take minutes


def test_unseen_pages(labeller):
    net, make = labeller
    r, right, total = random.Random(77), 0, 0
    for _ in range(200):
        page = html_extract.example_page(r)
        p, _ = net.forward(*html_extract._padded([make.whole([(t, path, a) for t, path, a, _ in page])]))
        right += sum((q > 0.5) == bool(y) for q, (*_, y) in zip(p[:, 0], page, strict=True))
        total += len(page)
    assert right / total > 0.97


def test_extract_defines_every_case(spark):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li></ul></nav><!-- x --><div class="ad">Buy now this thing.</div><article><h1>Head &amp; tail</h1><p><b>First\n  words<br>here.<p>Second, longer paragraph of the article with words.</article><footer>&copy; site</footer></body></html>'
    long = "<article>" + "<p>many words of one long page, over and over.</p>" * 3000 + "</article>"
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<nav><ul><li><a>Only</a></li></ul></nav>"), (1, "u", page), (None, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    text = "Head & tail\n\nFirst words here.\n\nSecond, longer paragraph of the article with words."
    whole = "\n\n".join(["many words of one long page, over and over."] * 3000)
    assert got == {(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "", 0), (None, whole, len(whole))}
    assert html_extract.extract(df).count() == 6
    assert html_extract.extract(spark.createDataFrame([], "page_id string, url string, html string")).count() == 0
