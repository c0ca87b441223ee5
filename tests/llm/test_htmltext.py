from collections import Counter

import pytest

from vellum.llm import htmltext

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>'
    '<header class="site"><a href="/">Brand</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Shop now</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies on this site, accept them all please.</div><!-- <p>gone</p> -->'
    "{open}<h1>A  heading\n of it</h1><p><b>First &amp; best&nbsp;words of<br>a paragraph that says a few things.<p>Second one, &lt;left open&gt;"
    '<div class="ad">Buy this thing now</div><ul><li>item one<li>item two</ul><p>End.</p>{shut}'
    '<aside><p>Other stories that you may like to read today.</p></aside><div id="comments"><p>I disagree with all of it, said someone.</p></div>'
    '<form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; all rights reserved by us</footer></body></html>'
)
WANT = ["A heading of it", "First & best words of a paragraph that says a few things.", "Second one, <left open>", "item one", "item two", "End."]


@pytest.fixture(scope="module")
def weights():
    return htmltext.fit([])


@pytest.mark.parametrize(("open_", "shut"), [("<article>", "</article>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ("", "")])
def test_the_article_without_its_furniture(weights, open_, shut):
    assert htmltext.extract(PAGE.replace("{open}", open_).replace("{shut}", shut), weights).split("\n\n") == WANT


def test_held_out_labelled_pages(weights):
    right = 0
    words = wanted = both = 0
    for pieces in htmltext.model_pages(200, seed=77):
        want = [t for markup, main in pieces if main for t, _ in htmltext.read(markup).blocks]
        got = htmltext.extract("".join(m for m, _ in pieces), weights)
        right += got == "\n\n".join(want)
        a, b = Counter(got.split("\n\n")), Counter(want)
        words, wanted, both = words + sum(a.values()), wanted + sum(b.values()), both + sum((a & b).values())
    print(right, words, wanted, both)
    assert right >= 120 and both >= 0.95 * wanted and both >= 0.95 * words


@pytest.mark.parametrize("source", [None, "", "   ", "<", "<<<>>", "<p", "<!-- open", "<script>x", "</p></div>", "<a href='x", "&#0;&#xFFFFFF;&bogus;", "<p>" * 5000, "<" * 20_000, '<a "' * 5000])
def test_reading_never_fails(weights, source):
    assert isinstance(htmltext.extract(source, weights), str)


BODY = "<h1>Night on the river</h1>" + "".join(f"<p>Paragraph {i} says that the river was slow and the lanterns stood along it all night.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["site-wrapper popular", "entry-content tags-news", "content legal", "promo-article", "main-archive", "page alert-story"])
def test_a_name_alone_makes_no_furniture(weights, name):
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="{name}">{BODY}</div><footer>copyright of ours</footer></body></html>'
    assert htmltext.extract(page, weights).split("\n\n") == ["Night on the river"] + [f"Paragraph {i} says that the river was slow and the lanterns stood along it all night." for i in range(6)]


@pytest.mark.parametrize("shell", ['<section id="discussion"><h2 id="comments">Discussion</h2>{}</section>', '<section id="legal">{}</section>', '<div class="related-figures">{}</div>'])
def test_sections_of_an_article_stay(weights, shell):
    inner = "<p>One more paragraph stands in a section of its own here.</p><p>And another, which is short.</p>"
    got = htmltext.extract(f'<body><article>{BODY}{shell.format(inner)}<p>The end of it.</p><div class="ad">Buy it now</div></article><div class="comments"><p>I say so too, and more.</p></div></body>', weights)
    assert "One more" in got and "And another" in got and got.endswith("The end of it.") and "Buy" not in got


def test_handwritten_pages(weights):
    wiki = (
        '<body class="skin"><div id="mw-head"><ul class="tabs"><li><a href="/t">Talk</a></li><li><a href="/e">Edit</a></li></ul></div><div id="content"><h1>Heron</h1>'
        "<p>The heron is a long-legged bird that lives near water, and it feeds mostly on fish that it catches in the shallows.</p>"
        "<p>It nests in colonies, high in trees, and comes back to the same nest year after year.</p></div>"
        '<div id="footer"><ul><li><a href="/p">Privacy</a></li><li><a href="/d">Terms</a></li></ul></div></body>'
    )
    assert htmltext.extract(wiki, weights).split("\n\n")[0] == "Heron" and htmltext.extract(wiki, weights).endswith("year after year.")
    shop = '<main><h1>Kettle</h1><p>Holds one litre and whistles when the water boils, which takes about four minutes.</p><aside class="newsletter">Get our letter</aside></main><div class="cookie-banner"><p>We use cookies to make this site better for all of its many visitors.</p><button>Fine</button></div>'
    assert htmltext.extract(shop, weights) == "Kettle\n\nHolds one litre and whistles when the water boils, which takes about four minutes."
    sums = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><p>Then so it is with every other number that there is.</p></article>"
    assert htmltext.extract(sums, weights).startswith("Let x=2 hold.")


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "text", '<div class="a b">' * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<li>" * 100_000])
def test_deep_markup_takes_linear_time(weights, source):
    import time

    start = time.process_time()
    htmltext.extract(source, weights)
    assert time.process_time() - start < 10


def test_long_pages_are_read_whole(weights):
    body = "".join(f"<p>Paragraph {i} holds some words of text.</p>" for i in range(20_000))
    got = htmltext.extract(f"<nav><a href=x>menu</a></nav><article>{body}</article><footer>end</footer>", weights)
    assert got.count("\n\n") == 19_999 and got.endswith("Paragraph 19999 holds some words of text.")


def test_best_run_against_all_runs():
    import random

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        a, b = htmltext.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def test_the_query(spark, tmp_path):
    page = PAGE.replace("{open}", "<article>").replace("{shut}", "</article>")
    rows = [(1, "http://a", page, "c"), (1, "http://a", page, "c"), (2, None, None, "c"), (None, "u", "plain words only", "c"), (3, "u", "", "c")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = htmltext.op3_htmltext(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted(
        [("1", "\n\n".join(WANT), len("\n\n".join(WANT)))] * 2 + [("2", "", 0), ("3", "", 0), ("None", "plain words only", 16)]
    )
