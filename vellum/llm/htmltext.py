"""Main text of web pages by a maximum-scoring run of words and tags.

A page is read as a sequence of words and tags.  A word scores the log-odds that it is main text, a
tag the log-probability that it stands inside, which is never above zero; one linear scan finds the
contiguous run of highest total, and its blocks are the text.  All weights come from labelled pages,
by logistic regression: pages of the table that mark their text by one ``article`` element label
themselves, at most ``SAMPLE`` of them, and ``model_pages`` writes labelled pages with the furniture
that a table may lack.

No name makes an element furniture.  The words of its class, id and role are features like others; an
element is furniture if these, with all the words it holds, score below zero together.  So a wrapper
or a section of prose stays whatever it is called.  Furniture inside the run is left out of the text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table

#: Self-labelled pages of the table that the weights are fitted to, and the characters of the longest.
SAMPLE, SAMPLE_CHARS = 300, 20_000
MODEL_PAGES = 500
#: Words of a piece of furniture that count against a run; the others only make it longer.
INSET_WORDS = 3
#: What a word or tag takes off at least, and the most that a word's score can be either way.
LEAST, MOST = 0.02, 8.0
#: Words of classes that the model knows at most, and the pages that one has to be on.
NAMES, NAME_PAGES = 2000, 5
#: A tag counts as so much of a word.
TAG_SHARE = 0.25
#: What a word scores at least in a named element that is found to be main text.
SURE = 1.0
SEED = 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?][^>]*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't markup; open ones last to the page's end.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content isn't shown; open ones hold nothing.
UNSHOWN = frozenset("template svg canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Open elements that a start tag ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
#: Elements whose own name is a feature of what they hold.
TELLING = frozenset("nav menu header footer aside dialog form button select fieldset noscript head".split())
#: Elements that hold a page's main text; neither their classes nor those of what holds them say anything.
HOLDERS = frozenset(("html", "body", "main", "article"))
LOOSE = frozenset("b i em strong u s small sup sub font big a span abbr code kbd cite q mark del ins time label tt".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


def names_of(name: str, attributes: str, within: bool) -> tuple[str, ...]:
    """The features of an element: its own name if that tells something, and the words of class, id and role."""
    # the heading of an article is part of it
    own = [f"el {name}"] if name in TELLING and not (within and name == "header") else []
    if not attributes or attributes.isspace():
        return tuple(own)
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value.lower()):
            return ("hidden",)
        if key in ("class", "id", "role") and name not in HOLDERS and name not in HEADINGS:
            for part in CAMEL.sub(r"\1-\2", value).lower().split():
                bits = SPLIT.split(part)
                if bits[0] not in ("has", "with", "no", "not", "js"):
                    own += [f"c {b}" for b in bits if b and not b.isdigit()]
    return tuple(dict.fromkeys(own))


@dataclass
class Page:
    """A page as a sequence.  ``items`` are (is word, element, what it is, words, block); of elements
    ``up`` has the one that holds each, ``names`` its features, ``exempt`` whether these say nothing."""

    items: list[tuple[bool, int, tuple, int, int]] = field(default_factory=list)
    blocks: list[tuple[str, int]] = field(default_factory=list)  # text, element
    sizes: list[int] = field(default_factory=list)  # of each block, in words
    inside: list[bool] = field(default_factory=list)  # of each item: main text, by its label
    up: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    exempt: list[bool] = field(default_factory=lambda: [True])
    held: list[bool] = field(default_factory=lambda: [False])  # of each element: in an article or main element
    named: list[bool] = field(default_factory=lambda: [False])  # of each element: it has names, or one that holds it


def read(source: str) -> Page:
    """The page's words and tags.  Never fails: what isn't markup is text.

    Labels are those of ``<?+>`` and ``<?->`` marks if there are any before, else of ``article`` elements.
    """
    page = Page()
    items, blocks, sizes = page.items, page.blocks, page.sizes
    stack: list[tuple[str, int]] = []  # open elements
    opened: Counter = Counter()
    leaf, linked, element, marked = "", 0, 0, None
    parts: list[str] = []
    count = 0

    def close_block() -> None:
        nonlocal count
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, element))
                sizes.append(count)
            parts.clear()
            count = 0

    def shut() -> None:
        nonlocal element
        name, _ = stack.pop()
        opened[name] -= 1
        element = stack[-1][1] if stack else 0

    def item(is_word: bool, what: tuple, n: int) -> None:
        items.append((is_word, element, what, n, len(blocks)))
        page.inside.append(opened["article"] > 0 if marked is None else marked)

    def text_of(raw: str) -> None:
        nonlocal count
        if raw:
            text = html.unescape(raw)
            n = len(text.split())
            parts.append(text)
            count += n
            if n:
                item(True, (leaf, linked > 0, "held" if page.held[element] else "bare" if not page.named[element] else ""), n)

    at, end = 0, len(source)
    gone: set[str] = set()  # unshown elements that never end
    while at < end:
        start = source.find("<", at)
        if start < 0:
            text_of(source[at:])
            break
        m = TOKEN.match(source, start)
        if not m:  # a lone "<" is text
            stop = source.find("<", start + 1)
            stop = end if stop < 0 else stop
            text_of(source[at:stop])
            at = stop
            continue
        text_of(source[at:start])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1] in ("?+", "?-"):
                close_block()
                marked = m[1] == "?+"
            continue
        name, closing, attributes = name.lower(), (m[2] or m[5]) == "/", m[4] or m[7] or ""
        if name in BLOCKS:
            close_block()
            leaf = "" if closing else name
        elif name == "br":
            parts.append(" ")
        if name == "a":
            linked = 0 if closing else 1
        item(False, (name,), 1)
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    shut()
                shut()
            continue
        if name in RAW or name in UNSHOWN and name not in gone:
            if attributes.endswith("/"):
                continue
            over = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
            if over:
                at = over.start()
            elif name in RAW:
                at = end
            else:
                gone.add(name)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            shut()
        if name in ENDS:
            while stack and stack[-1][0] in ENDS[name]:
                shut()
        own = names_of(name, attributes, opened["article"] + opened["main"] > 0)
        if name in LOOSE and not own:
            continue
        if own or name in HOLDERS:
            page.up.append(element)
            page.names.append(own)
            page.exempt.append(name in HOLDERS)
            page.held.append(page.held[element] or name in ("article", "main"))
            page.named.append(bool(own) or page.named[element])
            element = len(page.up) - 1
            if name in ("article", "main"):
                above = page.up[element]
                while above >= 0 and not page.exempt[above]:
                    page.exempt[above] = True
                    above = page.up[above]
        stack.append((name, element))
        opened[name] += 1
    close_block()
    return page


#: Blocks by what they are like; others are "other".
LEAVES = {"p": "p", "li": "li", "td": "cell", "th": "cell", "pre": "p", "blockquote": "p", "dd": "li", "dt": "li", "figcaption": "p"} | dict.fromkeys(HEADINGS, "h")


def word_features(what: tuple, size: int) -> list[str]:
    leaf, linked, where = what
    length = "1" if size < 5 else "5" if size < 15 else "15" if size < 40 else "40"
    own = ["word", f"leaf {LEAVES.get(leaf, 'other')}", f"size {length}"] + ["linked"] * linked
    return [f"{where} {f}" for f in own] if where else own


def name_features(names: Iterable[str], held: bool) -> list[str]:
    """What elements' names say; inside an article or main element, more besides."""
    return [*names, *(f"held {n}" for n in names)] if held else list(names)


@dataclass
class Weights:
    """Weights of features; ``word`` is a log-odds, ``tag`` the logarithm of a probability."""

    of: dict[str, float]
    memory: dict[tuple, float] = field(default_factory=dict, repr=False)

    def word(self, what: tuple, size: int) -> float:
        size = 1 if size < 5 else 5 if size < 15 else 15 if size < 40 else 40
        s = self.memory.get((what, size))
        if s is None:
            s = self.memory[what, size] = max(-MOST, min(MOST, sum(self.of.get(f, 0.0) for f in word_features(what, size))))
            if len(self.memory) > 10_000:
                self.memory.clear()
        return s

    def tag(self, name: str) -> float:
        s = max(-MOST, min(MOST, self.of.get("tag", 0.0) + self.of.get(f"tag {name}", 0.0)))
        return min(-LEAST, -TAG_SHARE * math.log1p(math.exp(-s)))

    def names(self, names: tuple[str, ...], held: bool) -> float:
        return sum(self.of.get(f, 0.0) for f in name_features(names, held))


#: Words that name furniture on the model pages, and the elements that hold it at times.
FURNITURE = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip toolbar",
    "header": "masthead topbar branding logo tagline header",
    "footer": "footer bottombar copyright colophon",
    "sidebar": "sidebar aside widget widgets related recommended recommendations trending blogroll rail complementary",
    "notice": "cookie cookies consent gdpr notice banner popup modal overlay toast newsletter subscribe subscription paywall disclaimer",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promoted adslot adbox outbrain taboola",
    "form": "form login signin signup search searchbox register contactform",
    "comment": "comment comments commentlist respond reply replies disqus",
    "social": "share sharing social follow",
}
#: Words that name furniture on some pages and main text on others, and words that tell little.
EITHER = "popular tags archive archives legal promo promotion alert discussion feedback related top bottom feature latest more extra teaser".split()
PLAIN = "content post entry article story body main page text container wrapper inner outer site section box block row col column layout grid primary app root wrap single prose blog news item module figures results".split()
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def model_pages(n: int = MODEL_PAGES, seed: int = SEED) -> list[list[tuple[str, bool]]]:
    """Labelled pages: lists of (markup, is main text) pieces, joined in order."""
    rng = random.Random(seed)
    # which words there are says nothing here, only how many
    words = lambda a, b: " ".join(["word"] * rng.randint(a, b))
    link = lambda: f'<a href="/there">{words(1, 4)}</a>'
    glue = lambda *xs: rng.choice(["-", "-", "_", " ", " "]).join(xs)

    def prose() -> str:
        return rng.choice([words(1, 90), words(20, 60) + " " + link() + " " + words(3, 30), f"<b>{words(1, 20)}</b> {words(1, 30)}"])

    def named(*xs: str) -> str:
        return f'{rng.choice(["class", "class", "id"])}="{glue(*rng.sample(xs, len(xs)))}"'

    def furniture(kind: str) -> str:
        inner = rng.choice([
            "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>",
            f"<p>{words(3, 40)}</p>", words(2, 15), f"<h3>{words(1, 4)}</h3><p>{words(3, 30)} {link()}</p>", link() + " " + link(),
        ])
        if kind == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>'
        if kind == "comment":
            inner = "".join(f"<div {named(rng.choice(['comment', 'reply']), 'body')}><p>{words(3, 70)}</p></div>" if rng.random() < 0.5 else f"<p>{words(3, 70)}</p>" for _ in range(rng.randint(1, 8)))
        if kind == "bare":
            return rng.choice([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<div>{link()} {link()}</div>", f"<p>{link()}</p>"])
        if kind == "either":
            return f"<div {named(rng.choice(EITHER))}>{rng.choice(['<ul>' + ''.join(f'<li>{link()}</li>' for _ in range(4)) + '</ul>', words(2, 9), link()])}</div>"
        if kind in ELEMENTS and rng.random() < 0.5:
            return f"<{ELEMENTS[kind]}>{inner}</{ELEMENTS[kind]}>"
        said = [rng.choice(FURNITURE[kind].split())] + ([rng.choice(PLAIN)] if rng.random() < 0.4 else [])
        return f"<{(e := rng.choice(['div', 'section', 'ul' if '<li>' in inner else 'div']))} {named(*said)}>{inner}</{e}>"

    out = []
    for _ in range(n):
        wrapper = [rng.choice(PLAIN)] + ([rng.choice(PLAIN)] if rng.random() < 0.4 else []) + ([rng.choice(EITHER)] if rng.random() < 0.4 else [])
        open_, shut = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), (f"<div {named(*wrapper)}>", "</div>"), (f"<section {named(*wrapper)}>", "</section>"), ("<div>", "</div>"), ("", "")])
        before = ["menu", "header", "notice", "advert", "form", "sidebar", "social", "either", "bare"]
        after = ["footer", "comment", "sidebar", "advert", "menu", "notice", "social", "form", "either", "bare"]
        page = [("<!DOCTYPE html><html><head><title>x</title></head><body>", False)]
        page += [(furniture(k), False) for k in rng.sample(before, rng.randint(0, 4))]
        page.append((open_, False))
        if rng.random() < 0.8:
            page.append((f"<h1>{words(2, 10)}</h1>", True))
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.13:
                page.append((furniture(rng.choice(["advert", "social", "sidebar", "notice", "either"])), False))
            elif r < 0.19:
                page.append((f"<h2>{words(1, 7)}</h2>", True))
            elif r < 0.27:
                page.append(("<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", True))
            elif r < 0.37:
                inner = "".join(f"<p>{words(10, 80)}</p>" for _ in range(rng.randint(1, 3)))
                page.append((f"<section {named(rng.choice(EITHER), *rng.sample(PLAIN, rng.randint(0, 1)))}><h2>{words(1, 3)}</h2>{inner}</section>", True))
            else:
                page.append((f"<p>{prose()}</p>", True))
        if open_ in ("<article>", "<main>") and rng.random() < 0.2:
            page.append((furniture("comment"), False))
        page.append((shut, False))
        page += [(furniture(k), False) for k in rng.sample(after, rng.randint(0, 5))]
        out.append(page + [("</body></html>", False)])
    return out


def marked_source(pieces: list[tuple[str, bool]]) -> str:
    return "".join(f"<?+>{m}<?->" if main else m if m == "" else f"<?->{m}" for m, main in pieces)


def _logistic(rows: list[list[str]], yes: np.ndarray, no: np.ndarray, ridge: float) -> dict[str, float]:
    """Ridge logistic regression by Newton's method on rows of features, told ``yes`` and ``no`` times."""
    names = {f: i for i, f in enumerate(sorted({f for fs in rows for f in fs}))}
    x = np.zeros((len(rows), len(names)))
    for i, fs in enumerate(rows):
        x[i, [names[f] for f in fs]] = 1
    w = np.zeros(len(names))
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (yes - (yes + no) * p) - ridge * w
        hessian = (x * ((yes + no) * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return {f: float(w[i]) for f, i in names.items()}


def fit(sources: list[str], ridge: float = 1.0) -> Weights:
    """Weights from pages with one ``article`` element each, and from the model pages."""
    pages = [read(s) for s in sources] + [read(marked_source(p)) for p in model_pages()]
    on = Counter(n for p in pages for n in {n for names in p.names for n in names})
    known = {n for n, k in sorted(on.items(), key=lambda x: (-x[1], x[0]))[:NAMES] if k >= NAME_PAGES}
    words: dict[tuple, Counter] = {}
    tags: dict[tuple, Counter] = {}
    for page in pages:
        held: list[frozenset] = []
        for up, names, exempt in zip(page.up, page.names, page.exempt, strict=True):
            above = held[up] if up >= 0 else frozenset()
            held.append(above if exempt else above | known.intersection(names))
        for (is_word, element, what, n, block), inside in zip(page.items, page.inside, strict=True):
            if is_word:
                words.setdefault((*word_features(what, page.sizes[block]), *name_features(sorted(held[element]), page.held[element])), Counter())[inside] += n
            else:
                tags.setdefault(("tag", f"tag {what[0]}"), Counter())[inside] += n
    of: dict[str, float] = {"hidden": -4 * MOST}
    for counts in (words, tags):
        # counts are damped so that a very common context leaves others their say
        yes, no = (np.sqrt(np.array([c[b] for c in counts.values()], dtype=float)) for b in (True, False))
        of.update({f: v for f, v in _logistic([list(k) for k in counts], yes, no, ridge).items() if f != "hidden"})
    return Weights(of)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run [a, b) of highest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def furniture_of(page: Page, weights: Weights) -> tuple[list[float], list[float]]:
    """Of each element, what its names take off a word if it is furniture, and what its words score if it is main text.

    An element is furniture if one that holds it is, or if its names and all words in it score below
    zero; it is main text if these score above, and what it holds is too: its words then score what they
    do on average, or ``SURE``, at least, so that a short block of it isn't cut off.
    """
    words, score, said = [0.0] * len(page.up), [0.0] * len(page.up), [0.0] * len(page.up)
    for is_word, element, what, n, block in page.items:
        # the page itself is held against its running text
        if is_word and (element or not what[1]):
            words[element] += n
            score[element] += n * weights.word(what, page.sizes[block])
    for i in range(len(page.up) - 1, 0, -1):
        said[i] = 0.0 if page.exempt[i] else weights.names(page.names[i], page.held[i])
        # furniture says nothing of what holds it
        if page.up[i] and score[i] + said[i] * words[i] >= 0:
            words[page.up[i]] += words[i]
            score[page.up[i]] += score[i]
    off, main = [0.0] * len(page.up), [-MOST] * len(page.up)
    for i in range(len(page.up)):
        if i:
            off[i], main[i] = off[page.up[i]], main[page.up[i]]
        total = score[i] + said[i] * words[i]
        if off[i] < 0 or i and page.exempt[i] and not page.held[i]:
            continue
        if said[i] < 0 and total < 0:
            off[i], main[i] = said[i], -MOST
        elif total > 0:
            main[i] = max(main[i], total / words[i], SURE if i else 0.0)
    return off, main


def extract(source: str | None, weights: Weights) -> str:
    """The main text of a page: its blocks, joined by two newlines.

    Null, empty and blank pages have none, nor have pages whose words all score below zero.  Unclosed,
    misnested and very deep markup is read as far as it goes; text outside any markup is text.
    """
    if not source:
        return ""
    page = read(source)
    if all(item[0] for item in page.items):  # no markup
        return "\n\n".join(text for text, _ in page.blocks)
    off, main = furniture_of(page, weights)
    scores = []
    for is_word, element, what, n, block in page.items:
        if not is_word:
            scores.append(weights.tag(what[0]))
        elif off[element] < 0:
            # furniture among main text is left out of it, not an end of it
            scores.append(-LEAST * min(n, INSET_WORDS))
        else:
            s = weights.word(what, page.sizes[block])
            if not what[1]:
                s = max(s, main[element])
            scores.append(s * n if s > 0 else s * min(n, INSET_WORDS))
    a, b = best_run(scores)
    chosen = [item[4] for item in page.items[a:b] if item[0] and off[item[1]] >= 0]
    if not chosen:
        return ""
    return "\n\n".join(text for text, element in page.blocks[min(chosen) : max(chosen) + 1] if off[element] >= 0)


def training_pages(pages: DataFrame, column: str = "html") -> list[str]:
    """At most ``SAMPLE`` different pages that have one article element, picked by a hash of the page.

    Hashes are picked first, on rows of eight bytes; then the pages that have them are fetched.
    """
    own = pages.select(F.col(column).cast("string").alias("h"))
    own = own.where(F.length("h").between(1, SAMPLE_CHARS) & (F.regexp_count("h", F.lit("(?i)<article[\\s>]")) == 1)).withColumn("at", F.xxhash64("h"))
    picked = [r["at"] for r in own.groupBy("at").agg(F.lit(1).alias("one")).orderBy("at").limit(SAMPLE).collect()]
    if not picked:
        return []
    return sorted(r["h"] for r in own.where(F.col("at").isin(picked)).groupBy("at").agg(F.min("h").alias("h")).collect())


def text_column(spark: SparkSession, weights: Weights, column: str = "html") -> Column:
    shipped = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for sources in batches:
            yield pd.Series([extract(s, own) for s in sources], dtype=object)

    return text(F.col(column).cast("string"))


def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    One row per row of the table, repeated rows and null ids included; null and empty pages have an
    empty text.  Columns of other names don't matter.
    """
    pages = table(spark, sf_dir, "pages")
    weights = fit(training_pages(pages))
    return pages.select("page_id", "url", text_column(spark, weights).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
