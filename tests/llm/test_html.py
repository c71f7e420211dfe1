import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from scenelake.llm.html_text import _Page, _parsed, extract, main_text

WORDS = "stone river, walks, over green hills and, quiet roads, where people talk of rain".split()


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n)) + "."


@pytest.mark.parametrize("seed", range(40))
def test_labelled_pages(seed):
    """Pages put together from known parts: exactly the article's blocks come out."""
    draw = random.Random(seed)
    want, body = [], []
    for _ in range(draw.randint(3, 9)):
        kind = draw.choice(["p", "p", "p", "blockquote", "ul", "h2", "links", "pre"])
        text = prose(draw, draw.randint(25, 60))
        if kind == "ul":
            items = [prose(draw, 5) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            want += items
        elif kind == "links":
            if not any(x.startswith("<p>") for x in body):
                continue  # before any text a list of links is a menu
            items = [f"see {i}" for i in range(4)]
            body.append("<ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(items)) + "</ul>")
            want += items
        else:
            body.append(f"<{kind}>{text}</{kind}>")
            want.append(text)
    body += [f"<p>{prose(draw, 40)}</p>" for _ in range(3)]
    want += [x[3:-4] for x in body[-3:]]
    frame = draw.choice([
        "<article>%s</article>", "<div class='main-content no-sidebar'>%s</div>", "<div class='post comments-open'>%s</div>",
        "<div class='story share'>%s</div>", "<form action=x><div>%s</div></form>", "<div id=widget><div>%s</div></div>",
        "<main><div class=x>%s</div></main>", "<div><div>%s</div></div>",
    ])
    junk = [
        f"<nav><p>{prose(draw, 30)}</p></nav>", f"<div class=sidebar><p>{prose(draw, 30)}</p></div>",
        f"<div id=cookie-notice>{prose(draw, 30)}</div>", f"<aside><p>{prose(draw, 30)}</p></aside>",
        "<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>", "<script>var x = '<p>no</p>'</script>",
        "<style>p{}</style>", f"<form><label>{prose(draw, 9)}</label><input></form>", f"<div class='ad-banner'>{prose(draw, 12)}</div>",
    ]
    draw.shuffle(junk)
    comments = f"<section id=comments>{''.join(f'<p>{prose(draw, 60)}</p>' for _ in range(draw.randint(0, 30)))}</section>"
    page = "<html><body>" + "".join(junk[:4]) + frame % "".join(body) + comments + "".join(junk[4:]) + "<footer>foot</footer></body></html>"
    assert main_text(page).split("\n") == want


class Slow(HTMLParser):
    """Every paragraph's points by a walk over all its ancestors; for well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.nodes, self.stack = [["#", None, "", ""]], [0]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, self.stack[-1], "", ""])
        self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        at, linked = self.stack[-1], False
        while self.nodes[at][0] in ("a", "b", "i", "span"):
            linked |= self.nodes[at][0] == "a"
            at = self.nodes[at][1]
        self.nodes[at][2] += data
        self.nodes[at][3] += data if linked else ""

    def scores(self):
        out = [0.0] * len(self.nodes)
        for i, (tag, up, text, linked) in enumerate(self.nodes):
            if not text.strip() or tag in ("h1", "h2"):
                continue
            points = ((len(text) >= 25) + min(len(text) / 100, 3) + text.count(",")) * (1 - len(linked) / len(text))
            at, level = i if tag in ("article", "main", "section", "body") else up, 0
            while at:
                out[at] += points / (1, 2)[level] if level < 2 else points / (2 * 3 ** (level - 1))
                at, level = self.nodes[at][1], level + 1
            if at == 0:
                out[0] += 0
        return out


@pytest.mark.parametrize("seed", range(30))
def test_points_by_a_walk_over_ancestors(seed):
    draw = random.Random(seed)

    def part(depth):
        if depth > 5 or draw.random() < 0.4:
            text = prose(draw, draw.randint(1, 40))
            return f"<p>{text}<a>{prose(draw, 4)}</a></p>" if draw.random() < 0.3 else f"<p>{text}</p>"
        tag = draw.choice(["div", "section", "blockquote", "h2", "span"]) if depth else "body"
        if tag in ("h2", "span"):
            return f"<div><{tag}>{prose(draw, 8)}</{tag}></div>"
        return f"<{tag}>" + "".join(part(depth + 1) for _ in range(draw.randint(1, 4))) + f"</{tag}>"

    page = "<body>" + "".join(part(1) for _ in range(3)) + "</body>"
    got, want = _Page(_parsed(page)).scores(), Slow(page).scores()
    assert got[1:] == pytest.approx(want[1:])


def test_odd_markup():
    assert main_text("<p>hello there <b unclosed") == "hello there"
    assert main_text("<p>a < b and <3 &lt;i&gt;</p>") == "a < b and <3 <i>"
    assert main_text("<p>x<a title='>' href=\">\">y</a> z") == "xy z"
    assert main_text("<p>x<![CDATA[<b> & c]]>y") == "x<b> & cy"
    assert main_text("<p>same</p>" * 3) == "same\nsame\nsame"


@pytest.mark.parametrize(
    "page",
    ["<a \"" * 100_000, "<![CDATA[" * 50_000, "<div>text" * 50_000, "<a x=\"" * 80_000, "<!--" * 100_000, "<div>" * 50_000 + "</section>" * 50_000,
     "<a x=\">'" * 50_000, "<ul><li>" * 50_000],
)
def test_long_odd_pages_take_linear_time(page):
    start = time.monotonic()
    main_text(page)
    assert time.monotonic() - start < 20


def test_long_page_is_whole():
    parts = [f"paragraph {i}, with some words, and more of them" for i in range(20_000)]
    assert main_text("<body>" + "".join(f"<p>{p}</p>" for p in parts) + "</body>") == "\n".join(parts)
    deep = "<article>" + "".join(f"<div>level {i}, text" for i in range(3_000))
    assert main_text(deep).count("\n") == 2_999


def test_clashing_columns(spark):
    rows = [(1, "u", "<p>x", "old", 7), (None, None, "<p>y", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, id long")
    got = extract(pages).orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r.id, r.url, r.text) for r in got] == [(1, "u", "x"), (None, None, "y")]
