"""Main text of HTML pages by tree scoring.

A lenient parser builds the element tree in one pass over the page.  Every block with text is a
paragraph: it earns points for length and commas, discounted by the share of its text in links.
Points go up the tree once, from the last element to the first: all to the parent, half to the next
ancestor, a third of what is left at each one above.  The container with the most points, discounted
by its own link density, is the article; its siblings that score well or read like text stay too.

Elements whose name or role is boilerplate (navigation, footers, scripts) are left out.  Class names
and forms only speak against an element: one that holds most of the page's paragraph text, with no
headline or article elsewhere, is the frame of the article and stays.  Comments stay out in any size.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
#: What matters inside a tag: its end, or the quote that opens a value.
_IN_TAG = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements deeper than this become siblings, as in browsers; texts stay in page order.
MAX_DEPTH = 512

# Element and attribute names of HTML, by their role here.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LISTS = {"ul", "ol", "dl", "dir"}
_TEXTUAL = {"p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "details"} | _HEADING
_BOILER_TAGS = set(
    "nav header footer aside script style noscript template iframe object svg canvas audio video "
    "button select option datalist input textarea label head title dialog menu search".split()
)
_BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion sidebar aside rail nav navbar navigation menu menubar breadcrumb breadcrumbs footer "
    "foot header masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended widget pagination pager copyright disclaimer".split()
)
_COMMENT_WORDS = {"comment", "comments", "respond", "disqus", "discussion"}
_BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_GOOD_WORDS = set("article body content entry hentry main page post story text blog".split())
#: Names that begin or end so tell of a state of the page, not of the element's role.
_STATES = {"has", "no", "with", "without", "is"}
_STATES_AFTER = {"open", "closed", "enabled", "disabled", "on", "off"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
_NEVER_CLOSE = {"html", "body", "table"}

# How an element stands by its names: no objection, out, out unless it frames the article, comments.
_FINE, _OUT, _DOUBTED, _COMMENTS = range(4)


class _Tree:
    """Elements in page order with name, parent and standing; and the texts in them.

    A text also has the number of block borders before it, so two texts of one block that no other
    block parts have equal numbers.
    """

    def __init__(self) -> None:
        self.tags = ["#"]
        self.parents = [-1]
        self.standing = [_FINE]
        self.bonus = [0.0]
        self.texts: list[tuple[int, int, str]] = []
        self.stack = [0]
        self.open_tags: dict[str, int] = {}
        self.borders = 0

    def _pop(self, at: int) -> None:
        for i in self.stack[at:]:
            tag = self.tags[i]
            self.open_tags[tag] -= 1
            self.borders += tag in _BLOCK
        del self.stack[at:]

    def open(self, tag: str, attrs: str) -> None:
        if len(self.stack) > MAX_DEPTH:
            self._pop(MAX_DEPTH)
        standing, bonus = _OUT if tag in _BOILER_TAGS else _FINE, 0.0
        if attrs and tag not in ("html", "body") and standing != _OUT:
            standing, bonus = _judged(attrs)
        if tag in ("article", "main"):
            standing, bonus = (_FINE if standing == _DOUBTED else standing), bonus + 10
        elif tag == "form" and standing == _FINE:
            standing = _DOUBTED
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.standing.append(standing)
        self.bonus.append(bonus)
        self.stack.append(len(self.tags) - 1)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.borders += tag in _BLOCK

    def close(self, tag: str) -> None:
        if not self.open_tags.get(tag):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[at]]
            if name == tag:
                self._pop(at)
                return
            if name in _BLOCK and tag not in _BLOCK:
                return  # an inline end tag doesn't close blocks

    def close_open(self, tags: set[str], limits: set[str]) -> None:
        """Close the innermost open element of ``tags``, if no element of ``limits`` is inside."""
        if not any(self.open_tags.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[at]]
            if name in tags:
                self._pop(at)
                return
            if name in limits or name in _NEVER_CLOSE:
                return

    def text(self, data: str) -> None:
        if data:
            self.texts.append((self.stack[-1], self.borders, data))


def _judged(attrs: str) -> tuple[int, float]:
    """An element's standing by its attributes, and the bonus for a good class or id."""
    bonus, standing = 0.0, _FINE
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = next((v for v in (m[2], m[3], m[4]) if v is not None), "").lower()
        if name in ("class", "id"):
            names = [re.split(r"[_-]+", n) for n in value.split()]
            good = any(n[0] in _GOOD_WORDS for n in names if len(n) == 1)
            for n in names:
                if n[0] in _STATES or n[-1] in _STATES_AFTER:
                    continue
                # beside a content name, a compound such as sidebar-left is a matter of layout
                if good and len(n) > 1 and n[0] not in _GOOD_WORDS:
                    continue
                if set(n) & _COMMENT_WORDS:
                    standing = max(standing, _DOUBTED if good else _COMMENTS)
                elif set(n) & _BOILER_WORDS:
                    standing = max(standing, _DOUBTED)
                elif set(n) & _GOOD_WORDS:
                    bonus = 25.0
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return _OUT, 0.0
        elif name == "role" and value in _BOILER_ROLES:
            return _OUT, 0.0
        elif name == "role" and value == "form":
            standing = max(standing, _DOUBTED)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _OUT, 0.0
    return standing, bonus


class _Finder:
    """``str.find`` from rising places; what isn't found once is never looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, int] = {}

    def after(self, needle: str, at: int) -> int:
        found = self.known.get(needle, 0)
        if 0 <= found < at:
            found = self.known[needle] = self.page.find(needle, at)
        elif needle not in self.known:
            found = self.known[needle] = self.page.find(needle, at)
        return found


def _tag_end(find: _Finder, at: int) -> int:
    """Where the tag that began before ``at`` has its ``>``, quoted values aside; -1 if nowhere.

    A quote that never closes counts as none, and the search goes on behind it.
    """
    while m := _IN_TAG.search(find.page, at):
        if not m[1]:
            return m.start()
        closed = find.after(m[1], m.end())
        if closed < 0:
            return find.after(">", m.end())
        at = closed + 1
    return -1


def _parsed(page: str) -> _Tree:
    """The tree of a page.  Every search goes on where the last one ended, so a page costs time in
    proportion to its length, markup that never ends included."""
    tree, find, at, n = _Tree(), _Finder(page), 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            tree.text(page[at:])
            break
        m = _NAME.match(page, less + 1)
        if not m:
            if page.startswith("<!--", less):
                end = find.after("-->", less + 4)
                tree.text(page[at:less])
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", less) and (end := find.after("]]>", less + 9)) >= 0:
                tree.text(page[at:less])
                tree.text(html.escape(page[less + 9 : end], quote=False))
                at = end + 3
            elif page.startswith(("!", "?", "/"), less + 1):
                end = find.after(">", less + 1)
                tree.text(page[at:less])
                at = end + 1 if end >= 0 else n
            else:  # a sign of its own
                tree.text(page[at : less + 1])
                at = less + 1
            continue
        tree.text(page[at:less])
        end = _tag_end(find, m.end())
        if end < 0:
            break  # a tag that never ends isn't text
        tag, attrs, at = m[1].lower(), page[m.end() : end], end + 1
        if page[less + 1] == "/":
            if tag == "br":
                tree.text(" ")
            else:
                tree.close(tag)
            continue
        if tag in _BLOCK:
            tree.close_open({"p"}, {"td", "th", "caption", "button", "object"} if tag == "p" else {"td", "th", "button"})
        if tag in _CLOSES:
            tree.close_open(_CLOSES[tag], _LIMITS.get(tag, set()))
        if tag == "br":
            tree.text(" ")
        elif tag in _VOID:
            if tag == "hr":
                tree.borders += 1
        elif tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            close_end = find.after(">", close.end()) if close else -1
            at = close_end + 1 if close_end >= 0 else n
        else:
            tree.open(tag, attrs)
    return tree


class _Page:
    """Sizes and points of a page's elements, and which of them stay."""

    def __init__(self, tree: _Tree):
        self.tags, self.parents = tree.tags, tree.parents
        n = len(self.tags)
        self.block, link = [0] * n, [False] * n  # nearest block; inside a link
        hidden = [s == _OUT or s == _COMMENTS for s in tree.standing]
        for i in range(1, n):
            up = self.parents[i]
            hidden[i] = hidden[i] or hidden[up]
            self.block[i] = i if self.tags[i] in _BLOCK else self.block[up]
            link[i] = link[up] or self.tags[i] == "a"
        self.texts = [(i, b, html.unescape(t)) for i, b, t in tree.texts if not hidden[i]]
        own, own_linked, commas = [0] * n, [0] * n, [0] * n
        for i, _, t in self.texts:
            b, size = self.block[i], len(t) if not t.isspace() else 0
            own[b] += size
            own_linked[b] += size if link[i] else 0
            commas[b] += t.count(",") + t.count("，") + t.count("、")
        self.points = [0.0] * n
        for i, size in enumerate(own):
            if size and self.tags[i] not in _HEADING:
                self.points[i] = ((size >= 25) + min(size / 100, 3) + commas[i]) * (1 - own_linked[i] / size)
        self.out = self._without_frames(tree, hidden, own, own_linked)
        for i in range(n):
            if self.out[i]:
                own[i], own_linked[i], self.points[i] = 0, 0, 0.0
        self.length, self.linked, self.links = own[:], own_linked[:], [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            self.length[up] += self.length[i]
            self.linked[up] += self.linked[i]
            self.links[up] += self.links[i] + (self.tags[i] == "a" and not self.out[i])
        self.has_text = [size > 0 for size in own]
        self.bonus = tree.bonus

    def _without_frames(self, tree: _Tree, hidden: list[bool], own: list[int], own_linked: list[int]) -> list[bool]:
        """Which elements are out, once doubted ones that frame the article are let off."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        prose = [s - own_linked[i] if s >= 25 and tags[i] not in _HEADING else 0 for i, s in enumerate(own)]
        marks = [0] * n  # headlines and articles outside of all doubt, at or below an element
        doubted = [False] * n
        for i in range(1, n):
            doubted[i] = doubted[parents[i]] or tree.standing[i] == _DOUBTED
            marks[i] = int(tags[i] in ("h1", "article", "main") and not hidden[i])
        clear = sum(m for i, m in enumerate(marks) if not doubted[i])
        for i in range(n - 1, 0, -1):
            prose[parents[i]] += prose[i]
        out = hidden[:]
        for i in range(1, n):
            frames = not clear and 2 * prose[i] > prose[0]
            out[i] = out[i] or out[parents[i]] or (tree.standing[i] == _DOUBTED and not frames)
        return out

    def scores(self) -> list[float]:
        """What paragraphs pass to their ancestors, summed from the last element to the first."""
        n = len(self.tags)
        near, mid, far = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            # text right in a container counts for itself
            near[i if self.tags[i] in ("article", "main", "section", "body") else up] += self.points[i]
            mid[up] += near[i] / 2
            far[up] += (mid[i] + far[i]) / 3
        return [a + b + c for a, b, c in zip(near, mid, far)]

    def kept(self) -> set[int]:
        """The article's container, and siblings or an enclosing article that stay with it."""
        tags, parents, length = self.tags, self.parents, self.length
        score, best, most = self.scores(), 0, 0.0
        for i, s in enumerate(score):
            if i and s > 0 and not self.out[i] and tags[i] in _BLOCK and tags[i] != "p":
                s = score[i] = (s + self.bonus[i]) * (1 - self.linked[i] / max(1, length[i]))
                if s > most:
                    best, most = i, s
        if not best:
            for name in ("article", "main", "body"):
                best = next((i for i, t in enumerate(tags) if t == name and not self.out[i]), 0)
                if best:
                    break
            return {best}
        top = best
        while top > 0 and tags[top] not in ("article", "main"):
            top = parents[top]
        if top > 0:
            return {top}  # the author marked it as the article, so all in it counts
        keep = {best}
        if tags[best] in ("body", "html"):
            return keep
        for i, up in enumerate(parents):
            if i == best or up != parents[best] or self.out[i] or not length[i]:
                continue
            density = self.linked[i] / length[i]
            if score[i] >= max(10.0, 0.2 * most):
                keep.add(i)
            elif tags[i] in _TEXTUAL or tags[i] in _BLOCK and length[i] > 80:
                if density < 0.25 if length[i] > 80 else density == 0:
                    keep.add(i)
        return keep

    def drop_menus(self, keep: set[int]) -> None:
        """Lists of links are menus, but for those that follow text of the article itself."""
        tags, parents = self.tags, self.parents
        loose = all(tags[i] in ("body", "html", "#") for i in keep)
        inside, prose = [False] * len(tags), [False] * len(tags)
        for i in range(len(tags)):
            up = parents[i]
            inside[i] = i in keep or i > 0 and inside[up]
            if i and self.out[up]:
                self.out[i] = True
            menu = tags[i] in _LISTS and self.links[i] > 2 and self.linked[i] > 0.8 * self.length[i]
            if menu and not (inside[i] and i not in keep and not loose and prose[up]):
                self.out[i] = True
            elif i and not menu and tags[i] not in _HEADING and self.length[i] - self.linked[i] >= 25:
                prose[up] = True


def main_text(page: str) -> str:
    """The article's blocks in page order, one to a line; empty if there is none."""
    own = _Page(_parsed(page))
    keep = own.kept()
    own.drop_menus(keep)
    inside = [False] * len(own.tags)
    for i, up in enumerate(own.parents):
        inside[i] = i in keep or i > 0 and inside[up]
    blocks: list[str] = []
    current: list[str] = []
    seen = -1
    for i, border, t in own.texts:
        if own.out[i] or not inside[i]:
            continue
        if border != seen:
            blocks.append(" ".join("".join(current).split()))
            current, seen = [], border
        current.append(t)
    blocks.append(" ".join("".join(current).split()))
    return "\n".join(b for b in blocks if b)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text) for every page.

    The text is empty if the page is null, empty or has no article.  Of containers with equal points
    the first in the page is the article.  A page is parsed whole in its task, in time and memory in
    proportion to its length; elements nested deeper than :data:`MAX_DEPTH` become siblings.  Repeated
    rows are extracted each, an empty table gives no rows, other columns aren't read.
    """

    def batches(it):
        for batch in it:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["id", "url", "text"],
            )

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col), F.col(html_col)).mapInArrow(
        batches, "id long, url string, text string"
    )
