"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with its root-to-leaf path of block tags. Over each distinct path
the length of text, the punctuation marks, the linked text and the number of blocks are summed; a path's ratio is
text a block, weighted by punctuation a block and by the share that is not linked. Ratios are smoothed along the
page (a Gaussian over neighbouring blocks), fused with the path's own by their geometric mean, and thresholded
relative to their spread. Paths over the threshold are seeds; the deepest path that holds nearly all seed text is
the content's container. The result are its blocks, except those of paths that lie in boilerplate or are mostly links.

Boilerplate is told by tag (nav, footer, aside, form ...) or by words of class, id and role (ad, menu, comments,
cookie ...); such a mark is part of the path and takes its ratio away. A mark names what an element is, what it is beside
or what it is about, so it does not decide alone: where a marked element holds nearly all of the page's running text
(unlinked sentences), it is the article or its wrapper, and the mark is void; marks inside it are then looked at alike.
Linked text inside the content stays where its blocks are sentences, as lists of sources are, and goes where they are menus.

Paths are nodes of a tree that is built while the page is read once, so the work grows with the page and not with
its depth.

Defined cases: null html is empty; a page without content gives the empty string; unclosed and crossed tags, a
'>' inside quoted attributes, and text outside any tag are read as browsers do; a quote that is never closed is an
ordinary character; a tag that is never closed by '>' is text; repeated rows are answered alike; no rows give no
rows; other columns pass through, but those with the names of the results are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm.common import add_columns

MARKUP = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
#: Inside a tag: its end, or the beginning of a quoted value.
TAG_PART = re.compile(r">|=\s*([\"'])")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
HEADING = re.compile(r"h[1-6]")
#: Fixed lists of the HTML vocabulary.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table article section div body html nav aside footer header main form td th li blockquote".split())
#: Tags that never hold content, and those that mark boilerplate.
NO_CONTENT = frozenset(("head", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "svg", "canvas", "iframe", "object", "menu", "title", "legend"))
BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "fieldset"))
#: Words of class, id and role that mark boilerplate, and those of them that as often say what an article is about.
BOILER_WORDS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "footers", "gdpr", "header", "masthead", "menu", "menus", "nav", "navbar", "navigation", "newsletter", "newsletters", "pager", "pagination", "popup", "promo", "respond", "sidebar", "sidebars",
    "sponsor", "sponsored", "toolbar", "topbar", "widget",
))
TOPIC_WORDS = frozenset((
    "alert", "copyright", "disclaimer", "legal", "login", "modal", "notice", "notices", "overlay", "promotion", "recommended", "related", "replies", "reply", "search", "share", "sharing", "signup", "social",
    "subscribe", "subscription",
))
#: With one of these words, a header is the content's own.
CONTENT = frozenset(("article", "main", "content", "post", "entry", "story"))
#: A mark is void where the element has so many times the running text of all unmarked ones; a certain one needs a heading or so many characters, too.
VOID_TOPIC, VOID_CERTAIN, CERTAIN_CHARS = 3, 20, 200
#: Linked blocks of so many characters with a mark of punctuation each are sentences.
CITED_CHARS = 30
#: So many linked blocks without a sentence, one after the other on one path, are a menu.
MENU_RUN = 3
PUNCT = str.maketrans("", "", ",.;:!?…、。，；：！？¿¡—")


#: Kinds of marks on an element: none, a word that may be a topic, a certain one, and a tag without content.
PLAIN, TOPIC, CERTAIN, NEVER = range(4)


class Paths:
    """The distinct tag paths of a page as a tree; path 0 is the root, and a path's number is larger than its parent's.

    A path also tells the marks of its elements (mark, words); `boiler` holds the strongest mark at or above it.
    """

    def __init__(self):
        self.tags, self.parents, self.depths, self.marks, self.boiler = [""], [0], [0], [PLAIN], [PLAIN]
        self.children: dict[tuple, int] = {}

    def child(self, parent: int, tag: str, mark: tuple) -> int:
        key = parent, tag, mark
        if key not in self.children:
            self.children[key] = len(self.tags)
            self.tags.append(tag)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.marks.append(mark[0])
            self.boiler.append(max(mark[0], self.boiler[parent]))
        return self.children[key]

    def below(self, own: list[int]) -> list[int]:
        """The sums of own (by path) over each path and all below it."""
        total = list(own)
        for path in range(len(total) - 1, 0, -1):
            total[self.parents[path]] += total[path]
        return total

    def settle(self, running: list[int]) -> None:
        """Voids marks of elements that hold nearly all of the running text, which is given by path, the largest first."""
        while True:
            rest = sum(n for n, b in zip(running, self.boiler) if b == PLAIN)
            inside, headed = self.below(running), self.below([bool(HEADING.fullmatch(t)) for t in self.tags])
            found = []
            for path, mark in enumerate(self.marks):
                if mark in (TOPIC, CERTAIN) and self.boiler[self.parents[path]] == PLAIN and inside[path]:
                    if inside[path] >= (VOID_TOPIC if mark == TOPIC else VOID_CERTAIN) * rest and (mark == TOPIC or headed[path] or inside[path] >= CERTAIN_CHARS):
                        found.append((inside[path], path))
            if not found:
                return
            self.marks[max(found)[1]] = PLAIN
            for path in range(1, len(self.marks)):
                self.boiler[path] = max(self.marks[path], self.boiler[self.parents[path]])


class Page:
    """Reads a page once: `found` holds (path, text with white space collapsed, characters inside links) of its text blocks in order."""

    def __init__(self, page: str):
        self.paths, self.found = Paths(), []
        #: Open elements as (tag, path), and how many of each tag are open.
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.read(page)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((self.stack[-1][1], text, min(self.linked, len(text))))
            self.parts.clear()
        self.linked = 0

    def say(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def pop_to(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            self.open[tag] -= 1
        del self.stack[i:]

    def close(self, tags: set[str]) -> None:
        """Ends the innermost open element of tags, unless another container has begun inside it."""
        if any(self.open[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in tags:
                    self.pop_to(i)
                    return
                if self.stack[i][0] in BOUNDS:
                    return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE:
            return
        self.flush()
        if tag not in VOID and self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self.pop_to(i)
                    return
                if tag == "p" and self.stack[i][0] in BOUNDS:
                    return

    def begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close({"p"})
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag])
        if tag == "body":
            self.close({"head"})
        if not attrs.endswith("/") or tag in ("p", "div", "li"):
            self.stack.append((tag, self.paths.child(self.stack[-1][1], tag, self.marked(tag, attrs))))
            self.open[tag] += 1

    def marked(self, tag: str, attrs: str) -> tuple:
        """The kind of an element's mark and the words that say so."""
        if tag in NO_CONTENT:
            return (NEVER,)
        if tag in BOILER_TAGS or (tag == "header" and not self.open["article"] and not self.open["main"]):
            return (CERTAIN,)
        if attrs and tag not in ("html", "body", "article", "main"):
            words: set[str] = set()
            for hint in HINT.finditer(attrs):
                words.update(WORD.findall((hint[1] or hint[2] or hint[3] or "").lower()))
            certain, topic = words & BOILER_WORDS, words & TOPIC_WORDS
            if certain and not (words & CONTENT and certain == {"header"}):
                return (CERTAIN, *sorted(certain))
            if topic:
                return (TOPIC, *sorted(topic))
        return (PLAIN,)

    def read(self, page: str) -> None:
        at, size, unclosed = 0, len(page), set()
        while m := MARKUP.search(page, at):
            self.say(page[at : m.start()])
            if m["comment"] or m["cdata"]:
                close = "-->" if m["comment"] else "]]>"
                stop = page.find(close, m.end())
                stop = size if stop < 0 else stop
                if m["cdata"]:
                    self.parts.append(page[m.end() : stop])
                at = min(size, stop + 3)
                continue
            stop = m.end()
            while part := TAG_PART.search(page, stop):
                stop, quote = part.end(), part[1]
                if not quote:
                    break
                if quote not in unclosed:
                    end = page.find(quote, stop)
                    if end < 0:
                        unclosed.add(quote)  # nor is any later one
                    else:
                        stop = end + 1
            else:
                self.say(page[m.start() :])
                at = size
                break
            at = stop
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                self.end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else size
            else:
                self.begin(tag, page[m.end() : stop - 1])
        self.say(page[at:])
        self.flush()


def running_text(page: Page) -> list[int]:
    """Characters of unlinked sentences by path: those that can be an article."""
    out = [0] * len(page.paths.tags)
    for path, text, linked in page.found:
        if len(text) >= CITED_CHARS and 2 * linked <= len(text) and not HEADING.fullmatch(page.paths.tags[path]) and len(text) > len(text.translate(PUNCT)):
            out[path] += len(text) - linked
    return out


def path_ratios(page: Page) -> tuple[dict[int, float], dict[int, float], set[int]]:
    """Of each path with text: text a block, by punctuation a block and the share of text that is not linked; that share; and paths of sentences."""
    sums: dict[int, list[int]] = {}
    for path, text, linked in page.found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(text) - len(text.translate(PUNCT))
        s[2] += linked
        s[3] += 1
    own = {path: max(0.0, 1 - linked / max(chars, 1)) for path, (chars, _, linked, _) in sums.items()}
    ratios = {path: 0.0 if page.paths.boiler[path] else chars / n * (1 + math.log1p(punct / n)) * own[path] for path, (chars, punct, _, n) in sums.items()}
    return ratios, own, {path for path, (chars, punct, _, n) in sums.items() if chars >= CITED_CHARS * n and punct >= n}


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian means over neighbours; at the edges over those there are."""
    kernel = [math.exp(-(d * d) / 2) for d in range(radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


#: A leaf of running text is widened to what holds it, so that headings and short paragraphs beside it stay.
LEAVES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "blockquote", "td", "th", "tr"))
WHOLE = frozenset(("", "html", "body"))


def container(page: Page, seeds: list[int]) -> int:
    """The deepest path that holds all text of seeds (numbers of blocks), or nearly all where that is the whole page; an article is whole."""
    paths = page.paths
    own = [0] * len(paths.tags)
    for i in seeds:
        own[page.found[i][0]] += len(page.found[i][1])
    inside = paths.below(own)

    def deepest(least: float) -> int:
        return max((p for p, n in enumerate(inside) if n >= least), key=lambda p: paths.depths[p])

    found = deepest(inside[0])
    if paths.tags[found] in WHOLE:
        found = deepest(0.9 * inside[0])
    while paths.tags[found] in LEAVES:
        found = paths.parents[found]
    # Title and lead of an article stand beside the element of its body as often as inside it.
    up = found
    while up and paths.tags[up] not in ("article", "main"):
        up = paths.parents[up]
    return up or found


def menu_runs(found: list[tuple[int, str, int]]) -> list[bool]:
    """Which blocks are in a run of MENU_RUN or more of one path that are links and no sentences, as paths alone may not tell a menu from text."""
    out, begin = [False] * len(found), 0
    for i in range(len(found) + 1):
        path, text, linked = found[i] if i < len(found) else (-1, "", 0)
        link = 2 * linked > len(text) and (len(text) < CITED_CHARS or len(text) == len(text.translate(PUNCT)))
        if not link or (i > begin and path != found[begin][0]):
            if i - begin >= MENU_RUN:
                out[begin:i] = [True] * (i - begin)
            begin = i if link else i + 1
    return out


def main_text(page: str | None, spread: float = 0.5, own_share: float = 0.35) -> str:
    """The content blocks of page, joined by spaces."""
    if not page:
        return ""
    read = Page(page)
    found, paths = read.found, read.paths
    paths.settle(running_text(read))
    menus = menu_runs(found)
    live = [i for i, (path, _, _) in enumerate(found) if not paths.boiler[path] and not menus[i]]
    if not live:
        return ""
    ratios, unlinked, sentences = path_ratios(read)
    own = [ratios[found[i][0]] for i in live]
    fused = [math.sqrt(a * b) for a, b in zip(own, smooth(own))]
    mean = sum(fused) / len(fused)
    limit = spread * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    seeds = [i for i, x in zip(live, fused) if x >= limit and x > 0] or [max(zip(fused, live))[1]]
    root = container(read, seeds)
    within = [False] * len(paths.tags)
    for path in range(len(within)):
        within[path] = path == root or (path > 0 and within[paths.parents[path]])
    # The whole body as container says nothing about its parts: there the threshold itself decides.
    bare = paths.tags[root] in WHOLE
    chosen = set(seeds)
    kept = []
    for i in live:
        path, text, _ = found[i]
        if i not in chosen:
            heading = HEADING.fullmatch(paths.tags[path])
            if not within[path]:
                if paths.tags[path] != "h1":
                    continue
            elif not heading and (bare or (unlinked[path] < own_share and path not in sentences)):
                continue
        kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages plus text and n_chars."""

    def make():
        def run(page):
            text = main_text(page)
            return text, len(text)

        return run

    return add_columns(pages, [column], make, "text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
