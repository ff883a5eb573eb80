"""Main text of web pages by composite text density.

A page becomes a small DOM. Every node gets its characters per tag, adjusted by
the share of its characters that are links and by the page's own share. A
node's score is the sum of the densities of its text and of its block children;
an inline element is text of its block. The block below the body with the
largest score is the core. The least density on the path from the core to the
body, menus and all, is the threshold that a block beside the path must reach
to count as text; so are words that stand in nodes of the path by themselves.
Between taken blocks of one parent nothing but link lists is left out, and a
heading goes with the block that it heads. Marks as article or main play no
part in this choice.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are taken out by element, role, class and id. A
class or id counts where a listed name is its head ("site-footer",
"sidebar-left", but neither "has-sidebar" nor "social-impact"), and not on
headings and paragraphs. A form or a named element that holds the page's
article stays, which its article and main elements tell: see ``_Page._drop``.
Nothing else is left out: not what is hidden, nor what stands in for scripts,
drawings and films, nor labels and field sets outside of forms.

A row needs only its own page: one scan, no shuffle, time in proportion to the
page. Unclosed and misnested markup is closed as browsers do.

Defined results: null html is empty and gives the empty text; a null page_id
or url is carried through; repeated rows repeat; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title template iframe select".split())
DROP = frozenset("nav footer aside form button input select head dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus respond replies".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus respond replies".split())
_MODIFIERS = frozenset("has have no not non with without is show hide hides toggle open close closed after before".split())
_PLACES = frozenset(
    "area bar bars block blocks body bottom box btn button buttons center column container content footer form group header holder icon icons inner "
    "item items left link links list lower main panel post posts primary right secondary section slot title top unit upper wrap wrapper zone".split()
)
_NO_NAMES = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_HARD, _NAMED, _COMMENTS, _FORM = 1, 2, 3, 4
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
_STOPS = frozenset("ul ol dl table tr tbody thead tfoot body html article main section div".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
_END = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[_-]+")


def _named(value: str) -> int:
    """Whether one of the names of a class or id says that the element is not text."""
    why = 0
    for name in value.split():
        parts = [x for x in _NAME_PARTS.split(name) if x]
        if not parts or parts[0] in _MODIFIERS:
            continue
        while len(parts) > 1 and parts[-1] not in DROP_NAMES and (parts[-1] in _PLACES or parts[-1].isdigit()):
            parts.pop()
        if parts[-1] in DROP_NAMES:
            if parts[-1] not in _COMMENT_NAMES:
                return _NAMED
            why = _COMMENTS
    return why


def _unwanted(tag: str, attrs: str, in_article: bool) -> int:
    """Why the element is taken out, 0 if it is not."""
    if tag == "form":
        return _FORM
    if tag in DROP or (tag == "header" and not in_article):
        return _HARD
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    why = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in DROP_ROLES:
            if value != "form":
                return _HARD
            why = why or _FORM
        if name in ("class", "id") and tag not in _NO_NAMES:
            why = why or _named(value)
    return why


class _Page:
    """Nodes in page order; text pieces with their node and block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.why, self.inside = ["#root"], [-1], [0], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self.body, self.block = 0, 0
        self.open, self.places = [0], {}  # open nodes; by tag, where in that list
        self.stops = [0]
        self.loose = False  # a quote was left open: tags end at the next >
        at, last = 0, page.rfind(">")
        while at < len(page):
            m = _OPEN.search(page, at)
            if m is None or m.start() > last:
                break
            if m.start() > at:
                self.pieces.append((self.open[-1], self.block, page[at : m.start()]))
            if m[3]:
                stop = page.find("-->", m.end())
                at = stop + 3 if stop >= 0 else len(page)
                continue
            tag = (m[2] or "").lower()
            if not tag:
                at = page.find(">", m.end()) + 1
                continue
            at = self._tag_end(page, m.end())
            if m[1]:
                self.block += tag in BLOCK
                if self.places.get(tag):
                    self._cut(self.places[tag][-1])
                continue
            attrs = page[m.end() : at - 1].strip()
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(f"</{tag}", re.I | re.A).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
                continue
            self._begin(tag, attrs)
        if at < len(page):
            self.pieces.append((self.open[-1], self.block, page[at:]))
        self._drop()

    def _tag_end(self, page: str, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends; > in quotes does not count."""
        place = at
        while not self.loose:
            m = _END.search(page, place)
            if m is None:
                self.loose = True
            elif m[0] == ">":
                return m.end()
            else:
                place = page.find(m[0], m.end()) + 1
                self.loose = place == 0
        return page.find(">", at) + 1 or len(page) + 1

    def _cut(self, k: int) -> None:
        """Close the open nodes from place ``k``."""
        while len(self.open) > k:
            self.places[self.tag[self.open.pop()]].pop()
        while self.stops[-1] >= k:
            self.stops.pop()

    def _begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.pieces.append((self.open[-1], self.block, " "))
        if tag in BLOCK:
            self.block += 1
            # End tags that HTML implies before a block.
            closes = CLOSED_BY.get(tag, frozenset())
            for names in ({"p"}, closes):
                k = max((self.places[x][-1] for x in names if self.places.get(x)), default=0)
                if k > self.stops[-1] or (k and k == self.stops[-1] and self.tag[self.open[k]] in names):
                    self._cut(k)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        inside = self.inside[self.open[-1]]
        self.why.append(_unwanted(tag, attrs, inside))
        self.inside.append(inside or tag in ("article", "main"))
        if tag == "body" and not self.body:
            self.body = node
        if tag not in VOID and not attrs.endswith("/"):
            if tag in _STOPS:
                self.stops.append(len(self.open))
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _drop(self) -> None:
        """``out``: nodes that are taken out. A form stays that holds an article
        or main element. If none of these stands outside of what goes by name,
        the named elements that hold one stay. If the page has none, those stay
        that hold all h1 there are, and those, but for reader comments, that
        hold over half of the characters outside of links."""
        n, why = len(self.tag), self.why
        hard, soft, link = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            hard[k] = hard[up] or why[k] == _HARD
            soft[k] = soft[up] or why[k] > _HARD
            link[k] = link[up] or self.tag[k] == "a"
        if any(x > _HARD for x in why):
            core = [self.tag[k] in ("article", "main") and not hard[k] for k in range(n)]
            head = [self.tag[k] == "h1" and not hard[k] for k in range(n)]
            free = any(core[k] and not soft[k] for k in range(n))
            free_head = any(head[k] and not soft[k] for k in range(n))
            plain = [0] * n
            for node, _, raw in self.pieces:
                if not (hard[node] or link[node]):
                    plain[node] += len(raw.strip())
            for k in range(n - 1, 0, -1):
                up = self.parent[k]
                core[up], head[up], plain[up] = core[up] or core[k], head[up] or head[k], plain[up] + plain[k]
            for k in range(1, n):
                if why[k] <= _HARD:
                    continue
                if core[0]:
                    stays = core[k] and (why[k] == _FORM or not free)
                else:
                    stays = head[k] and not free_head or why[k] != _COMMENTS and 2 * plain[k] > plain[0]
                if stays:
                    why[k] = 0
        self.out = [False] * n
        for k in range(1, n):
            self.out[k] = self.out[self.parent[k]] or why[k] > 0


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Characters per tag, lowered by the share of them that are links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + page_share * chars + math.e)
    inner = max(chars / links * tags / link_tags, 1.0)
    return chars / tags * math.log(inner) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else chars / tags * math.log(inner)


class _Counts:
    """Characters, tags and link shares of every node's subtree."""

    def __init__(self, dom: _Page, pieces: list[tuple[int, int, str]], link: list[bool], skip: list[bool]):
        n = len(dom.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in pieces:
            if not skip[node]:
                size = len(text.strip())
                self.chars[node] += size
                self.link_chars[node] += size if link[node] else 0
        for k in range(n - 1, 0, -1):
            if not skip[k]:
                up = dom.parent[k]
                self.chars[up] += self.chars[k]
                self.tags[up] += self.tags[k] + 1
                self.link_chars[up] += self.link_chars[k]
                self.link_tags[up] += self.link_tags[k] + (dom.tag[k] == "a")
        self.share = self.link_chars[dom.body] / max(self.chars[dom.body], 1)

    def dense(self, k: int) -> float:
        return density(self.chars[k], self.tags[k], self.link_chars[k], self.link_tags[k], self.share)


def _scores(dom: _Page, pieces: list[tuple[int, int, str]], link: list[bool], dense: list[float], share: float) -> list[float]:
    """By node the sum of the densities of its own text and its block children."""
    n = len(dom.tag)
    holder, own, own_link, tags, link_tags = list(range(n)), [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        if dom.tag[k] not in BLOCK and dom.tag[k] != "body" and not dom.out[k]:
            holder[k] = holder[dom.parent[k]]
            tags[holder[k]] += 1
            link_tags[holder[k]] += dom.tag[k] == "a"
    for node, _, text in pieces:
        size = len(text.strip())
        own[holder[node]] += size
        own_link[holder[node]] += size if link[node] else 0
    total = [density(own[k], tags[k], own_link[k], link_tags[k], share) for k in range(n)]
    for k in range(1, n):
        if holder[k] == k and not dom.out[k]:
            total[holder[dom.parent[k]]] += dense[k]
    return total


def _chosen(dom: _Page, pieces: list[tuple[int, int, str]]) -> tuple[list[bool], set[int]]:
    """Nodes whose text is taken, and blocks of words beside them that are."""
    n = len(dom.tag)
    link = [False] * n
    for k in range(1, n):
        link[k] = dom.tag[k] == "a" or link[dom.parent[k]]
    counts, page = _Counts(dom, pieces, link, dom.out), _Counts(dom, dom.pieces, link, [False] * n)
    dense = [0.0 if dom.out[k] else counts.dense(k) for k in range(n)]
    total = _scores(dom, pieces, link, dense, counts.share)
    block = [k for k in range(1, n) if dom.tag[k] in BLOCK and dom.tag[k] != "html" and not dom.out[k] and counts.chars[k]]
    core = max(block, key=lambda k: (total[k], -k), default=dom.body)
    path = [core]
    while path[-1] != dom.body and dom.parent[path[-1]] >= 0:
        path.append(dom.parent[path[-1]])
    on_path = set(path)
    least = min(min(dense[k], page.dense(k)) for k in path)
    take = [False] * n
    take[core] = True
    beside: dict[int, list[int]] = {k: [] for k in path[1:]}
    for k in range(1, n):
        up = dom.parent[k]
        if up in beside and not dom.out[k] and dom.tag[k] in BLOCK and (k in on_path or counts.chars[k]):
            beside[up].append(k)
            take[k] = take[k] or k not in on_path and dense[k] >= least
    for children in beside.values():
        text = [i for i, k in enumerate(children) if take[k] or k in on_path]
        for k in children[text[0] : text[-1]] if text else ():
            take[k] = take[k] or k not in on_path and 2 * counts.link_chars[k] < counts.chars[k]
        for i in range(len(children) - 2, -1, -1):
            k, after = children[i], children[i + 1]
            take[k] = take[k] or dom.tag[k] in _HEADINGS and (take[after] or after in on_path)
    for k in range(1, n):
        take[k] = take[k] or take[dom.parent[k]] and k not in on_path
    # Words that stand in the path's nodes by themselves, by block.
    free = set(path[1:])
    for k in range(1, n):
        if dom.parent[k] in free and dom.tag[k] not in BLOCK and k not in on_path:
            free.add(k)
    size, linked = {}, {}
    for node, b, text in pieces:
        if node in free:
            size[b] = size.get(b, 0) + len(text.strip())
            linked[b] = linked.get(b, 0) + (len(text.strip()) if link[node] else 0)
    words = {b for b, c in size.items() if c and density(c, 1, linked[b], 1 if linked[b] else 0, counts.share) >= least}
    for node, b, _ in pieces:
        if take[node]:
            words.discard(b)
    return [take[k] or k in free for k in range(n)], words | {-1 - k for k in free}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends."""
    if not page:
        return ""
    dom = _Page(page)
    pieces = [(node, block, html_lib.unescape(raw) if "&" in raw else raw) for node, block, raw in dom.pieces if not dom.out[node]]
    take, words = _chosen(dom, pieces)
    blocks: dict[int, list[str]] = {}
    for node, block, text in pieces:
        if take[node] and (-1 - node not in words or block in words):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(batches, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
