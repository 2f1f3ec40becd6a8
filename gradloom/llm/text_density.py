"""Main text of web pages by composite text density.

For every node of a page's tree the composite density is computed: characters per tag,
adjusted by how much of the text and how many of the tags are links, against the page's
own share of link text (Sun, Song and Liao's CETD). The densities of a node's children are
summed; among the nodes as dense as the sparsest one between the body and the page's
densest node, the one with the largest sum is the content, with the title above it and its neighbours that are
headings, paragraphs or whole sentences. Elements that are boilerplate
by what they are (navigation, forms, scripts ...) or by how they are named (adverts,
cookie notices, comment sections ...) carry no text in any of this, unless they hold the article: a heading, or most of the page's text.

Defined results: a null or empty html, or a page without text, gives an empty text; broken
markup (unclosed, misnested or cut off) is read as browsers do for paragraphs, lists and
tables; repeated pages are read row by row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.workers import ship

#: Comments, declarations and tags. A quote opens a value only after an equals sign; elsewhere it is a character.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMING = frozenset("class id role aria-label".split())
_TOKEN = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style title textarea noscript template iframe svg object xmp noembed noframes canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Boilerplate by kind.
DROP = frozenset("head nav footer aside button select option input dialog menu audio video map datalist output progress meter".split()) | RAW
#: Boilerplate by name: a class, id or role that is one of these words, or a compound of such a word and of ``PARTS``.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail menu menus nav
    navbar navigation breadcrumb breadcrumbs footer footnav cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay toast subscribe subscription
    newsletter signup signin login register share sharing sharebar social related recommended recommendations trending popular comment comments commentlist disqus respond reply
    replies discussion reactions widget widgets pagination pager toolbar masthead copyright legal disclaimer search searchbox skip contentinfo complementary""".split()
)
#: Words that say where or of what kind a named box is, and nothing of its topic.
PARTS = frozenset(
    """area aside bar block body bottom box btn button buttons card center col column container content fixed floating form global group header holder icon icons inner item items label
    left link links list main message module more outer page panel policy primary right row secondary section site slot small sticky tab text thread title top unit wrap wrapper
    follow us me to by the a on of in""".split()
)
#: Of these, words that also name what running text is about: they drop boxes, not paragraphs.
TOPICAL = frozenset("legal popular social search alert alerts notice notices reply replies discussion reactions trending recommended related copyright disclaimer promotion share sharing register subscription consent".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tr td th li dl dt dd span em strong b i a q code".split())
#: Of these, words that stand for what readers say: such boxes never hold the article.
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion reactions".split())
#: Inside of an article they say that a box of a topical name is a part of it.
CONTENT = frozenset("content main text body".split())
#: Boilerplate only outside an article: the page's header and not the article's.
OUTER = frozenset("header topbar".split())
#: An opening tag closes these, up to the given boundary.
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_SCOPE = ("table", "td", "th", "button", "html", "body", "article", "section", "div", "li")


class _Tree:
    """Nodes in the order of their opening tags, and the page's text events in page order."""

    def __init__(self, source: str) -> None:
        self.name, self.parent, self.tokens, self.hidden, self.first, self.last = ["html"], [-1], [frozenset()], [False], [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        stack, at = [0], 0
        #: Where on the stack the open elements of each name, of blocks and of those that bound a paragraph stand: no scan of the stack.
        where: dict[str, list[int]] = defaultdict(list)
        blocks: list[int] = []
        scopes: list[int] = []
        endless: set[str] = set()

        def lists(name: str) -> list[list[int]]:
            return [where[name], *([blocks] if name in BLOCK else []), *([scopes] if name in _SCOPE else [])]

        def push(k: int) -> None:
            for x in lists(self.name[k]):
                x.append(len(stack))
            stack.append(k)

        def pop() -> None:
            k = stack.pop()
            for x in lists(self.name[k]) if k else ():
                x.pop()
            if self.name[k] in BLOCK:
                self.events.append((k, None))
            self.last[k] = len(self.events)

        def last(names: Iterable[str]) -> int:
            return max((where[x][-1] for x in names if where[x]), default=0)

        def cut_to(size: int) -> None:
            while len(stack) > size:
                pop()

        while True:
            m = _MARKUP.search(source, at)
            piece = source[at : m.start() if m else len(source)]
            if piece:
                self.events.append((stack[-1], _html.unescape(piece) if "&" in piece else piece))
            if not m:
                break
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if m["end"]:
                if name == "br":
                    self.events.append((stack[-1], " "))
                elif name == "p" and not where["p"]:
                    self.events.append((stack[-1], None))
                elif (i := last([name])) and (name in BLOCK or not blocks or blocks[-1] <= i):  # an inline end tag closes nothing beyond its block
                    cut_to(i)
                continue
            if name == "br":
                self.events.append((stack[-1], " "))
            if name in ("html", "body") and (name == "html" or where[name]):
                continue
            if name in BLOCK:
                if (i := last(["p"])) and (not scopes or scopes[-1] < i):  # a block ends an open paragraph
                    cut_to(i)
                if name in CLOSES:
                    names, stops = CLOSES[name]
                    if (i := last(names.split())) and i > last(stops):
                        cut_to(i)
            k = len(self.name)
            tokens, hidden = _attributes(m["attrs"])
            for column, value in ((self.name, name), (self.parent, stack[-1]), (self.tokens, tokens), (self.hidden, hidden), (self.first, len(self.events)), (self.last, 0)):
                column.append(value)
            if name in BLOCK:
                self.events.append((k, None))
            if name in RAW:  # to its end tag; without one, to the end of the page
                end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    at = at if name in ("svg", "math", "object") else len(source)
                self.last[k] = len(self.events)
            elif name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
                self.last[k] = len(self.events)
            else:
                push(k)
        cut_to(0)


def _attributes(attrs: str) -> tuple[frozenset[str], bool]:
    """(names that the element goes by, whether it is hidden); a name is a whole class, id or role."""
    if not attrs or attrs.isspace():
        return frozenset(), False
    names: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value == "true"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif key in _NAMING:
            names.update(value.split())
    return frozenset(names), hidden


def _named(names: frozenset[str], words: frozenset[str]) -> frozenset[str]:
    """The words that name an element: those of a name all of whose words are known."""
    out: set[str] = set()
    for name in names:
        tokens = set(_TOKEN.findall(name))
        hit = tokens & words
        if hit and all(t in words or t in PARTS or t.isdigit() for t in tokens):
            out |= hit
    return frozenset(out)


def densities(t: _Tree, drop: list[bool]) -> tuple[list[int], list[int], list[float], list[float]]:
    """Of every node: characters, those in links, composite density, and the sum of its children's densities."""
    n = len(t.name)
    chars, links, tags, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        in_link[k] = in_link[t.parent[k]] or t.name[k] == "a"
    for k, text in t.events:
        if text and not drop[k]:
            size = len(text.strip())
            chars[k] += size
            if in_link[k]:
                links[k] += size
    for k in range(n - 1, 0, -1):
        up = t.parent[k]
        if not drop[k]:
            chars[up] += chars[k]
            links[up] += links[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (t.name[k] == "a")
    share = links[0] / chars[0] if chars[0] else 0.0

    def density(k: int) -> float:
        c, lc, tg, lt = chars[k], links[k], max(tags[k], 1), max(link_tags[k], 1)
        if not c:
            return 0.0
        plain = c / tg
        if not links[0]:
            return plain
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return plain * math.log(c / max(lc, 1) * tg / lt + 1e-9) / math.log(base) if base > 1.0001 else plain * math.log(c * tg + 1)

    own = [0.0 if drop[k] else density(k) for k in range(n)]
    sums = [0.0] * n
    for k in range(n - 1, 0, -1):
        sums[t.parent[k]] += own[k]
    return chars, links, own, sums


def _dropped(t: _Tree, names: bool) -> list[bool]:
    """What is boilerplate by its kind, or (``names``) by what it is called.

    A form and a named box stay if they hold an article, a main element or a heading, or, in pages without an article, more than half of the
    page's text outside of links: what readers say apart, a name is no reason then.
    """
    n = len(t.name)
    holds, weight, idle, in_link = [x in ("article", "main", "h1") for x in t.name], [0] * n, [False] * n, [False] * n
    for k in range(1, n):
        idle[k] = idle[t.parent[k]] or t.hidden[k] or t.name[k] in DROP
        in_link[k] = in_link[t.parent[k]] or t.name[k] == "a"
    for k, text in t.events:
        if text and not idle[k] and not in_link[k]:
            weight[k] += len(text.strip())
    for k in range(n - 1, 0, -1):
        holds[t.parent[k]] |= holds[k]
        weight[t.parent[k]] += weight[k]
    marked = any(x in ("article", "main") and not idle[k] for k, x in enumerate(t.name))
    inside, drop = [False] * n, [False] * n
    for k in range(1, n):
        up, name = t.parent[k], t.name[k]
        inside[k] = inside[up] or name in ("article", "main")
        kept = holds[k] and not (name == "article" and inside[up]) or not marked and 2 * weight[k] > weight[0] and not _named(t.tokens[k], NAMES) & READERS
        by_name = outer = False
        if names and name not in ("html", "body", "main"):
            by_name = bool(_boilerplate(t.tokens[k], name in RUNNING, inside[k])) and not kept
            outer = not inside[up] and (name in OUTER or bool(_named(t.tokens[k], OUTER))) and name != "article"
        drop[k] = drop[up] or t.hidden[k] or name in DROP or name == "form" and not kept or by_name or outer
    return drop


def _boilerplate(tokens: frozenset[str], running: bool, inside: bool) -> frozenset[str]:
    """The words by which an element is boilerplate: of running text, names that are nothing else; in an article no part of it."""
    if running:
        return _named(frozenset(x for x in tokens if not set(_TOKEN.findall(x)) & PARTS), NAMES) - TOPICAL
    found = _named(tokens, NAMES)
    told = {x for name in tokens for x in _TOKEN.findall(name)}
    return found - TOPICAL if inside and told & CONTENT else found


def main_text(source: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not source:
        return ""
    t = _Tree(source)
    n = len(t.name)
    drop = _dropped(t, True)
    if not any(text and text.strip() and not drop[k] for k, text in t.events):  # all went by its names: then kinds alone decide
        drop = _dropped(t, False)
    chars, links, own, sums = densities(t, drop)
    if not chars[0]:
        return ""
    body = next((k for k in range(n) if t.name[k] == "body" and not drop[k]), 0)
    densest = max((k for k in range(n) if not drop[k]), key=lambda k: (sums[k], -k))
    threshold, k = own[densest], densest
    while k > 0 and k != body:
        threshold = min(threshold, own[k])
        k = t.parent[k]
    threshold = min(threshold, own[body])
    best = max((k for k in range(n) if not drop[k] and own[k] >= threshold), key=lambda k: (sums[k], -k))
    # a part of an article stands for the article; neighbours as dense as the path belong to it too
    k = best
    while k > 0:
        if t.name[k] in ("article", "main"):
            best = k
        k = t.parent[k]
    whole = t.name[best] in ("article", "main")
    if not whole:
        lowest = best

        def is_dense(j: int) -> bool:
            return own[j] >= threshold and bool(chars[j]) and 2 * links[j] < chars[j]

        dense = [0] * n
        for j in range(1, n):
            dense[t.parent[j]] += is_dense(j)
        while best > 0 and best != body and t.parent[best] > 0 and t.name[best] not in ("body", "html"):
            up = t.parent[best]
            if t.name[up] in ("body", "html") and sums[up] - own[best] < threshold:
                break
            if dense[up] - is_dense(best) < 1:
                break
            best = up
        for j in range(best + 1, n) if best != lowest else ():  # what came along beside the dense parts and is mostly links
            drop[j] = drop[j] or drop[t.parent[j]] and j > best or t.parent[j] == best and t.name[j] in BLOCK and t.name[j] != "p" and bool(chars[j]) and 2 * links[j] >= chars[j]
    spans = [(t.first[best], t.last[best])] if whole or best in (0, body) else _with_neighbours(t, best, body, drop, chars, links)
    out: list[str] = []
    parts: list[str] = []
    for k, text in (e for first, last in spans for e in [*t.events[first:last], (best, None)]):
        if drop[k]:
            if text is None and parts:
                out.append("".join(parts))
                parts = []
            continue
        if text is None:
            if parts:
                out.append("".join(parts))
                parts = []
        else:
            parts.append(text)
    out.append("".join(parts))
    return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def _with_neighbours(t: _Tree, best: int, body: int, drop: list[bool], chars: list[int], links: list[int]) -> list[tuple[int, int]]:
    """Where the chosen subtree stands among the events, with what belongs to it beside it: headings and paragraphs, boxes of
    whole sentences, and the page's title above; neither links nor named boxes."""
    on_path, k = {best: 0}, best
    while k not in (body, 0):
        k = t.parent[k]
        on_path[k] = 1
    near = t.parent[best]
    spans = []
    for j in range(1, len(t.name)):
        up = t.parent[j]
        if j == best:
            spans.append((t.first[j], t.last[j]))
        elif up in on_path and up != best and j not in on_path and not drop[j] and chars[j] and 2 * links[j] < chars[j]:
            said = " ".join("".join(x or " " for k, x in t.events[t.first[j] : t.last[j]] if not drop[k]).split())
            if t.name[j] == "h1" or up == near and (t.name[j] in ("h2", "h3", "p", "blockquote", "pre", "figure", "table") or said[-1:] in {".", "!", "?", "…", '"', "”", "»", "。"} and (len(said) >= 40 or t.name[j] == t.name[best] == "section")):
                spans.append((t.first[j], t.last[j]))
    return spans


def extract(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # keeps few pages in memory as Python strings
                part = b.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, url_col, "text", "n_chars"])

    ship(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, f"`{key}` long, `{url_col}` string, text string, n_chars long")


def op5(pages: DataFrame) -> DataFrame:
    """The contract of ``op5_text_density``."""
    return extract(pages)
