"""Main text of web pages by composite text density (operator 9).

Every element gets a link-adjusted number of characters per tag; an element's
density sum adds up its children.  The element with the greatest sum is the core
of the page.  The least density on the way from it to ``body`` is the page's
threshold: an ancestor takes the core's place when it has another child that
reaches the threshold, ``body`` too.

Elements that a menu, form, footer, comment section or the like would be by kind or
name count for less (``MARKED``, comments for nothing) and are left out of the chosen
subtree.  The mark goes when the element holds the greatest density sum all the same,
or over half of the page's link-free text with no ``article`` or ``main`` beside it.
Where ``article`` and ``main`` hold a fifth of the link-free text or more, the core is
sought in them (in ``article`` alone where it holds half of that), and only other
articles, or what precedes one inside ``main``, may widen it.  An ``h1`` beside the way to ``body`` is returned too.  Of equal sums the
denser element wins, then the earlier.
"""

from __future__ import annotations

import functools
import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|$|=|/)", re.I)
_UNSEEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

MARKED, PRIOR, COMMENT_SHARE = 0.2, 0.2, 0.9  # weight of marked elements, least share of article and main, share that unmarks comments
PLAIN, HEAD, OTHER, COMMENT = range(4)  # what a name tells of its element

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike "
    "strong sub sup time tt u var wbr".split())
NEVER = frozenset(
    "head script style template noscript iframe object embed svg canvas audio video map button select option optgroup textarea "
    "input fieldset datalist title xmp noembed noframes".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Words in class, id and role that mark menus, headers, footers, sidebars, notices, adverts and forms.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar sidebars rail menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer footers cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager search complementary contentinfo".split())
HEADS = frozenset("header headers masthead banner banners".split())
COMMENTS = frozenset("comment comments respond replies reply disqus".split())
# A name is told by its last word, boxes and places aside: "site-footer", "comment-list", but not "search-article".
BOXES = frozenset(
    "area articles bar block body bottom box buttons card container content form group inner item items left link links list media "
    "message outer panel posts primary right row secondary section slot stories text thread top unit wrap wrapper zone".split())
NEGATES = frozenset("has no not with without".split())
CORES = frozenset(("article", "main"))


@functools.lru_cache(maxsize=1 << 14)
def kind_of_name(token: str) -> int:
    """What one class, id or role tells of its element."""
    parts = [w.lower() for w in _PART.findall(token)]
    known = [w for w in parts if w not in BOXES]
    if not known or NEGATES & set(parts):
        return PLAIN
    last = known[-1]
    if last in HEADS:
        return OTHER if NAMED & set(known) else HEAD
    return OTHER if last in NAMED else COMMENT if last in COMMENTS else PLAIN


class Page:
    """A page's elements as parallel lists, and its text runs in order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.drop = ["#"], [0], [False]
        self.mark, self.is_core = [PLAIN], [False]
        self.runs: list[tuple[int, str]] = []  # element and text; an empty text separates blocks
        self.body = 0
        self._parse(html)
        self._measure()

    def _open(self, tag: str, attrs: str) -> int:
        inside = self.stack[-1]
        drop, mark, core = self.drop[inside] or tag in NEVER, PLAIN, tag in CORES
        if not drop and tag not in ("body", "html"):
            names = [(m[1].lower(), t) for m in _NAMES.finditer(attrs) for t in (m[2] or m[3] or m[4] or "").split()] if attrs else ()
            core = core or ("role", "main") in names or ("role", "article") in names
            kinds = {kind_of_name(t) for _, t in names} | ({HEAD} if tag == "header" else {OTHER} if tag in ASIDE else set())
            drop = bool(attrs) and not core and bool(
                _UNSEEN.search(attrs) or "idden" in attrs.lower() and _HIDDEN.search(_QUOTED.sub("", attrs)))
            if COMMENT in kinds:
                mark = COMMENT
            elif not core and (OTHER in kinds or HEAD in kinds and not self.core):
                mark = OTHER
        self.tag.append(tag), self.parent.append(inside), self.drop.append(drop)
        self.mark.append(mark), self.is_core.append(core and mark == PLAIN)
        if tag == "body" and not self.body:
            self.body = len(self.tag) - 1
        return len(self.tag) - 1

    def _close_to(self, names: set, stop: set) -> None:
        """End the nearest open element of ``names``, unless one of ``stop`` is nearer."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in names:
                for e in self.stack[depth:]:
                    self.core -= self.is_core[e]
                del self.stack[depth:]
                return
            if tag in stop:
                return

    def _parse(self, html: str) -> None:
        self.stack, self.core, at = [0], 0, 0
        text = self.runs.append
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                break
            if m.start() > at:
                text((self.stack[-1], html[at:m.start()]))
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    text((self.stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
            if tag not in INLINE:
                text((self.stack[-1], ""))
            if m["end"] or m["end2"]:
                self._close_to({tag}, {"article", "main", "body"} - {tag} if tag in INLINE or tag == "p" else set())
                continue
            if tag in ("html", "body") and tag in self.tag:
                continue
            if tag == "body":  # what a page leaves open in its head ends here
                self._close_to({"head"}, set())
            if tag in CLOSES_P:
                self._close_to({"p"}, {"table", "td", "th", "li", "div", "article", "section", "button", "object", "blockquote"})
            if tag in ALIKE:
                self._close_to(ALIKE[tag], SCOPE[tag])
            own = self._open(tag, attrs)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                self.stack.append(own)
                self.core += self.is_core[own]
            elif tag not in VOID and tag not in ("svg", "path"):  # "<div/>" opens a div
                self.stack.append(own)
                self.core += self.is_core[own]
        if at < len(html):
            text((self.stack[-1], html[at:]))

    def _measure(self) -> None:
        """Characters of each element's own text, all and in links, without what is never shown; the part within ``body``."""
        n = len(self.tag)
        self.own, self.own_links = [0] * n, [0] * n
        self.within, self.in_link = [False] * n, [False] * n
        self.within[self.body] = True
        for e in range(1, n):
            self.in_link[e] = self.in_link[self.parent[e]] or self.tag[e] == "a"
            self.within[e] = self.within[e] or e > self.body and self.within[self.parent[e]]
        for e, run in self.runs:
            if run and not self.drop[e]:
                size = len("".join(unescape(run).split()))
                self.own[e] += size
                if self.in_link[e]:
                    self.own_links[e] += size

    def unmark(self) -> None:
        """Clear marks of elements that hold over half of the link-free text (comments: nine tenths) and no article beside them."""
        if not any(self.mark):
            return
        n = len(self.tag)
        free = [a - b for a, b in zip(self.own, self.own_links)]
        last = list(range(n))  # last element of each subtree: elements stand in page order
        for e in range(n - 1, 0, -1):
            free[self.parent[e]] += free[e]
            last[self.parent[e]] = max(last[self.parent[e]], last[e])
        whole = free[self.body]
        cores, marked = [c for c in range(1, n) if self.is_core[c] and free[c]], [False] * n
        for e in range(1, n):
            large = free[e] > whole * (COMMENT_SHARE if self.mark[e] == COMMENT else 0.5)
            if self.mark[e] and large and not marked[self.parent[e]]:
                above, up = set(), self.parent[e]
                while up:
                    above.add(up)
                    up = self.parent[up]
                if not any(not e <= c <= last[e] and c not in above and not self._is_marked(c) for c in cores):
                    self.mark[e] = PLAIN
            marked[e] = marked[self.parent[e]] or self.mark[e] != PLAIN

    def _is_marked(self, e: int) -> bool:
        while e and not self.mark[e]:
            e = self.parent[e]
        return bool(e)

    def densities(self) -> tuple[list[float], list[float], list[int], list[float]]:
        """Density, density sum, characters and weight of every element; marked ones add nothing to those around them."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags, weight = self.own[:], self.own_links[:], [0] * n, [0] * n, [1.0] * n
        for e in range(n - 1, 0, -1):
            if self.drop[e] or self.mark[e]:
                continue
            p = self.parent[e]
            chars[p] += chars[e]
            link_chars[p] += link_chars[e]
            tags[p] += tags[e] + 1
            link_tags[p] += link_tags[e] + (self.tag[e] == "a")
        root = self.body
        share = link_chars[root] / max(chars[root], 1)
        density, total = [0.0] * n, [0.0] * n
        for e in range(n):
            if e:
                own = (1.0, 1.0, MARKED, 0.0)[self.mark[e]]
                weight[e] = min(weight[self.parent[e]], own)
            c, t = chars[e], max(tags[e], 1)
            if c and not self.drop[e] and weight[e]:
                links, free = link_chars[e], max(c - link_chars[e], 1)
                base = math.log(c / free * links + share * c + math.e)
                lift = math.log(c / max(links, 1) * t / max(link_tags[e], 1))
                density[e] = weight[e] * (c / t * lift / max(math.log(base), 0.1))
        for e in range(1, n):
            if not self.mark[e]:
                total[self.parent[e]] += density[e]
        return density, total, [a - b for a, b in zip(chars, link_chars)], weight

    def choose(self) -> list[int]:
        """Roots of the subtrees that are the page's main part, marked elements in them aside."""
        self.unmark()
        density, total, free, weight = self.densities()
        n, root = len(self.tag), self.body
        usable = [e for e in range(n) if self.within[e] and not self.drop[e] and weight[e]]

        in_core, in_article = [False] * n, [False] * n
        for e in range(1, n):
            own, p = self.is_core[e] and weight[e] == 1.0, self.parent[e]
            in_core[e] = in_core[p] or own
            in_article[e] = in_article[p] or own and self.tag[e] == "article"
        held, articles = (
            sum(free[e] for e in usable if where[e] and not where[self.parent[e]]) for where in (in_core, in_article))
        prior = held > 0 and held >= PRIOR * free[root]
        where = [True] * n if not prior else in_article if 2 * articles >= held else in_core
        core = max((e for e in usable if where[e]), key=lambda e: (total[e], density[e], -e), default=root)
        if weight[core] < 1.0:  # the greatest density sum, though it counts for less
            up = core
            while up != root:
                self.mark[up], up = PLAIN, self.parent[up]
            density, total, free, weight = self.densities()
        if not total[core] and not (prior and free[core]):
            core = root

        path = [core]
        while path[-1] != root:
            path.append(self.parent[path[-1]])
        least, on_path = min(density[e] for e in path), set(path)
        holds_core = [False] * n
        for e in range(n - 1, 0, -1):
            own = self.is_core[e] and free[e] > 0
            if (own or holds_core[e]) and not self.drop[e] and weight[e] == 1.0:
                holds_core[e] = True
                holds_core[self.parent[e]] = True

        def rich(up):
            return [e for e in self.children(up) if e not in on_path and density[e] >= least and not self.drop[e] and not self.mark[e]
                    and self.tag[e] not in INLINE]

        chosen, leads, within_article = core, [], self.is_core[core]
        for below, up in zip(path, path[1:]):
            beside = rich(up)
            if not within_article:
                if beside or self.is_core[up]:
                    chosen = up
                within_article = self.is_core[up]
            elif any(holds_core[e] for e in beside):
                chosen = up
            elif in_core[up]:
                leads += [e for e in beside if e < below]
        heads = []
        for up in path[1:]:
            for e in self.children(up):
                tops = self.children(e) if in_core[up] and self.tag[e] in ("header", "hgroup") else [e]
                heads += [h for h in tops if self.tag[h] == "h1"]
        return [chosen, *leads, *heads]

    def main(self) -> str:
        chosen = set(self.choose())
        inside, out = [e in chosen for e in range(len(self.tag))], [self.drop[e] for e in range(len(self.tag))]
        for e in range(1, len(self.tag)):
            p = self.parent[e]
            inside[e] = inside[e] or inside[p]
            out[e] = out[e] or out[p] or self.mark[e] != PLAIN
        kept = [unescape(run) if run else " " for e, run in self.runs if inside[e] and not out[e]]
        return " ".join("".join(kept).split())

    def children(self, e: int) -> list[int]:
        if not hasattr(self, "_children"):
            self._children: dict[int, list[int]] = {}
            for k in range(1, len(self.parent)):
                self._children.setdefault(self.parent[k], []).append(k)
        return self._children.get(e, [])


def main_text(html: str) -> str:
    return Page(html).main() if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(*keep, text, n_chars)`` for every row.

    Character references are decoded, white space becomes one space, blocks are
    joined by one.  A null, empty or textless page has an empty text.  Repeated
    rows come back repeated; columns outside ``keep`` are not read.
    """
    whole = pages.select(F.struct(*[F.col(c) for c in keep]).alias("own"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for part, texts in text_slices(batches, "html"):
            out = [main_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["own", "text", "n_chars"])

    shape = T.StructType([whole.schema["own"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return whole.mapInArrow(run, shape).select("own.*", "text", "n_chars")
