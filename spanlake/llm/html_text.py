"""Main text of web pages by consensus host paths.

Each page scores its containers by the text that stands in them outside links and votes for the generalised path (tags
and classes, digits masked) of the best. Votes are counted for each host in Spark; the path that most pages of a host
vote for is taken for all of its pages, and a page that lacks it falls back to its own best container. In each page the
winner is widened to the article around it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from spanlake.llm._common import add_columns, any_names, checkpoint, table

#: Bytes of winning paths up to which they are sent to all workers; beyond, pages are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article blockquote body center div fieldset figure form main section table tbody td tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never of the article, blocks or not; header and form stand apart.
OUT = frozenset("aside audio button canvas datalist dialog footer head iframe map math menu nav noembed noframes noscript object optgroup option select svg template textarea title video".split())
#: Elements whose content is no markup; all of them are out. Only the first two go on to the end of a page.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style iframe noembed noframes textarea title".split()}
#: Names of what is no part of an article, whatever it holds: menus, footers, sidebars, adverts, cookie notices, comments.
HARD = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsbygoogle breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr menu menus nav navbar navigation navmenu pager pagination replies respond sidebar sidebars sidenav sponsor sponsored sponsors submenu toolbar".split()
)
#: Names of what is no part of one unless it holds most of the page's text: headers, notices, forms and what goes with them.
SOFT = frozenset(
    "alert banner dialog header login masthead modal newsletter notice notices notification notifications popup promo promos promotion promotions promoted recommended recommendations related share sharing signup skip social subscribe subscription widget widgets".split()
)
#: Words that say where something stands or what holds it; a name of these and marked words alone is marked too.
PLACES = frozenset(
    "area article bar block body bottom box btn button buttons col column container content entry float form global group holder icon icons inner item items left link links list main mobile module outer page panel post primary reader readers region right row secondary section site slot sticky story strip tabs text thread title to top unit user users wrap wrapper".split()
)
#: Landmark roles that mark; all others mark nothing.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NOT_NAME = re.compile(r"[^a-z]+")


@lru_cache(1 << 14)
def _mark(name: str) -> int:
    """2 if a class or id names something hard, 1 if something soft, else 0: whole names, or marked words and places."""
    words = [w for w in NOT_NAME.split(HUMP.sub("-", name).lower()) if w]
    marked = [w for w in words if w in HARD or w in SOFT]
    if not marked or any(w not in HARD and w not in SOFT and w not in PLACES for w in words):
        return 0
    return 2 if any(w in HARD for w in marked) else 1


def _names(attributes: str) -> tuple[str, int]:
    """The generalised classes (or id) for a path, and how a name marks the element (see _mark)."""
    if "=" not in attributes:
        return "", 0
    found: dict[str, str] = {}
    for k, a, b, c in NAMED.findall(attributes):
        found.setdefault(k.lower(), a or b or c)
    marks = [_mark(name) for k in ("class", "id") for name in found.get(k, "").split()]
    marks += [1 for name in found.get("role", "").lower().split() if name in ROLES]
    kind = " ".join(sorted(DIGITS.sub("#", found.get("class") or "").split())) or ("#" + DIGITS.sub("#", found["id"]) if found.get("id") else "")
    return "." + kind.replace("/", "|") if kind else "", max(marks, default=0)


class Page:
    """Blocks outside boilerplate in page order, and the tree of containers; container 0 is the page itself.

    texts, linked, owner: of each block its text, characters in links and innermost container. parent, label, path: of
    each container its parent, tag with classes, and the number of its path.
    """

    def __init__(self, page: str):
        self.parent, self.label, self.path, self.numbers = [-1], [""], [0], {}
        self._marks: list[tuple[int, int]] = []  # parent and strength of each marked element
        self._blocks: list[tuple[int, list[tuple[str, bool, int]]]] = []  # container and pieces: text, in a link, mark
        self._read(page)
        self._settle()

    def _read(self, page: str) -> None:
        stack: list[tuple[str, bool, int, int]] = []  # tag, out, container, mark
        count: dict[str, int] = defaultdict(int)  # of open elements by tag
        pieces: list[tuple[str, bool, int]] = []
        out, container, mark, at, n = False, 0, -1, 0, len(page)

        def flush():
            if pieces:
                self._blocks.append((container, pieces[:]))
                pieces.clear()

        def pop(depth: int):
            nonlocal out, container, mark
            if any(x[0] in BLOCKS and not x[1] for x in stack[depth:]):
                flush()
            for x in stack[depth:]:
                count[x[0]] -= 1
            del stack[depth:]
            out, container, mark = stack[-1][1:] if stack else (False, 0, -1)

        while at < n:
            m = TOKEN.search(page, at)
            if not out and (text := page[at : m.start() if m else n]):
                pieces.append((text, count["a"] > 0, mark))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if count[tag]:
                    pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                elif tag in BLOCKS and not out:
                    flush()
                continue
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.end() if end else n if tag in ("script", "style") else at
                continue
            if tag == "br":
                if not out:
                    pieces.append((" ", False, mark))
                continue
            if tag in BLOCKS:
                if not out:  # what is left out breaks no block around it
                    flush()
                if tag == "body" and stack and count["html"]:
                    pop(next(i for i, x in enumerate(stack) if x[0] == "html") + 1)
                elif tag == "body":
                    pop(0)
                twin = tag in ("li", "dt", "dd", "tr", "td", "th") and count[tag]
                if count["p"] or twin:  # what an open paragraph or item of a list implies
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p" or twin and stack[i][0] == tag:
                            pop(i)
                            break
                        if stack[i][0] in CONTAINERS or stack[i][0] in OUT or stack[i][0] in ("ul", "ol", "dl"):
                            break
            if tag in VOID or m[3].endswith("/") or tag == "a" and "href" not in m[3].lower():
                continue  # an anchor without a target, often never closed, links nothing
            kind, strength = _names(m[3])
            within = count["article"] or count["main"]
            if tag in OUT:
                out = True
            elif tag == "header" and not within:
                strength = max(strength, 1)
            elif tag == "form":
                strength = max(strength, 1)
            elif strength == 1 and within and _titles(kind):
                strength = 0
            if strength and tag not in ("html", "body", "main", "article"):
                self._marks.append((mark, strength))
                mark = len(self._marks) - 1
            if tag in CONTAINERS:
                label = tag + kind
                self.path.append(self.numbers.setdefault((self.path[container], label), len(self.numbers) + 1))
                self.parent.append(container)
                self.label.append(label)
                container = len(self.parent) - 1
            count[tag] += 1
            stack.append((tag, out, container, mark))
        flush()

    def _settle(self) -> None:
        """Drop what stands in marked elements; soft ones stay if most of the unlinked text is in them, and if all is gone."""
        held = [0] * (len(self._marks) + 1)  # the last: text under no mark
        size = [sum(len(t.strip()) for t, linked, _ in pieces if not linked) for _, pieces in self._blocks]
        total = sum(size)
        for _, pieces in self._blocks:
            for t, linked, k in pieces:
                held[k] += 0 if linked else len(t.strip())
        own = held[:]
        for k in range(len(self._marks) - 1, -1, -1):
            if self._marks[k][0] >= 0:
                held[self._marks[k][0]] += held[k]
        gone = [False] * (len(self._marks) + 1)
        for k, (up, strength) in enumerate(self._marks):
            gone[k] = up >= 0 and gone[up] or strength == 2 or 2 * held[k] <= total
        if total and not any(n for n, g in zip(own, gone, strict=True) if not g):
            best = max(range(len(self._marks)), key=lambda k: (held[k], -k))
            for k, (up, _) in enumerate(self._marks):  # the marked element with most text, without marked parts of its own
                gone[k] = k != best and gone[k]
        self.texts, self.linked, self.owner = [], [], []
        for container, pieces in self._blocks:
            kept = [(t, linked) for t, linked, k in pieces if not gone[k]]
            text = " ".join(html.unescape("".join(t for t, _ in kept)).split())
            if text:
                self.texts.append(text)
                self.linked.append(min(len(text), sum(len(t.strip()) for t, linked in kept if linked)))
                self.owner.append(container)

    def best(self) -> tuple[int, float] | None:
        """Container and score of most text: a block counts for its container, half for its parent, a quarter and so on."""
        score = [0.0] * len(self.parent)
        for text, linked, c in zip(self.texts, self.linked, self.owner, strict=True):
            score[c] += len(text) * (1 - linked / len(text)) ** 2
        for c in range(len(score) - 1, 0, -1):
            score[self.parent[c]] += score[c] / 2
        if not self.texts:
            return None
        top = max(range(len(score)), key=lambda c: (score[c], -c))
        return top, score[top]

    def path_of(self, c: int) -> str:
        labels = []
        while c > 0:
            labels.append(self.label[c])
            c = self.parent[c]
        return "".join("/" + x for x in reversed(labels))

    def at_path(self, path: str) -> list[int]:
        """The containers with this path."""
        number = 0
        for label in path.split("/")[1:]:
            number = self.numbers.get((number, label), -1)
        return [c for c, x in enumerate(self.path) if x == number]

    def widened(self, inside: list[int]) -> set[int]:
        """The nearest article or main around each container; without one, the outermost that adds no more links than text.

        The body, or the page itself, is only taken where it is the container.
        """
        n = len(self.parent)
        length, links = [0] * n, [0] * n
        for text, linked, c in zip(self.texts, self.linked, self.owner, strict=True):
            length[c] += len(text)
            links[c] += linked
        for c in range(n - 1, 0, -1):
            length[self.parent[c]] += length[c]
            links[self.parent[c]] += links[c]
        article, outer = [-1] * n, list(range(n))
        for c in range(1, n):  # parents come first
            up, tag = self.parent[c], self.label[c].partition(".")[0]
            article[c] = c if tag in ("article", "main") else article[up]
            grows = up > 0 and self.label[up].partition(".")[0] != "body" and 2 * (links[up] - links[c]) <= length[up] - length[c]
            outer[c] = outer[up] if grows else c
        return {article[c] if article[c] >= 0 else outer[c] for c in inside}


def _titles(kind: str) -> bool:
    """Whether the classes name a header, which in an article holds its title."""
    return any("header" in NOT_NAME.split(HUMP.sub("-", name).lower()) for name in kind[1:].split())


def extract(page: Page, path: str | None) -> str:
    """The blocks in containers of this path and the articles around them, else of the page's own best one; one on a line."""
    inside = page.at_path(path) if path is not None else []
    if not inside:
        found = page.best()
        if found is None:
            return ""
        inside = [found[0]]
    chosen = page.widened(inside)
    kept = [False] * len(page.parent)
    for c in range(len(kept)):
        kept[c] = c in chosen or c > 0 and kept[page.parent[c]]
    return "\n".join(t for t, c in zip(page.texts, page.owner, strict=True) if kept[c])


def host_paths(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path that most pages of a host vote for; ties go to the higher score, then the path's order."""

    def vote(cols):
        paths, scores = [], []
        for p in cols[0]:
            page = Page(p.as_py() or "")
            found = page.best()
            paths.append(page.path_of(found[0]) if found else None)
            scores.append(found[1] if found else 0.0)
        return [pa.array(paths, pa.string()), pa.array(scores, pa.float64())]

    votes = add_columns(pages.select(_host(url).alias("host"), F.col(html_col).alias("__h")), [F.col("__h")], [StructField("path", StringType()), StructField("score", DoubleType())], vote)
    counts = votes.drop("__h").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counts.groupBy("host").agg(F.max_by("path", F.struct("n", F.round("score", 3), "path")).alias("path"))


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))


@any_names
def extract_pages(pages: DataFrame, url: str = "url", html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each; null or empty html, and pages without text, give an empty text.

    A null url, or one without a host, counts as the host "". Repeated rows and equal ids stay as they are. Time and
    memory are in proportion to a page, however deep its elements stand.
    """
    winners = checkpoint(host_paths(pages, url, html_col).withColumnsRenamed({"host": "__host", "path": "__path"}))
    size = winners.agg(F.coalesce(F.sum(F.length("__host") + F.length("__path") + 16), F.lit(0))).first()[0]
    joined = pages.withColumn("__host", _host(url)).join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners.hint("merge"), "__host", "left")

    def work(cols):
        text = [extract(Page(p.as_py() or ""), w) for p, w in zip(cols[0], cols[1].to_pylist(), strict=True)]
        return [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]

    fields = [StructField(out, StringType(), False), StructField("n_chars", LongType(), False)]
    return add_columns(joined, [F.col(html_col), F.col("__path")], fields, work).drop("__host", "__path")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
