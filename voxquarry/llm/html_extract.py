"""Main text of web pages through consensus paths of their hosts.

Every page names the container that holds nearly all of its running text, as
a path of tags and class names with their numbers taken out.  The pages of a
host vote; the winning path then says for each of them where the article is,
so a page with a long discussion or a short article follows its neighbours.
Pages that lack the winning path fall back on their own container.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .ngram_join import light

VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript noembed noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("body caption dd dt html legend li option select tbody td tfoot th thead tr".split()) | {"p"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("applet button caption html marquee object table td template th".split())
#: an element that a start tag ends, and where the search for it stops
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
CONTAINERS = set("article main section div td body center form table fieldset".split())
DROPPED = set("nav aside footer button select textarea dialog svg math template object audio video canvas map menu".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert".split())
#: words in class names and ids of parts that aren't the article
NAMES = re.compile(
    r"(?!commentary|shared)(?:[a-z]*(?:navbar|sidebar|footer|menu|comments?|breadcrumbs?|adverts?|advertisements?|cookies?|newsletter"
    r"|masthead|banner|nav)|(?:nav|menu|footer|sidebar|comment|advert|cookie|breadcrumb|newsletter|sponsor|promo|popup|share|social)"
    r"[a-z]*|ads?|adv|adbox|adslot|adsense|aside|header|topbar|widgets?|consent|gdpr|notices?|alerts?|notifications?|modal|overlay"
    r"|subscribe|subscription|signup|signin|login|related|recommended|recommendations|disqus|respond|reply|replies|discussion|form"
    r"|search(?:box|form|bar)?|pagination|pager|copyright|disclaimer|toolbar|skip|teasers?)"
)
#: for elements that are articles by their tag, only these count
ASIDE_ARTICLES = re.compile(r"(?!commentary)comment[a-z]*|related|recommended|ads?|adverts?|sponsor[a-z]*|promo[a-z]*|teasers?|reply|replies")
MODIFIERS = {"has", "with", "no", "without", "is", "hide", "non"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"""(?:[^"'>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+>""")
ATTRIBUTE = re.compile(r"""(?<=[\s"'/])(class|id|role|style|hidden)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBERED = re.compile(r"[a-z]*\d[\da-z]*")
HIDING = re.compile(r"display\s*:\s*none", re.I)
PAGE_CHARS = 500  # running text beyond which a page has its full vote
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


class Page:
    """Elements of a page in order, and its text as ``(element, text)``, breaks between blocks being None."""

    def __init__(self, html: str):
        self.tag, self.parent, self.label = ["#"], [-1], [""]
        self.drop, self.by_name = [False], [False]
        self.first, self.last = [0], [0]  # range of an element's texts
        self.texts: list[tuple[int, str | None]] = []
        self.title = ""
        self._parse(html)
        self._judge()

    def _open(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1]
        i = len(self.tag)
        label, drop, by_name = tag, tag in DROPPED, tag == "header" or tag == "form"
        if attributes:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            drop = drop or found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or bool(HIDING.search(found.get("style", "")))
            if not names.isspace():
                if tag not in ("body", "html"):
                    by_name = by_name or boilerplate(names, ASIDE_ARTICLES if tag in ("article", "main") else NAMES)
                label = tag + "".join(f".{c}" for c in sorted({NUMBERED.sub("#", c.lower()) for c in names.split()}))
        self.tag.append(tag)
        self.parent.append(parent)
        self.label.append(label)
        self.drop.append(drop)
        self.by_name.append(by_name)
        if tag in BLOCKS:
            self.texts.append((parent, None))
        self.first.append(len(self.texts))
        self.last.append(len(self.texts))
        self.stack.append(i)
        self.open[tag] += 1

    def _close(self, depth: int) -> None:
        """End all elements from a place in the stack on."""
        for i in reversed(self.stack[depth:]):
            self.last[i] = len(self.texts)
            self.open[self.tag[i]] -= 1
            if self.tag[i] in BLOCKS:
                self.texts.append((self.parent[i], None))
        del self.stack[depth:]

    def _nearest(self, tags: set[str], stop: set[str]) -> int:
        """Place in the stack of the innermost of some elements, 0 if none is open before a stopping one."""
        if not any(self.open[t] for t in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[depth]]
            if t in tags:
                return depth
            if t in stop:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.texts.append((self.stack[-1], " "))
            return
        if tag in CLOSES_P and (depth := self._nearest({"p"}, SCOPE)):
            self._close(depth)
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self._close(len(self.stack) - 1)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            while depth := self._nearest(ended, stop):
                self._close(depth)
        if tag == "hr":
            self.texts.append((self.stack[-1], None))
        elif tag not in VOID and not (tag in ("html", "body") and self.open[tag]):
            self._open(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        stop = (SCOPE if tag in BLOCKS else BLOCKS) - {tag}
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            stop = {"table"}
        if depth := self._nearest(HEADINGS if tag in HEADINGS else {tag}, stop):
            self._close(depth)

    def _parse(self, html: str) -> None:
        self.stack, self.open = [0], Counter()
        quoted = max(html.rfind('"'), html.rfind("'"))
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._text(html[at:lt])
            at = lt + 1
            after = html[at : at + 1]
            if after == "/" and (m := NAME.match(html, at + 1)):
                self._end(m[0].lower())
                at = html.find(">", m.end()) + 1 or n
            elif m := NAME.match(html, at):
                tag = m[0].lower()
                end = TAG_END.match(html, m.end()) if at < quoted else None
                stop = end.end() if end else html.find(">", m.end()) + 1 or n
                if tag in RAW:
                    stop = self._skip(html, tag, stop)
                else:
                    self._start(tag, html[m.end() : stop - 1])
                at = stop
            elif html.startswith("!--", at):
                at = html.find("-->", at + 1) + 3  # <!--> is a whole comment
                at = n if at < 3 else at
            elif after in ("!", "?", "/"):
                at = html.find(">", at) + 1 or n
            elif lt < n:
                self._text("<")
        self._close(1)
        self.last[0] = len(self.texts)
        del self.stack, self.open

    def _skip(self, html: str, tag: str, at: int) -> int:
        """The end of an element that holds no markup."""
        end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
        if tag == "title" and not self.title:
            self.title = " ".join(unescape(html[at : end.start() if end else len(html)]).split())
        return html.find(">", end.end()) + 1 or len(html) if end else len(html)

    def _text(self, text: str) -> None:
        self.texts.append((self.stack[-1], unescape(text) if "&" in text else text))

    def _judge(self) -> None:
        """What is dropped, and how much running text and link text each element holds."""
        n = len(self.tag)
        holds = [0] * n  # 2: around the main heading, so no part beside the article; 1: around an article
        for i in range(n - 1, 0, -1):
            own = 2 if self.tag[i] in ("h1", "main") else int(self.tag[i] == "article")
            holds[i] = max(holds[i], own)
            holds[self.parent[i]] = max(holds[self.parent[i]], holds[i])
        plain, link = [0] * n, [0] * n
        gate, linked = [-1] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            linked[i] = linked[p] or self.tag[i] == "a"
            # a form around a whole page is none to fill in
            kept = holds[i] == 2 or (holds[i] and self.tag[i] == "form")
            gate[i] = i if self.drop[i] or (self.by_name[i] and not kept) else gate[p]
        for i, t in self.texts:
            if t is not None and gate[i] < 0:
                size = len(t) - t.count(" ") if not t.isspace() else 0
                if linked[i]:
                    link[i] += size
                else:
                    plain[i] += size
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
            link[self.parent[i]] += link[i]
        self.gate, self.plain, self.link = gate, plain, link
        self.headings = [i for i in range(1, n) if self.tag[i] == "h1" and gate[i] < 0]

    def path(self, i: int) -> str:
        parts = []
        while i > 0:
            if self.tag[i] != "html":
                parts.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(parts))

    def text_of(self, i: int) -> str:
        """Text of the blocks in an element, without dropped parts."""
        whole, blocks, now = self.tag[i] in ("#", "body", "html"), [], []
        menus = self._link_lists() if whole else ()
        skip_to = -1
        for k in range(self.first[i], self.last[i]):
            node, t = self.texts[k]
            if k < skip_to or self.gate[node] > i:
                continue
            if menus and (m := self._inside(node, menus)):
                skip_to = self.last[m]
                continue
            if t is not None:
                now.append(t)
            elif now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)

    def _link_lists(self) -> set[int]:
        """Lists whose text is links: menus without a name."""
        count = Counter()
        for i, t in enumerate(self.tag):
            if t == "a":
                p = self.parent[i]
                while p > 0 and self.tag[p] not in ("ul", "ol"):
                    p = self.parent[p]
                count[p] += 1
        return {i for i, n in count.items() if i > 0 and n > 2 and self.link[i] >= 9 * self.plain[i]}

    def _inside(self, node: int, some: set[int]) -> int:
        while node > 0:
            if node in some:
                return node
            node = self.parent[node]
        return 0

    def heading_outside(self, i: int, child: int) -> bool:
        """Whether the element has a main heading that the child lacks; in the body only the one of the page's title counts."""
        if any(self.first[child] <= self.first[h] < self.last[child] for h in self.headings):
            return False
        for h in self.headings:
            if self.first[i] <= self.first[h] < self.last[i]:
                text = self.text_of(h)
                if text and (self.tag[i] != "body" or self.title.startswith(text[:40])):
                    return True
        return False

    def container(self) -> int:
        """The innermost element that holds at least four fifths of what its parents hold, with the heading; 0 if no text."""
        kids: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            kids.setdefault(self.parent[i], []).append(i)
        best = now = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        while True:
            inner = [i for i in kids.get(now, ()) if self.gate[i] < 0 and self.plain[i] >= 0.8 * self.plain[best] and self.plain[i]]
            if not inner:
                return best
            now = inner[0]
            if self.tag[now] in CONTAINERS:
                if self.heading_outside(best, now):
                    return best
                best = now

    def matching(self, path: str) -> list[int]:
        """Outermost elements on a path; of several without a name only the one with most text."""
        leaf = path.rpartition(">")[2]
        found = [i for i, x in enumerate(self.label) if x == leaf and self.path(i) == path] if leaf else []
        named = leaf in ("article", "main") or any(n.strip("#-_") for n in leaf.split(".")[1:])
        if len(found) > 1 and not named:
            found = [max(found, key=lambda i: (self.plain[i], -i))]
        return [i for i in found if self.gate[i] < 0 or self.gate[i] == i]

    def main_text(self, path: str | None) -> str:
        at = self.matching(path) if path else []
        if not any(self.plain[i] for i in at):
            at = [self.container()]
        return "\n".join(t for t in map(self.text_of, at) if t)


def boilerplate(names: str, pattern: re.Pattern) -> bool:
    """Whether class names or an id name a part beside the article; ``has-sidebar`` and the like don't."""
    for name in names.split():
        before = ""
        for word in WORDS.findall(name):
            word = word.lower()
            if before not in MODIFIERS and pattern.fullmatch(word):
                return True
            before = word
    return False


def texts_of(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows and values, of which a few at a time become Python objects."""
    for a in range(0, len(column), 64):
        for k, value in enumerate(column.slice(a, 64).to_pylist()):
            yield a + k, value or ""


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, votes`` over ``pages(host, html)``; a page votes for its own container, short ones less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter = Counter()

        def table() -> pa.RecordBatch:
            hosts, paths = zip(*votes)
            return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(paths), pa.array(votes.values(), pa.int64())], names=["host", "path", "votes"])

        for batch in batches:
            hosts = batch.column(0).to_pylist()
            for k, html in texts_of(batch.column(1)):
                page = Page(html)
                if (i := page.container()) and page.plain[i]:
                    votes[hosts[k], page.path(i)] += min(page.plain[i], PAGE_CHARS)
            if len(votes) > 50_000:
                yield table()
                votes.clear()
        if votes:
            yield table()

    found = pages.where("host IS NOT NULL").select("host", "html").mapInArrow(run, "host string, path string, votes bigint")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 64
) -> DataFrame:
    """Main text of every whole page: ``id_col, url_col, text, n_chars``.

    Blocks of the article in page order, one a line, white space inside a
    block being one space and character references decoded; menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are left out.  ``n_chars`` counts code points.

    Null, blank or odd markup: whatever text it has, else an empty one.  A
    null url or one without a host has no neighbours, so the page's own
    container counts.  Null ids and repeated rows: one result per row.  Very
    long pages are parsed whole, in time linear in their length.  Other
    columns are ignored.  No rows: no rows.
    """
    ship_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col(f"`{url_col}`").cast("string"), HOST, 1))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").alias("html"),
        F.when(host != "", host).alias("host"),
    )
    best = F.max(F.struct("votes", "path"))
    winners = cut_lineage(host_paths(rows).groupBy("host").agg(best.alias("b")).select(F.col("host").alias("of"), F.col("b.path").alias("path")))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    # pages of one host are many: beyond the size of a broadcast they are dealt out under several keys
    small = light(winners)
    if small is winners:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("html"), F.lit(salts)).cast("int"))
        spread = winners.select("of", "path", salt)
        rows = rows.join(spread, (rows["host"] == spread["of"]) & (rows["part"] == spread["salt"]), "left")
    else:
        rows = rows.join(small, rows["host"] == small["of"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(3).to_pylist()
            for a in range(0, batch.num_rows, 256):
                texts = [Page(html).main_text(paths[a + k]) for k, html in texts_of(batch.column(2).slice(a, 256))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, 256) for c in (0, 1)],
                        pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                    ],
                    names=["_id", "_url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.select("_id", "_url", "html", "path").mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars bigint")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
