"""Main text of web pages by consensus of their host.

First every page scores its containers (elements that hold blocks of text): a block's characters outside
links count for the nearest container, and half for the one around it. Containers are named by their path of tags
and classes, digits generalised. Spark adds up the pages' votes by host and path; then each page is
extracted again from its host's best path that it has, or, if it has none, from its own best container; an article or main
around it is taken whole. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role, class and id.

Defined results: null html is an empty page, with the empty text; pages without a host vote among themselves; rows are
extracted one by one, so repeated rows get equal texts; an empty table gives no rows; broken markup is read as far as it
goes; further columns stay.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import free_name, table, written

#: A path wins if it has this share of the votes of its host's best path.
LEAST_SHARE = 0.1
#: Paths of a host that are kept at most.
MOST_PATHS = 64
#: Containers around a block that are told apart.
DEEPEST = 50
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
#: Elements left out up to their end tag; without one only the tag is.
_EMBEDDED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("template", "svg", "select", "object")}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article body center div main section table tbody td tr ul ol dl".split())
BLOCKS = CONTAINERS | set(
    "address aside blockquote caption dd details dialog dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup head html legend li menu nav option p pre search summary tfoot th thead title".split())
LEFT_OUT = set("aside button dialog footer form head menu nav search title".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Fixed value: words that name what is not main text.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split())
#: Fixed value: those that are no main text wherever they stand.
ALWAYS = set("ad ads advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus gdpr login popup respond".split())
#: Fixed value: whole names of the same.
WHOLE_NAMES = {"byline-links", "site-header", "skip-link"}
#: Fixed value: first and last words of names that tell a state or an arrangement, not what an element is.
STATES = set("no not has have with without is are js hide hides hidden show shows when if above below".split())
STATE_ENDS = set("enabled disabled active inactive on off open opened closed visible shown present layout page body wrapper true false".split())
#: Elements that only tag and role judge inside an article, whose sections and headings may be about anything.
CONTENT = set("section h1 h2 h3 h4 h5 h6 p table thead tbody tr td th figure figcaption blockquote pre dl dt dd details summary li".split())
#: Fixed value: words that inside an article may name a part of it.
MILD = set("comment notice promotion recommended related reply respond search toolbar widget copyright banner notification".split())
MAIN = re.compile(r"(?:^|[-_\s])(?:article|content|entry|main|post|story)(?:$|[-_\s])", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _named_out(tag: str, names: str, in_article: bool, listed: set[str]) -> bool:
    """Whether a class or an id names a part of the page that is no main text.

    A name counts by its first and its last word: ``ad-slot`` and ``left-sidebar`` do, ``no-sidebar`` and ``share-enabled`` tell a
    state of something else. An element also called content, post or the like is not left out.
    """
    if in_article and tag in CONTENT:
        return False
    out = False
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if not words:
            continue
        if name in ("content", "main", "article", "entry", "post", "story") or "-".join(words[-2:]) in (
                "main-content", "entry-content", "post-content", "article-content", "article-body", "post-body", "page-content"):
            return False
        if words[0] in STATES or words[-1] in STATE_ENDS:
            continue
        ends = {words[0], words[-1]} - (MILD if in_article and len(words) > 1 else set())
        out = out or bool(ends & listed) or name in WHOLE_NAMES
    return out


def _whole(path: str) -> str:
    """The path of the outermost article around ``path``, or else of the nearest main, or else ``path``."""
    steps = path.split(">")
    tags = [x.partition(".")[0] for x in steps]
    if "article" in tags:
        return ">".join(steps[:tags.index("article") + 1])
    return ">".join(steps[:len(tags) - tags[::-1].index("main")]) if "main" in tags else path


class Page:
    """The blocks of text of a page outside what is left out, and its containers by path."""

    def __init__(self, html: str, listed: set[str] = NAMES):
        self.listed = listed
        #: Characters of text that names alone left out.
        self.named = 0
        self.blocks: list[str] = []
        self.inside: dict[str, list[int]] = defaultdict(list)
        self.score: dict[str, float] = defaultdict(float)
        self._text: list[str] = []
        self._links = 0
        #: Open elements: tag, (path, weight) of the containers around, left out (1 by name alone, 2 otherwise), in an article.
        self._open: list[tuple[str, tuple, int, bool]] = [("", (("", 1.0),), 0, False)]
        #: How many elements of each tag are open.
        self._count: dict[str, int] = defaultdict(int)
        at, endless = 0, set()
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self._add(html[at:m.start()])
            at = m.end()
            tag = m[3]
            if tag:
                tag = tag.lower()
                if not m[2] and tag in ("svg", "math") and m[4].endswith("/"):
                    continue
                if tag in _EMBEDDED:
                    end = None if m[2] or tag in endless else _EMBEDDED[tag].search(html, at)
                    if end:
                        at = end.end()
                    elif not m[2]:
                        endless.add(tag)
                    continue
                self._end(tag) if m[2] else self._start(tag, m[4])
        self._add(html[at:])
        self._flush()

    def _add(self, raw: str) -> None:
        if self._open[-1][2] == 1:
            self.named += len(raw.strip())
        elif not self._open[-1][2]:
            text = references.unescape(raw)
            self._text.append(text)
            if self._count["a"] > 0:
                self._links += len(text.strip())

    def _flush(self) -> None:
        text, links = " ".join("".join(self._text).split()), self._links
        self._text, self._links = [], 0
        if not text:
            return
        chain = self._open[-1][1]
        for p, _ in chain:
            self.inside[p].append(len(self.blocks))
        plain = max(len(text) - links, 0)
        for (p, weight), share in zip(reversed(chain), (1.0, 0.5)):
            self.score[p] += plain * share * weight
        self.blocks.append(text)

    def _close(self, depth: int) -> None:
        if any(x[0] in BLOCKS for x in self._open[depth:]):
            self._flush()
        for x in self._open[depth:]:
            self._count[x[0]] -= 1
        del self._open[depth:]

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS or tag == "br":
            if tag != "br" and tag not in ("html", "body"):
                self._close_implied(tag)
            self._flush()
        if tag in VOID:
            return
        _, chain, out, in_article = self._open[-1]
        names = classes = ""
        if rest.strip():
            a = _attributes(rest)
            classes = a.get("class", "")
            names = f"{classes} {a.get('id', '')}".strip()
            if (a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                    or re.search(r"display\s*:\s*none", a.get("style", ""), re.I)
                    or (tag == "article" and re.search(r"(?:^|[-_\s])(?:comment|reply)", names, re.I))):
                out = 2
            elif not out and tag not in ("html", "body", "article", "main") and _named_out(tag, names, in_article, self.listed):
                out = 1
        if tag in LEFT_OUT or (tag == "header" and not in_article):
            out = 2
        elif tag in ("article", "main") and out == 1 and not in_article:
            # The article itself is main text, whatever a wrapper around it is called.
            out = 0
        if tag in CONTAINERS and tag != "body" and len(chain) < DEEPEST:
            step = ".".join([tag, *sorted(set(re.sub(r"\d+", "0", classes).replace(">", "").lower().split()))])
            # Containers of one name around each other are one, as are those beyond the depth and the last above it.
            if chain[-1][0].rpartition(">")[2] != step:
                weight = 1.25 if tag in ("article", "main") or MAIN.search(names) else 1.0
                chain = (*chain, (f"{chain[-1][0]}>{step}", weight))
        self._open.append((tag, chain, out, in_article or tag in ("article", "main")))
        self._count[tag] += 1

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and the like end their own kind."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
                "tr": ("tr",), "option": ("option",)}.get(tag, ())
        stop = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}.get(tag, ("dl",))
        found = 0
        if not any(self._count[t] for t in ("p", *same)):
            return
        for d in range(len(self._open) - 1, 0, -1):
            t = self._open[d][0]
            if t == "p" or t in same:
                found = d
            elif t in stop or (t in BLOCKS and not same):
                break
        if found:
            self._close(found)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._count[tag]:
            return
        for d in range(len(self._open) - 1, 0, -1):
            if self._open[d][0] == tag:
                self._close(d)
                return
            if tag not in BLOCKS and self._open[d][0] in BLOCKS:
                return

    def votes(self) -> dict[str, int]:
        """Thousandths of the page's score by path."""
        total = sum(self.score.values())
        return {p: int(1000 * s / total) for p, s in self.score.items()} if total else {}

    def text(self, winners: list[str]) -> str:
        path = next((p for p in winners if p in self.inside), None)
        if path is None:
            if not self.score:
                return ""
            path = min(self.score, key=lambda p: (-self.score[p], p.count(">"), p))
        return " ".join(self.blocks[i] for i in self.inside[_whole(path)])


def page_of(html: str | None) -> Page:
    """The page; where names left out nearly all of its text, only those of ``ALWAYS`` count, as the others mean something else there."""
    page = Page(html or "")
    return Page(html, ALWAYS) if page.named > 20 * sum(map(len, page.blocks)) else page


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def host_paths(pages: DataFrame, least_share: float = LEAST_SHARE, most: int = MOST_PATHS) -> DataFrame:
    """(host, paths): at most ``most`` winning paths of each host, best first; the shorter and then the lower path on a tie.

    Paths of one page alone are no consensus and do not count: such a page uses its own best container anyway.
    """
    def vote(batches):
        for batch in batches:
            votes: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, n in page_of(html.as_py()).votes().items():
                    sums = votes[host, path]
                    sums[0] += n
                    sums[1] += 1
            hosts, paths = [h for h, _ in votes], [p for _, p in votes]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              *[pa.array([x[i] for x in votes.values()], pa.int64()) for i in (0, 1)]],
                                             ["host", "path", "votes", "pages"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, votes long, pages long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages")).filter("pages > 1")
    depth = F.size(F.split("path", ">"))
    # The limit by host is applied before rows are shuffled by host.
    first = Window.partitionBy("host").orderBy(F.desc("votes"), depth, "path")
    top = summed.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("at", "votes", "path")))
    best = lambda x: F.get(x, F.lit(0))["votes"]
    # The whole page wins only if nothing within it does better.
    won = F.filter("all", lambda x: (x["votes"] >= best(F.col("all")) * least_share) & ((x["path"] != "") | (x["votes"] == best(F.col("all")))))
    return top.groupBy("host").agg(ordered.alias("all")).select("host", F.transform(won, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, name: str = "text", **params) -> DataFrame:
    """``pages`` (url, html, ...) with the main text as column ``name``, which takes the place of one that is called so."""
    host, paths = free_name(pages, "_host"), free_name(pages, "_paths")
    # Written, so that its size is known: a small table is broadcast and html stays where it is, and beyond that a
    # host with very many pages is split by adaptive execution.
    won = written(host_paths(pages, **params), "paths").select(F.col("host").alias(host), F.col("paths").alias(paths))
    joined = pages.withColumn(host, host_of(F.col("url"))).join(won, host, "left")

    @F.pandas_udf(T.StringType())
    def read(html, winners):
        import pandas as pd
        return pd.Series([page_of(h).text(list(w) if w is not None else []) for h, w in zip(html, winners)], dtype=object)

    return joined.withColumn(name, read("html", paths)).drop(host, paths)


def op4_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
