"""Main text of web pages by a site style tree.

Pages of one host are merged by style: a style node is a path of tags with their classes and ids. A node's content
features are the phrases of its blocks (up to PHRASE words, digits alike), and its presentation features the sequences
of its children. Over the pages of the host a phrase has the entropy of its spread, from 0 (on one page) to 1 (on all
of them). A node's commonness is the mean entropy over its distinct phrases and those below it, and counts up to twice
where the pages agree in the node's children; what is left to 1 is the node's importance. Branches of low importance
are removed, unless the host's largest node is nearly as common, as where pages are copies. The fewer pages a host has the
less their agreement tells, so commonness is shrunk by m / (m + PRIOR) for m pages; a page alone shares nothing. What a
node's tag or name states (menu, footer, advert and the like) removes it too, but not against its importance: a node that holds
at least half of what is important on the host stays whatever its name. One rule holds for hosts of any size. Scripts,
forms, hidden parts and reader comments, which differ between pages like articles, go always; and where what is left of a
page lies by at least half in a stated main part, the rest of it goes.

The tree exists only as counts by host, node and feature: tasks count their own pages first, and Spark adds these up.
So no task holds the pages of a host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import written

PHRASE = 6
#: Pages without anything in common that count beside a host's own.
PRIOR = 30
#: Levels of a style path; elements nested deeper belong to the node at this depth.
DEPTH = 64
CONTENT, PRESENTATION, ROLE = 0, 1, 2
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Element kinds of HTML.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Roles that are no main text, as tags and as words of class, id and role.
_HARD_TAGS = _RAW | {"head", "form", "button", "select", "input", "dialog", "object", "audio", "video", "canvas", "label"}
_SOFT_TAGS = {"nav", "footer", "aside", "menu"}
_HARD_NAMES = {"comment", "comments", "disqus", "reply", "respond", "login", "signup", "search", "modal", "popup", "overlay"}
_SOFT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs",
    "consent", "cookie", "cookies", "footer", "gdpr", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pager", "pagination", "promo", "promoted", "recommended", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "complementary", "contentinfo",
}
_MAIN = {"article", "main"}
_CONTAINERS = {"ul", "ol", "dl", "table", "tbody", "td", "th", "div", "article", "section", "body", "li", "form", "select"}
_MATTERS = re.compile("class|id|role|hidden|style", re.I)


@lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Of a start tag: its style (empty for a plain inline one), whether it is the main part, no text in any case, stated to be none, or a header."""
    names = {k.lower(): (v or "").strip("\"'") for k, v in _NAME.findall(attributes)} if attributes else {}
    given = f"{names.get('class', '')} {names.get('id', '')}"
    label = ".".join(sorted(given.lower().split()))
    words = set(re.findall("[a-z]+", f"{re.sub('(?<=[a-z])(?=[A-Z])', ' ', given)} {names.get('role', '')}".lower()))
    named = tag not in ("html", "body", "main", "article")
    hidden = "hidden" in names or names.get("aria-hidden", "") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
    hard = hidden or tag in _HARD_TAGS or named and bool(words & _HARD_NAMES)
    soft = tag in _SOFT_TAGS or named and bool(words & _SOFT_NAMES)
    style = _DIGITS.sub("0", f"{tag}.{label}" if label else tag) if label or tag not in _INLINE else ""
    return style, tag in _MAIN or names.get("role") == "main", hard, soft, tag == "header" or "header" in words


class Page:
    """blocks: (style path, text, in the main part, no text in any case, stated to be none) in page order; children: the
    sequence of styles in each path; roles: the paths that state a role. All from one pass, in linear time.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str, bool, bool, bool]] = []
        self.children: dict[tuple[str, ...], list[str]] = {}
        self.roles: set[tuple[str, ...]] = set()
        self._stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, style (if it is in the path), main, hard, soft
        self._counts: Counter = Counter()  # open elements on the stack by tag
        self._plain: Counter = Counter()  # open inline elements that have no style, which are on no stack
        self._path: tuple[str, ...] = ()
        self._mains = self._hards = self._softs = 0
        self._text: list[str] = []
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, end, quotes = 0, len(source), True
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self._text.append(source[at:])
                return
            if start > at:
                self._text.append(source[at:start])
            if source.startswith("<!--", start):
                close = source.find("-->", start + 4)
                at = close + 3 if close >= 0 else end
                continue
            if source.startswith("<![CDATA[", start) and (close := source.find("]]>", start)) >= 0:
                self._text.append(html.escape(source[start + 9 : close], quote=False))
                at = close + 3
                continue
            if source.startswith(("<!", "<?"), start):
                close = source.find(">", start)
                if close < 0:
                    self._text.append(source[start:])
                    return
                at = close + 1
                continue
            m = _TAG.match(source, start)
            if m is None:
                self._text.append("<")
                at = start + 1
                continue
            close = self._tag_end(source, m.end()) if quotes else source.find(">", m.end())
            if close < 0 and quotes:  # a quote is never closed, so quotes end no value from here on
                quotes, close = False, source.find(">", m.end())
            if close < 0:
                self._text.append(source[start:])
                return
            at, tag, attributes = close + 1, m[2].lower(), source[m.end() : close]
            if m[1]:
                self._end(tag)
            else:
                self._open(tag, attributes)
                if tag in _RAW and not attributes.endswith("/"):
                    found = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = found.end() if found else end
                    self._flush()
                    self._drop()

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """Place of the > that ends a tag; quotes hold it only where they begin a value."""
        while m := _STOP.search(source, at):
            if m[0] == ">":
                return m.start()
            close = source.find(m[0][-1], m.end())
            if close < 0:
                return -1
            at = close + 1
        return -1

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self.blocks.append((self._path, text, self._mains > 0, self._hards > 0, self._softs > 0))

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            self._close({"p"}, within=True)
        if tag in _CLOSES_OWN:
            self._close(_CLOSES_OWN[tag], within=True)
        style, main, hard, soft, header = _kind(tag, attributes if attributes and _MATTERS.search(attributes) else "")
        if not style and not (main or hard or soft):
            self._plain[tag] += 1
            return
        soft = soft or header and not (main or self._mains)
        self._mains += main
        self._hards += hard
        self._softs += soft
        if style:
            self.children.setdefault(self._path, []).append(style)
            if len(self._path) < DEPTH:
                self._path = (*self._path, style)
            else:
                style = ""
        if soft and style:
            self.roles.add(self._path)
        self._stack.append((tag, style, main, hard, soft))
        self._counts[tag] += 1

    def _drop(self) -> None:
        tag, style, main, hard, soft = self._stack.pop()
        self._counts[tag] -= 1
        self._mains -= main
        self._hards -= hard
        self._softs -= soft
        if style:
            self._path = self._path[:-1]

    def _end(self, tag: str) -> None:
        if self._plain[tag]:
            self._plain[tag] -= 1
        elif self._counts[tag]:
            self._close({tag})

    def _close(self, tags: set[str], within: bool = False) -> None:
        """Close the innermost open element of tags, with what is open in it; within: not out of a container."""
        if not any(self._counts[tag] for tag in tags):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[i][0]
            if tag in tags:
                if any(s[0] not in _INLINE for s in self._stack[i:]):
                    self._flush()
                while len(self._stack) > i:
                    self._drop()
                return
            if within and tag in _CONTAINERS:
                return


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _phrases(text: str) -> list[str]:
    """Runs of up to PHRASE words, one after another, digits alike."""
    words = _DIGITS.sub("0", text).split(" ")
    return [" ".join(words[i : i + PHRASE]) for i in range(0, len(words), PHRASE)]


def style_counts(pages: DataFrame, limit: int = 200_000) -> DataFrame:
    """Pages by host, node and feature: host, path, kind (content, presentation or role), feature (hash), n.

    A task flushes its own counts when they reach limit, so its memory is bounded.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def frame() -> pd.DataFrame:
            rows = [(*k, n) for k, n in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "n"])

        for batch in batches:
            for host, source in zip(batch["host"], batch["html"], strict=True):
                page = Page(source or "")
                seen: dict[tuple[str, ...], set[str]] = {}
                for path, text, _, hard, _ in page.blocks:
                    if not hard:
                        seen.setdefault(path, set()).update(_phrases(text))
                for path, phrases in seen.items():
                    name = ">".join(path)
                    held.update((host, name, CONTENT, _hash(p)) for p in phrases)
                for path, styles in page.children.items():
                    held[host, ">".join(path), PRESENTATION, _hash(" ".join(s for i, s in enumerate(styles) if not i or s != styles[i - 1]))] += 1
                held.update((host, ">".join(path), ROLE, 0) for path in page.roles)
                if len(held) > limit:
                    yield frame()
        yield frame()

    made = pages.select("host", "html").mapInPandas(count, "host string, path string, kind int, feature long, n long")
    return made.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))


def low_branches(counts: DataFrame, least: float = 0.9, share: float = 0.5) -> DataFrame:
    """host and paths (a sorted array of nodes to remove, perhaps empty) for all hosts.

    A node goes when its importance is below least and its commonness is over twice that of the host's node with most
    phrases, or when it states a role and holds less than this share of the host's importance (phrases, each counted by what
    its entropy leaves to 1).
    """
    log = F.log(F.col("n").cast("double"))
    nodes = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("n"), F.sum(log).alias("logs"), F.sum(F.col("n") * log).alias("spread"), F.count("*").alias("features"))
    nodes = written(nodes, "style-tree")
    hosts = nodes.filter((F.col("path") == "") & (F.col("kind") == PRESENTATION)).select("host", F.col("n").alias("m"))
    content = nodes.filter(F.col("kind") == CONTENT).join(hosts, "host").select("host", "path", "logs", "features", "m")
    # A node has the phrases of all nodes below it, so each content row goes to every prefix of its path.
    parts = F.split("path", ">")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ">"))
    below = content.select("host", "m", "logs", "features", F.explode(prefixes).alias("node")).filter(F.col("node") != "")
    per = F.try_divide(F.sum("logs"), F.log(F.max("m").cast("double")))  # entropies summed up; null for a page alone
    spread = below.groupBy("host", "node").agg(F.coalesce(per, F.lit(0.0)).alias("spread"), F.sum("features").alias("features"), F.max("m").alias("m"))
    spread = spread.select("host", "node", (F.col("spread") / F.col("features") * F.col("m") / (F.col("m") + PRIOR)).alias("entropy"), (F.col("features") - F.col("spread")).alias("own"))
    # Of the children's sequences: 0 where all pages agree, 1 where all differ.
    differ = F.when(F.col("n") > 1, (F.log(F.col("n").cast("double")) - F.col("spread") / F.col("n")) / F.log(F.col("n").cast("double"))).otherwise(0.0)
    shape = nodes.filter(F.col("kind") == PRESENTATION).select("host", F.col("path").alias("node"), differ.alias("differ"))
    common = spread.join(shape, ["host", "node"], "left").select("host", "node", "own", (F.col("entropy") * (2 - F.coalesce("differ", F.lit(0.0)))).alias("common"))
    largest = content.groupBy("host").agg(F.max_by("path", F.struct("features", "path")).alias("node"), (F.sum("features") - F.coalesce(per, F.lit(0.0))).alias("whole"))
    main = largest.join(common, ["host", "node"], "left").select("host", "whole", F.coalesce("common", F.lit(0.0)).alias("main"))
    roles = nodes.filter(F.col("kind") == ROLE).select("host", F.col("path").alias("node"), F.lit(True).alias("role"))
    judged = common.join(roles, ["host", "node"], "full").join(hosts, "host").join(main, "host", "left")
    often = F.coalesce((F.col("common") > 1 - least) & (F.col("common") > 2 * F.col("main")), F.lit(False))
    low = often | F.coalesce(F.col("role") & (F.coalesce("own", F.lit(0.0)) < share * F.col("whole")), F.col("role"), F.lit(False))
    found = judged.groupBy("host").agg(F.collect_set(F.when(low, F.col("node"))).alias("paths"))
    return hosts.select("host").join(found, "host", "left").select("host", F.array_sort(F.coalesce("paths", F.array().cast("array<string>"))).alias("paths"))


def main_text(source: str | None, removed: frozenset[str] | None = None) -> str:
    """Blocks of one page without those in removed branches, each on a line of its own.

    Without a tree (None), what elements state decides alone. A stated main part that holds at least half of what is left
    is taken without the rest.
    """
    blocks = [b for b in Page(source or "").blocks if not b[3]]
    if removed is None:
        plain = [b for b in blocks if not b[4]]
        return "\n".join(b[1] for b in [b for b in plain if b[2]] or plain)
    cut: dict[tuple[str, ...], bool] = {}
    kept = []
    for path, text, main, *_ in blocks:
        if path not in cut:
            cut[path] = any(">".join(path[:k]) in removed for k in range(1, len(path) + 1))
        if not cut[path]:
            kept.append((text, main))
    within = [text for text, main in kept if main]
    return "\n".join(within if 2 * sum(map(len, within)) >= sum(len(text) for text, _ in kept) else (text for text, _ in kept))


def extract_text(pages: DataFrame, limit: int = 32 << 20, least: float = 0.9, share: float = 0.5) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    pages needs page_id, url and html; other columns are ignored. A null html counts as empty, and its text is empty; a
    null url or one without a host shares the host that is empty; repeated rows are kept, and count as pages of their
    host; no rows give none. The removed branches are broadcast while their bytes are at most limit, and joined by host
    otherwise, where adaptive skew joins split a hot host.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = written(low_branches(style_counts(rows), least, share), "branches")
    size = low.agg(F.sum(64 + F.length(F.array_join("paths", "\n")) * 4)).first()[0] or 0
    joined = rows.join(F.broadcast(low) if size <= limit else low, "host", "left")

    @F.pandas_udf("string")
    def extracted(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, frozenset(p) if p is not None else None) for s, p in zip(sources, paths, strict=True)], dtype=object)

    found = joined.select("page_id", "url", extracted("html", "paths").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
