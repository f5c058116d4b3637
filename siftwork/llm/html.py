"""Main text of web pages by wrappers inferred for each host.

Every page becomes a stream of nodes: a node is a run of text blocks that follow one another in
one container, as the path of its containers. ``merged`` aligns the streams of all pages of a host
into one wrapper, a union-free pattern: nodes of one path and one text, met once on either side, are
the same; between these, nodes of one path that meet are one node. Nodes that only some pages have become optional ``(...)?``, runs are groups ``(...)+``, nodes whose text differs
from page to page are text slots, and those with one text are template text. Each node gathers
the pages that have it, whether their texts are one, the share of its text in links, and how
its containers are marked. ``inside`` gives the node's verdict from these. A page is then aligned
with the wrapper of its host, and each of its blocks goes by the node that it falls on.

A page marks a node by its containers: -1 in menus, headers, footers, sidebars, notices, adverts,
forms, comments and hidden parts, by element, role, class and id; 1 in its ``article``, else its
``main``, else a container named as content, and -1 outside of it; 0 where it marks nothing.
Scripts, styles and other raw content aren't text. Where the pages of a host mark a node, its
marks decide. Where they don't, nodes that are mostly links are out, and so are nodes whose text
is one on most pages of a host whose pages otherwise differ. A single page of a host has no other
to compare, so there only marks and links count.

All pages take part. Equal pages of a host count once, pages of one shape are summed first, and
shapes are merged in the order of their hashes, in three steps by prefixes of the hash, so the
wrapper depends neither on partitions nor on order, and no task takes all shapes of a large host.

Cases: null and empty html give an empty text. Null urls and urls without a host are one host.
Unclosed and misnested tags are closed by what follows, as browsers do. Repeated pages each get
their result, null ids too. An empty table gives an empty result; other columns are ignored,
whatever their names. White space is what Python's ``str.split`` takes for it, so a no-break space is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from math import log2
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LINK_SHARE = 0.6
#: In ``inside``: the weight of unanimous marks, what a node without marks starts from, what it loses as links, and
#: the most that one text on all pages takes off.
MARKED, UNMARKED, LINKED, TEMPLATE = 4.0, 0.5, 2.5, 3.0
#: Nodes of one path in as many containers one after the other are one group.
FOLD_FROM = 6
#: Hex digits of a shape's hash that a step of the merge has in common, most first.
MERGE_DIGITS = (3, 1, 0)
#: Characters of all wrappers up to which they are broadcast; beyond, the join is salted.
BROADCAST_CHARS, SALTS = 8_000_000, 16
TAG = re.compile(
    r"<!--(?:.*?--|-?)>|<!--.*\Z|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements by how they are read.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr nobr".split()
)
OUT = frozenset("nav footer aside form head button select dialog menu fieldset audio video".split())
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
        "menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget "
    "toolbar pagination pager copyright paywall legal skip".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_WORDS = frozenset("content article post entry story body main text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
STREAM = "array<struct<path:string,text:bigint,chars:bigint,links:bigint,mark:int,n:int>>"
NODES = "array<struct<path:string,repeats:boolean,pages:bigint,marks:bigint,low:bigint,high:bigint,chars:bigint,links:bigint>>"


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class Block:
    __slots__ = ("path", "holder", "text", "links", "region", "out")

    def __init__(self, path: str, holder: int, text: str, links: int, region: int, out: bool):
        self.path, self.holder, self.text, self.links, self.region, self.out = path, holder, text, links, region, out


def _judge(name: str, source: str, inherited: tuple[str, int, bool]) -> tuple[str, int, bool]:
    """Path, region (3 article, 2 main, 1 content) and whether it is out, for a container."""
    path, region, out = inherited
    label, words, role, hidden = name, set(), "", False
    if source.strip(" /"):
        attrs = _attributes(source)
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = {w.lower() for w in NAMES.findall(named)}
        role = attrs.get("role", "").lower()
        label = ".".join([name, *sorted(set(re.sub(r"\d+", "0", f"{attrs.get('class') or attrs.get('id') or ''} {role}").split()))])
        hidden = (
            "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
        )
    own = 0
    if name == "article":
        own = 3
    elif name == "main" or role == "main":
        own = 2
    elif words & CONTENT_WORDS and name not in HEADINGS and name not in ("body", "html", "p", "li"):
        own = 1
    bad = name in OUT or hidden or role in OUT_ROLES or (bool(words & OUT_WORDS) and name not in ("body", "html", "article", "main"))
    bad |= name == "article" and bool(words & {"comment", "comments", "reply"})
    bad |= name == "header" and region < 1
    return f"{path}/{label}", max(region, own), out or bad


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in order, with the judgement of their containers."""
    found: list[Block] = []
    if not html:
        return found
    # a state is path, region, out, and the numbers of the container and of the one that holds it
    stack: list[tuple[str, tuple[str, int, bool, int, int]]] = []
    state, pieces, link_chars, in_link, at, opened = ("", 0, False, 0, -1), [], 0, 0, 0, 0
    match = TAG.search(html)

    def flush() -> None:
        nonlocal pieces, link_chars
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append(Block(state[0], state[4], text, min(link_chars, len(text)), state[1], state[2]))
        pieces, link_chars = [], 0

    while True:
        piece = html[at : match.start()] if match else html[at:]
        if piece:
            pieces.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        if not match:
            break
        at = match.end()
        name = match["name"] or match["name2"]
        if name is None:
            if match[0].startswith("<![CDATA["):
                pieces.append(match[0][9:-3].replace("&", "&amp;"))
            match = TAG.search(html, at)
            continue
        name, ends = name.lower(), bool(match["end"] or match["end2"])
        if name in INLINE or name in ("br", "img", "wbr"):
            if name == "a":
                in_link = 0 if ends else 1
            elif name == "br":
                pieces.append(" ")
        elif name in RAW and not ends:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
        else:
            flush()
            in_link = 0
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        state = stack[k][1]
                        del stack[k:]
                        break
            elif name not in VOID:
                for k in range(len(stack) - 1, -1, -1):
                    closers = CLOSED_BY.get(stack[k][0])
                    if closers is None:
                        break
                    if name in closers:
                        state = stack[k][1]
                        del stack[k:]
                        break
                stack.append((name, state))
                opened += 1
                state = (*_judge(name, match["attrs"] or match["attrs2"] or "", state[:3]), opened, state[3])
        match = TAG.search(html, at)
    flush()
    return found


def marks(found: list[Block]) -> list[int]:
    """How the page itself marks each block: 1 in, -1 out, 0 where it doesn't say."""
    best = max((b.region for b in found if not b.out), default=0)
    return [-1 if b.out or b.region != best else int(best > 0) for b in found]


def runs(found: list[Block]) -> list[tuple[int, int]]:
    """The nodes of a page as slices of its blocks."""
    out: list[list[int]] = []
    for i, b in enumerate(found):
        if out and (b.path, b.holder) == (found[i - 1].path, found[i - 1].holder):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    folded, k = [], 0
    while k < len(out):
        end = k + 1
        while end < len(out) and found[out[end][0]].path == found[out[k][0]].path:
            end += 1
        if end - k >= FOLD_FROM:
            folded.append((out[k][0], out[end - 1][1]))
        else:
            folded += [(x, y) for x, y in out[k:end]]
        k = end
    return folded


def _digest(found: list[Block]) -> int:
    text = "\n".join(x.text for x in found)
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def stream(html: str | None) -> list[tuple]:
    """A page's nodes: path, hash of the text, characters, those in links, mark and blocks."""
    found = blocks(html)
    said, out = marks(found), []
    for a, b in runs(found):
        chars = sum(len(x.text) + 1 for x in found[a:b]) - 1
        out.append((found[a].path, _digest(found[a:b]), chars, sum(x.links for x in found[a:b]), said[a], b - a))
    return out


class Sequence:
    """Nodes to be aligned: their paths, and their texts' hashes where they have only one."""

    def __init__(self, paths: list[str], texts: list[int | None]):
        self.paths = paths
        self.spots: dict[str, list[int]] = defaultdict(list)
        once: dict[tuple, int | None] = {}
        for k, (path, text) in enumerate(zip(paths, texts)):
            self.spots[path].append(k)
            if text is not None:
                once[path, text] = None if (path, text) in once else k
        self.once = {key: k for key, k in once.items() if k is not None}

    def after(self, path: str, k: int, end: int) -> int | None:
        """The next place of a path behind ``k`` and before ``end``."""
        places = self.spots.get(path, ())
        n = bisect_right(places, k)
        return places[n] if n < len(places) and places[n] < end else None


def anchors(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending on both sides, of nodes that either side has once."""
    pairs = sorted((a.once[key], j) for key, j in b.once.items() if key in a.once)
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_right(tails, j)
        back.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def walk(wrapper: Sequence, page: Sequence) -> Iterator[tuple[int | None, int | None]]:
    """Aligns two sequences: pairs of places, None where the other side has nothing. Between the
    anchors a mismatch is resolved to the nearest later match on either side; what is passed over
    stands alone."""
    i, j = 0, 0
    for i_end, j_end in [*anchors(wrapper, page), (len(wrapper.paths), len(page.paths))]:
        while i < i_end and j < j_end:
            if wrapper.paths[i] == page.paths[j]:
                yield i, j
                i, j = i + 1, j + 1
                continue
            ahead, later = wrapper.after(page.paths[j], i, i_end), page.after(wrapper.paths[i], j, j_end)
            if ahead is None and later is None:
                yield i, None
                yield None, j
                i, j = i + 1, j + 1
            elif later is None or (ahead is not None and ahead - i <= later - j):
                yield from ((k, None) for k in range(i, ahead))
                i = ahead
            else:
                yield from ((None, k) for k in range(j, later))
                j = later
        yield from ((k, None) for k in range(i, i_end))
        yield from ((None, k) for k in range(j, j_end))
        i, j = i_end, j_end
        if i < len(wrapper.paths) and j < len(page.paths):
            yield i, j
            i, j = i + 1, j + 1


def sequence_of(nodes: list[dict]) -> Sequence:
    return Sequence([x["path"] for x in nodes], [x["low"] if x["low"] == x["high"] else None for x in nodes])


def _both(a: dict, b: dict) -> dict:
    return {
        "path": a["path"], "repeats": a["repeats"] or b["repeats"], "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"]),
        **{k: a[k] + b[k] for k in ("pages", "marks", "chars", "links")},
    }


def align(wrapper: list[dict], other: list[dict]) -> list[dict]:
    """The wrapper that both fit, with what is known of each node on either side."""
    pairs = walk(sequence_of(wrapper), sequence_of(other))
    return [_both(wrapper[i], other[j]) if i is not None and j is not None else other[j] if i is None else wrapper[i] for i, j in pairs]


def merged(parts: list[dict]) -> dict:
    """``total`` pages and ``nodes`` of all parts, aligned one after the other."""
    nodes: list[dict] = []
    for k, part in enumerate(parts):
        nodes = align(nodes, list(part["nodes"])) if k else list(part["nodes"])
    return {"total": sum(p["total"] for p in parts), "nodes": nodes}


def inside(wrapper: dict) -> list[bool]:
    """The verdict of each node: part of the article or not."""
    total, nodes = wrapper["total"], wrapper["nodes"]
    one_text = [x["low"] == x["high"] and x["pages"] > 1 for x in nodes]
    told = [x for x in zip(nodes, one_text) if x[0]["marks"] > -x[0]["pages"]]
    varying, fixed = (sum(x["chars"] - x["links"] for x, one in told if one is same) for same in (False, True))
    differ, out = varying / max(1, varying + fixed), []
    for x, one in zip(nodes, one_text):
        linked = LINKED if x["links"] >= LINK_SHARE * x["chars"] else 0.0
        template = differ * x["pages"] / total * min(TEMPLATE, log2(x["pages"])) if one else 0.0
        out.append(MARKED * x["marks"] / x["pages"] + UNMARKED - linked - template > 0)
    return out


def expression(wrapper: dict) -> str:
    """A wrapper as text."""
    out = []
    for x in wrapper["nodes"]:
        inner = f"<{x['path'].rpartition('/')[2]}>{'=TEXT' if x['low'] == x['high'] else '#TEXT'}"
        mark = ("+" if x["repeats"] else "") + ("?" if x["pages"] < wrapper["total"] else "")
        out.append(f"({inner}){mark}" if mark else inner)
    return " ".join(out)


class Wrapper:
    """A host's nodes, ready to be matched."""

    def __init__(self, paths: list[str], texts: list[int | None], verdicts: list[bool]):
        self.nodes, self.verdicts = Sequence(paths, texts), verdicts

    def article(self, html: str | None) -> str:
        """The blocks of a page that fall on nodes of the article.

        A node without a place, which another alignment of the page had, goes by the first of its path.
        """
        found = blocks(html)
        nodes, kept = runs(found), {}
        page = Sequence([found[a].path for a, _ in nodes], [_digest(found[a:b]) for a, b in nodes])
        for i, j in walk(self.nodes, page):
            if j is None:
                continue
            place = i if i is not None else self.nodes.spots.get(page.paths[j], [None])[0]
            if place is not None and self.verdicts[place]:
                kept[j] = [b.text for b in found[slice(*nodes[j])]]
        return "\n".join(t for j in sorted(kept) for t in kept[j])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, total, nodes`` for each host: the wrapper of all its pages."""
    read = F.pandas_udf(lambda s: s.map(stream, na_action=None), STREAM)
    streams = pages.select(host_of(F.col(url)).alias("host"), read(F.col(html)).alias("page")).filter(F.size("page") > 0)
    named = streams.select(
        "host", "page", F.xxhash64(F.transform("page", lambda b: b["path"])).alias("shape"), F.xxhash64("page").alias("whole")
    )
    each = named.dropDuplicates(["host", "shape", "whole"]).select("host", "shape", F.posexplode("page").alias("at", "b"))
    sums = each.groupBy("host", "shape", "at").agg(
        F.min("b.path").alias("path"), F.max(F.col("b.n") > 1).alias("repeats"), F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("b.mark").cast("bigint")).alias("marks"), F.min("b.text").alias("low"), F.max("b.text").alias("high"),
        F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"),
    )
    node = F.struct("at", F.struct("path", "repeats", "pages", "marks", "low", "high", "chars", "links").alias("node"))
    parts = sums.groupBy("host", F.lower(F.hex("shape")).alias("key")).agg(
        F.max("pages").alias("total"), F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("nodes")
    )
    parts = parts.withColumn("key", F.lpad("key", 16, "0"))

    @F.pandas_udf(f"struct<total:bigint,nodes:{NODES}>")
    def merge(groups: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in groups:
            yield pd.DataFrame([merged(list(ps)) for ps in batch], columns=["total", "nodes"])

    for digits in MERGE_DIGITS:
        held = parts.groupBy("host", F.right(F.col("key"), F.lit(digits)).alias("key")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("key").alias("order"), "total", "nodes"))).alias("ps")
        )
        parts = held.select("host", "key", merge("ps").alias("w")).select("host", "key", "w.*")
    return parts.select("host", "total", "nodes")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""

    @F.pandas_udf("array<boolean>")
    def judged(total: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([inside({"total": t, "nodes": list(ns)}) for t, ns in zip(total, nodes)], dtype=object)

    only = F.transform("nodes", lambda x: F.when(x["low"] == x["high"], x["low"]))
    made = wrappers(pages, url, html).select(
        "host", F.transform("nodes", lambda x: x["path"]).alias("paths"), only.alias("texts"), judged("total", "nodes").alias("verdicts")
    )
    made = checkpointed(made)
    chars = F.length(F.array_join("paths", " ")) + 20 * F.size("paths") + F.length("host")
    size = made.agg(F.sum(chars).alias("n")).first()["n"] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if size <= BROADCAST_CHARS:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["paths"], r["texts"], r["verdicts"]) for r in made.collect()})
        known: dict[str, Wrapper] = {}

        @F.pandas_udf("string")
        def text(hosts: pd.Series, html: pd.Series) -> pd.Series:
            for h in set(hosts) - set(known):
                known[h] = Wrapper(*sent.value.get(h, ([], [], [])))
            return pd.Series([known[h].article(x) for h, x in zip(hosts, html)], dtype=object)

        joined, taken = rows, text("host", "html")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        copies = made.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, ["host", "salt"], "left")

        @F.pandas_udf("string")
        def text(html: pd.Series, paths: pd.Series, texts: pd.Series, verdicts: pd.Series) -> pd.Series:
            # a null among hashes makes floats of them, so they come as text
            whole = lambda ts: [None if t is None else int(t) for t in ts]
            each = zip(html, paths, texts, verdicts)
            return pd.Series(["" if p is None else Wrapper(list(p), whole(t), list(v)).article(x) for x, p, t, v in each], dtype=object)

        taken = text("html", "paths", F.transform("texts", lambda t: t.cast("string")), "verdicts")
    return joined.select("page_id", "url", taken.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
