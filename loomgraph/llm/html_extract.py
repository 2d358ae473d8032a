"""Main text of web pages: mark-up first, then the host's suffix array where mark-up says nothing.

A page is taken apart into blocks. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are known by element, role, class
or id and dropped. Where an ``article``, a ``main`` or an element marked as the
article's body holds text, that is the main text, whole: passages that
articles share stay. On other pages all remaining blocks are in question, and
repetition decides: the blocks of all such pages of a host are one token
stream, its suffixes are sorted, and substrings of ``least`` tokens or more
that stand in distinct pages cover boilerplate. Of a block that is mostly
covered only the unique runs stay, however short; a block that is not stays
whole. A block of links alone that is shorter than ``least`` goes if another
page of the host has it too.

The suffix array of a host is built in slices of bounded size. Each gives one
row for each class of suffixes that agree in their first ``least`` tokens, with
the least and largest page; classes of all slices are merged by the hash of
those tokens, which finds just the substrings that one array would. Equal pages
of a host count as one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vector
from ._common import store

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKED = re.compile(r"\b(?:class|id|role|hidden|itemprop)\b", re.I)

# Element names of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed textarea title xmp plaintext".split())
DROPPED = frozenset("head nav footer aside form menu dialog button select option datalist svg math object audio video canvas map".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that such a start tag ends, and the elements at which the search for it stops.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

# Words of class names, ids and roles.
BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond reply replies share sharing social related recommended recommendations pagination pager login "
    "search widget toolbar masthead topbar copyright".split()
)
HEADER = frozenset("header heading".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar".split())
BODY_CLASSES = frozenset("article article-body article-content article-text articlebody post-body post-content postbody entry-content entry-body story-body story-content".split())
CONTENT_CLASSES = frozenset("content main main-content maincontent page-content content-body body-content post entry story text".split())

#: Stands before the text of a block that is links alone; other texts never begin with white space.
LINKS = " "


@dataclass(frozen=True)
class Settings:
    #: Tokens of a repeated substring.
    least: int = 8
    #: Share of a block's tokens from which it counts as covered.
    covered: float = 0.5
    #: Tokens of a slice of a host.
    slice: int = 500_000


@lru_cache(maxsize=20_000)
def _traits(name: str, attributes: str) -> tuple[bool, bool, int]:
    """Of a start tag: whether it is dropped, whether it is a header, and its level (3: article, 2: main, 1: content)."""
    level = {"article": 3, "main": 2}.get(name, 0)
    dropped, header = name in DROPPED, name == "header"
    if attributes and MARKED.search(attributes):
        found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").strip().lower()
        level = max(level, 2 * (role == "main"), 3 * ("articlebody" in found.get("itemprop", "").lower()))
        dropped |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in BAD_ROLES
        for value in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
            plain = "-".join(words)
            level = max(level, 3 * (plain in BODY_CLASSES), plain in CONTENT_CLASSES)
            if name in ("html", "body", "main") or {"with", "has", "no"} & set(words[:-1]):
                continue
            ends = {words[0], words[-1]}
            if ends & BAD and (name != "article" or ends & {"comment", "comments", "reply", "related"}):
                dropped = True
            header |= words[-1] in HEADER and name != "article"
    return dropped, header, level


def blocks(html: str) -> list[tuple[int, bool, str]]:
    """(level, whether all of it is links, text) of every block that isn't dropped, in page order."""
    out: list[tuple[int, bool, str]] = []
    # name, skip, header, level and in a link: of the open elements, each as it holds for what is inside
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]
    parts: list[str] = []
    state = [True, 0]  # only links so far; level

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((state[1], state[0], text))
        parts.clear()
        state[0], state[1] = True, 0

    def say(text: str):
        _, skip, header, level, link = stack[-1]
        if text and not skip and not header:
            parts.append(unescape(text) if "&" in text else text)
            if not link and not text.isspace():
                state[0] = False
            state[1] = max(state[1], level)

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if any(x[0] not in INLINE for x in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            else:
                if name == "p":
                    flush()
            continue
        attributes = m[3] or m[6] or ""
        if name in VOID:
            if name == "br":
                parts.append("\n")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE and name not in RAW:
            flush()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in ENDS:
            closed, stop = (x.split() for x in ENDS[name])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closed:
                    del stack[i:]
                    break
                if stack[i][0] in stop:
                    break
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if attributes.rstrip().endswith("/") and name in ("svg", "math"):
            continue
        dropped, header, own = _traits(name, attributes)
        _, skip, in_header, level, link = stack[-1]
        # a header is dropped, but for the headings of an article's
        in_header = in_header or header
        if in_header and name in HEADINGS and level >= 2:
            in_header = False
        stack.append((name, skip or dropped, in_header, max(level, own), link or name == "a"))
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower() if m else ""


def _parsed(batches):
    """The text of pages whose mark-up is sure; of others the blocks, and a key by host and html."""
    for batch in batches:
        for part in _vector.pieces(batch, "html"):
            texts, keys, hosts, lists, sizes = [], [], [], [], []
            urls = part.column("url").to_pylist()
            for url, html in zip(urls, part.column("html").to_pylist(), strict=True):
                found = blocks(html or "")
                top = max((level for level, _, _ in found), default=3)
                sure = top >= 2
                texts.append(" ".join(t for level, _, t in found if level == top) if sure else None)
                host = None if sure else host_of(url)
                keys.append(None if sure else xxhash.xxh3_128_digest(f"{host}\0{html}".encode()))
                hosts.append(host)
                lists.append(None if sure else [LINKS * link + t for level, link, t in found if level == top])
                sizes.append(None if sure else sum(len(t.split()) + 1 for t in lists[-1]))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(keys, pa.binary()), pa.array(hosts, pa.string()), pa.array(lists, pa.list_(pa.string())), pa.array(sizes, pa.int64())],
                ["page_id", "url", "text", "key", "host", "blocks", "n"],
            )


def tokens_of(page_blocks) -> list[str]:
    """The token stream of a page: a mark and the words of each block."""
    return [w for b in page_blocks for w in ("\0", *b.split())]


def suffix_ranks(tokens: np.ndarray, least: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``least`` tokens: prefix doubling, then one step over the rest.

    Suffixes with fewer tokens left have rank -1.
    """
    n = len(tokens) - least + 1
    out = np.full(len(tokens), -1, np.int64)
    if n <= 0:
        return out
    rank, step = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while step < least:
        ahead = min(step, least - step)
        m = len(rank) - ahead
        rank = np.unique(rank[:m] * (int(rank.max()) + 1) + rank[ahead : ahead + m], return_inverse=True)[1]
        step += ahead
    out[:n] = rank[:n]
    return out


def _window_keys(tokens: np.ndarray, at: np.ndarray, least: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(tokens[i : i + least].tobytes()) for i in at.tolist()]


def _short_links(page_blocks, least: int) -> list[tuple[int, bytes]]:
    """Where in the token stream blocks of links alone begin that are too short for a window, and a key of each."""
    out, at = [], 0
    for b in page_blocks:
        n = len(b.split())
        if b.startswith(LINKS) and n < least:
            out.append((at, xxhash.xxh3_128_digest(b.encode())))
        at += n + 1
    return out


def _hashed_stream(page_blocks) -> np.ndarray:
    return _vector.hashed(pa.array(tokens_of(page_blocks), pa.string()))


def _classes(least: int):
    """For a slice of a host: each class of suffixes, with its least and largest page."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        streams = [_hashed_stream(b) for b in group["blocks"]]
        owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        flat = np.concatenate(streams) if streams else np.empty(0, np.uint64)
        rank = suffix_ranks(flat, least)
        ends = np.cumsum([len(s) for s in streams])
        inside = np.nonzero((rank >= 0) & (np.arange(len(flat)) + least <= ends[owner]))[0] if len(flat) else np.empty(0, np.int64)
        ordered = inside[np.argsort(rank[inside], kind="stable")]
        first = np.concatenate(([True], rank[ordered][1:] != rank[ordered][:-1])) if len(ordered) else np.empty(0, bool)
        starts = np.nonzero(first)[0]
        pages = group["key"].to_numpy()
        low, high = (f.reduceat(owner[ordered], starts) if len(starts) else np.empty(0, np.int64) for f in (np.minimum, np.maximum))
        links = [(k, page) for page, b in zip(pages, group["blocks"], strict=True) for _, k in _short_links(b, least)]
        both = list(zip(low, high, strict=True))
        return pd.DataFrame({
            "host": group["host"].iloc[0], "window": _window_keys(flat, ordered[starts], least) + [k for k, _ in links],
            "lo": [min(pages[a], pages[b]) for a, b in both] + [x for _, x in links], "hi": [max(pages[a], pages[b]) for a, b in both] + [x for _, x in links],
        })

    return run


def _windows(least: int):
    def run(batches):
        for batch in batches:
            for key, host, page in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                flat = _hashed_stream(page)
                at = np.arange(max(0, len(flat) - least + 1))
                links = _short_links(page, least)
                keys, at = _window_keys(flat, at, least) + [k for _, k in links], np.concatenate([at, np.array([-1 - i for i, _ in links], np.int64)])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array([host] * len(at)), pa.array(keys, pa.binary()), pa.array(at.astype(np.int32))], ["key", "host", "window", "at"])

    return run


def unique_text(page_blocks, at, s: Settings) -> str:
    """The text of a page's blocks without what the repeated substrings beginning ``at`` cover.

    ``-1 - i`` in ``at`` stands for a whole block that begins at ``i``.
    """
    n = sum(len(b.split()) + 1 for b in page_blocks)
    change = np.zeros(n + 1, np.int64)
    whole = {-1 - i for i in at if i < 0}
    for i in at:
        if i < 0:
            continue
        change[i] += 1
        change[min(n, i + s.least)] -= 1
    covered, out, i = np.cumsum(change)[:n] > 0, [], 0
    for b in page_blocks:
        words = b.split()
        c, gone = covered[i + 1 : i + 1 + len(words)], i in whole
        i += 1 + len(words)
        if gone or not len(words):
            continue
        if c.mean() <= s.covered:
            out.append(b.removeprefix(LINKS))
            continue
        edges = np.nonzero(np.diff(np.concatenate(([True], c, [True])).astype(np.int8)))[0]
        out += [" ".join(words[a:z]) for a, z in zip(edges[::2], edges[1::2], strict=True)]
    return " ".join(out)


def _cut(s: Settings):
    def run(batches):
        for batch in batches:
            texts = [unique_text(page, at or (), s) for page, at in zip(batch.column("blocks").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return run


def judge(unsure: DataFrame, s: Settings, owner: str = "") -> DataFrame:
    """(key, text) of pages in question, stored rows (key, host, blocks, n), each key once."""
    per_host = unsure.groupBy("host").agg(F.ceil(F.sum("n") / s.slice).cast("int").alias("slices"))
    sliced = unsure.join(per_host, "host").withColumn("slice", F.pmod(F.xxhash64("key"), F.greatest(F.col("slices"), F.lit(1))))
    classes = sliced.select("key", "host", "blocks", "slice").groupBy("host", "slice").applyInPandas(_classes(s.least), "host string, window binary, lo binary, hi binary")
    repeated = store(classes.groupBy("host", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("host", "window"), "html-repeated", owner)
    hits = unsure.select("key", "host", "blocks").mapInArrow(_windows(s.least), "key binary, host string, window binary, at int").join(repeated, ["host", "window"], "left_semi")
    spots = hits.groupBy("key").agg(F.collect_list("at").alias("at"))  # at most a page's tokens
    return unsure.select("key", "blocks").join(spots, "key", "left").mapInArrow(_cut(s), "key binary, text string")


def extract(pages: DataFrame, s: Settings = Settings(), owner: str = "") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null html is empty; without main text ``text`` is empty. Pages with a
    null url share a host. Repeated rows fare alike. Other columns are not
    looked at.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    parsed = store(slim.mapInArrow(_parsed, f"page_id {kind}, url string, text string, key binary, host string, blocks array<string>, n long"), "html-parsed", owner)
    unsure = parsed.where("key is not null").select("key", "host", "blocks", "n")
    parsed = parsed.select("page_id", "url", "text", "key")
    if not unsure.isEmpty():
        unsure = store(unsure.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("n"))).where("nth = 1").drop("nth"), "html-unsure", owner)
        told = judge(unsure, s, owner).select("key", F.col("text").alias("judged"))
        parsed = parsed.join(told, "key", "left").withColumn("text", F.coalesce("text", "judged"))
    return parsed.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
