"""Main text of web pages: block structure first, host suffix arrays for pages without it.

A page is cut into blocks by its markup. Elements that by name, role or class are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments go. Where the page says which part is
its article (``article``, else ``main``), that part is the text, and nothing else is removed: articles do
repeat across pages, so repetition there is no sign of boilerplate.

Pages without such a part go through host suffix arrays: the token streams of pages of a host are put in one
string, its suffix array and the lengths that neighbours share are built by prefix doubling, and maximal repeats of
``RUN`` tokens or more in distinct pages are boilerplate; the blocks they cover go and the unique runs stay. For a host too large for one task the same
runs are found over the whole host by a shuffle on hashes of windows of ``RUN`` tokens.

Defined results: null and empty html give the empty text; unclosed elements end with their parent or the page;
white space inside a block becomes one space; repeated pages do not count as distinct pages; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from topicloom.llm.common import bound_batches, cut

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text at all; read up to the end tag, whatever is inside.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp".split())
DROP = frozenset("nav header footer aside form button select dialog menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer comment comments disqus replies reply respond share sharing social related "
    "recommended newsletter subscribe subscription signup login widget widgets toolbar pagination pager skip"
)
CLASSES = frozenset(_WORDS.split())
#: Only containers are judged by their class: a word in a paragraph's class says less.
CONTAINER = frozenset("div section ul ol dl table span p aside".split())
#: A quotation mark counts after an equals sign only, and what the page's end leaves open ends there, as in public
#: parsers of HTML; so every match moves on and nothing is read twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[^a-zA-Z0-9]+")
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Tokens that a run has at least that two distinct pages repeat.
RUN = 8
#: Characters of a host's blocks up to which one task takes the host; larger ones are shuffled by windows.
GROUP_CHARS = 2_000_000
#: Windows in one batch of rows.
STEP = 10_000


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in DROP:
        return True
    if not attrs or attrs.isspace():
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" and tag in CONTAINER or name == "aria-hidden" and value.lower() == "true" and tag in CONTAINER:
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag in CONTAINER and not CLASSES.isdisjoint(_PART.split(value.lower())):
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Text blocks of the main part in page order, and whether the page marks that part itself."""
    page = page or ""
    low = None
    everything: list[str] = []
    parts: dict[str, list[str]] = {"article": [], "main": []}
    stack: list[tuple[str, bool]] = []  # element and whether it is dropped
    opened: Counter[str] = Counter()
    dropped, inside = 0, {"article": 0, "main": 0}
    seen = {"article": False, "main": False}
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block and not dropped:
                everything.append(block)
                for k, v in inside.items():
                    if v:
                        parts[k].append(block)

    def pop() -> None:
        nonlocal dropped
        tag, out = stack.pop()
        opened[tag] -= 1
        dropped -= out
        if tag in inside and not out:
            inside[tag] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not dropped:
                text.append(page[at:])
            break
        if m.start() > at and not dropped:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if not m.group(1) and not m.group(3):
                continue
        elif tag == "br":
            text.append(" ")
            continue
        else:
            flush()
        if m.group(1):
            if opened[tag] > 0:
                flush()
                while stack and stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m.group(3).endswith("/") and tag in ("path", "rect"):
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            if end < 0:
                break
            close = page.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if tag in _P_ENDS and opened["p"] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag == "li" and stack and stack[-1][0] == "li":
            pop()
        out = _unwanted(tag, m.group(3))
        if tag == "header" and inside["article"]:
            out = False  # the article's own heading
        if out:
            flush()
        stack.append((tag, out))
        opened[tag] += 1
        dropped += out
        if tag in inside and not out and not dropped:
            inside[tag] += 1
            seen[tag] = True
        elif tag in inside and not out:
            stack[-1] = (tag, True)
            dropped += 1
    flush()
    for k in ("article", "main"):
        if seen[k]:
            return parts[k], True
    return everything, False


# ---- suffix arrays of a host ------------------------------------------------------------------------


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a token string in order, and for each the length that it shares with the one before it.

    Prefix doubling until all ranks differ; the ranks of every doubling are kept, so a shared length is found by
    going down the powers of two, for all neighbours at once.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, k = [rank.astype(np.int64)], 1
    order = np.argsort(rank, kind="stable")
    while k < n and levels[-1].max() < n - 1:
        last = levels[-1]
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - k] = last[k:]
        order = np.lexsort((nxt, last))
        new = np.concatenate([[False], (last[order[1:]] != last[order[:-1]]) | (nxt[order[1:]] != nxt[order[:-1]])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        k *= 2
    shared = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for i in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[i][a[ok]] == levels[i][b[ok]]
        # a rank of a doubling past the end of the string stands for a shorter prefix, which no other suffix has
        step = ok.astype(np.int64) << i
        shared[1:] += step
        a, b = a + step, b + step
    return order, shared


def _before(shared: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix (in order) the longest prefix that it shares with an earlier one of another page."""
    n = len(page)
    part = np.cumsum(np.concatenate([[0], page[1:] != page[:-1]]))  # stretches of suffixes of one page
    far = np.int64(n + 1)
    return np.minimum.accumulate(shared - part * far) + part * far  # the least shared length since the stretch began


def covered(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Tokens that lie in a run (of run tokens or more) that occurs in two distinct pages.

    The pages' token streams are one string with a separator of its own after each page, so no run crosses pages.
    Every suffix gets its longest match with a suffix of another page: the maximal repeats, whatever their length.
    """
    if not len(tokens):
        return np.zeros(0, dtype=bool)
    ends = np.flatnonzero(page[1:] != page[:-1]) + 1
    string = np.insert(tokens.astype(np.int64), ends, tokens.max() + 1 + np.arange(len(ends)))
    whose = np.insert(page.astype(np.int64), ends, page.min() - 1 - np.arange(len(ends)))
    n = len(string)
    order, shared = suffix_array(string)
    up = _before(shared, whose[order])
    down = _before(np.concatenate([[0], shared[:0:-1]]), whose[order][::-1])[::-1]
    match = np.empty(n, dtype=np.int64)
    match[order] = np.maximum(up, down)
    edge, at = np.zeros(n + 1, dtype=np.int64), np.flatnonzero(match >= run)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + match[at], -1)
    return np.delete(np.cumsum(edge[:-1]) > 0, ends + np.arange(len(ends)))


def without_boilerplate(pages_blocks: list[list[str]], run: int = RUN) -> list[list[str]]:
    """The blocks (or their unique runs) that are left of each page of a host. Equal pages count once.

    A run may span blocks; of a block that it covers in part it takes only ``run`` words or more.
    """
    stream, page = [], []
    number: dict[str, int] = {}
    unlike = {"\n".join(bs): bs for bs in pages_blocks}
    for p, bs in enumerate(unlike.values()):
        for text in bs:
            for w in text.split(" "):
                stream.append(number.setdefault(w, len(number)))
                page.append(p)
    hit = covered(np.array(stream, dtype=np.int64), np.array(page, dtype=np.int64), run)
    at, left = 0, {}
    for key, bs in unlike.items():
        n = sum(text.count(" ") + 1 for text in bs)
        left[key] = what_is_left(bs, hit[at : at + n], run)
        at += n
    return [left["\n".join(bs)] for bs in pages_blocks]


def what_is_left(blocks_: list[str], hit: np.ndarray, run: int = RUN) -> list[str]:
    """The blocks of one page without the tokens hit; of a block hit in part only runs of run tokens go."""
    at, left = 0, []
    for text in blocks_:
        words = text.split(" ")
        own = hit[at : at + len(words)].copy()
        if not own.all():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a < run:
                    own[a:b] = False
        if not own.all():
            left.append(" ".join(w for w, gone in zip(words, own.tolist(), strict=True) if not gone))
        at += len(words)
    return left


# ---- a host too large for one task -------------------------------------------------------------------


def windows(rows: DataFrame, run: int = RUN) -> DataFrame:
    """own (the page's content), pos and h (128 bits of host and words) of each window of run tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, own, bs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [w for text in bs for w in text.split(" ")]
                for lo in range(0, len(words) - run + 1, STEP):
                    at = range(lo, min(lo + STEP, len(words) - run + 1))
                    h = [xxh3_128_digest(f"{host}\0{' '.join(words[i : i + run])}") for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(h, pa.binary())], names=["own", "pos", "h"])

    return rows.select("host", "own", "blocks").mapInArrow(each, "own binary, pos int, h binary")


def clean_large(rest: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text of pages of large hosts: what ``without_boilerplate`` gives for the host, by shuffles.

    A window is repeated if its pages are not all one; least and largest page are partial aggregates, so a window
    that all pages share makes no large task. Equal pages of a host have one key and count once.
    """
    rows = rest.withColumn("own", F.unhex(F.md5(F.concat(F.col("host"), F.lit("\n"), F.array_join("blocks", "\n")))))
    w = windows(rows, run)
    # two pages of a window are told apart by 64 bits, which hash aggregates hold without a sort
    page = F.xxhash64("own")
    repeated = w.groupBy("h").agg(F.min(page).alias("a"), F.max(page).alias("b")).where("a <> b").select("h")
    hits = w.join(repeated, "h").groupBy("own").agg(F.collect_set("pos").alias("hits"))
    kind = rest.schema["page_id"].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for bs, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                edge = np.zeros(sum(t.count(" ") + 1 for t in bs) + 1, dtype=np.int64)
                at = np.array(at or [], dtype=np.int64)
                edge[at] += 1
                np.add.at(edge, at + run, -1)
                texts.append("\n\n".join(what_is_left(bs, np.cumsum(edge[:-1]) > 0, run)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(hits, "own", "left").select("page_id", "url", "blocks", "hits").mapInArrow(clean, f"page_id {kind}, url string, text string")


# ---- the operator -----------------------------------------------------------------------------------


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = pages.sparkSession
    bound_batches(spark, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blocks(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got])], names=["page_id", "url", "blocks", "marked"])

    kind = pages.schema["page_id"].dataType.simpleString()
    cutup = cut(pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, blocks array<string>, marked boolean"))
    done = cutup.where("marked").select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    rest = cutup.where("not marked").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)))
    rest = rest.withColumn("size", F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.length(b)))
    over = cut(rest.groupBy("host").agg(F.sum("size").alias("size")).where(F.col("size") > GROUP_CHARS).select("host"))
    n = over.count()
    over = F.broadcast(over) if n <= 100_000 else over
    small = rest.join(over, "host", "left_anti") if n else rest

    def clean(t: pd.DataFrame) -> pd.DataFrame:
        left = without_boilerplate([list(b) for b in t["blocks"]])
        return pd.DataFrame({"page_id": t["page_id"], "url": t["url"], "text": ["\n\n".join(x) for x in left]})

    cleaned = small.select("host", "page_id", "url", "blocks").groupBy("host").applyInPandas(clean, f"page_id {kind}, url string, text string")
    both = done.union(cleaned)
    if n:
        both = both.union(clean_large(rest.join(over, "host", "left_semi")))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
