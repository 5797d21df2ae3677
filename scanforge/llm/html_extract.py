"""Main text of web pages: site templates are found by counting element subtrees for each host.

First pass: each page gives the hashes of its block elements; Spark counts on how many different pages
of a host each hash occurs. Pages with the same text count once, so a copied page does not make its own
article a template. A subtree on a share of the host's different pages, and on a few at least, is its template.

Second pass: each page is read again and its template subtrees are deleted, wherever they stand. The article is
then looked for in what is left. Names, classes and roles that say that an element is no article remove what no
count can show: the parts of a page that differ on each page, and all of them on hosts of one or two pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, each
from .html_parse import INLINE, PROSE, Page, attributes, parse

#: Different pages of a host that must hold a subtree before it counts as the site's template: a few, and a share of all.
#: What fewer pages share, such as a list or a quotation, may be what their articles have in common.
MIN_PAGES, MIN_SHARE = 3, 0.5
#: Stands for the page itself among the hashes of a page's subtrees.
PAGE_HASH = 0
#: Recurring (host, hash) rows that may be broadcast (16 bytes each and the hosts' names); beyond, they are joined.
BROADCAST_ROWS = 500_000

# What marks an element as no part of an article.
DROPPED_TAGS = frozenset("head script style noscript template nav footer aside form button select input textarea iframe object embed canvas svg audio video dialog menu map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay share sharing social related recommended "
    "recommendations comment comments disqus respond widget widgets toolbar pagination pager login search copyright disclaimer skip".split()
)
CONTENT_WORDS = frozenset("content article post entry story main body text".split())


def _marks(attr: str) -> tuple[set[str], dict[str, str]]:
    if not attr or attr.isspace():
        return set(), {}
    a = attributes(attr)
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())), a


def _says_dropped(a: dict[str, str]) -> bool:
    """Whether a class or the id is made of nothing but words for what is no article. Inside an article a word among others says
    little: a section of class related-work belongs to it, a box of class share-widget does not."""
    names = [re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", n).lower()) for n in (*a.get("class", "").split(), a.get("id", ""))]
    return any(n and DROPPED_WORDS.issuperset(n) for n in names)


def _inside(page: Page, flags: list[bool]) -> list[bool]:
    """Which elements have a flagged element above or are flagged. Parents come before children."""
    out = list(flags)
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.parents[i]]
    return out


def _choose(page: Page, dropped: list[bool], sizes: list[int]) -> int:
    """The element that holds the article: of <article>, <main> and the like, the one with the most text; else the page."""
    gone = _inside(page, dropped)
    ranks: dict[int, list[int]] = {}
    for i in range(1, len(page.tags)):
        if gone[i] or not sizes[i]:
            continue
        tag = page.tags[i]
        if tag == "article":
            ranks.setdefault(0, []).append(i)
        elif tag == "main":
            ranks.setdefault(1, []).append(i)
        elif page.attrs[i] and tag not in INLINE and tag not in PROSE and tag not in ("body", "html"):
            marks, a = _marks(page.attrs[i])
            if a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
                ranks.setdefault(1, []).append(i)
            elif marks & CONTENT_WORDS:
                ranks.setdefault(2, []).append(i)
    for rank in sorted(ranks):
        best = max(ranks[rank], key=lambda i: (sizes[i], -i))
        if rank < 2 or 2 * sizes[best] >= sizes[0]:
            return best
    return 0


def _own_rules(page: Page) -> list[bool]:
    """Elements that are no article by their tag, class, id, role or visibility."""
    n = len(page.tags)
    holds = [False] * n  # an element around the article is not judged by its class
    for i in range(n - 1, 0, -1):
        if holds[i] or page.tags[i] in ("article", "main"):
            holds[page.parents[i]] = True
    out, in_article = [False] * n, _inside(page, [t in ("article", "main") for t in page.tags])
    for i in range(1, n):
        tag = page.tags[i]
        if tag in DROPPED_TAGS:
            out[i] = not (holds[i] and tag == "form")
        elif tag == "header":
            out[i] = not in_article[i] and not holds[i]
        elif page.attrs[i] and not holds[i] and tag not in ("html", "body", "main"):
            marks, a = _marks(page.attrs[i])
            style = a.get("style", "").replace(" ", "").lower()
            out[i] = (
                (_says_dropped(a) if in_article[i] else bool(marks & DROPPED_WORDS)) or ("header" in marks and not in_article[i]) or a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a
                or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
            )
    return out


def _sizes(page: Page, dropped: list[bool]) -> list[int]:
    """Characters of text in each element, without what is dropped."""
    gone, sizes = _inside(page, dropped), [0] * len(page.tags)
    for i, s in page.events:
        if s is not None and not gone[i]:
            sizes[i] += len(s.strip())
    for i in range(len(sizes) - 1, 0, -1):
        if not gone[i]:
            sizes[page.parents[i]] += sizes[i]
    return sizes


def template(page: Page, recurring: frozenset[int] | set[int]) -> list[bool]:
    """Elements whose subtree recurs on the host. Prose of a named article stays: what the article says is not the template's."""
    out = [False] * len(page.tags)
    if not recurring:
        return out
    named = [t in ("article", "main") for t in page.tags]
    within, frame = _inside(page, named), list(named)
    for i in range(len(frame) - 1, 0, -1):  # an article and what it stands in are not deleted with it
        if frame[i]:
            frame[page.parents[i]] = True
    for i in range(1, len(page.tags)):
        tag = page.tags[i]
        out[i] = page.hashes[i] in recurring and tag not in INLINE and not frame[i] and not (within[i] and tag in PROSE)
    return out


def main_text(page: Page, recurring: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, each with single spaces, joined by a space. recurring: subtree hashes of the host's template."""
    dropped = template(page, recurring)
    dropped = [a or b for a, b in zip(dropped, _own_rules(page), strict=True)]
    root = _choose(page, dropped, _sizes(page, dropped))
    within = _inside(page, [i == root for i in range(len(page.tags))])
    gone, out = _inside(page, dropped), []
    for i, s in page.events:
        if s is not None:
            if within[i] and not gone[i]:
                out.append(s)
        else:
            e = i if i >= 0 else -i - 1
            if page.tags[e] not in INLINE:
                out.append(" ")
    return " ".join("".join(out).split())


def block_hashes(page: Page) -> list[int]:
    """Distinct hashes of the page's block elements, but for the page's frame."""
    return list({h for t, h in zip(page.tags[1:], page.hashes[1:], strict=True) if t not in INLINE and t not in ("html", "body", "head", "br", "meta", "link", "title", "style", "script")})


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hosts, hashes, texts = [], [], [], []
        for i, where, source in zip(*map(each, batch.columns), strict=True):
            page = parse(source)
            own = [PAGE_HASH, *block_hashes(page)]
            sign = xxhash.xxh64_intdigest(main_text(page).encode("utf-8", "replace"))
            ids.extend([i] * len(own))
            hosts.extend([where] * len(own))
            texts.extend([sign] * len(own))
            hashes.extend(own)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), signed(hashes), signed(texts)], names=["id", "host", "h", "sign"])


def _shared_texts(shared):
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = {k: frozenset(v.tolist()) for k, v in shared.value.items()}
        for hosts, sources in batches:
            yield pa.array([main_text(parse(s), known.get(k, frozenset())) for k, s in zip(each(hosts), each(sources), strict=True)], pa.string())

    return run


@F.arrow_udf(T.StringType())
def _joined_texts(found: pa.Array, sources: pa.Array) -> pa.Array:
    pages = zip(each(found), each(sources), strict=True)
    return pa.array([main_text(parse(s), {h & 0xFFFFFFFFFFFFFFFF for h in k or ()}) for k, s in pages], pa.string())


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds `text`, the main text of each page (empty if there is none). A column of that name is replaced.

    pages: page_id (integer), url, html, and any other columns, which pass through. A null or empty html has
    no text. A null url, or one without a host, is of the host ''. A repeated page (the same main text) counts
    once towards the template. Null and repeated page_ids are pages like any other. An empty table gives an empty table.
    """
    fresh = lambda name: name + "_" * sum(c.startswith(name) for c in pages.columns)
    where, own_id, own_host, held = map(fresh, ("__host", "__id", "__of", "__found"))
    keyed = pages.withColumn(where, host(F.col("url").cast("string")))
    rows = keyed.select(F.col("page_id").cast("long"), where, F.col("html").cast("string")).mapInArrow(_hash_rows, "id long, host string, h long, sign long")
    different = rows.groupBy("host", "h", "sign").agg(F.lit(1).alias("one"))
    often = cut(different.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    of = often.where(F.col("h") == PAGE_HASH).select("host", F.col("n").alias("pages"))
    recurring = cut(often.where(F.col("h") != PAGE_HASH).join(of, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "h"))
    if recurring.count() <= broadcast_rows:
        table: dict[str, list[int]] = {}
        for r in recurring.collect():
            table.setdefault(r.host, []).append(r.h)
        shared = pages.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).view(np.uint64) for k, v in table.items()})
        out = keyed.withColumn("text", _shared_texts(shared)(F.col(where), F.col("html").cast("string")))
    else:
        of_page = rows.select("id", "host", "h").distinct().join(recurring, ["host", "h"]).groupBy(F.col("id").alias(own_id), F.col("host").alias(own_host)).agg(F.collect_set("h").alias(held))
        same = keyed["page_id"].cast("long").eqNullSafe(of_page[own_id]) & (keyed[where] == of_page[own_host])
        out = keyed.join(of_page, same, "left").withColumn("text", _joined_texts(F.col(held), F.col("html").cast("string"))).drop(own_id, own_host, held)
    return out.drop(where)
