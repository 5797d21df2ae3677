"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by size: class c holds those with 2**c to 2**(c+1)-1 shingles. For each class a
document is cut into half-overlapping windows of 2**(c+2) shingles, so that a short item is compared
with text of its own order of size however long the document is. A window and an item that share the
minimum of any of the hash functions are a candidate. Candidates are verified over the whole document,
shingle by shingle, as text.

The benchmark side is indexed once, as flat arrays, and travels to the tasks in groups of a bounded size
(GROUP_BYTES of item text); the documents are read once for each group, and nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, split_words, word_hashes

SHINGLE_WORDS, CONTAINMENT = 5, 0.8
#: Hash functions. An item that fills 0.19 of a window's union, the least that the classes allow, is missed once in 700,000.
HASHES = 64
#: Bytes of item texts that are broadcast at a time, with an index of up to some six times as much.
GROUP_BYTES = 8 << 20
#: Shingles that are hashed at a time.
BLOCK = 1 << 20

_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(1 << 32, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(w: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def _hashed(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h * _A[k] + _B[k]
        return x ^ (x >> np.uint64(31))


def build_index(texts: list[str], n: int, hashes: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each shingle length and size class: the items' minima of each hash function, sorted, and the places of their items."""
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for number, text in enumerate(texts):
        w = split_words(text)
        if w:
            size = min(n, len(w))  # an item shorter than a shingle is one shingle of its own length
            h = np.unique(shingle_hashes(word_hashes(w), size))
            groups.setdefault((size, h.size.bit_length() - 1), []).append((number, h))
    out = {}
    for key, own in groups.items():
        numbers, h = np.array([i for i, _ in own], np.int32), np.concatenate([x for _, x in own])
        starts = np.concatenate([[0], np.cumsum([x.size for _, x in own])[:-1]]).astype(np.int64)
        minima = np.stack([np.minimum.reduceat(_hashed(h, k), starts) for k in range(hashes)])
        order = np.argsort(minima, axis=1)
        out[key] = np.take_along_axis(minima, order, 1), numbers[order]
    return out


class Index:
    """A group of items (id, text) with their index, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], classes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], n: int, hashes: int):
        self.items, self.classes, self.n, self.hashes, self._own, self._cut = items, classes, n, hashes, {}, {}

    def item(self, number: int) -> tuple[int, int, set[bytes]]:
        """An item's id, shingle length and shingles."""
        if number not in self._own:
            w = split_words(self.items[number][1])
            size = min(self.n, len(w))
            self._own[number] = self.items[number][0], size, shingles(w, size)
        return self._own[number]

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (document, item number). ids: word hashes of documents end to end; starts: where each begins, and the end."""
        found = set()
        for size in {s for s, _ in self.classes}:
            h = shingle_hashes(ids, size)  # those that run into the next document are left out below
            first, count = starts[:-1], np.maximum(0, np.diff(starts) - size + 1)
            for k in range(self.hashes):
                x = None
                for (s, c), (minima, numbers) in self.classes.items():
                    if s != size:
                        continue
                    if x is None:
                        x = _hashed(h, k)
                    edges, of, last = self._blocks(size, c, first, count)
                    if not of.size:
                        continue
                    low = np.minimum.reduceat(x, edges)[::2]
                    low[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                    values = minima[k]
                    first_at = np.searchsorted(values, low)
                    for i in np.flatnonzero(values[np.minimum(first_at, values.size - 1)] == low):
                        upto = np.searchsorted(values, low[i], "right")
                        found.update((int(of[i]), int(x)) for x in numbers[k, first_at[i] : upto])
            self._cut = {}
        return found

    def _blocks(self, size: int, c: int, first: np.ndarray, count: np.ndarray):
        """Edges of blocks of 2**(c+1) shingles (start, end, start, end ...), their documents, and whether each is its document's last."""
        if (size, c) not in self._cut:
            step = 1 << (c + 1)
            blocks = -(-count // step)
            of = np.repeat(np.arange(count.size), blocks)
            nth = np.arange(of.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = first[of] + nth * step
            end = np.minimum(start + step, first[of] + count[of])
            self._cut[size, c] = np.column_stack([start, end]).ravel(), of, np.append(of[1:] != of[:-1], True) if of.size else of
        return self._cut[size, c]


def _search(shared, n: int, containment: float, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value, n, hashes)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            doc_ids, at = batch.column(0).to_pylist(), 0
            texts = batch.column(1)
            while at < batch.num_rows:
                docs, total = [], 0
                while at + len(docs) < batch.num_rows and total < BLOCK:
                    docs.append(split_words(texts[at + len(docs)].as_py()))
                    total += len(docs[-1])
                ids = word_hashes(list(itertools.chain.from_iterable(docs)))
                starts = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
                held: dict[tuple[int, int], set[bytes]] = {}
                for doc, number in sorted(index.candidates(np.append(ids, np.zeros(n, np.uint64)), starts)):
                    item_id, size, own = index.item(number)
                    if (doc, size) not in held:
                        held[doc, size] = shingles(docs[doc], size)
                    shared_n = len(own & held[doc, size])
                    if shared_n >= containment * len(own):
                        for column, value in zip(out, (doc_ids[at + doc], item_id, len(own), shared_n), strict=True):
                            column.append(value)
                at += len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def find(docs: DataFrame, items: DataFrame, n: int = SHINGLE_WORDS, containment: float = CONTAINMENT, hashes: int = HASHES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_shared): items of which a document holds the share `containment` of distinct shingles or more.

    docs: doc_id (integer), text. items: item_id (integer), text. Words are lower-cased in A-Z. An item of fewer
    than n words is one shingle of all its words; one without words is found nowhere, and a null or empty document
    holds nothing. Repeated rows on either side give repeated rows. Null ids are kept. Empty tables give none.
    """
    spark = docs.sparkSession
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for g in range(groups):
        rows = clean.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).collect()
        shared = spark.sparkContext.broadcast(([(r.item_id, r.text) for r in rows], build_index([r.text for r in rows], n, hashes)))
        part = slim.mapInArrow(_search(shared, n, containment, hashes), "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    return out


#: What `find` returns, in DuckDB.
CONTAINMENT_SQL = """
WITH i0 AS (SELECT item_id, {words} AS w FROM benchmark),
i AS (SELECT item_id, w, least(5, len(w)) AS k FROM i0 WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
d0 AS (SELECT doc_id, {words} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d0, (SELECT DISTINCT k FROM i))),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM s JOIN d USING (k, g) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= 0.8 * n_shingles
""".replace("{words}", "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")
