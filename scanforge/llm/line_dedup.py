"""Lines that many documents share stay in one of them.

Spark sums the documents of each distinct line hash. All distinct hashes, in shards, go into minimal perfect
hashes, whose number of a line indexes compact arrays: a fingerprint, the document count (to a limit) and,
for lines that recur, the holder. Documents then probe those arrays: the hashes of their lines are sent to
the shard that can answer for them, only the hashes of lost lines come back, and no line is joined. This is
the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, SPACE, cut, each
from .perfect_hash import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines of all documents for each shard; a shard has no more distinct ones than that, on average.
SHARD_KEYS = 1 << 17
#: Lines that one task looks up in one shard at a time, on average.
ROUTED_LINES = 1 << 17
#: Bytes of an entry's fingerprint; documents that are counted at most.
FINGERPRINT, MOST = np.uint32, 255
_NULL_ID = -(1 << 63)


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased, as UTF-8."""
    return [x.strip(SPACE).encode("utf-8", "replace").lower() for x in (text or "").split("\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8")) >= min_chars)


def _hashes(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Two independent 64-bit hashes: the key of the perfect hash, and the fingerprint."""
    return [xxhash.xxh64_intdigest(k, 42) for k in keys], [xxhash.xxh64_intdigest(k, 7) for k in keys]


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _emit(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept = [], []
            for i, text in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                own = {k for k in line_keys(text) if _long_enough(k, min_chars)}
                kept.extend(own)
                ids.extend([i] * len(own))
            h, f = _hashes(kept)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(_signed(f)), pa.array(ids, pa.int64())], names=["h", "f", "id"])

    return run


def _build(min_docs: int):
    """One shard: the perfect hash and the arrays it indexes, as one row."""

    def run(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(np.uint64)
        index = PerfectHash.build(h)
        order = np.argsort(index.find(h))
        n = np.minimum(table["n"].to_numpy()[order], MOST)
        fingerprint = table["f"].to_numpy()[order].view(np.uint64).astype(FINGERPRINT)
        arrays = [index.sizes, index.words, fingerprint, n.astype(np.uint8), table["holder"].to_numpy()[order][n >= min_docs]]
        return pa.table({"shard": table["shard"][:1], "arrays": pa.array([[np.ascontiguousarray(a).tobytes() for a in arrays]], pa.list_(pa.binary()))})

    return run


class Shard:
    """The arrays of a shard, ready to be probed."""

    def __init__(self, arrays: list[bytes], min_docs: int):
        self.index = PerfectHash(np.frombuffer(arrays[0], np.int64), np.frombuffer(arrays[1], np.uint64))
        self.fingerprint, self.count, self.holders = (np.frombuffer(a, t) for a, t in zip(arrays[2:], (FINGERPRINT, np.uint8, np.int64), strict=True))
        self.recurs = self.count >= min_docs
        self.place = np.cumsum(self.recurs) - 1  # of an entry's holder

    def lost(self, h: np.ndarray, f: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which lines (hash, fingerprint, document) their document loses."""
        at = self.index.find(h.view(np.uint64))
        out = at >= 0
        rows = np.flatnonzero(out)
        at = at[rows]
        out[rows] = self.recurs[at] & (self.fingerprint[at] == f[rows].view(np.uint64).astype(FINGERPRINT))
        rows = np.flatnonzero(out)
        out[rows] = self.holders[self.place[self.index.find(h[rows].view(np.uint64))]] != ids[rows]
        return out


def _answer(min_docs: int):
    """Of the lines sent to a shard, those that their document loses."""

    def run(lines: pa.Table, shard: pa.Table) -> pa.Table:
        if not shard.num_rows or not lines.num_rows:
            return lines.select(["h", "id"]).slice(0, 0)
        lost = Shard(shard["arrays"][0].as_py(), min_docs).lost(*(lines[c].to_numpy() for c in ("h", "f", "id")))
        return lines.select(["h", "id"]).filter(pa.array(lost))

    return run


_RESULT = "text string, n_lines long, n_dropped long"


def _dropping(min_chars: int):
    @F.arrow_udf(_RESULT)
    def drop(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            out = [], [], []
            for text, g in zip(each(texts), each(gone), strict=True):
                lines, flags = (text or "").split("\n"), []
                if g:
                    g, keys = set(g), line_keys(text)
                    flags = [_long_enough(k, min_chars) and x in g for k, x in zip(keys, _signed(_hashes(keys)[0]).tolist(), strict=True)]
                out[0].append("\n".join(x for x, d in zip(lines, flags, strict=True) if not d) if g else text or "")
                out[1].append(len(lines))
                out[2].append(sum(flags))
            yield pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["text", "n_lines", "n_dropped"])

    return drop


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, routed_lines: int = ROUTED_LINES) -> DataFrame:
    """Documents without the lines that at least min_docs documents share, except in one holder.

    docs: doc_id (integer), text and any other columns, which pass through. Adds n_lines (before) and
    n_dropped, replacing columns of those names; text is the rest, joined by newlines.

    A null or empty text is one empty line. Keys under min_chars code points are never dropped. The holder
    is the largest doc_id that has the line. It keeps all its lines of that key. A document is a doc_id: rows
    that share one count once and keep or lose a line together, and rows without one are one document of the
    smallest id. An empty table gives an empty table. min_docs: 255 at most.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    lines = cut(docs.select(id_.alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_emit(min_chars), "h long, f long, id long"))
    shards = max(1, -(-lines.count() // shard_keys))
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    counted = lines.groupBy("h", "f").agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder"))
    # two keys with one 64-bit hash: the perfect hash keeps one of them, and the other's lines stay
    distinct = counted.groupBy("h").agg(F.min_by(F.struct("f", "n", "holder"), "f").alias("e")).select(shard, "h", "e.*")
    built = distinct.groupBy("shard").applyInArrow(_build(min_docs), "shard int, arrays array<binary>")
    sent = lines.select(shard, "h", "f", "id")
    parts = sent.groupBy("shard").agg(F.ceil(F.count("*") / routed_lines).cast("int").alias("parts"))
    asked = sent.join(parts, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "h", "f", "id")
    arrays = built.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "arrays")
    lost = asked.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(_answer(min_docs), "h long, id long")
    lost = cut(lost.groupBy(F.col("id").alias("__lost_id")).agg(F.collect_set("h").alias("__lost")))  # the lines of one document
    few = lost.agg(F.sum(F.size("__lost") + 4)).first()[0] or 0
    found = docs.join(F.broadcast(lost) if few <= SMALL_IDS else lost, id_ == F.col("__lost_id"), "left")
    out = found.withColumn("__r", _dropping(min_chars)(F.col("text").cast("string"), F.col("__lost"))).drop("__lost", "__lost_id")
    return out.withColumns({"text": F.col("__r.text"), "n_lines": F.col("__r.n_lines"), "n_dropped": F.col("__r.n_dropped")}).drop("__r")


#: The contract of op2 in DuckDB. {docs}: a table with doc_id, text.
LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM {docs}),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.holder AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
