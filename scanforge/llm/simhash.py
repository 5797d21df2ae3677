"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each of 64 that more than half of its shingles' hashes set. Equal
fingerprints are one row from here on. Distinct fingerprints are cut into tiles by the population counts
of their four 16-bit parts. Two fingerprints within the radius differ by no more than the radius in the
sum of those four counts' differences, so all other tile pairs are skipped; the rest are compared whole,
with numpy exclusive-or and bit counts. Of each tile pair only a spanning forest of its links leaves the
task: components need no more, and a group of n near copies then makes n rows, not n squared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each, words
from .components import components

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
PARTS = 4
#: Fingerprints of a tile on average; fuller cells are split.
TILE = 8192
#: Cells there can be: each part counts 0 to 16 bits.
CELLS = (64 // PARTS + 1) ** PARTS
#: Hashes whose bits are unpacked at a time, to bound memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int):
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, n) for t in each(texts)], np.uint64).view(np.int64), pa.int64())

    return run


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds `fp`, the fingerprint as a signed long."""
    return docs.withColumn("fp", _fingerprints(shingle_words)(F.col("text").cast("string")))


def _cell(fp: Column) -> Column:
    """The number of the cell: population counts of the parts, as digits."""
    width, base = 64 // PARTS, 64 // PARTS + 1
    cell = F.lit(0)
    for i in range(PARTS):
        cell = cell * base + F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return cell.cast("int")


def _offsets(radius: int) -> list[list[int]]:
    """Steps from a cell to itself and to each later cell that may hold fingerprints within the radius."""
    span = range(-radius, radius + 1)
    return sorted([*d] for d in itertools.product(span, repeat=PARTS) if sum(map(abs, d)) <= radius and [*d] >= [0] * PARTS)


def _neighbours(cell: Column, radius: int) -> Column:
    """Cells to compare a cell with, itself included, each pair of cells from one side only."""
    base = 64 // PARTS + 1
    digits = [F.pmod(F.floor(cell / F.lit(base ** (PARTS - 1 - i))), F.lit(base)) for i in range(PARTS)]
    steps = F.from_json(F.lit(str(_offsets(radius))), "array<array<int>>")
    inside = lambda d: F.forall(F.zip_with(F.array(*digits), d, lambda x, y: (x + y).between(0, base - 1)), lambda x: x)
    number = lambda d: sum(((digits[i] + F.get(d, F.lit(i))) * base ** (PARTS - 1 - i) for i in range(PARTS)), F.lit(0)).cast("int")
    return F.transform(F.filter(steps, inside), number)


def _pack(table: pa.Table) -> pa.Table:
    return pa.table({"cell": table["cell"][:1], "tile": table["tile"][:1], "fps": pa.array([np.sort(table["fp"].to_numpy()).tobytes()], pa.binary())})


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in a, in b) of links that span what all pairs within the radius connect."""
    label, left, right = np.arange(a.size + b.size), [], []
    rows = max(1, (1 << 20) // max(1, b.size))
    for at in range(0, a.size, rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            j = np.flatnonzero(near[i])
            i = int(i) + at
            found, first = np.unique(label[j + a.size], return_index=True)
            new = found != label[i]
            if new.any():  # one link to each group that this row joins
                left.extend([i] * int(new.sum()))
                right.extend(j[first[new]].tolist())
                joined = np.append(found, label[i])
                label[np.isin(label, joined)] = joined.min()
    return np.array(left, np.int64), np.array(right, np.int64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [], []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (left, right))
                i, j = forest(a, b, radius)
                found[0].append(a[i])
                found[1].append(b[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64)) for x in found], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (a, b) that connect what fingerprints within the radius connect. fps: distinct fp (long)."""
    cells = fps.withColumn("cell", _cell(F.col("fp")))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))  # CELLS rows at most, so it may be broadcast
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    dealt = cells.join(F.broadcast(counts.select("cell", split.alias("tiles"))), "cell").select("cell", "fp", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
    tiles = cut(dealt.groupBy("cell", "tile").applyInArrow(_pack, "cell int, tile int, fps binary"))
    left = tiles.select(F.col("cell").alias("c1"), F.col("tile").alias("t1"), F.col("fps").alias("left"), F.explode(_neighbours(F.col("cell"), radius)).alias("c2"))
    right = tiles.select(F.col("cell").alias("c2"), F.col("tile").alias("t2"), F.col("fps").alias("right"))
    pairs = left.join(right, "c2").where((F.col("c1") != F.col("c2")) | (F.col("t1") <= F.col("t2")))
    return pairs.select("left", "right").mapInArrow(_compare(radius), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id that links of near fingerprints reach.

    docs: doc_id (integer), text. A null or empty text, or one without words, has fingerprint 0 and is linked
    like any other. Fewer words than a shingle make one shingle. Repeated shingles count each time. Rows that
    share a doc_id keep a row each. A null doc_id is larger than all others, and its component_id is null only
    if nothing else is reachable. An empty table gives an empty table.
    """
    slim = cut(with_fingerprint(docs.select("doc_id", "text"), shingle_words).select("doc_id", "fp"))
    classes = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), radius), "a", "b")
    classes = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return slim.join(ids, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
