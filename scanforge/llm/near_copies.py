"""Near copies by SimHash comparison in tiles of documents that share a rare shingle, verified by exact Jaccard similarity.

A similarity of 0.8 leaves 64-bit fingerprints about 8 bits apart, a radius at which population counts rule out
nearly no tile pair. So tiles are made otherwise here. Shingles have one global order: those that a bounded sample
of texts holds often come last, the others go by hash. Two sets of the similarity share one of their first shingles,
as many as the similarity leaves room to differ in, and the documents with such a shingle are a tile. In a tile,
fingerprints are compared with exclusive-or and bit counts: of those a few bits apart, spanning forests are kept, so
that n near copies make n rows and not n squared, and between its trees all pairs that are likely by their bits.

What this leaves open is settled in a second round. A tile with pairs that were not taken, and whose documents are
not one group by then, is compared again, each pair of two groups: by the parities of the sets' hashes, which differ
in no more places than the sets do, so that they rule a pair out for certain. Fingerprints thus say what is looked at
first, and no pair is left out by them. Each pair is then verified, shingle by shingle.

Texts with the same set of shingles are one class from the start. Texts themselves are never shuffled but for those
of pairs; rows are told apart by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_IDS, cut, each, shingle_hashes, split_words, word_hashes, written
from .components import components

SHINGLE_WORDS = 5
#: Similarity of 0.8 as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Bits apart up to which fingerprints are likely near, 10 on average with a deviation of 3: these are taken in the first round.
FAR = 22
#: Bits within which a tile keeps forests, and how many of them.
NEAR, FORESTS = 8, 3
#: Parity bits of a set: the power of two from twice its size up, from the least to the most. They bear on the work alone.
LEAST_BITS, MOST_BITS = 64, 1 << 17
#: Texts of the sample that orders shingles, and shingles that it puts last, at most. They bear on the work, not on the result.
SAMPLE, LAST = 5_000, 100_000
#: Documents of a tile on average; fuller ones, by the sample, are split into pairs of tiles.
TILE = 2_048
#: Documents of a tile up to which all its pairs are taken.
FEW = 6


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle make one, none make none."""
    h = word_hashes(split_words(text))
    h = np.sort(shingle_hashes(h, min(SHINGLE_WORDS, h.size))) if h.size else h
    return h[np.append(True, h[1:] != h[:-1])] if h.size else h


def fingerprint(h: np.ndarray) -> np.uint64:
    """The SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > h.size, bitorder="little").view(np.uint64)[0]


def parities(h: np.ndarray) -> bytes:
    """For each value of the hashes' low bits, whether an odd number of the set's hashes has it."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * h.size - 1).bit_length()))
    odd = np.bincount((h & np.uint64(size - 1)).view(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of sets, by their parities, in how many hashes they differ at least. A longer row is folded to the shorter."""
    width, out = np.array([len(x) for x in bits], np.int64), np.zeros(i.size, np.int64)
    least = np.minimum(width[i], width[j])
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, w // 8), axis=0) for k in used])
        step = max(1, (1 << 22) // w)
        for s in range(0, at.size, step):
            e = min(at.size, s + step)
            out[at[s:e]] = np.bitwise_count(rows[place[s:e]] ^ rows[place[at.size + s : at.size + e]]).sum(axis=1)
    return out


def possible(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that may have the similarity: sets of it differ in a ninth of their sizes' sum at most. No pair that has it is left out."""
    return (NUM + DEN) * differences(bits, i, j) <= (DEN - NUM) * (n[i].astype(np.int64) + n[j])


@F.arrow_udf(T.BooleanType())
def _possible(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for na, nb, a, b in columns:
        i = np.arange(len(na))
        yield pa.array(possible(np.concatenate([na.to_numpy(), nb.to_numpy()]), a.to_pylist() + b.to_pylist(), i, i + i.size))


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([_signed(shingles(t)) for t in each(batch)], pa.list_(pa.int64()))


def _keys(often):
    """A text's class, the size of its set, its fingerprint, its first shingles and its parities."""

    @F.arrow_udf("struct<key:long,n:int,fp:long,prefix:array<long>,bits:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last, rank = often.value[:2]
        for batch in batches:
            out = [], [], [], [], []
            for t in each(batch):
                h = shingles(t)
                size = h.size - (NUM * h.size + DEN - 1) // DEN + 1 if h.size else 0
                order = np.zeros(h.size, np.int64)
                if last.size and h.size:
                    at = np.minimum(np.searchsorted(last, h), last.size - 1)
                    order = np.where(last[at] == h, rank[at], 0)
                out[0].append(xxhash.xxh64_intdigest(h.tobytes()))
                out[1].append(h.size)
                out[2].append(fingerprint(h))
                out[3].append(_signed(h[np.argsort(order, kind="stable")[:size]]))
                out[4].append(parities(h))
            columns = [pa.array(_signed(out[0])), pa.array(out[1], pa.int32()), pa.array(_signed(out[2])), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=["key", "n", "fp", "prefix", "bits"])

    return run


def _tokens(often):
    """Rows (tile, side, key, n, mark) of classes (key, n, mark, prefix). side: 2 in a tile of its own, 0 or 1 in a pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, _, parts = often.value
        wide, parts = last[parts > 1], parts[parts > 1]
        for batch in batches:
            lists = batch.column("prefix")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            key, n, mark = (batch.column(c).to_numpy() for c in ("key", "n", "mark"))
            tile, side = h.view(np.int64), np.full(h.size, 2, np.int8)
            if wide.size:
                at = np.minimum(np.searchsorted(wide, h), wide.size - 1)
                hot = np.flatnonzero(wide[at] == h)
                p = parts[at[hot]]
                mine = (key[row[hot]].view(np.uint64) % p.astype(np.uint64)).astype(np.int64)
                each, other = np.repeat(np.arange(hot.size), p), np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
                low, high = np.minimum(mine[each], other), np.maximum(mine[each], other)
                with np.errstate(over="ignore"):
                    pair = (h[hot[each]] + (low * 65_536 + high + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                cold = np.ones(h.size, bool)
                cold[hot] = False
                row = np.concatenate([row[cold], row[hot[each]]])
                tile = np.concatenate([tile[cold], pair])
                side = np.concatenate([side[cold], np.where(low == high, 2, (mine[each] == high).astype(np.int8)).astype(np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(side), pa.array(key[row]), pa.array(n[row]), pa.array(mark[row])], names=["tile", "side", "key", "n", "mark"])

    return run


def _sizes_alike(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that sizes do not rule out."""
    return DEN * np.minimum(n[i], n[j]).astype(np.int64) >= NUM * np.maximum(n[i], n[j]).astype(np.int64)


def _meet(side: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that belong to this tile: all in a tile of its own, those of both sides in a pair of tiles."""
    return (side[i] == 2) | (side[i] != side[j])


def forests(n: np.ndarray, fp: np.ndarray, near: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of pairs in one tile: FORESTS disjoint forests of those within `near` bits, and the tree of the first that each place is in."""
    m = fp.size
    labels, pairs = np.tile(np.arange(m), (FORESTS, 1)), []
    for i in range(1, m):  # each document with those before it
        j = np.flatnonzero((np.bitwise_count(fp[:i] ^ fp[i]) <= near) & (DEN * np.minimum(n[:i], n[i]) >= NUM * np.maximum(n[:i], n[i])))
        for label in labels:
            if not j.size:
                break
            found, first = np.unique(label[j], return_index=True)
            new = found != label[i]
            if new.any():  # one link to each tree that this document joins
                pairs.append(np.stack([np.full(int(new.sum()), i), j[first[new]]]))
                joined = np.append(found, label[i])
                label[np.isin(label, joined)] = joined.min()
                j = np.delete(j, first[new])
    return pairs, labels[0]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tile -> tables of whole tiles."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        if held and tile[-1] == now:
            held.append(batch)
            continue
        last = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held, now = [batch.slice(last)], tile[-1]
    if held:
        yield pa.Table.from_batches(held)


def _starts(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each tile starts, and its rows."""
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    return starts, np.diff(np.append(starts, tile.size))


def _few(starts: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of small tiles, many tiles at a time."""
    for m in range(2, FEW + 1):
        first = starts[count == m]
        for a in range(m):
            for b in range(a + 1, m):
                yield first + a, first + b


def _many(first: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one tile, in blocks."""
    rows = max(1, (1 << 18) // m)
    for at in range(0, m, rows):
        a, b = np.nonzero(np.arange(at, min(m, at + rows))[:, None] < np.arange(m)[None, :])
        yield first + at + a, first + b


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    pair = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
    return np.unique(np.stack([pair.min(axis=0), pair.max(axis=0)]), axis=1) if pair.size else pair


def _likely(near: int, far: int):
    """Rows sorted by tile, marked with fingerprints -> pairs (a, b) of classes, and rows (tile, null) of tiles in which other pairs are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            tile, side, key, n, fp = (table[c].to_numpy() for c in ("tile", "side", "key", "n", "mark"))
            fp, (starts, count) = fp.view(np.uint64), _starts(tile)
            found, left = [], [np.zeros(0, np.int64)]

            def take(i, j, apart=None):
                ok = (key[i] != key[j]) & _meet(side, i, j) & _sizes_alike(n, i, j)  # noqa: B023
                ok &= True if apart is None else apart[i] != apart[j]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= far  # noqa: B023
                found.append(np.stack([key[i[ok]], key[j[ok]]]))  # noqa: B023
                left.append(np.unique(tile[i[~ok]]))  # noqa: B023

            for i, j in _few(starts, count):
                take(i, j)
            trees = np.zeros(tile.size, np.int64)
            for first, m in zip(starts[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
                links, label = forests(n[first : first + m], fp[first : first + m], near)
                for i, j in links:
                    i, j = i[key[first + i] != key[first + j]], j[key[first + i] != key[first + j]]
                    found.append(np.stack([key[first + i], key[first + j]]))
                if np.bincount(label).max() > 2:  # a tree's other pairs
                    left.append(tile[first : first + 1])
                trees[first : first + m] = label
                for i, j in _many(first, m):
                    take(i, j, trees)
            pair, left = _distinct(found), np.unique(np.concatenate(left))
            a, b = pa.array(np.append(pair[0], left)), pa.array(np.append(pair[1], left), mask=np.repeat([False, True], [pair.shape[1], left.size]))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return run


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, marked with groups, and their parities -> pairs of classes of different groups that parities do not rule out."""
    for table in _tiles(batches):
        tile, side, key, n, group = (table[c].to_numpy() for c in ("tile", "side", "key", "n", "mark"))
        bits, (starts, count), found = table["bits"].to_pylist(), _starts(tile), []
        big = zip(starts[count > FEW].tolist(), count[count > FEW].tolist(), strict=True)
        for i, j in (pairs for some in (_few(starts, count), *(_many(*b) for b in big)) for pairs in some):
            ok = (group[i] != group[j]) & _meet(side, i, j) & _sizes_alike(n, i, j)
            i, j = i[ok], j[ok]
            ok = possible(n, bits, i, j)
            found.append(np.stack([key[i[ok]], key[j[ok]]]))
        pair = _distinct(found)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def _often(docs: DataFrame, text: Column):
    """Broadcast: the shingles that the sample holds more than twice, how often, and into how many tiles each is split; LAST of them at most."""
    total = docs.count()
    rate = min(1.0, SAMPLE / max(1, total))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select(text.alias("text")).distinct().limit(2 * SAMPLE)
    counts = some.select(F.explode(_sets("text")).alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(LAST).toPandas()
    h, n = counts["h"].to_numpy(np.int64).view(np.uint64), counts["count"].to_numpy(np.int64)
    order = np.argsort(h)
    parts = np.minimum(65_535, -(-(n / rate).astype(np.int64) // TILE))
    return docs.sparkSession.sparkContext.broadcast((h[order], n[order], parts[order]))


def _small(rows: DataFrame) -> DataFrame:
    """rows, which are written already, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL_IDS else rows


def _verified(docs: DataFrame, text: Column, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that have the similarity, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = cut(rows.groupBy("key").agg(F.min("text_hash").alias("w")).join(wanted, "key", "left_semi"))
    sets = docs.select(text.alias("text")).join(_small(wanted), F.xxhash64("text") == F.col("w")).groupBy("key").agg(F.first("text").alias("text")).select("key", _sets("text").alias("set"))
    sets = cut(sets)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where((NUM + DEN) * same >= NUM * (F.size("x") + F.size("y"))).select("a", "b")


def groups(docs: DataFrame, near: int = NEAR, far: int = FAR) -> DataFrame:
    """Rows (doc_id, text_hash, group), one for each row of docs: near copies have one number. docs: doc_id, text.

    Rows without words are one group. Texts are told apart by xxhash64 of the text, null as empty. near and far,
    in bits, say which pairs are looked at first; the groups are the same for all values of theirs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    often = _often(docs, text)
    rows = written(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _keys(often)(text).alias("s")).select("doc_id", "text_hash", "s.*"))
    classes = written(rows.where("n > 0").select("key", "n", "fp", "prefix", "bits").dropDuplicates(["key"]))
    token, pair = "tile long, side byte, key long, n int, mark long", "a long, b long"
    tokens = classes.select("key", "n", F.col("fp").alias("mark"), "prefix").mapInArrow(_tokens(often), token)
    met = cut(tokens.repartition("tile").sortWithinPartitions("tile").mapInArrow(_likely(near, far), pair).distinct())
    tried = met.where("b is not null")
    bits = lambda k: classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    likely = tried.join(bits("a"), "a").join(bits("b"), "b").where(_possible("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")
    links = cut(_verified(docs, text, rows, cut(likely)))
    found = components(links, "a", "b").toDF("node", "root")
    # tiles with pairs that were not taken, as far as their documents are of several groups by now
    tokens = classes.join(found, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("root", "key").alias("mark"), "prefix").mapInArrow(_tokens(often), token)
    left = _small(met.where("b is null").select(F.col("a").alias("tile")))
    mixed = tokens.join(left, "tile", "left_semi").groupBy("tile").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least < most")
    mixed = cut(mixed.select("tile"))
    if not mixed.isEmpty():
        again = tokens.join(_small(mixed), "tile", "left_semi").join(classes.select("key", "bits"), "key").repartition("tile").sortWithinPartitions("tile")
        rest = cut(again.mapInArrow(_rest, pair).distinct().join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            found = components(links.union(_verified(docs, text, rows, rest)), "a", "b").toDF("node", "root")
    return rows.select("doc_id", "text_hash", "key").join(found, F.col("key") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("group"))


def drop(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, null last, and of those the one with the least text hash.

    docs: doc_id, text and any other columns, which pass through. Rows are judged, not ids: a null or repeated doc_id
    changes nothing for rows of other texts. Of rows alike in doc_id and text one stays. Rows without words are near
    copies of each other. An empty table gives an empty table.
    """
    g = cut(groups(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = cut(g.groupBy("group").agg(F.count("*").alias("n"), F.min(place).alias("best")).where("n > 1"))
    small = F.broadcast if best.count() <= SMALL_IDS else (lambda d: d)
    full = g.join(small(best), "group").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first(place.eqNullSafe(F.col("best"))).alias("stays"))
    full = cut(full.where("not stays or n > 1").toDF("__id", "__hash", "__n", "__stays"))
    small = F.broadcast if full.count() <= SMALL_IDS else (lambda d: d)
    here = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = here["doc_id"].eqNullSafe(full["__id"]) & (here["__h"] == full["__hash"])
    out = here.join(small(full.where("not __stays")), same, "left_anti")
    again = full.where("__stays")
    if not again.isEmpty():  # rows alike in id and text
        repeated = out.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "__h"])
        out = out.join(small(again), same, "left_anti").unionByName(repeated)
    return out.drop("__h")
