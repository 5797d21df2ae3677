"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it. Every
node of a tree holds a Krichevsky-Trofimov estimate of its bit, and the weighting mixes the estimates of
all depths along the path: a node's own with its child's, by the share that the node's data gives to
stopping there. With frozen counts both come in closed form from the counts of (depth + 1)-byte strings,
which Spark sums over all training documents.

Trees are built in buckets of whole subtrees (contexts that end in the same two bytes); only the nodes of
depth 0 and 1, at most 256 * 256 of them, meet on the driver. The finished tables travel to the tasks in
groups of a bounded size, one group to a task, and a document's score is the sum of the groups' parts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DEPTH = 5
#: Distinct strings of a bucket on average, and strings or words that one broadcast holds (about 60 and 16 bytes each).
BUCKET, GROUP_GRAMS, GROUP_WORDS = 100_000, 4_000_000, 12_000_000
#: Bytes of text that are scored or counted at a time.
BLOCK = 1 << 20
#: Documents of a batch whose words are counted, and whose texts are held as Python strings, at a time.
COUNT_ROWS, SCORE_ROWS = 2_048, 256
END_WORD = b"\x00"  # the end of a document; no word holds it, as it is counted apart
_HALF = math.log(0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log probability that the Krichevsky-Trofimov estimator gives to n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1.0)


def _weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes: the estimate of a one, the share of stopping, the weighted log probability. below: the children's sum, None at the last depth."""
    own = log_kt(n0, n1)
    total = own if below is None else np.logaddexp(_HALF + own, _HALF + below)
    stop = np.ones(own.size) if below is None else np.exp(_HALF + own - total)
    return (n1 + 0.5) / (n0 + n1 + 1.0), stop, total


def _bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes: the number of each of the eight decisions (a 1, then the bits so far) and its outcome; shapes (8, n)."""
    x, i = x.astype(np.uint64)[None, :], np.arange(8, dtype=np.uint64)[:, None]
    return (np.uint64(1) << i) | (x >> (np.uint64(8) - i)), (x >> (np.uint64(7) - i)) & np.uint64(1)


class Subtrees:
    """The nodes of depth 2 to `depth` for a set of strings (context bytes, then the byte) with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        z, bit = _bits(grams & np.uint64(255))
        ctx = np.broadcast_to(grams >> np.uint64(8), z.shape).ravel()
        self.z, self.bit = z.ravel(), bit.ravel().astype(bool)
        n = np.broadcast_to(counts.astype(float), z.shape).ravel()
        keys, at = (ctx << np.uint64(8)) | self.z, None
        n0, n1, below = np.where(self.bit, 0, n), np.where(self.bit, n, 0), None
        self.levels = []  # (depth, keys, estimate, stop, place of each decision), deepest first
        for d in range(depth, 0, -1):
            if d < depth:
                mask = np.uint64((1 << (8 * d)) - 1)
                keys = (((keys >> np.uint64(8)) & mask) << np.uint64(8)) | (keys & np.uint64(255))
            keys, place = np.unique(keys, return_inverse=True)
            n0, n1 = (np.bincount(place, v, keys.size) for v in (n0, n1))
            below = None if below is None else np.bincount(place, below, keys.size)
            at = place if at is None else place[at]
            if d == 1:
                self.first = keys, n0, n1, below  # of depth 1 other buckets have parts too
                self.at_first = at
                break
            p, stop, below = _weigh(n0, n1, below)
            self.levels.append((d, keys, p, stop, at))


class Top:
    """Depth 0 and 1 as flat tables: estimate and share of stopping."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        sums = np.zeros((3, 1 << 16))
        for keys, *values in parts:
            for s, v in zip(sums, values, strict=True):
                np.add.at(s, keys.astype(np.int64), v)
        self.p1, self.w1, total = _weigh(sums[0], sums[1], sums[2])
        total[sums[0] + sums[1] == 0] = 0.0
        n0, n1, below = (v.reshape(256, 256).sum(axis=0) for v in (sums[0], sums[1], total))
        self.p0, self.w0, _ = _weigh(n0, n1, below)

    def finish(self, first: np.ndarray, deeper: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The mixed probability of each bit at the root, from that of depth 2 (1/2 where training never was)."""
        first = first.astype(np.int64)
        z = first & 255
        one = self.w1[first] * _of(self.p1[first], bit) + (1 - self.w1[first]) * deeper
        return self.w0[z] * _of(self.p0[z], bit) + (1 - self.w0[z]) * one


def _of(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return np.where(bit, p, 1 - p)


def _log10(p: np.ndarray) -> np.ndarray:
    return np.log10(p).reshape(8, -1).sum(axis=0)


def _build_first(depth: int):
    def run(table: pa.Table) -> pa.Table:
        s = Subtrees(table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy(), depth)
        return pa.table({"bucket": table["bucket"][:1].cast(pa.int32()), "parts": pa.array([[np.ascontiguousarray(x).tobytes() for x in s.first]], pa.list_(pa.binary()))})

    return run


def _build(shared, depth: int):
    def run(table: pa.Table) -> pa.Table:
        grams, top = table["gram"].to_numpy().view(np.uint64), shared.value
        order = np.argsort(grams)
        grams = grams[order]
        s = Subtrees(grams, table["n"].to_numpy()[order], depth)
        p = None
        for _, _, est, stop, at in s.levels:
            own = _of(est[at], s.bit)
            p = own if p is None else stop[at] * own + (1 - stop[at]) * p
        values = _log10(top.finish(s.first[0][s.at_first], p, s.bit))
        # the deepest nodes never weigh, and their counts are sums over neighbouring strings: they need no rows of their own
        out = [grams, values.astype(np.float32), table["n"].to_numpy()[order]]
        for _, keys, est, stop, _ in s.levels[1:]:
            # log-odds, as a probability near 1 would lose its rest in single precision
            out += [keys, (np.log(est) - np.log1p(-est)).astype(np.float32), stop.astype(np.float32)]
        return pa.table({"bucket": table["bucket"][:1].cast(pa.int32()), "parts": pa.array([[np.ascontiguousarray(x).tobytes() for x in out]], pa.list_(pa.binary()))})

    return run


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a string: a hash of the two bytes before its last one."""
    return (((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65536) % np.uint64(buckets)).astype(np.int64)


def byte_strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of all texts, with the end of each as a zero byte, and the number of each text's first string."""
    gap = b"\x00" * depth
    joined = np.frombuffer(b"".join(gap + t + b"\x00" for t in texts), np.uint8)
    h = np.zeros(joined.size - depth, np.uint64)
    for i in range(depth + 1):
        h = (h << np.uint64(8)) | joined[i : joined.size - depth + i]
    # the strings that end in the gap before a text are no part of it
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths + depth) - lengths - depth
    keep = np.zeros(h.size + depth, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + lengths, -1)
    return h[np.cumsum(keep[: h.size]).astype(bool)], np.cumsum(lengths) - lengths


def _folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


def _blocks(texts: Iterable[bytes], limit: int = BLOCK) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t) + 8
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def _count(depth: int):
    """Rows (kind, key, train, other): kind 0 strings of training texts; kind 1 words, with counts inside and outside training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, keys, train, other):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.asarray(keys, np.uint64).view(np.int64)), pa.array(np.asarray(train, np.int64)), pa.array(np.asarray(other, np.int64))], names=["kind", "key", "train", "other"])

        for batch in (b.slice(at, COUNT_ROWS) for b in batches for at in range(0, b.num_rows, COUNT_ROWS)):
            texts, train = [_folded(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            inside, outside = Counter(), Counter()
            for t, own in zip(texts, train, strict=True):
                (inside if own else outside).update(t.split())
            n = sum(map(bool, train))
            inside[END_WORD], outside[END_WORD] = n, len(train) - n
            keys = list(inside | outside)
            yield rows(1, [_word_hash(w) for w in keys], [inside[w] for w in keys], [outside[w] for w in keys])
            for block in _blocks((t for t, own in zip(texts, train, strict=True) if own), 3 * BLOCK):
                grams, counts = np.unique(byte_strings(block, depth)[0], return_counts=True)
                yield rows(0, grams, counts, np.zeros(len(counts)))

    return run


def _sorted(arrays: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(arrays[0])
    return [a[order] for a in arrays]


def join_buckets(rows: Iterator, total: int, depth: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Finished buckets as sorted tables: which buckets they are, the strings, and the nodes from the deepest level up."""
    kinds = [np.uint64, np.float32, np.int64] + [np.uint64, np.float32, np.float32] * (depth - 2)
    own, parts = np.zeros(total, bool), [[] for _ in kinds]
    for r in rows:
        own[r.bucket] = True
        for p, k, x in zip(parts, kinds, r.parts, strict=True):
            p.append(np.frombuffer(bytes(x), k))
    tables = []
    for a in range(0, len(kinds), 3):
        tables.append(_sorted([np.concatenate([*parts[i], np.zeros(0, kinds[i])]) for i in range(a, a + 3)]))
        parts[a : a + 3] = [[]] * 3
    tables[0][2] = np.concatenate([[0], np.cumsum(tables[0][2])])  # occurrences before each string
    return own, tables


class Trees:
    """A group of finished buckets, ready to score strings."""

    def __init__(self, joined: tuple[np.ndarray, list[list[np.ndarray]]], top: Top, depth: int):
        self.top, self.depth, (self.own, tables) = top, depth, joined
        self.grams, self.values, self.before = tables[0]
        self.levels = [(depth - 1 - i, *t) for i, t in enumerate(tables[1:])]
        self.new_keys, self.new_values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, keys.size - 1))
        return at, (keys[at] == wanted if keys.size else np.zeros(wanted.size, bool))

    def _unseen(self, grams: np.ndarray) -> np.ndarray:
        """Scores of strings that training did not hold: a node that it never was at gives either bit 1/2."""
        z, bit = _bits(grams & np.uint64(255))
        ctx, z, bit = np.broadcast_to(grams >> np.uint64(8), z.shape).ravel(), z.ravel(), bit.ravel().astype(bool)
        left = np.uint64(8) - np.repeat(np.arange(8, dtype=np.uint64), grams.size)  # bits that are open at each decision
        low = (ctx << np.uint64(8)) | ((z << left) & np.uint64(255))
        edges = [self.before[np.searchsorted(self.grams, low + ((half << left) >> np.uint64(1)))] for half in (np.uint64(0), np.uint64(1), np.uint64(2))]
        n0, n1 = edges[1] - edges[0], edges[2] - edges[1]
        p = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        for d, keys, odds, stop in self.levels:
            at, hit = self._find(keys, ((ctx & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | z)
            at = at[hit]
            own = 1 / (1 + np.exp(np.where(bit[hit], -1, 1) * odds[at].astype(float)))
            p[hit] = stop[at] * own + (1 - stop[at]) * p[hit]
        return _log10(self.top.finish(((ctx & np.uint64(255)) << np.uint64(8)) | z, p, bit))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, of the strings in this group's buckets."""
        h, first = byte_strings(texts, self.depth)
        u = np.unique(h)
        value = np.zeros(u.size)
        mine = np.flatnonzero(self.own[bucket_of(u, self.own.size)])
        at, hit = self._find(self.grams, u[mine])
        value[mine[hit]] = self.values[at[hit]]
        rest = mine[~hit]
        at, hit = self._find(self.new_keys, u[rest])
        value[rest[hit]] = self.new_values[at[hit]]
        rest = rest[~hit]
        if rest.size:
            value[rest] = self._unseen(u[rest])
            if self.new_keys.size < 1 << 19:  # remembered, to a bound
                place = np.searchsorted(self.new_keys, u[rest])
                self.new_keys, self.new_values = np.insert(self.new_keys, place, u[rest]), np.insert(self.new_values, place, value[rest])
        return np.add.reduceat(value[np.searchsorted(u, h)], first)


class Words:
    """A group of the word counts, ready to score words."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray], group: int, groups: int, total: float, distinct: float):
        (self.keys, self.counts), self.group, self.groups = table, group, groups
        self.norm = math.log10(total + 0.5 * (distinct + 1))

    def score(self, texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text's words in this group: the sum of log10 probabilities, how many there are and how many are known."""
        number: dict[bytes, int] = {}
        tokens = [[number.setdefault(w, len(number)) for w in (*t.split(), END_WORD)] for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat, first = np.fromiter((i for t in tokens for i in t), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes
        h = np.fromiter(map(_word_hash, number), np.uint64, len(number))
        order = np.argsort(h)  # wanted in order, they are found faster
        at = np.empty(h.size, np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, h[order]), max(0, self.keys.size - 1))
        hit = self.keys[at] == h if self.keys.size else np.zeros(h.size, bool)
        mine = h.view(np.int64) % self.groups == self.group  # by the signed hash, as Spark holds it
        # a word without an entry is in its own text alone: once if that is a training text, else never
        count = np.where(hit, self.counts[at], 0) if self.keys.size else np.zeros(h.size, np.int64)
        own = np.repeat(np.array(train, bool), sizes)
        in_train, elsewhere = np.where(hit, count, 1), count
        value = np.where(own, np.log10(in_train + 0.5)[flat], np.log10(elsewhere + 0.5)[flat]) - self.norm
        use = mine[flat]
        add = lambda x: np.add.reduceat(x, first) if first.size else np.zeros(0)
        return add(np.where(use, value, 0.0)), add(use.astype(np.int64)), add((use & (own | (elsewhere > 0)[flat])).astype(np.int64))


def _scoring(trees, top, words, depth: int, group: int, groups: int, total: float, distinct: float):
    """A document's parts of both scores from one group of each table; None: no such group. One function, so that one worker holds both."""

    @F.arrow_udf("score double, sum double, n long, known long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tree = Trees(trees.value, top.value, depth) if trees else None
        word = Words(words.value, group, groups, total, distinct) if words else None
        for texts, train in batches:
            scores, counts = [], []
            for at in range(0, len(texts), SCORE_ROWS):
                folded = [_folded(t) for t in texts.slice(at, SCORE_ROWS).to_pylist()]
                scores += [tree.score(block) if tree else np.zeros(len(block)) for block in _blocks(folded)]
                own = train.slice(at, SCORE_ROWS).to_pylist()
                counts.append(word.score(folded, own) if word else (np.zeros(len(folded)), *[np.zeros(len(folded), np.int64)] * 2))
            sums, ns, known = (np.concatenate([*(c[i] for c in counts), np.zeros(0)]) for i in range(3))
            columns = [pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(sums), pa.array(ns.astype(np.int64)), pa.array(known.astype(np.int64))]
            yield pa.StructArray.from_arrays(columns, names=["score", "sum", "n", "known"])

    return run


def score(docs: DataFrame, train: Column, depth: int = DEPTH, group_grams: int = GROUP_GRAMS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to documents; train: which of them the counts come from.

    docs: text and any other columns, which pass through; columns of those names are replaced. Texts are
    lower-cased in A-Z; null counts as empty. score is the log10 probability of the text's UTF-8 bytes and its
    end (-score * log2(10) over the bytes is the code length per byte). base_score is that of its words and end
    by smoothed word counts. Words are told apart by 64-bit hashes. Repeated rows count again. Without training
    texts every bit has probability 1/2 and no token is known. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text, own = F.col("text").cast("string"), F.coalesce(train, F.lit(False))
    counted = docs.select(text.alias("text"), own.alias("own")).mapInArrow(_count(depth), "kind int, key long, train long, other long")
    sums = cut(counted.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("other").alias("other")))
    grams = sums.where("kind = 0").select(F.col("key").alias("gram"), F.col("train").alias("n"))
    size = sums.agg(
        F.count_if(F.expr("kind = 0")).alias("grams"), F.sum(F.when(F.col("kind") == 1, F.col("train"))).alias("tokens"), F.count_if(F.expr("kind = 1 and train > 0")).alias("distinct"),
        # a word that is in one training text once and nowhere else needs no entry: see _word_scoring
        F.count_if(F.expr("kind = 1 and (train > 1 or train = 1 and other > 0)")).alias("words"),
    ).first()
    buckets = min(1 << 16, max(1, -(-size.grams // BUCKET)))
    two = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = grams.withColumn("bucket", F.pmod(F.pmod(two * 40503, F.lit(65536)), F.lit(buckets)).cast("int")).groupBy("bucket")
    first = [r.parts for r in dealt.applyInArrow(_build_first(depth), "bucket int, parts array<binary>").collect()]  # 65,536 nodes a bucket at most, depth 1 only
    top = spark.sparkContext.broadcast(Top([(np.frombuffer(p[0], np.uint64), *(np.frombuffer(x, float) for x in p[1:])) for p in first]))
    built = dealt.applyInArrow(_build(top, depth), "bucket int, parts array<binary>")
    groups = max(1, -(-size.grams // group_grams))
    built = cut(built) if groups > 1 else built
    kept = sums.where("kind = 1 and (train > 1 or train = 1 and other > 0)").select("key", "train")
    word_groups = max(1, -(-size.words // group_words))
    tokens, n_words, parts = float(size.tokens or 0), float(size.distinct or 0), []
    for g in range(max(groups, word_groups)):
        trees = counts = None
        if g < groups:
            trees = spark.sparkContext.broadcast(join_buckets(built.where(F.pmod("bucket", F.lit(groups)) == g).toLocalIterator(), buckets, depth))
        if g < word_groups:
            t = kept.where(F.pmod("key", F.lit(word_groups)) == g).toArrow()
            counts = spark.sparkContext.broadcast(tuple(_sorted([t["key"].to_numpy().view(np.uint64), t["train"].to_numpy()])))
        source = text if max(groups, word_groups) == 1 else F.col("__text")
        parts.append(_scoring(trees, top, counts, depth, g, word_groups, tokens, n_words)(source, F.col("__own")))
    final = {"n_tokens": "n", "n_known": "known", "base_score": "sum", "score": "score"}
    if len(parts) == 1:
        out = docs.withColumn("__own", own).withColumn("__p", parts[0]).withColumns({k: F.col(f"__p.{v}") for k, v in final.items()})
        return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long")).drop("__own", "__p")
    # a task holds the tables of one group; a row's parts are summed by a number of the row
    rows = cut(docs.withColumns({"__own": own, "__row": F.monotonically_increasing_id()}))
    every = None
    for part in parts:
        one = rows.select("__row", text.alias("__text"), "__own").select("__row", part.alias("p")).select("__row", "p.*")
        every = one if every is None else every.unionByName(one)
    every = every.groupBy(F.col("__row").alias("__of")).agg(*[F.sum(v).alias(f"__{v}") for v in final.values()])
    out = rows.join(every, F.col("__row") == F.col("__of")).withColumns({k: F.col(f"__{v}") for k, v in final.items()})
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long")).drop("__own", "__row", "__of", *[f"__{v}" for v in final.values()])
