"""Spelling variants: which words differ by one inserted, deleted or replaced code point, and which form they stand for.

A trie of all words lies in an edge table (parent, ch, child), distributed like any other table. A frontier of states
(word, position, node, edits) walks down it level by level: each level is one equi-join of the states with the edges that
leave nodes of that depth. A state without an edit stands on its word's own path and branches: over an edge of another
letter (a replacement), or over that of the next letter (its own letter is deleted). A state with an edit goes on over the
edge of its next letter alone. States that have used up their word end at a node; where that node is a word, both are near.

Near the root each state would branch over the whole alphabet. So there are two tries, of words and of words read
backwards, and each takes the edits of the half that lies far from its root. As nearness is mutual, insertions need no
branch (the other word has a deletion), and a replacement branches to greater letters alone.

A level is a job, so words of over MAX_LEVELS code points take one closing step instead: their hashes without each one of
their letters are joined with each other. Nodes are 64-bit hashes of prefixes; every pair found is verified on the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, each, written

MIN_CHARS, MIN_COUNT, TIMES = 7, 2, 10
#: A run loses a letter where this divides its hash.
LOSES = 31
MAX_LEVELS = 32
#: Words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Edges of a level up to which they are broadcast; beyond, states and edges are shuffled by node and Spark splits hot nodes.
SMALL_EDGES = 150_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_CHARS},}}")  # shorter ones cannot become words
_PRIME, _BASE = (1 << 61) - 1, 911_382_323


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([held[w] for w in part], pa.int64())})
        held.clear()

    for batch in batches:
        for doc_id, text in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(_RUN.findall(text)).items():
                h = zlib.crc32(run.encode(), start)
                if h % LOSES == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < MIN_CHARS:
                        continue
                held[run] += n
            if len(held) > HELD_WORDS:
                yield from flush()
    yield from flush()


def count_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (word, n): runs of letters of at least MIN_CHARS code points after the loss of letters, with min_count occurrences or more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias("text"))
    counted = rows.mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _spelt(word: Column, back: Column) -> Column:
    return F.when(back, F.reverse(word)).otherwise(word)


def _node(prefix: Column, back: Column) -> Column:
    return F.xxhash64(back, prefix)


def _char(word: Column, at: Column) -> Column:
    """The code point at a place counted from 0; empty beyond the end."""
    return F.substring(word, at + 1, F.lit(1))


def _edges(tries: DataFrame, level: int) -> DataFrame:
    """Edges (parent, ch, child) that leave nodes of a depth. tries: back, spelt, size."""
    prefix = lambda n: _node(F.left("spelt", F.lit(n)), F.col("back"))
    long = tries.where(F.col("size") > level)
    return long.select(prefix(level).alias("parent"), _char(F.col("spelt"), F.lit(level)).alias("ch"), prefix(level + 1).alias("child")).distinct()


def _walk(words: DataFrame) -> DataFrame:
    """Rows (word, n, back, node) of the states that have used up their word, one edit included. words: word, n of up to MAX_LEVELS code points."""
    tries = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.length("word").alias("size")).withColumn("spelt", _spelt(F.col("word"), F.col("back")))
    sizes = {r["size"]: r["c"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("c")).collect()}  # MAX_LEVELS rows at most
    own_part = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2))
    schema = ["word", "n", "back", "pos", "node"]
    active, done = None, []
    for level in range(MIN_CHARS // 2, max(sizes, default=0)):
        own = tries.where((F.col("size") > level) & (own_part <= level)).select("word", "n", "back", F.lit(level).alias("pos"), _node(F.left("spelt", F.lit(level)), F.col("back")).alias("node"))
        # the last letter is deleted: no edge is left to take
        done.append(own.where(F.length("word") == level + 1).select("word", "n", "back", "node"))
        states = own.withColumn("edited", F.lit(False))
        if active is not None:
            states = states.unionByName(active.where(F.col("pos") < F.length("word")).withColumn("edited", F.lit(True)))
        edges = _edges(tries, level)
        small = 2 * sum(c for size, c in sizes.items() if size > level) <= SMALL_EDGES
        spelt = _spelt(F.col("word"), F.col("back"))
        states = states.withColumns({"here": _char(spelt, F.col("pos")), "after": _char(spelt, F.col("pos") + 1)})
        goes = F.col("edited") & (F.col("ch") == F.col("here"))
        replaces = ~F.col("edited") & (F.col("ch") > F.col("here"))
        deletes = ~F.col("edited") & (F.col("ch") == F.col("after")) & (F.col("ch") != F.col("here"))
        met = states.join(F.broadcast(edges) if small else edges, (F.col("node") == F.col("parent")) & (goes | replaces | deletes))
        steps = F.filter(F.array(F.when(goes | replaces, F.col("pos") + 1), F.when(deletes, F.col("pos") + 2)), lambda x: x.isNotNull())
        active = written(met.select("word", "n", "back", F.explode(steps).alias("pos"), F.col("child").alias("node")).select(*schema))
        done.append(active.where(F.col("pos") >= F.length("word")).select("word", "n", "back", "node"))
    return reduce(DataFrame.unionByName, done) if done else words.select("word", "n", F.lit(False).alias("back"), F.lit(0).cast("long").alias("node")).limit(0)


def _hashes_without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word its own hash, and for a long one its hashes without the letter at each place (twice: for deletions, and for replacements there)."""
    for batch in batches:
        for word, n in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
            size = len(word)
            prefix, power = [0], [1]
            for c in word:
                prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)
            out = [("own", size, -1, prefix[size])]
            if size > MAX_LEVELS:
                for i in range(size):
                    rest = (prefix[size] - prefix[i + 1] * power[size - i - 1]) % _PRIME
                    less = (prefix[i] * power[size - i - 1] + rest) % _PRIME
                    out += [("without", size - 1, -1, less)] * (i + 1 == size or word[i] != word[i + 1]) + [("masked", size, i, less)]
            for at in range(0, len(out), 10_000):
                kind, length, place, h = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_pydict({"word": [word] * len(h), "n": [n] * len(h), "kind": list(kind), "size": pa.array(length, pa.int32()), "place": pa.array(place, pa.int32()), "h": pa.array(h, pa.int64())})


def _long_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, a_n, b, b_n) of near words of which the longer has over MAX_LEVELS code points."""
    rows = words.where(F.length("word") >= MAX_LEVELS).mapInArrow(_hashes_without, "word string, n long, kind string, size int, place int, h long")
    side = lambda kind, w, n: rows.where(F.col("kind") == kind).select("size", "place", "h", F.col("word").alias(w), F.col("n").alias(n))
    keys = ["size", "place", "h"]
    deleted = side("without", "a", "a_n").join(side("own", "b", "b_n"), keys)
    # words that agree but for one place: as many as there are letters at most
    replaced = side("masked", "a", "a_n").join(side("masked", "b", "b_n"), keys).where("a < b")
    return deleted.unionByName(replaced).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n, other, other_n), both ways round, of words that differ by one code point. words: distinct (word, n)."""
    short = words.where(F.length("word") <= MAX_LEVELS)
    ends = short.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select("b", "b_n", _node(_spelt(F.col("b"), F.col("back")), F.col("back")).alias("node"))
    walked = _walk(short).join(ends, "node").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")
    found = walked.unionByName(_long_pairs(words)).where(F.levenshtein("a", "b", 1) == 1).dropDuplicates(["a", "b"])
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))
    return found.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def group(docs: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of docs (doc_id, text).

    form: the near word that occurs most often (ties: the first in code-point order), if it does so `times` as often as the
    word; null otherwise. root: where following forms ends. Null text: no words; a null doc_id counts as empty in
    the hash. Repeated rows count again. Empty tables give no rows. Other columns of docs are not read.
    """
    words = cut(count_words(docs, min_count))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(best, "word", "left")
    takes = -F.col("best.less") >= F.col("n") * times
    forms = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    # each step multiplies the count, so the largest count bounds the way to the root; a round doubles how far it is followed
    most, steps = forms.agg(F.max("n")).first()[0] or 0, 1
    while times > 1 and times**steps <= most:
        steps += 1
    up = forms.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        up = cut(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB over a table `documents`: words share what is left without one letter.
GROUP_SQL = rf"""WITH RECURSIVE crc AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) for b in range(256)] AS tab),
  runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
  hashed AS (SELECT run, n, xor(list_reduce([('0x' || x)::BIGINT for x in regexp_extract_all(hex(id || ':' || run), '..')], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM runs, crc),
  w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {LOSES} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
  less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
  near AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, w.word, w.n FROM less a JOIN w ON w.word = a.rest UNION ALL SELECT w.word, a.word, a.n FROM less a JOIN w ON w.word = a.rest)),
  best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -other_n, b := other)) AS m FROM near GROUP BY word),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.a >= {TIMES} * w.n THEN m.b END AS form, CASE WHEN -m.a >= {TIMES} * w.n THEN -m.a END AS form_n FROM w LEFT JOIN best USING (word)),
  up AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT up.word, forms.word, forms.form FROM up JOIN forms ON forms.word = up.next)
SELECT forms.word, form, up.root, n, n_near, form_n FROM forms JOIN up ON up.word = forms.word AND up.next IS NULL"""
