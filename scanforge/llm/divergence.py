"""How far the sources of a language differ in their words: exact totals for all pairs of sources, and the words behind them.

The sparse table of (source, term) counts is multiplied with itself row by row (Gustavson): a source scatters each of its
terms through a term-major index into a dense accumulator with one cell for each peer. No pair of postings is ever a row.
A term that a source lacks still has a probability there, its baseline; the accumulator starts with what baselines give and
the scatter corrects it.

Terms are dealt out in blocks, so that neither a language nor a source nor a frequent term meets in one task; a block's
totals for a pair of sources are added up by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, each

MIN_DOCS, PRIOR, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Postings (a source's count of a term) of a block that one task holds.
BLOCK_POSTINGS = 50_000
#: Distinct (source, term) cells that a task counts before it passes them on, and bytes of a text that are cut into words at a time.
HELD_CELLS, TEXT_BYTES = 300_000, 1 << 22
#: Sources up to which their table is broadcast.
SMALL_GROUPS = 200_000

# Letters, and all bytes of characters beyond ASCII; the rest separates terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part of it at a time."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each source, and for each source that occurs a row without a term."""
    cells: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in cells.items():
            terms = [None, *n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [df[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CELLS, strict=True)], schema=_CELLS)
        cells.clear()

    for batch in batches:
        for lang, source, text in zip(*(each(batch.column(i)) for i in range(3)), strict=True):
            n, df = cells.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for part in _terms(text):
                n.update(part)
                seen.update(part)
            df.update(seen)
            held += len(n) - before
            if held > HELD_CELLS:
                yield from flush()
                held = 0
    yield from flush()


def _distances(p: np.ndarray, term: np.ndarray, group: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a block of terms: for each group t its peers s and the sums of |p_t - p_s| over the block's terms.

    p, term, group: the block's postings. base: each group's probability of a term that it lacks. A pair is told by that of
    its groups whose baseline is less (then its number is), as no probability of the other one is below that baseline:
    a term that both lack or that only the other has adds this baseline to the sum of minima.
    """
    size = base.size
    by_term = np.argsort(term, kind="stable")
    peer, peer_p = group[by_term], p[by_term]
    distinct, place, df = np.unique(term, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(df)])
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(size + 1))
    own_terms = np.diff(bounds)
    own_p = np.zeros(size, np.int64)
    np.add.at(own_p, group, p)
    totals = own_p + (distinct.size - own_terms) * base
    order = np.lexsort((np.arange(size), base))
    for at, t in enumerate(order):
        rest = order[at + 1 :]
        if not rest.size:
            return
        mine = by_group[bounds[t] : bounds[t + 1]]
        sums = np.concatenate([[0], np.cumsum(np.sort(p[mine]))])
        under = np.searchsorted(np.sort(p[mine]), base, "right")
        minima = sums[under] + (mine.size - under) * base  # what t's terms give with peers that lack them
        rows = place[mine]  # t's rows of the term-major index, and their postings one after another
        n = df[rows]
        at_posting = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if mine.size else np.zeros(0, np.int64)
        to, here = peer[at_posting], np.repeat(p[mine], n)
        np.add.at(minima, to, np.minimum(here, peer_p[at_posting]) - np.minimum(here, base[to]))
        shared = minima + (distinct.size - mine.size) * base[t]
        yield t, rest, totals[t] + totals[rest] - 2 * shared[rest]


def _block_distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one block: rows (lang, a, b, value), some sources at a time."""
    pdf = pd.concat(batches)
    own = pdf["term"].notna().to_numpy()
    groups, posts = pdf[~own].sort_values("ord"), pdf[own]
    term = pd.factorize(posts["term"])[0].astype(np.int64)
    rows, held = [], 0
    frame = lambda: pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": np.concatenate([np.full(s.size, t, np.int64) for t, s, _ in rows]), "b": np.concatenate([s for _, s, _ in rows]), "value": np.concatenate([d for _, _, d in rows])})
    for found in _distances(posts["p"].to_numpy(np.int64), term, posts["ord"].to_numpy(np.int64), groups["p"].to_numpy(np.int64)):
        rows.append(found)
        held += found[1].size
        if held >= HELD_CELLS:
            yield frame()
            rows, held = [], 0
    if rows:
        yield frame()


def _probability(count: str) -> str:
    # in decimals, as the product may pass 64 bits
    return f"CASE WHEN n_all + {PRIOR} * v > 0 THEN 1 + ({SCALE} * CAST({count} + {PRIOR} AS DECIMAL(20, 0))) div CAST(n_all + {PRIOR} * v AS DECIMAL(20, 0)) ELSE 0 END"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, block: int = BLOCK_POSTINGS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair`: item is another source of the language, value the sum over the language's kept terms of the differences
    of both sources' scaled probabilities; all ranks. Part `term`: item is a kept term that the source uses more than its
    language does, value by how much; `ranks` ranks at most. Kept: terms in at least min_docs documents (rows) of the
    language. Null lang, source and text count as empty; a source without terms has pairs, and each of them counts 0 where
    the language keeps no term; a language of one source has no pairs. Repeated rows count again. Empty tables give no rows.
    Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*named, text.cast("binary").alias("text")).mapInArrow(_count_cells, "lang string, source string, term binary, n long, df long")
    # dealt by term once: sums by source, by language and their join need no other shuffle
    dealt = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    cells = cut(dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    kept = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_docs).drop("df")
    posts = cut(cells.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    n_posts = posts.count()
    per_lang = posts.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    per_group = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    every = cells.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    every = every.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_all", "v", "lang_n")})
    groups = cut(every.withColumn("ord", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))
    small = (lambda x: F.broadcast(x)) if groups.count() <= SMALL_GROUPS else (lambda x: x)

    own = posts.join(small(groups), ["lang", "source"]).withColumn("p", F.expr(_probability("n")))
    q = F.expr(_probability("total").replace("n_all", "lang_n"))
    over = own.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= ranks)

    blocks = max(1, -(-n_posts // block))
    dealt_posts = own.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "term", "ord", "p")
    base = groups.withColumn("p", F.expr(_probability("0"))).select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("string").alias("term"), "ord", "p")
    partial = dealt_posts.unionByName(base).groupBy("lang", "block").applyInPandas(_block_distances, "lang string, a long, b long, value long")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
    name = lambda c, to: groups.select("lang", F.col("ord").alias(c), F.col("source").alias(to))
    named_pairs = both.join(small(name("x", "source")), ["lang", "x"]).join(small(name("y", "item")), ["lang", "y"])
    pairs = named_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(terms)


#: The same in DuckDB over a table `documents`.
AUDIT_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
  t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
  l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + {PRIOR})) // (g.n + {PRIOR} * l.v) AS p, 1 + ({SCALE} * (kept.total + {PRIOR})) // (l.n + {PRIOR} * l.v) AS q
    FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.sx = a.source AND s.sy = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
