"""Mix sources to target weights, without sorting.

A document's place in the order of its source is a hash of its id, so a larger budget always takes a
superset of a smaller one. A budget is met by a hash threshold: words are summed by source and hash
bucket, the bucket where the running sum crosses the budget is found, and that bucket alone is split
again by the next bits, until the threshold separates single hash values. Only then are documents
filtered, each by its own hash and its source's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Times that a document may be taken at most.
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Hash bits in all and in each level: 5 histograms of 4,096 buckets for each source.
HASH_BITS, LEVEL_BITS = 60, 12


def place(doc_id: Column) -> Column:
    """60 hash bits of an id, evenly spread; null counts as the text 'null'. MD5, as any SQL engine has it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Rows (source, source_size, target) for rows (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Targets share the sum of all sizes by
    weight. A source whose target would exceed max_repeats times its size stops there, and the excess goes
    to the others by weight: with sources ordered by size over weight, those that stop come first, so two
    running sums find the level of all others.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w)
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("w"), F.col("source").asc_nulls_last())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    cap = F.col("source_size") * F.lit(max_repeats)
    share = (total - F.coalesce(F.sum(cap).over(above), F.lit(0))) / F.sum("w").over(rest)  # words for each unit of weight, if all before stop
    rows = rows.withColumns({"cap": cap.cast("double"), "share": share.cast("double")})
    level = F.max(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("share"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


#: Sources up to which a table with a row for each source is broadcast.
SMALL_SOURCES = 10_000


def thresholds(docs: DataFrame, budgets: DataFrame, small: bool = False) -> DataFrame:
    """Rows (source, below): documents whose place is under `below` come to the budget as nearly as whole places can.

    docs: source, place, size. budgets: source, budget (at most the source's size). small: budgets may be
    broadcast. A budget of all words gives 2**60.
    """
    hint = F.broadcast if small else lambda d: d
    none = F.lit(None).cast("long")
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("got"), none.alias("edge"), F.lit(False).alias("done"))
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # of each source only the bucket where its budget runs out is read again
        now = hint(state.where(~F.col("done")).select(F.col("source").alias("of"), "budget", "low", "got"))
        here = docs.join(now, docs["source"].eqNullSafe(now["of"])).where(F.shiftright("place", left + LEVEL_BITS) == F.shiftright("low", left + LEVEL_BITS))
        sums = here.groupBy("of", "budget", "got", F.shiftright("place", left).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("place").alias("least"), F.max("place").alias("most")
        )
        upto = Window.partitionBy("of").orderBy("bucket")
        after = F.col("got") + F.sum("words").over(upto)
        sums = sums.withColumn("after", after)
        # the first bucket that crosses the budget; a source that never does so is taken whole
        hit = sums.groupBy("of").agg(
            F.min_by(F.struct("bucket", "words", "after", "least", "most"), F.when(F.col("after") > F.col("budget"), F.col("bucket"))).alias("x")
        )
        one = (F.col("x.least") == F.col("x.most")) | F.lit(left == 0)
        found = hit.select(
            "of",
            F.when(F.col("x").isNull(), F.lit(1 << HASH_BITS)).when(one, F.col("x.least")).otherwise(F.shiftleft("x.bucket", left)).alias("low_"),
            (F.col("x.after") - F.col("x.words")).alias("got_"), F.when(one, F.col("x.words")).alias("edge_"), (F.col("x").isNull() | one).alias("done_"),
        )
        state = cut(
            state.join(hint(found), state["source"].eqNullSafe(found["of"]), "left").select(
                "source", "budget",
                *[F.when(F.col("done") | F.col("done_").isNull(), F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in ("low", "got", "edge")],
                (F.col("done") | F.coalesce(F.col("done_"), F.lit(True))).alias("done"),
            )
        )
        if state.where(~F.col("done")).isEmpty():
            break
    # one place is left at the boundary: take it if that is nearer to the budget
    nearer = F.coalesce(F.col("got") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("got"), F.lit(False))
    return state.select("source", (F.col("low") + nearer.cast("long")).alias("below"))


def _plan(slim: DataFrame, weights: tuple[float, ...], max_repeats: int) -> tuple[DataFrame, bool]:
    """A row for each source: how often all of it is taken, and the threshold for once more; and whether it may be broadcast."""
    goal = cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    small = goal.count() <= SMALL_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    below = thresholds(slim, goal.select("source", "budget"), small).withColumnRenamed("source", "of")
    return goal.join(below, F.col("source").eqNullSafe(F.col("of"))).select(F.col("of"), "source_size", "target", "whole", "below"), small


def _slim(docs: DataFrame) -> DataFrame:
    columns = {"source": F.col("source").cast("string"), "place": place(F.col("doc_id")), "size": word_count(F.col("text").cast("string"))}
    return docs.select("doc_id", *[c.alias(k) for k, c in columns.items()])


def _taken(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    rows = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return rows.withColumn("taken", F.col("size") * (F.col("whole") + (F.col("place") < F.col("below")).cast("long"))).drop("whole", "below")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for every document.

    docs: doc_id, source, text; other columns are not read. size: words of the text, null has 0. taken: the
    words of this document in the mix, a multiple of its size up to max_repeats times. A source takes all its
    documents as often as its target holds its size, and the rest of the target by hash threshold, so its sum
    misses the target by half of one place at most. Rows that share a doc_id share their place and are taken
    together. Null sources are one source, after all others; a null doc_id has a place like any other. A source
    without words has target 0. An empty table gives an empty table.
    """
    slim = cut(_slim(docs))
    return _taken(slim, *_plan(slim, weights, max_repeats)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents that the mix takes, with their own columns and size, target and taken (as in mix; replaced if there).

    taken / size is how often a document is to be repeated. Documents without words are in no mix.
    """
    plan, small = _plan(cut(_slim(docs)), weights, max_repeats)
    own = docs.drop("size", "target", "taken", "place", "of", "source_size", "whole", "below")
    out = _taken(own.withColumns({"place": place(F.col("doc_id")), "size": word_count(F.col("text").cast("string"))}), plan, small)
    return out.where(F.col("taken") > 0).drop("place", "source_size")


#: The same rows in DuckDB, with a sorted running sum in the thresholds' place. {docs}: a table with doc_id, source, text.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 3 AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s WINDOW o AS (ORDER BY source_size / w, w, source ASC NULLS LAST)),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(share) FROM r WHERE share * w <= cap) * w) AS target FROM r),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM g),
p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS after FROM p),
e AS (
  SELECT b.source, min(place) FILTER (after > budget) AS edge, arg_min(after, place) FILTER (after > budget) AS after,
         arg_min(words, place) FILTER (after > budget) AS words, any_value(budget) AS budget
  FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source GROUP BY b.source),
k AS (SELECT source, CASE WHEN edge IS NULL THEN 1152921504606846976 ELSE edge + CAST(after - budget < budget - (after - words) AS BIGINT) END AS below FROM e)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CAST(place < below AS BIGINT)) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
