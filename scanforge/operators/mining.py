"""Secret signatures and learned rules from declared secrets, and their use on later text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.arrays import scan_left
from scanforge.functions.text import LEFT, SPACES, learned_rule_id, signature

_BEFORE = f"[{SPACES}]*[:=][{SPACES}]*[\"']?"
#: A name, and ahead of it the separator and the value, so that one assignment cannot hide the next.
ASSIGNMENT = rf"({LEFT}[A-Za-z][A-Za-z0-9_]{{0,63}}(?![A-Za-z0-9_]))(?=({_BEFORE})([A-Za-z0-9_\-/+.=]{{4,}}))"
SHAPE = ["length", "entropy", "has_upper", "has_lower", "has_digit", "has_symbol"]


def declared(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows (name, value, ts) of non-empty declared secrets. messages: secrets (map), ts."""
    return messages.select(F.col(ts).alias("ts"), F.explode("secrets").alias("name", "value")).where("value is not null and value <> ''")


def signatures(rows: DataFrame) -> DataFrame:
    """Counts by shape; values are dropped before the shuffle."""
    shaped = rows.select(signature(F.col("value")).alias("s"), "ts").select("s.*", "ts")
    return shaped.groupBy(*SHAPE).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def learned_rules(rows: DataFrame) -> DataFrame:
    """One rule for each normalised name: the earliest name, the least value length, counts and times."""
    slim = rows.select(learned_rule_id(F.col("name")).alias("id"), "name", F.length("value").alias("n"), "ts")
    return slim.groupBy("id").agg(
        F.min_by("name", F.struct("ts", "name")).alias("name"), F.greatest(F.lit(4), F.least(F.lit(8192), F.min("n"))).alias("min_value_length"),
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def total_signatures(rows: DataFrame) -> DataFrame:
    """Signatures of several batches as one table: counts add up, times are the outermost."""
    return rows.groupBy(*SHAPE).agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def total_rules(rows: DataFrame) -> DataFrame:
    """Learned rules of several batches as one table."""
    return rows.groupBy("id").agg(
        F.min_by("name", F.struct("first_seen", "name")).alias("name"), F.min("min_value_length").alias("min_value_length"), F.sum("occurrences").alias("occurrences"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def merge_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    return total_signatures(old.unionByName(new))


def merge_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    return total_rules(old.unionByName(new))


def most_frequent(table: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k signatures or learned rules that occurred most often, ties by the columns given: a top-k, not a sort of all."""
    return table.orderBy(F.desc("occurrences"), *tie).limit(k)


def assignments(text: Column) -> Column:
    """array<struct<name,start,end,value>> of everything that looks like NAME = value."""
    groups = [F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(i)).alias(x) for i, x in ((1, "n"), (2, "b"), (3, "v"))]
    gaps = F.transform(F.split(text, ASSIGNMENT, -1), F.length).alias("g")  # one more, behind the last match
    steps = F.filter(F.arrays_zip(*groups, gaps), lambda x: x["n"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["g"] + F.length(x["n"])
        start = end + F.length(x["b"])
        return end, F.array(F.struct(x["n"].alias("name"), start.alias("start"), (start + F.length(x["v"])).alias("end"), x["v"].alias("value")))

    out = "struct<name:string,start:int,end:int,value:string>"
    return F.when(text.rlike("[:=]"), scan_left(steps, F.lit(0), step, out)).otherwise(F.array().cast(f"array<{out}>"))


#: Rules up to which their table is broadcast.
SMALL_RULES = 100_000


def learned_hits(texts: DataFrame, rules: DataFrame, row_id: str, text: str, ts: str | None = None) -> DataFrame:
    """Rows (row_id, rule_id, start, end): values after learned names, long enough, with a rule seen by then.

    Of hits of one name, those that start inside an earlier one are dropped.
    """
    when = [F.col(ts).alias("at")] if ts else []
    hits = texts.select(row_id, *when, F.explode(assignments(F.coalesce(F.col(text), F.lit("")))).alias("a")).select(row_id, *(["at"] if ts else []), F.lower("a.name").alias("key"), "a.start", "a.end")
    known = rules.select(F.lower("name").alias("key"), F.col("id").alias("rule_id"), "min_value_length", "first_seen")
    joined = hits.join(F.broadcast(known) if rules.count() <= SMALL_RULES else known, "key").where(F.col("end") - F.col("start") >= F.col("min_value_length"))
    if ts:
        joined = joined.where(F.col("first_seen") <= F.col("at"))
    ordered = joined.groupBy(row_id, "rule_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))  # hits of one rule in one text
    free = lambda cursor, x: x["start"] >= cursor
    step = lambda c, x: (F.when(free(c, x), x["end"]).otherwise(c), F.when(free(c, x), F.array(x)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    sweep = scan_left(F.col("s"), F.lit(0), step, "struct<start:int,end:int>")
    return ordered.select(row_id, "rule_id", F.inline(sweep))


def learned_findings(hits: DataFrame, row_id: str) -> DataFrame:
    """Rows (row_id, learned): hits as findings, to join to the texts and give to scan.evaluate."""
    f = F.struct(F.col("rule_id").alias("id"), F.lit("secret").alias("category"), F.lit("high").alias("severity"), "start", "end", F.lit(500).alias("ordinal"))
    return hits.groupBy(row_id).agg(F.array_sort(F.collect_list(f)).alias("learned"))
