"""State database, run logs and published tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AGENT = "id string, name string, description string, instructions string, status string, workspacePath string, threadId string, lastError string, createdAt string, updatedAt string"
MESSAGE = "id string, agentId string, runId string, role string, content string, createdAt string"
RUN = (
    "id string, agentId string, status string, prompt string, output string, error string, usage struct<inputTokens:bigint,cachedInputTokens:bigint,outputTokens:bigint>, "
    "stepCount int, toolCalls struct<commands:int,fileEdits:int,other:int>, startedAt string, completedAt string, createdAt string"
)
EVENT = "id string, runId string, userId string, agentId string, boundary string, decision string, reason string, metadata struct<findingIds:array<string>,findingCategories:array<string>,secretNames:array<string>>, timestamp string"
SIGNATURE = "length int, entropy double, hasUpper boolean, hasLower boolean, hasDigit boolean, hasSymbol boolean, occurrences bigint, firstSeenAt string, lastSeenAt string"
LEARNED = "id string, name string, minValueLength int, occurrences bigint, firstSeenAt string, lastSeenAt string"
TABLES = {"agents": AGENT, "messages": MESSAGE, "runs": RUN, "safetyEvents": EVENT, "secretSignatures": SIGNATURE, "learnedSecretPatterns": LEARNED}
TIMES = ("createdAt", "updatedAt", "startedAt", "completedAt", "timestamp", "firstSeenAt", "lastSeenAt")
PUBLIC_EVENT = ("id", "runId", "agentId", "boundary", "decision", "reason", "timestamp")


def _struct(ddl: str) -> str:
    """struct<...> of a column list."""
    return "struct<" + ",".join(":".join(x.strip().split(" ", 1)) for x in _split(ddl)) + ">"


def _split(ddl: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [*parts, now]


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of a state database file. Absent arrays are empty; another version than 1 is an error."""
    schema = "version int, " + ", ".join(f"{k} array<{_struct(v)}>" for k, v in TABLES.items())
    raw = spark.read.schema(schema).json(path, multiLine=True)
    bad = F.raise_error(F.concat(F.lit("unsupported state version "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))
    checked = raw.withColumn("agents", F.when((F.col("version") == 1) & F.col("agents").isNotNull(), F.col("agents")).otherwise(bad.cast(f"array<{_struct(AGENT)}>")))
    # a database that is not valid is an error whichever table is read
    first = F.when((F.col("version") == 1) & F.col("agents").isNotNull(), F.lit(True)).otherwise(bad.cast("boolean"))
    out = {}
    for name, ddl in TABLES.items():
        rows = checked.where(first).select(F.inline(F.coalesce(F.col(name), F.array().cast(f"array<{_struct(ddl)}>"))))
        out[name] = rows.withColumns({c: F.to_timestamp(c) for c in rows.columns if c in TIMES})
    return out


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long, tables map<string,long>").parquet(f"{path}/published")
    except AnalysisException:  # nothing was published yet
        return None


def _newest(spark: SparkSession, path: str):
    done = _versions(spark, path)
    return None if done is None else done.orderBy(F.desc("version")).first()


def publish(tables: dict[str, DataFrame], path: str) -> int:
    """Publish tables together, all of them or nothing, and return their version.

    Each table is written to a folder of the new version. Only then is one row added to the table `published`, with
    the version that each table has now, which Spark's commit makes visible at once; readers go by its newest row. Tables
    that are not given stay as they were published last. A publication that fails on the way leaves the one before
    as it was. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    last = _newest(spark, path)
    version = (last.version if last else 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    now = (last.tables if last else {}) | dict.fromkeys(tables, version)
    row = spark.createDataFrame([(version, now)], "version long, tables map<string,long>")
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables as they are published now; none, if nothing was."""
    last = _newest(spark, path)
    return {} if last is None else {name: spark.read.parquet(f"{path}/{version}/{name}") for name, version in last.tables.items()}


def _bare(path: Column | str):
    """A path without its scheme and host."""
    form = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    return re.sub(form, "", path) if isinstance(path, str) else F.regexp_replace(path, form, "")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (run_id, line_no, line) of the files named *.jsonl below a folder.

    A run is named by its file's place below the folder, so files of one name in two folders are two runs. Line numbers
    count from 0 without gaps, over all the parts in which Spark reads a long file: each part is counted, the counts of
    a file's parts are summed up, and lines are numbered within their part alone.
    """
    text = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    lines = text.withColumn("at", F.monotonically_increasing_id())  # ascending within a part
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("file", "part").orderBy("at")) - 1
    numbered = lines.join(counts.withColumn("before", before).drop("n"), ["file", "part"]).withColumn("line_no", F.col("before") + within)
    root = _bare(path).rstrip("/")
    below = F.substring(_bare(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))), len(root) + 2, 1 << 20)
    return numbered.select(F.regexp_replace(below, r"\.jsonl$", "").alias("run_id"), "line_no", F.col("value").alias("line"))


def public_events(events: DataFrame) -> DataFrame:
    """The columns of the public feed, and nothing else."""
    return events.select(*PUBLIC_EVENT)
