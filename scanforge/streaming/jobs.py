"""Structured Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from scanforge.operators import mining, runs, scan, validate
from scanforge.operators.policy import Policy
from scanforge.sources.batches import BatchTables


def scan_stream(messages: DataFrame, policy: Policy = Policy(), text: str = "content", row_id: str = "id") -> DataFrame:
    """The same columns as in batch; no state."""
    return scan.evaluate(messages, text, policy, row_id=row_id).drop("execution")


def scan_events(scanned: DataFrame, row_id: str = "id", ts: str = "created_at") -> DataFrame:
    """The safety events (row_id, ts, seq, boundary, decision, reason, metadata) that scanned messages give rise to: one if it was redacted, one for the decision."""
    never = {c: F.lit(None).cast("timestamp") for c in ("stopped_at", "timed_out_at", "over_at")}
    none = F.lit(None).cast("map<string,string>")
    facts = scanned.select(F.col(row_id).alias("run_id"), F.lit(None).cast("string").alias("agent_id"), F.col(ts).alias("ts"), "was_redacted", "decision", "reason", runs.audit_metadata(F.col("findings"), none).alias("metadata"))
    events = runs.safety_events(facts.withColumns({"scanned": F.lit(True), "status": F.lit("running"), **never}))
    return events.drop("agent_id").withColumnRenamed("run_id", row_id).withColumnRenamed("ts", ts)


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    def once(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            step(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_stream(messages: DataFrame, store: BatchTables, checkpoint: str, policy: Policy = Policy(), ts: str = "created_at") -> StreamingQuery:
    """Scan messages (id, content, ts) into two tables of store: `trace`, without the text as it came, and `events`.

    Both stand at the same batch at any time, and a batch that is tried again is in them once.
    """

    def step(batch: DataFrame, number: int) -> None:
        store.write(number, _scanned_tables(scan.evaluate(batch, "content", policy), ts))

    return _each_batch(messages, step, checkpoint)


def _scanned_tables(scanned: DataFrame, ts: str) -> dict[str, DataFrame]:
    return {"trace": scanned.drop("content", "secrets"), "events": scan_events(scanned, ts=ts)}


def mine_stream(messages: DataFrame, store: BatchTables, checkpoint: str, ts: str = "created_at") -> StreamingQuery:
    """Count the declared secrets of each batch into the tables `rules` and `signatures` of store; see learned and shapes for their sums."""

    def step(batch: DataFrame, number: int) -> None:
        found = mining.declared(batch, ts)
        store.write(number, {"rules": mining.learned_rules(found), "signatures": mining.signatures(found)})

    return _each_batch(messages, step, checkpoint)


def learned(store: BatchTables, before: int | None = None) -> DataFrame | None:
    """The learned rules of all batches that are done (before: of earlier ones than this)."""
    rows = store.read("rules", before)
    return None if rows is None else mining.total_rules(rows)


def shapes(store: BatchTables) -> DataFrame | None:
    """The signatures of all batches that are done."""
    rows = store.read("signatures")
    return None if rows is None else mining.total_signatures(rows)


#: How the tables of mine_stream are compacted.
TOTALS = {"rules": mining.total_rules, "signatures": mining.total_signatures}


def scan_and_learn_stream(messages: DataFrame, store: BatchTables, checkpoint: str, ts: str = "created_at", policy: Policy = Policy()) -> StreamingQuery:
    """Each batch is scanned with all rules learned so far, its own declarations included: tables `rules`, `trace` and `events` of store.

    A batch that is tried again is scanned with the rules of the batches before it, as it was the first time.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not store.has(number):
            new, scanned = learn_then_scan(batch, learned(store, number), ts, policy)
            store.write(number, {"rules": new, **_scanned_tables(scanned, ts)})

    return _each_batch(messages, step, checkpoint)


def learn_then_scan(batch: DataFrame, known: DataFrame | None, ts: str = "created_at", policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Of one micro-batch (id, content, secrets, ts): the rules that it declares, and its rows scanned with those and the known ones."""
    new = mining.learned_rules(mining.declared(batch, ts))
    hits = mining.learned_hits(batch, new if known is None else mining.merge_rules(known, new), "id", "content", ts)
    rows = batch.join(mining.learned_findings(hits, "id"), "id", "left")
    return new, scan.evaluate(rows, "content", policy, learned=F.col("learned")).drop("learned")


MESSAGE = "id string, content string, secrets map<string,string>, created_at timestamp"


def split_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejected) of lines (value, source): JSON objects with the fields of MESSAGE, as they are sent.

    Rejected, in this order of checks: what is no such object, unknown fields, content that is no text of 1 to 50,000
    characters, and secrets whose names, values or number break their contract. A rejected row says where it came from,
    its size and which fields fail, and holds nothing of the line.
    """
    parsed = lines.withColumn("m", F.from_json("value", f"{MESSAGE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    v = F.try_parse_json("value")
    rows = parsed.select("source", F.octet_length("value").alias("bytes"), "value", "m.*", F.schema_of_variant(v).alias("kind"), F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")).alias("content_kind"))
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    whole = [("body", "must be a JSON object", F.col("_bad").isNull() & F.col("kind").startswith("OBJECT"))]
    checks = [*validate.known_fields("value", names), ("content", "must be a text", F.col("content_kind") == "STRING"), *validate.message_checks(), *validate.secret_checks()]
    own = F.when(F.size(validate.violations(whole)) > 0, validate.violations(whole)).otherwise(validate.violations([("body" if f == "value" else f, m, ok) for f, m, ok in checks]))
    marked = rows.withColumn("violations", own)
    return marked.where(F.size("violations") == 0).select(*names), marked.where(F.size("violations") > 0).select("source", "bytes", "violations")


def ingest_stream(spark: SparkSession, path: str, store: BatchTables, checkpoint: str) -> StreamingQuery:
    """Read messages as JSON lines from the files of a folder into two tables of store: `messages` and `rejected` (see split_messages)."""
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("source"))

    def step(batch: DataFrame, number: int) -> None:
        good, bad = split_messages(batch)
        store.write(number, {"messages": good, "rejected": bad})

    return _each_batch(lines, step, checkpoint)


class RunTimeout(StatefulProcessor):
    """Emits CANCELLED for a run that has no completion within the time limit of its start."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, done = None, False
        for pdf in rows:
            done = done or bool((pdf["event"] == "completed").any())
            begun = pdf.loc[pdf["event"] == "started", "ts"]
            if len(begun):
                ms = int(begun.min().timestamp() * 1000)
                first = ms if first is None else min(first, ms)
        if done:
            self._forget()
        elif first is not None and not self.started.exists():
            self.started.update((first,))
            self.handle.registerTimer(first + self.limit_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self._forget()
        yield pd.DataFrame({"run_id": [key[0]], "decision": ["CANCELLED"], "at_ms": [at]})

    def _forget(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.started.clear()

    def close(self) -> None:
        pass


def timeouts(events: DataFrame, limit_ms: int = 600_000, delay: str = "1 minute") -> DataFrame:
    """Rows (run_id, decision, at_ms) for runs that outlive the limit. events: run_id, event, ts."""
    return (
        events.withWatermark("ts", delay).groupBy("run_id")
        .transformWithStateInPandas(RunTimeout(limit_ms), "run_id string, decision string, at_ms long", "Append", "EventTime")
    )


def event_windows(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Safety events for each time window and decision; rows later than the delay are dropped by the watermark."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "decision").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "decision", "n")


def read_parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
