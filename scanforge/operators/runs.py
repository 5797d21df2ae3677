"""Agent run logs to summaries, outcomes, safety events and audit marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions.text import trimmed
from scanforge.operators.policy import Policy

from . import scan

EVENT_SCHEMA = "type string, thread_id string, item struct<type:string,text:string>, usage struct<input_tokens:double,cached_input_tokens:double,output_tokens:double>, message string, error string"
# The bucket of each tool item.
COMMANDS, FILE_EDITS, OTHER = ("command_execution",), ("file_change",), ("mcp_tool_call", "web_search", "function_call")
OUTPUT_CAP, TIMEOUT_MS, STDERR_CHARS = 2_097_152, 600_000, 16_384
# Who reports an event, the reasons of events, and the errors of runs.
SERVICE, RUNNER = "SERVICE", "RUNNER"
REDACTED, USER_STOP, TIME_IS_UP, TOO_MUCH = "Secret removed from trace", "User stopped execution", "Timeout exceeded", "Output limit exceeded"
CANCELLED, LATE, EXCEEDED, NO_MESSAGE = "Run cancelled", "Codex timed out after {ms} ms", "Codex output exceeded CODEX_MAX_OUTPUT_BYTES", "Codex completed without an agent message"
EXITED, RESTARTED = "Codex exited with code ", "Server restarted while this run was active"
UNKNOWN_ERROR = "The runtime reported an unknown error"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows (run_id, line_no, e) of lines that are JSON objects; the others are skipped."""
    e = F.from_json("line", EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = F.get_json_object("line", "$").startswith("{")
    rows = lines.where(F.coalesce(ok, F.lit(False))).select("run_id", "line_no", e.alias("e"), F.get_json_object("line", "$.item").startswith("{").alias("item_ok"))
    return rows.where(F.col("e").isNotNull())


def summarise(lines: DataFrame) -> DataFrame:
    """One row for each run with a readable line: last thread, message and error, usage (null: not reported), steps and tool calls (0 where there are none)."""
    e = F.col("e")
    done = (e["type"] == "item.completed") & F.coalesce("item_ok", F.lit(False))
    kind = e["item"]["type"]
    last = lambda value, where: F.max_by(value, F.when(where, F.col("line_no")))
    count = lambda kinds: F.count_if(done & kind.isin(*kinds)).cast("int")
    steps = F.count_if(done)
    message = done & (kind == "agent_message") & e["item"]["text"].isNotNull()
    usage = F.struct(*[F.col(f"e.usage.{c}").cast("long").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens")])
    error = F.coalesce(e["message"], e["error"], F.lit(UNKNOWN_ERROR))
    out = parse_lines(lines).groupBy("run_id").agg(
        last(e["thread_id"], (e["type"] == "thread.started") & e["thread_id"].isNotNull()).alias("thread_id"),
        last(trimmed(e["item"]["text"]), message).alias("message"), last(error, e["type"] == "error").alias("last_error"),
        steps.cast("int").alias("step_count"), F.struct(count(COMMANDS).alias("commands"), count(FILE_EDITS).alias("file_edits"), count(OTHER).alias("other")).alias("tool_calls"),
        last(usage, (e["type"] == "turn.completed") & e["usage"].isNotNull()).alias("usage"),
    )
    return out.withColumn("message", F.when(F.col("message") != "", F.col("message")))


#: Rows of one key that a window holds at most, where their numbers follow each other.
SEGMENT = 65_536


def _carried(rows: DataFrame, key: str, segment: Column, value: Column, total, later: bool = False) -> DataFrame:
    """Adds segment_, and carried_: total(value) over all earlier segments of the key (later: over the later ones).

    The first of two passes: segments are summed before they meet in a window, so a key with very many rows is a few totals
    there. The second pass is a window inside (key, segment_), which the join has already brought together. Rows without a
    key or a place in its order are left out.
    """
    rows = rows.withColumn("segment_", segment)
    sums = rows.groupBy(key, "segment_").agg(total(value).alias("sum_"))
    w = Window.partitionBy(key).orderBy(F.desc("segment_") if later else "segment_").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.withColumn("carried_", total(F.col("sum_")).over(w)).drop("sum_"), [key, "segment_"])


def capped_output(chunks: DataFrame, cap: int = OUTPUT_CAP, segment: int = SEGMENT) -> DataFrame:
    """Chunks (run_id, seq, chunk, ...) with total_bytes so far; over: the first one past the cap; dropped: that one and all later ones."""
    rows = _carried(chunks, "run_id", F.floor(F.col("seq") / segment), F.octet_length("chunk"), F.sum)
    w = Window.partitionBy("run_id", "segment_").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("carried_", F.lit(0)) + F.coalesce(F.sum(F.octet_length("chunk")).over(w), F.lit(0))
    out = rows.withColumn("total_bytes", total).drop("segment_", "carried_")
    past = F.col("total_bytes") > cap
    return out.withColumns({"over": past & (F.col("total_bytes") - F.coalesce(F.octet_length("chunk"), F.lit(0)) <= cap), "dropped": past})


def stderr_tail(chunks: DataFrame, chars: int = STDERR_CHARS, segment: int = SEGMENT) -> DataFrame:
    """The last characters of each run's stderr: only the chunks that reach into the tail are gathered."""
    rows = _carried(chunks.where("stream = 'stderr' and chunk <> ''"), "run_id", F.floor(F.col("seq") / segment), F.length("chunk"), F.sum, later=True)
    w = Window.partitionBy("run_id", "segment_").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce("carried_", F.lit(0)) + F.coalesce(F.sum(F.length("chunk")).over(w), F.lit(0))
    tail = rows.where(F.coalesce("carried_", F.lit(0)) < chars).withColumn("behind", behind).where(F.col("behind") < chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")  # `chars` chunks at most
    return tail.groupBy("run_id").agg(F.right(text, F.lit(chars)).alias("stderr"))


def run_facts(starts: DataFrame, chunks: DataFrame, stops: DataFrame, exits: DataFrame, as_of: Column, timeout_ms: int = TIMEOUT_MS, cap: int = OUTPUT_CAP) -> DataFrame:
    """One row for each start: started_at, exited_at, exit_code, and when a user stopped the run, its time was up and its
    output passed the cap (stopped_at, timed_out_at, over_at; null: did not happen), and which came first (first_limit).

    starts: run_id, ts. chunks: run_id, seq, ts, chunk. stops: run_id, ts. exits: run_id, ts, code. What is told of a run
    before its start or after its exit does not count; a run without an exit is open until as_of. All limits that are
    reached before the exit count, as ending a process takes a while. Null times count as never, unknown runs are left out.
    """
    first = lambda df, name: df.groupBy("run_id").agg(F.min("ts").alias(name))
    ended = exits.groupBy("run_id").agg(F.min("ts").alias("exited_at"), F.min_by("code", F.struct("ts", "code")).alias("exit_code"))
    runs = first(starts, "started_at").join(ended, "run_id", "left")
    runs = runs.withColumns({"until_": F.least("exited_at", as_of), "timer_": F.col("started_at") + F.make_dt_interval(secs=F.lit(timeout_ms / 1000))})
    span = runs.select("run_id", "started_at", "until_")
    inside = lambda df: df.join(span, "run_id").where((F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.col("until_"))).drop("started_at", "until_")
    over = first(capped_output(inside(chunks), cap).where("over"), "over_at")
    out = runs.join(first(inside(stops), "stopped_at"), "run_id", "left").join(over, "run_id", "left")
    out = out.withColumn("timed_out_at", F.when(F.col("timer_") <= F.col("until_"), F.col("timer_"))).drop("timer_", "until_")
    limits = F.array_sort(F.filter(F.array(*[F.struct(F.col(c).alias("ts"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (c, n) in enumerate(_LIMITS.items())]), lambda x: x["ts"].isNotNull()))
    return out.withColumn("first_limit", F.get(limits, F.lit(0))["name"])


_LIMITS = {"stopped_at": "cancelled", "timed_out_at": "timed_out", "over_at": "output_exceeded"}


def outcomes(facts: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Adds outcome, status and error. facts: stopped_at, timed_out_at, over_at (see run_facts), exit_code, message, last_error, stderr.

    A user's stop goes before the time, the time before the output, whichever came first. A null exit code is 1, as of a killed process.
    """
    why = (
        F.when(F.col("stopped_at").isNotNull(), F.lit("cancelled")).when(F.col("timed_out_at").isNotNull(), F.lit("timed_out")).when(F.col("over_at").isNotNull(), F.lit("output_exceeded"))
        .when(F.coalesce("exit_code", F.lit(1)) != 0, F.lit("non_zero_exit")).when(F.coalesce("message", F.lit("")) == "", F.lit("no_message")).otherwise(F.lit("completed"))
    )
    status = F.when(F.col("outcome").isin("cancelled", "completed"), F.col("outcome")).otherwise(F.lit("failed"))
    detail = F.coalesce("last_error", trimmed(F.coalesce("stderr", F.lit(""))))
    exited = F.concat(F.lit(EXITED), F.coalesce("exit_code", F.lit(1)).cast("string"), F.lit(": "), detail)
    told = {"cancelled": F.lit(CANCELLED), "timed_out": F.lit(LATE.format(ms=timeout_ms)), "output_exceeded": F.lit(EXCEEDED), "non_zero_exit": exited, "no_message": F.lit(NO_MESSAGE)}
    text = reduce(lambda a, k: a.when(F.col("outcome") == k, told[k]), told, F.when(F.lit(False), F.lit(None).cast("string")))
    return facts.withColumn("outcome", why).withColumn("status", status).withColumn("error", text)


METADATA = "struct<finding_ids:array<string>,finding_categories:array<string>,secret_names:array<string>>"


def audit_metadata(findings: Column, secrets: Column) -> Column:
    """Distinct ids and categories of findings in the order they were found, and the declared names; never a value."""
    each = lambda field: F.array_distinct(F.transform(findings, lambda f: f[field]))
    names = F.coalesce(F.map_keys(secrets), F.array().cast("array<string>"))
    return F.struct(each("id").alias("finding_ids"), each("category").alias("finding_categories"), names.alias("secret_names"))


_EVENT = f"struct<boundary:string,decision:string,reason:string,metadata:{METADATA}>"


def _event(boundary: str, decision: Column | str, reason: Column | str, metadata: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    more = (F.lit(None) if metadata is None else metadata).cast(METADATA)
    return F.struct(F.lit(boundary).alias("boundary"), lit(decision).alias("decision"), lit(reason).alias("reason"), more.alias("metadata"))


def runner_events() -> Column:
    """array of the runner's own events in the order in which they happened, of stopped_at, timed_out_at and over_at; a clean run has none."""
    of = (("stopped_at", "CANCELLED", USER_STOP), ("timed_out_at", "CANCELLED", TIME_IS_UP), ("over_at", "BLOCK", TOO_MUCH))
    timed = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("at"), F.lit(i).alias("i"), _event(RUNNER, d, r).alias("e"))) for i, (c, d, r) in enumerate(of)])
    return F.transform(F.array_sort(F.filter(timed, lambda x: x.isNotNull())), lambda x: x["e"].cast(_EVENT))


def safety_events(runs: DataFrame) -> DataFrame:
    """Rows (run_id, agent_id, ts, seq, boundary, decision, reason, metadata); seq counts from 1 in each run.

    runs: run_id, agent_id, ts, scanned, was_redacted, decision, reason, status, stopped_at, timed_out_at, over_at (see
    run_facts), and maybe metadata (see audit_metadata), which the event of the scan's decision carries. A run that was
    cancelled before its scan has its end alone, a blocked one never runs, one that still runs has no end.
    """
    scanned, blocked = F.col("scanned"), F.col("decision") == "BLOCK"
    ran = scanned & ~blocked
    ended = F.when(F.col("status") == "cancelled", F.lit("CANCELLED")).otherwise(F.lit("ALLOW"))
    metadata = F.col("metadata") if "metadata" in runs.columns else None
    over = (ran | ~scanned) & F.col("status").isin("completed", "failed", "cancelled")
    none = F.array().cast(f"array<{_EVENT}>")
    some = lambda condition, event: F.when(condition, F.array(event.cast(_EVENT))).otherwise(none)
    events = F.concat(
        some(scanned & F.col("was_redacted"), _event(SERVICE, "REDACT", REDACTED)), some(scanned, _event(SERVICE, F.col("decision"), F.col("reason"), metadata)),
        F.when(ran, runner_events()).otherwise(none), some(over, _event(SERVICE, ended, F.concat(F.lit("Run "), F.col("status")))),
    )
    return runs.select("run_id", "agent_id", "ts", F.posexplode(events).alias("seq", "e")).select("run_id", "agent_id", "ts", (F.col("seq") + 1).alias("seq"), "e.*")


def stored_trace(runs: DataFrame, declared: DataFrame, policy: Policy = Policy(), allow_partial: bool = False) -> DataFrame:
    """Runs as they are kept: the prompt redacted, output and error redacted and then rid of the run's declared values.

    runs: run_id, prompt, output, error, status, and any other columns, which pass through. declared: run_id, secrets (map);
    where a run has several rows, all their values count, longer ones first. The error of a cancelled run is fixed. Null
    texts stay null; an unknown run declares none.
    """
    maps = declared.where(F.col("secrets").isNotNull()).groupBy("run_id").agg(F.collect_list("secrets").alias("m"))  # what one run declares
    every = F.array_distinct(F.flatten(F.transform("m", lambda m: F.map_values(m))))
    longest = F.transform(F.array_sort(F.transform(every, lambda v: F.struct((-F.length(v)).alias("less"), v.alias("v")))), lambda x: x["v"])
    values = maps.select("run_id", F.when(F.size("m") == 1, F.map_values(F.get("m", F.lit(0)))).otherwise(longest).alias("__values"))
    rows = runs.join(values, "run_id", "left")
    clean = lambda c: F.when(F.col(c).isNotNull(), scan.scrub_values(scan.redact_text(F.col(c), policy), F.col("__values"), allow_partial))
    error = F.when(F.col("status") == "cancelled", F.lit(CANCELLED)).otherwise(clean("error"))
    prompt = F.when(F.col("prompt").isNotNull(), scan.redact_text(F.col("prompt"), policy))
    return rows.withColumns({"prompt": prompt, "output": clean("output"), "error": error}).drop("__values")


def rows_of(rows: DataFrame, known: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows (messages, runs, events) of the keys that are asked for; a key that `known` does not hold is an error.

    known, asked: a column named key.
    """
    wanted = asked.select(key).distinct().join(known.select(key, F.lit(True).alias("__there")).distinct(), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.join(wanted.where(F.coalesce("__there", missing)).select(key), key, "left_semi")


def timeline(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return events.withColumn("seq_no", F.row_number().over(w))


def badges(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (run_id, badge). events: run_id, ts, event_id, decision. runs: run_id, status."""
    last = events.groupBy("run_id").agg(F.max_by("decision", F.struct("ts", "event_id")).alias("last"))
    badge = F.when((F.col("status") == "blocked") | (F.col("last") == "BLOCK"), F.lit("Blocked")).when((F.col("status") == "cancelled") | (F.col("last") == "CANCELLED"), F.lit("Run stopped")).otherwise(F.lit("Protected"))
    return runs.join(last, "run_id", "left").select("run_id", badge.alias("badge"))


def event_counts(events: DataFrame) -> DataFrame:
    """Counts by boundary and decision, with all subtotals, and the runs and agents affected."""
    return events.cube("boundary", "decision").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"), F.count_distinct("agent_id").alias("agents"))


def latest_runs(runs: DataFrame, *columns: str) -> DataFrame:
    newest = F.max_by(F.struct("run_id", *columns), F.struct("created_at", "run_id"))
    return runs.groupBy("agent_id").agg(newest.alias("r")).select("agent_id", "r.*")


def overlapping_runs(runs: DataFrame, segment_seconds: int = 86_400) -> DataFrame:
    """Runs that begin before an earlier run of their agent has ended. runs: run_id, agent_id, started_at, ended_at.

    Windows hold an agent's runs of one segment of time, a day if not told otherwise.
    """
    rows = _carried(runs, "agent_id", F.floor(F.unix_micros("started_at") / (segment_seconds * 1_000_000)), F.col("ended_at"), F.max)
    w = Window.partitionBy("agent_id", "segment_").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    busy = rows.withColumn("busy_until", F.greatest("carried_", F.max("ended_at").over(w))).drop("segment_", "carried_")
    return busy.where(F.col("started_at") < F.col("busy_until"))


def recover(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that a restart found queued or running become cancelled."""
    lost = F.col("status").isin("queued", "running")
    return runs.withColumns({"completed_at": F.when(lost, now).otherwise(F.col("completed_at")), "error": F.when(lost, F.lit(RESTARTED)).otherwise(F.col("error")), "status": F.when(lost, F.lit("cancelled")).otherwise(F.col("status"))})


def recover_agents(agents: DataFrame, now: Column) -> DataFrame:
    """Agents (status, updated_at) that a restart found busy are ready again."""
    busy = F.col("status") == "busy"
    return agents.withColumns({"updated_at": F.when(busy, now).otherwise(F.col("updated_at")), "status": F.when(busy, F.lit("ready")).otherwise(F.col("status"))})


def newest_first(rows: DataFrame, time: str, id: str) -> DataFrame:
    """Agents by updated_at or runs by created_at, the newest first, ties by id."""
    return rows.orderBy(F.desc(time), id)


def status_after(agent: Column, run: Column) -> Column:
    """An agent's status after a run; one that was stopped stays so on failure or cancellation."""
    stays = (agent == "stopped") & run.isin("failed", "cancelled")
    return F.when(stays, agent).when(run == "failed", F.lit("error")).when(run.isin("completed", "blocked", "cancelled"), F.lit("ready")).otherwise(agent)


def purge(agents: DataFrame, gone: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Agents and the given tables without the agents of `gone`; safety events are kept by not passing them."""
    return [t.join(gone.select("agent_id").distinct(), "agent_id", "left_anti") for t in (agents, *others)]


def audit_mart(runs: DataFrame, agents: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each run, with its agent and counts of messages and events; both sides are summed before they are joined."""
    m = messages.groupBy("run_id").agg(F.count("*").alias("n_messages"))
    e = events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("decision") == "BLOCK").alias("n_blocks"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_messages", "n_events", "n_blocks")}
    return runs.join(agents, "agent_id").join(m, "run_id", "left").join(e, "run_id", "left").withColumns(zero)
