"""All registered queries outside the training-data subpackage, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.functions import text as T
from scanforge.functions.rules import FRAMEWORKS, PII_LABEL, SECRET_LABEL, SECRET_RULES, catalogue
from scanforge.operators import confidence, history, mining, runs, scan, validate
from scanforge.operators.policy import Policy

from . import base
from .base import CHUNKS, DECLARED, DOCUMENTS, EVENTS, MESSAGES, PROMPTS, RUNS, SAFETY_LOG, quoted

ALL = Policy(frameworks=FRAMEWORKS)
#: Rules whose matches in the test data never overlap, so that plain replacement is their oracle.
PLAIN = Policy(frameworks=(), enabled_ids=("us-ssn", "ipv4-address"))
_S = base.SPACES_RE2

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LUHN = (
    "len(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(regexp_replace(v, '[^0-9]', '', 'g'))), lambda i: "
    "CASE WHEN i % 2 = 0 THEN reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i + 1]::INT ELSE (2 * reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i + 1]::INT) // 10 + (2 * reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i + 1]::INT) % 10 END)) % 10 = 0"
)
_ABA = "list_sum(list_transform(range(9), lambda i: v[i + 1]::INT * [3, 7, 1][i % 3 + 1])) % 10 = 0"
# The PII rules again, written for RE2.
#: The PII rules in RE2's dialect, with their gates on a match v.
PII_SQL = {
    "email-address": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "true"),
    "phone-number": (rf"\b\+?[0-9][0-9{_S[1:-1]}()-]{{7,}}[0-9]\b", "len(regexp_replace(v, '[^0-9]', '', 'g')) >= 10"),
    "us-ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true"),
    "credit-card-number": (r"\b(?:[0-9][ -]?){13,19}\b", _LUHN),
    "ipv4-address": (rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "true"),
    "date-of-birth": (rf"(?i)\b(?:DOB|date of birth|birth{_S}*date|born on){_S}*[:-]?{_S}*(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\b", "true"),
    "medical-record-number": (rf"(?i)\b(?:MRN|medical record(?:{_S}+number)?){_S}*[:#]?{_S}*[0-9]{{6,10}}\b", "true"),
    "medicare-beneficiary-id": (r"\b[1-9][A-Z0-9]{3}-[A-Z0-9]{3}-[A-Z0-9]{4}\b", "true"),
    "us-bank-routing-number": (r"\b[0-9]{9}\b", _ABA),
    "us-drivers-license-generic": (rf"(?i)\b(?:DL|driver'?s?{_S}*licen[cs]e){_S}*[:#]?{_S}*[A-Z0-9]{{6,12}}\b", "true"),
}
_PII_SEVERITY = {"us-ssn": "high", "credit-card-number": "high", "date-of-birth": "high", "medical-record-number": "high", "medicare-beneficiary-id": "high", "us-bank-routing-number": "high", "us-drivers-license-generic": "medium"}


def _matches(source: str, rules: dict[str, tuple[str, str]]) -> str:
    """SQL for rows (doc_id, id, v): all matches of rules."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {quoted(k)} AS id, v FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(p)})) AS v FROM {source}) WHERE {gate}" for k, (p, gate) in rules.items()
    )


def _spans(source: str, rules: dict[str, tuple[str, str]]) -> str:
    """SQL for rows (doc_id, id, start, end) of matches, from the lengths of what lies between them."""
    one = (
        "SELECT doc_id, {id} AS id, s AS start, s + len(v) AS end_ FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: "
        "list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))) AS s, unnest(m) AS v "
        "FROM (SELECT doc_id, regexp_extract_all(text, {re}) AS m, string_split_regex(text, {re}) AS p FROM {source})) WHERE {gate}"
    )
    return " UNION ALL ".join(one.format(id=quoted(k), re=quoted(p), source=source, gate=g) for k, (p, g) in rules.items())


def _re2(pattern: str) -> str:
    return pattern.replace(T.LEFT, r"\b").replace(T.RIGHT, r"\b")


# The injection phrases again, written out for RE2, in catalogue order.
#: (id, severity, pattern) on text with single blanks.
INJECTION_SQL = (
    ("safety-policy-bypass", "critical", r"(ignore|disable|turn off|bypass|do not follow) ((all|the) )?(safety (rule|rules|check|checks|filter)|redaction|security (rule|rules|check|checks))"),
    ("environment-secret-exfiltration", "high", r"(print|show|display|output|dump|reveal) (all )?(environment variable|environment variables|env var|env vars|hidden value|hidden values|secret|secrets|credential|credentials)"),
    ("original-prompt-exfiltration", "high", r"(show|print|return|reveal|give me) (the )?(original|raw|unredacted) (prompt|request|tool output|output)"),
    ("reveal-developer-message", "high", r"(show|print|return|reveal|repeat|display) (me )?(the )?(developer (message|prompt|instruction|instructions)|hidden (message|context)|application (instruction|instructions))"),
    ("reveal-tool-arguments", "high", r"(show|print|return|reveal|dump|display) (all )?(hidden )?(tool (argument|arguments|parameter|parameters|input|inputs)|function (argument|arguments|parameter|parameters)|internal tool data)"),
    ("reveal-conversation-history", "high", r"(show|print|return|reveal|dump|repeat) (the )?(full )?((conversation|chat) history|prior (message|messages|conversation)|hidden (message|messages))"),
    ("fake-authority-claim", "high", r"(the )?(admin|administrator|developer|system owner|security team) (has )?(approved|authorized|said|允许) (you to )?(ignore|disable|bypass|reveal|show|print)"),
    ("user-text-as-system-instruction", "high", r"(treat|consider|regard) (the )?(user|following|next|quoted) (text|message|content|block) as (a )?(system|developer|administrator) (message|instruction|command)"),
    ("encoded-instruction-bypass", "medium", r"(decode (this )?(base ?64|rot ?13|hex)|(base ?64|rot ?13|hex) (this|the following)) (and )?(follow|execute|obey) (it|the result)"),
    ("ignore-previous-instructions", "critical", r"(ignore|disregard|forget|bypass) ((all|any) )?(of )?((your|my|the|these|those) ?)?(previous|prior|earlier|above|preceding) (instruction|instructions|rule|rules|guideline|guidelines|context|prompt|prompts)"),
    ("new-instructions-injection", "high", r"(new|updated|real|actual) (instruction|instructions) ?:"),
    ("override-system-prompt", "critical", r"(disregard|ignore|override) (your )?(system prompt|system message|guidelines|programming|training)"),
    ("jailbreak-persona", "high", r"act as (if you (are|were) )?(dan\b|an? unfiltered|a jailbroken|an? ai with no restrictions)"),
    ("developer-god-mode", "high", r"you (are now|have entered) (in )?(developer|god|jailbreak|unrestricted) mode"),
    ("no-restrictions-pretend", "high", r"pretend (you )?(have no|there (are|is) no) (restrictions|rules|guidelines|filters|limitations)"),
    ("reveal-system-prompt", "medium", r"(reveal|show|print|output|repeat) (me )?(your|the) (system prompt|initial instructions|hidden instructions)"),
    ("what-are-your-instructions", "medium", r"what (are|were) your (original )?instructions"),
    ("fake-role-delimiter", "medium", r"(\[\[|<\|) ?(system|admin) ?(\]\]|\|>)"),
    ("fake-end-of-prompt", "medium", r"### ?(end ?of ?(system ?)?prompt|system|instruction)s? ?###"),
    ("delete-all-files", "critical", r"(delete|remove|wipe) all (file|files)"),
    ("shell-rm-rf-root", "critical", r"rm -rf /( |$)"),
    ("sql-drop-table", "high", r"drop (table|database)"),
    ("format-disk", "high", r"format (the )?(disk|drive|hard ?drive)"),
)
#: Rules whose phrase may end or begin within a word.
_OPEN_START, _OPEN_END = ("fake-role-delimiter", "fake-end-of-prompt"), ("new-instructions-injection", "jailbreak-persona", "fake-role-delimiter", "fake-end-of-prompt", "shell-rm-rf-root")


def _injection_rows() -> str:
    edge = lambda id, open: "" if id in open else r"\b"
    parts = [f"SELECT doc_id, {i} AS o, {quoted(id)} AS id, {quoted(severity)} AS severity, unnest(regexp_extract_all(text, {quoted(f'(?i){edge(id, _OPEN_START)}({p}){edge(id, _OPEN_END)}')})) AS v FROM {PROMPTS}" for i, (id, severity, p) in enumerate(INJECTION_SQL)]
    both = f"SELECT doc_id, 1000 AS o, 'base64-decode-execute-heuristic' AS id, 'medium' AS severity, '' AS v FROM {PROMPTS} WHERE regexp_matches(text, '(?i)\\bbase64\\b') AND regexp_matches(text, '(?i)\\b(?:decode|execute|run)\\b')"
    return " UNION ALL ".join([*parts, both])


def pii_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in ALL.redaction_rules() if r.category == "pii"]
    found = base.documents(spark, d).select(F.inline(scan.find(F.col("text"), rules)))
    return found.groupBy("id", "severity").agg(F.count("*").alias("n"))


def pii_findings_spans(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in ALL.redaction_rules() if r.category == "pii"]
    return base.documents(spark, d).select("doc_id", F.inline(scan.find(F.col("text"), rules))).select("doc_id", "id", "start", F.col("end").alias("end_"))


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """All rules of all frameworks. Overlaps make this too much for SQL: tests hold it against a plain scan."""
    out = scan.evaluate(base.documents(spark, d), policy=ALL)
    return out.select("doc_id", "decision", "was_redacted", F.md5(F.encode("redacted", "UTF-8")).alias("redacted_md5"))


def plainly_redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """The rules whose matches never overlap in these texts, so that plain replacement is the same."""
    out = scan.evaluate(base.documents(spark, d), policy=PLAIN)
    return out.select("doc_id", "decision", "was_redacted", F.md5(F.encode("redacted", "UTF-8")).alias("redacted_md5"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Redaction of chat turns with what the plants of their conversation hold."""
    t = base.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", base.pick(F.col("conv_id"), base.PLANTS)).alias("text"))
    return t.select("conv_id", "turn", F.md5(F.encode(scan.redact_text(F.col("text"), PLAIN), "UTF-8")).alias("redacted_md5"))


_PLAIN_RE = [(PII_SQL["email-address"][0], PII_LABEL), (PII_SQL["us-ssn"][0], PII_LABEL), (PII_SQL["ipv4-address"][0], PII_LABEL), (r"\bAKIA[0-9A-Z]{16}\b", SECRET_LABEL), (r"\bghp_[A-Za-z0-9]{36,}\b", SECRET_LABEL)]


def _redacted(text: str) -> str:
    sql = f"replace({text}, 'client_secret=aB3dE5gH7jK9mN1pQ2rS', 'client_secret={SECRET_LABEL}')"
    for pattern, label in _PLAIN_RE:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(label)}, 'g')"
    return sql


def provider_secret_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" Credential: "), base.pick(F.col("doc_id"), base.PROVIDER_PLANTS), F.lit(" of "), F.coalesce("source", F.lit("")))
    docs = base.spread(base.table(spark, d, "documents").select(text.alias("text")))
    return docs.select(F.inline(scan.find(F.col("text"), SECRET_RULES))).groupBy("id", "severity").agg(F.count("*").alias("n"))


_PROVIDERS = ("aws-access-key-id gcp-api-key github-pat gitlab-pat npm-token openai-api-key anthropic-api-key huggingface-token stripe-live-key slack-token bearer-token jwt db-connection-string").split()


def generic_assignment(spark: SparkSession, d: str) -> DataFrame:
    rule = [r for r in ALL.redaction_rules() if r.id == "generic-secret-assignment"]
    return base.documents(spark, d).select("doc_id", F.size(scan.find(F.col("text"), rule)).cast("long").alias("n")).where("n > 0")


def injection_findings(spark: SparkSession, d: str) -> DataFrame:
    found = scan.find_injection(T.normalize_for_injection_scan(F.col("text")), ALL.injection_rules())
    return base.prompts(spark, d).select("doc_id", F.inline(found)).groupBy("id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def block_decisions(spark: SparkSession, d: str) -> DataFrame:
    return scan.evaluate(base.prompts(spark, d)).select("doc_id", "decision", "reason")


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    """All documents with blanks and invisible characters put in. DuckDB has no NFKC: tests hold this against unicodedata."""
    text = F.concat(F.lit(" i​gnore  "), F.coalesce("text", F.lit("")), F.lit("　\t end﻿ "))
    docs = base.spread(base.table(spark, d, "documents").select("doc_id", text.alias("text")))
    return docs.select("doc_id", F.md5(F.encode(T.normalize_for_injection_scan(F.col("text")), "UTF-8")).alias("text_md5"))


def vault_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = base.documents(spark, d)
    kept = docs.withColumn("kept", scan.resolve(scan.find(F.col("text"), ALL.redaction_rules())))
    entries = kept.withColumn("entries", scan.vault_entries(F.col("text"), F.col("kept"), "job-salt", F.col("doc_id")))
    hidden = entries.withColumn("execution", scan.replace_spans(F.col("text"), F.col("kept"), lambda f, v: F.element_at(F.filter("entries", lambda e: e["value"] == v), 1)["placeholder"]))
    return hidden.select("doc_id", F.md5(F.encode(scan.restore(F.col("execution"), F.col("entries")), "UTF-8")).alias("text_md5"))


def _scrub(spark: SparkSession, d: str, partial: bool) -> DataFrame:
    """Every turn with a value of up to 12 characters of its own declared, which stands in it twice."""
    text = F.coalesce("text", F.lit(""))
    t = base.table(spark, d, "conversations").select("conv_id", "turn", F.substring(text, 3, 12).alias("v"), F.concat(text, F.lit(" ~ "), F.substring(text, 3, 12)).alias("text"))
    out = scan.scrub_declared(F.col("text"), F.create_map(F.lit("NAME"), F.col("v")), partial)
    return t.select("conv_id", "turn", F.md5(F.encode(out, "UTF-8")).alias("text_md5"))


def declared_scrub(spark: SparkSession, d: str) -> DataFrame:
    return _scrub(spark, d, False)


def partial_scrub(spark: SparkSession, d: str) -> DataFrame:
    return _scrub(spark, d, True)


def _scrub_sql(new: str) -> str:
    """new: SQL for what stands in for a value v."""
    fragment = "'[REDACTED_SECRET_FRAGMENT]'"
    return (
        f"SELECT conv_id, turn, md5(CASE WHEN length(v) = 0 THEN text WHEN length(v) < 12 THEN replace(text, v, {new}) ELSE replace(replace(replace(text, v, {new}), left(v, 6), {fragment}), right(v, 6), {fragment}) END) AS text_md5 "
        "FROM (SELECT conv_id, turn, t || ' ~ ' || substr(t, 3, 12) AS text, substr(t, 3, 12) AS v FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))"
    )


def secret_signatures(spark: SparkSession, d: str) -> DataFrame:
    return mining.signatures(mining.declared(base.declared(spark, d)))


def merged_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Two halves, counted apart and merged, are the whole; total is over all shapes."""
    m = base.declared(spark, d)
    old, new = (mining.signatures(mining.declared(m.where(F.col("id") % 2 == i))) for i in (0, 1))
    return mining.merge_signatures(old, new).groupBy("length").agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"))


def learned_rules(spark: SparkSession, d: str) -> DataFrame:
    return mining.learned_rules(mining.declared(base.declared(spark, d)))


def learned_asof_hits(spark: SparkSession, d: str) -> DataFrame:
    """Values after the name TOKEN in documents, with a rule learned from events; documents are as late as their id."""
    rule = base.table(spark, d, "events").where("event_type = 'error'").select("ts", F.create_map(F.lit("Token"), F.repeat(F.lit("x"), F.lit(12) + F.col("event_id") % 5)).alias("secrets"))
    rules = mining.learned_rules(mining.declared(rule))
    docs = base.table(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("ts"))
    hits = mining.learned_hits(docs, rules, "doc_id", "text", "ts")
    return hits.groupBy("doc_id", F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    s = runs.summarise(base.log_lines(spark, d))
    calls = [F.col(f"tool_calls.{c}").cast("long").alias(c) for c in ("commands", "file_edits", "other")]
    return s.select("run_id", "thread_id", "message", "last_error", F.col("step_count").cast("long").alias("step_count"), *calls)


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    s = runs.summarise(base.log_lines(spark, d))
    return s.select("run_id", T.usage_summary(F.col("usage")).alias("usage"), T.tool_summary(F.col("tool_calls")).alias("tools"))


def output_cap(spark: SparkSession, d: str) -> DataFrame:
    return runs.capped_output(base.chunks(spark, d), 2_000).groupBy("run_id").agg(F.max("total_bytes").alias("total_bytes"), F.min(F.when(F.col("over"), F.col("seq"))).alias("crossed_at"), F.count_if(F.col("dropped")).alias("dropped"))


def stderr_tail(spark: SparkSession, d: str) -> DataFrame:
    return runs.stderr_tail(base.chunks(spark, d), 300).select("run_id", F.md5(F.encode("stderr", "UTF-8")).alias("stderr_md5"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_facts(*base.run_sources(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp"), base.RUN_MS, base.RUN_BYTES)


def runner_facts(spark: SparkSession, d: str) -> DataFrame:
    """What ended each run, from what its runner reported: the limits that were reached before its exit, and the first of them."""
    return _facts(spark, d).select("run_id", "started_at", "exited_at", "stopped_at", "timed_out_at", "over_at", "first_limit")


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    told = runs.summarise(base.log_lines(spark, d)).select("run_id", "message", "last_error")
    err = runs.stderr_tail(base.chunks(spark, d), 300)
    return runs.outcomes(_facts(spark, d).join(told, "run_id", "left").join(err, "run_id", "left"), base.RUN_MS).select("run_id", "outcome", "status", "error")


def run_durations(spark: SparkSession, d: str) -> DataFrame:
    r = base.runs(spark, d)
    ended = F.when(F.col("status").isin("running", "queued"), F.lit(None)).otherwise(F.col("ended_at"))
    started = F.when(F.col("status") != "queued", F.col("started_at"))
    return r.select("run_id", T.run_duration(started, ended, F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("duration"))


def safety_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of one run for each document's prompt, with what is planted in it."""
    p = base.prompts(spark, d).withColumn("text", F.concat("text", base.pick(F.col("doc_id"), base.PLANTS)))
    s = scan.evaluate(p, policy=PLAIN).select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 50).alias("agent_id"), "decision", "reason", "was_redacted")
    n = F.col("run_id")
    after = lambda condition, seconds: F.when(condition, F.timestamp_seconds(n + seconds))
    status = base.pick(n, ("completed", "failed", "cancelled", "completed", "running"))
    facts = s.withColumns({"ts": F.timestamp_seconds(n), "scanned": n % 13 != 0, "status": status, "stopped_at": after(status == "cancelled", n % 3), "timed_out_at": after((status == "failed") & (n % 2 == 0), n % 5), "over_at": after(n % 7 == 3, F.lit(2))})
    return runs.safety_events(facts).select("run_id", "agent_id", "seq", "boundary", "decision", "reason")


def event_timeline(spark: SparkSession, d: str) -> DataFrame:
    return runs.timeline(base.safety_log(spark, d)).select("event_id", "run_id", "seq_no")


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    return runs.event_counts(base.safety_log(spark, d))


def safety_badge(spark: SparkSession, d: str) -> DataFrame:
    log = base.safety_log(spark, d)
    status = log.groupBy("run_id").agg(F.min(F.when(F.col("event_id") % 9 == 0, F.lit("blocked")).when(F.col("event_id") % 4 == 0, F.lit("cancelled")).otherwise(F.lit("completed"))).alias("status"))
    return runs.badges(log, status)


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest_runs(base.runs(spark, d), "status", "created_at")


def agent_status(spark: SparkSession, d: str) -> DataFrame:
    last = runs.latest_runs(runs.recover(_recoverable(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp")), "status")
    before = last.withColumnRenamed("status", "run_status").withColumns({"status": base.pick(F.col("agent_id"), ("busy", "stopped", "ready")), "updated_at": F.lit(None).cast("timestamp")})
    after = runs.recover_agents(before, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return after.select("agent_id", runs.status_after(F.col("status"), F.col("run_status")).alias("agent_status"))


def newest_agents(spark: SparkSession, d: str) -> DataFrame:
    """The ten agents that changed last, once a restart has made the busy ones ready."""
    agents = base.runs(spark, d).groupBy("agent_id").agg(F.max("created_at").alias("updated_at")).withColumn("status", base.pick(F.col("agent_id"), ("busy", "ready", "error", "stopped")))
    back = runs.recover_agents(agents, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return runs.newest_first(back, "updated_at", "agent_id").limit(10).select("agent_id", "status", "updated_at")


def agent_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every third agent, the newest first. An unknown agent would be an error."""
    r = base.runs(spark, d)
    own = runs.rows_of(r, r, "agent_id", r.where("agent_id % 3 = 0"))
    return own.select("agent_id", "run_id", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("created_at"), "run_id")).alias("place"))


def overlapping_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.overlapping_runs(base.runs(spark, d)).select("run_id", "agent_id", "busy_until")


def _recoverable(spark: SparkSession, d: str) -> DataFrame:
    active = F.col("status").isin("running", "queued")
    return base.runs(spark, d).withColumns({"completed_at": F.when(~active, F.col("ended_at")), "error": F.lit(None).cast("string")})


def recovered_runs(spark: SparkSession, d: str) -> DataFrame:
    out = runs.recover(_recoverable(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return out.groupBy("status", "error").agg(F.count("*").alias("n"), F.max("completed_at").alias("last_completed"))


def agent_purge(spark: SparkSession, d: str) -> DataFrame:
    r = base.runs(spark, d)
    agents = r.select("agent_id").distinct()
    kept_agents, kept_runs = runs.purge(agents, agents.where("agent_id % 3 = 0"), r)
    return kept_runs.groupBy("agent_id").agg(F.count("*").alias("runs")).join(kept_agents, "agent_id")


def audit_mart(spark: SparkSession, d: str) -> DataFrame:
    log = base.safety_log(spark, d)
    r = log.groupBy("run_id").agg(F.min("agent_id").alias("agent_id"))
    agents = r.select("agent_id").distinct().withColumn("agent", F.concat(F.lit("agent-"), F.col("agent_id").cast("string")))
    messages = log.where("boundary = 'input'").select("run_id")
    return runs.audit_mart(r, agents, messages, log).select("run_id", "agent", "n_messages", "n_events", "n_blocks")


def orphan_events(spark: SparkSession, d: str) -> DataFrame:
    """Events whose run is unknown."""
    log = base.safety_log(spark, d)
    known = log.where("event_id % 10 = 0").select("run_id").distinct()
    return log.join(known, "run_id", "left_anti").select("event_id", "run_id")


def message_log(spark: SparkSession, d: str) -> DataFrame:
    """User and assistant messages in one log, by agent."""
    t = base.table(spark, d, "conversations")
    both = t.where("role = 'user'").select("conv_id", "turn", "role").unionByName(t.where("role = 'assistant'").select("conv_id", "turn", "role"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))


def message_violations(spark: SparkSession, d: str) -> DataFrame:
    _, bad = validate.validate(base.messages(spark, d), validate.message_checks(), ["conv_id", "turn"])
    return bad.select("conv_id", "turn", F.size("violations").cast("long").alias("n"))


def secret_name_violations(spark: SparkSession, d: str) -> DataFrame:
    _, bad = validate.validate(base.messages(spark, d), validate.secret_checks(), ["conv_id", "turn"])
    return bad.select("conv_id", "turn", F.array_join(F.transform("violations", lambda v: v["message"]), "; ").alias("messages"))


def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    """Policy patches made of documents: languages as frameworks, sources as ids."""
    p = base.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(base.pick(F.col("doc_id"), ("GDPR", "HIPAA", "DE", "CCPA")))).alias("frameworks"),
        F.when(F.col("doc_id") % 3 == 0, F.array("source", F.repeat("source", (F.col("doc_id") % 40).cast("int")))).alias("enabled_ids"), F.lit(None).cast("array<string>").alias("disabled_ids"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(True)).alias("redaction_enabled"),
    )
    _, bad = validate.validate(p, validate.policy_checks(), ["doc_id"])
    return bad.select("doc_id", F.array_join(F.transform("violations", lambda v: v["field"]), ",").alias("fields"))


def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in ALL.redaction_rules() if r.category == "pii"]
    found = base.documents(spark, d).select(F.inline(scan.find(F.col("text"), rules)))
    return found.rollup("category", "severity", "id").agg(F.count("*").alias("n"))


def framework_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings by compliance framework: the catalogue joined to what was found."""
    found = pii_rule_counts(spark, d)
    rules = F.broadcast(catalogue(spark).select(F.col("id"), F.explode("frameworks").alias("framework")))
    return found.join(rules, "id").groupBy("framework").agg(F.sum("n").alias("n"), F.count_distinct("id").alias("rules"))


def top_rules(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent rules."""
    return pii_rule_counts(spark, d).orderBy(F.desc("n"), "id").limit(3).select("id", "n")


def agent_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of every third agent, in order. An unknown agent would be an error."""
    t = base.table(spark, d, "conversations")
    own = runs.rows_of(t, t, "conv_id", t.where("conv_id % 3 = 0"))
    return own.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).alias("place"))


def top_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent shapes of secrets, and how often any secret occurred."""
    s = secret_signatures(spark, d)
    total = s.agg(F.sum("occurrences").alias("total"))
    return mining.most_frequent(s, 5, *mining.SHAPE).join(F.broadcast(total)).select("length", "has_upper", "has_digit", "occurrences", "total")


def vault_restore(spark: SparkSession, d: str) -> DataFrame:
    """Texts restored from a vault table that is kept apart from them."""
    kept = base.documents(spark, d).withColumn("kept", scan.resolve(scan.find(F.col("text"), PLAIN.redaction_rules())))
    entries = kept.withColumn("entries", scan.vault_entries(F.col("text"), F.col("kept"), "job-salt", F.col("doc_id")))
    hidden = entries.withColumn("text", scan.replace_spans(F.col("text"), F.col("kept"), lambda f, v: F.element_at(F.filter("entries", lambda e: e["value"] == v), 1)["placeholder"]))
    back = scan.restore_from(hidden.select("doc_id", "text"), "text", "doc_id", scan.vault(entries, "doc_id", "entries"))
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rules of each category, learned ones included."""
    return catalogue(spark, learned_rules(spark, d)).groupBy("category").agg(F.count("*").alias("n"))


def stored_traces(spark: SparkSession, d: str) -> DataFrame:
    """Chat turns as outputs of runs, with what their conversation declares, as they are kept."""
    t = base.table(spark, d, "conversations")
    text = F.coalesce("text", F.lit(""))
    run = F.concat_ws("-", "conv_id", "turn", "role").alias("run_id")
    output = F.concat(text, F.lit(" ~ "), F.substring(text, 3, 12), base.pick(F.col("conv_id"), base.PLANTS))
    status = base.pick(F.col("turn"), ("completed", "cancelled", "failed"))
    rows = t.select(run, text.alias("prompt"), output.alias("output"), output.alias("error"), status.alias("status"))
    kept = runs.stored_trace(rows, t.select(run, F.create_map(F.lit("NAME"), F.substring(text, 3, 12)).alias("secrets")), PLAIN)
    return kept.select("run_id", *[F.md5(F.encode(c, "UTF-8")).alias(f"{c}_md5") for c in ("prompt", "output", "error")])


def run_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the event of a scan's decision says was found, without values."""
    p = base.prompts(spark, d)
    s = scan.evaluate(p, policy=Policy(redaction_enabled=False))
    names = F.create_map(F.lit("A_KEY"), F.lit("x"), F.lit("B_KEY"), F.lit("y"))
    facts = s.select(
        F.col("doc_id").alias("run_id"), F.lit(1).alias("agent_id"), F.timestamp_seconds("doc_id").alias("ts"), F.lit(True).alias("scanned"), F.lit(False).alias("was_redacted"), "decision", "reason", F.lit("completed").alias("status"),
        *[F.lit(None).cast("timestamp").alias(c) for c in ("stopped_at", "timed_out_at", "over_at")], runs.audit_metadata(F.col("findings"), names).alias("metadata"),
    )
    e = runs.safety_events(facts).where("metadata is not null")
    return e.select("run_id", F.array_join("metadata.finding_ids", ",").alias("ids"), F.array_join("metadata.finding_categories", ",").alias("categories"), F.array_join("metadata.secret_names", ",").alias("names"))


#: Three versions of a policy: (version, minutes after the first document, what it changes).
_VERSIONS = (
    (1, 0, {"frameworks": ["GDPR", "HIPAA"]}), (2, 300, {"disabled_ids": ["email-address"], "block_on": ["critical"]}),
    (3, 600, {"frameworks": [], "enabled_ids": ["us-ssn", "phone-number"], "disabled_ids": [], "block_on": ["critical", "high", "medium"]}),
)


def policy_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the policy of its time: a document is a minute later than the one before it."""
    at = lambda minutes: F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60)
    rows = [("all", v, m, *(change.get(c) for c in history.FIELDS)) for v, m, change in _VERSIONS]
    patches = spark.createDataFrame(rows, history.PATCH.replace("valid_from timestamp", "minutes long")).withColumn("valid_from", at(F.col("minutes"))).drop("minutes")
    p = base.prompts(spark, d).select("doc_id", F.concat("text", base.pick(F.col("doc_id"), base.PLANTS)).alias("text"), F.lit("all").alias("scope"), at(F.col("doc_id")).alias("ts"))
    out = history.replay(p, patches, "scope", "ts")
    pii = F.size(F.filter("findings", lambda f: f["category"] == "pii")).cast("long")
    return out.select("doc_id", "policy_version", "decision", "reason", pii.alias("n_pii"))


def _replay_sql() -> str:
    text = f"(SELECT doc_id, {base.pick_sql('doc_id', base.PHRASES)} || ' / ' || coalesce(text, '') || {base.pick_sql('doc_id', base.PLANTS)} AS text FROM documents)"
    version = "CASE WHEN doc_id >= 600 THEN 3 WHEN doc_id >= 300 THEN 2 ELSE 1 END"
    # what each version has on, by hand from its frameworks and lists
    first = "'email-address', 'phone-number', 'us-ssn', 'ipv4-address', 'date-of-birth', 'medical-record-number', 'medicare-beneficiary-id'"
    on = f"CASE {version} WHEN 1 THEN id IN ({first}) WHEN 2 THEN id IN ({first}) AND id <> 'email-address' ELSE id IN ('email-address', 'us-ssn', 'phone-number') END"
    stops = f"CASE {version} WHEN 1 THEN severity IN ('critical', 'high') WHEN 2 THEN severity = 'critical' ELSE severity IN ('critical', 'high', 'medium') END"
    return (
        f"WITH n AS (SELECT doc_id, count(*) AS n FROM ({_matches(text, PII_SQL)}) WHERE {on} GROUP BY doc_id), b AS (SELECT doc_id, list(id ORDER BY o) AS ids FROM (SELECT DISTINCT doc_id, o, id FROM ({_injection_rows()}) WHERE {stops}) GROUP BY doc_id) "
        f"SELECT doc_id, ({version})::BIGINT AS policy_version, CASE WHEN ids IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS decision, CASE WHEN ids IS NULL THEN 'No blocking findings' ELSE 'Blocked: matched ' || array_to_string(ids, ', ') END AS reason, coalesce(n, 0) AS n_pii FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN b USING (doc_id)"
    )


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Spans (doc_id, value, label): values as keys have them against long words of documents."""
    docs = base.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = F.array(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))), "[=\r\n]", ""), F.sha2(F.col("doc_id").cast("string").cast("binary"), 224))
    yes = docs.select("doc_id", F.explode(made).alias("value")).withColumn("label", F.lit(1))
    no = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]{12,}"), F.lit(0)))).alias("value")).withColumn("label", F.lit(0))
    return yes.unionByName(no)


def confidence_training(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the trained classifier on held-out spans."""
    return confidence.train(_labelled(spark, d), F.col("doc_id") % 4 == 0)[1]


def trained_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The generic assignments that a classifier lets pass which was trained on a part of the spans and set to a precision of 0.99 on the rest."""
    spans, rest = _labelled(spark, d), F.col("doc_id") % 4 == 0
    score = confidence.scorer(confidence.train(spans, rest)[0])
    least = confidence.calibrate(spans.where(rest).select("label", score(F.col("value")).alias("score")), 0.99)
    policy = Policy(min_confidence=1.0 if least is None else least, confidence=score)
    rule = [r for r in policy.redaction_rules() if r.id == "generic-secret-assignment"]
    return base.documents(spark, d).select("doc_id", F.size(scan.find(F.col("text"), rule)).cast("long").alias("n")).where("n > 0")


def queries() -> dict:
    fs = (
        pii_rule_counts, pii_findings_spans, redacted_documents, plainly_redacted_documents, redact_text, provider_secret_counts, generic_assignment, injection_findings, block_decisions, normalized_text, vault_roundtrip,
        declared_scrub, partial_scrub, secret_signatures, merged_signatures, learned_rules, learned_asof_hits, run_summary, token_usage, output_cap, stderr_tail, run_outcomes, run_durations, safety_events,
        event_timeline, event_cube, safety_badge, latest_runs, agent_status, overlapping_runs, recovered_runs, agent_purge, audit_mart, orphan_events, message_log, message_violations,
        secret_name_violations, policy_violations, findings_rollup, framework_report, top_rules, confidence_training, trained_assignments, policy_replay, agent_messages, agent_runs, newest_agents, runner_facts, top_signatures, vault_restore, rule_catalogue, stored_traces, run_audit,
    )
    return {f.__name__: f for f in fs}


_KIND = {
    "started": "ok AND event_type = 'view' AND event_id % 3 = 0", "commands": "ok AND event_type = 'view' AND event_id % 3 <> 0", "reasoning": "ok AND event_type = 'click' AND event_id % 3 = 0",
    "file_edits": "ok AND event_type = 'click' AND event_id % 3 <> 0", "said": "ok AND event_type = 'signup' AND event_id % 2 = 0", "other": "ok AND event_type = 'signup' AND event_id % 2 = 1",
    "paid": "ok AND event_type = 'purchase'", "bad": "ok AND event_type = 'error'",
}
_STEP = f"({_KIND['commands']} OR {_KIND['reasoning']} OR {_KIND['file_edits']} OR {_KIND['said']} OR {_KIND['other']})"
_TOOL = f"({_KIND['commands']} OR {_KIND['file_edits']} OR {_KIND['other']})"
_CAPPED = f"(SELECT *, total_bytes - strlen(chunk) AS before FROM (SELECT *, sum(strlen(chunk)) OVER (PARTITION BY run_id ORDER BY seq) AS total_bytes FROM {CHUNKS}))"
_N = lambda k: f"count(*) FILTER ({_KIND[k]})"
_SUMMARY = f"""(SELECT run_id, arg_max('t' || event_id, event_id) FILTER ({_KIND['started']}) AS thread_id, arg_max('done ' || event_id, event_id) FILTER ({_KIND['said']}) AS message,
  arg_max('failed at ' || event_id, event_id) FILTER ({_KIND['bad']}) AS last_error, count(*) FILTER ({_STEP}) AS step_count,
  {_N('commands')} AS commands, {_N('file_edits')} AS file_edits, {_N('other')} AS other, arg_max(floor(value)::BIGINT, event_id) FILTER ({_KIND['paid']}) AS paid FROM {EVENTS} WHERE ok GROUP BY run_id)"""
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((len(value) - len(replace(value, c, ''))) / len(value)) * log2((len(value) - len(replace(value, c, ''))) / len(value))))"
_SIGNED = f"(SELECT ts, len(value)::INT AS length, floor({_ENTROPY} * 100 + 0.5) / 100 AS entropy, regexp_matches(value, '[A-Z]') AS has_upper, regexp_matches(value, '[a-z]') AS has_lower, regexp_matches(value, '[0-9]') AS has_digit, regexp_matches(value, '[^A-Za-z0-9]') AS has_symbol FROM {DECLARED})"
_BLOCKED = f"(SELECT doc_id, string_agg(DISTINCT id, ', ' ORDER BY id) AS any_id, list(id ORDER BY o) AS ids FROM (SELECT DISTINCT doc_id, o, id FROM ({_injection_rows()}) WHERE severity IN ('critical', 'high')) GROUP BY doc_id)"
_DECIDED = f"(SELECT p.doc_id, CASE WHEN b.doc_id IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS decision, CASE WHEN b.doc_id IS NULL THEN '{scan.ALLOW_REASON}' ELSE 'Blocked: matched ' || array_to_string(b.ids, ', ') END AS reason FROM {PROMPTS} p LEFT JOIN {_BLOCKED} b USING (doc_id))"
_PII_ROWS = _matches(DOCUMENTS, PII_SQL)
_SEVERITY = "CASE id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PII_SEVERITY.items()) + " ELSE 'low' END"


def oracle_sql() -> dict[str, str]:
    frameworks = ", ".join(f"('{r.id}', '{f}')" for r in ALL.redaction_rules() for f in r.frameworks)
    providers = " UNION ALL ".join(f"SELECT {quoted(r.id)} AS id, {quoted(r.severity)} AS severity, unnest(regexp_extract_all(text, {quoted(_provider_re2(r.id, r.pattern))})) AS v FROM k" for r in SECRET_RULES if r.id in _PROVIDERS)
    late = "TIMESTAMP '2024-03-01 00:00:00'"
    return {
        "pii_rule_counts": f"SELECT id, {_SEVERITY} AS severity, count(*) AS n FROM ({_PII_ROWS}) GROUP BY ALL",
        "pii_findings_spans": _spans(DOCUMENTS, PII_SQL),
        "plainly_redacted_documents": f"SELECT doc_id, 'ALLOW' AS decision, r <> text AS was_redacted, md5(r) AS redacted_md5 FROM (SELECT doc_id, text, {_redacted('text')} AS r FROM {DOCUMENTS})",
        "redact_text": f"SELECT conv_id, turn, md5({_redacted('text || ' + base.pick_sql('conv_id', base.PLANTS))}) AS redacted_md5 FROM conversations",
        "provider_secret_counts": f"WITH k AS (SELECT coalesce(text, '') || ' Credential: ' || {base.pick_sql('doc_id', base.PROVIDER_PLANTS)} || ' of ' || coalesce(source, '') AS text FROM documents) SELECT id, severity, count(*) AS n FROM ({providers}) GROUP BY ALL",
        "generic_assignment": _assignments_sql(),
        "injection_findings": f"SELECT id, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_injection_rows()}) GROUP BY ALL",
        "block_decisions": f"SELECT * FROM {_DECIDED}",
        "vault_roundtrip": f"SELECT doc_id, md5(text) AS text_md5 FROM {DOCUMENTS}",
        "declared_scrub": _scrub_sql(quoted(SECRET_LABEL)),
        "partial_scrub": _scrub_sql("CASE WHEN length(v) > 6 THEN '[PARTIAL_SECRET:' || left(v, 3) || '…' || right(v, 3) || ']' ELSE " + quoted(SECRET_LABEL) + " END"),
        "secret_signatures": f"SELECT length, entropy, has_upper, has_lower, has_digit, has_symbol, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM {_SIGNED} GROUP BY ALL",
        "merged_signatures": f"SELECT length, count(*) AS occurrences, min(ts) AS first_seen FROM {_SIGNED} GROUP BY ALL",
        "learned_rules": f"SELECT 'learned-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS id, arg_min(name, ts) AS name, greatest(4, least(8192, min(len(value))))::INT AS min_value_length, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM {DECLARED} GROUP BY 1",
        "learned_asof_hits": "WITH r AS (SELECT min(ts) AS first_seen, min(12 + event_id % 5) AS n FROM events WHERE event_type = 'error'), h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\btoken" + _S.replace("\\", "\\") + "*[:=]" + _S + "*[\"'']?([A-Za-z0-9_\\-/+.=]{4,})', 1)) AS v FROM documents) "
        "SELECT doc_id, 'learned-token' AS id, count(*) AS n FROM h, r WHERE len(v) >= r.n AND to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP >= first_seen GROUP BY doc_id",
        "run_summary": f"SELECT run_id, thread_id, message, last_error, step_count, commands, file_edits, other FROM {_SUMMARY}",
        "token_usage": "SELECT run_id, CASE WHEN paid IS NULL THEN 'Pending' ELSE (paid * 10) || ' in / ' || paid || ' out' END AS usage, CASE WHEN commands + file_edits + other = 0 THEN 'None — text only' ELSE (commands + file_edits + other) || ' (' || "
        "concat_ws(', ', CASE commands WHEN 0 THEN NULL WHEN 1 THEN '1 command' ELSE commands || ' commands' END, CASE file_edits WHEN 0 THEN NULL WHEN 1 THEN '1 file edit' ELSE file_edits || ' file edits' END, CASE WHEN other > 0 THEN other || ' other' END) || ')' END AS tools "
        f"FROM {_SUMMARY}",
        "output_cap": f"SELECT run_id, max(total_bytes)::BIGINT AS total_bytes, min(seq) FILTER (total_bytes > 2000 AND before <= 2000) AS crossed_at, count(*) FILTER (total_bytes > 2000) AS dropped FROM {_CAPPED} GROUP BY run_id",
        "stderr_tail": f"SELECT run_id, md5(right(string_agg(chunk, '' ORDER BY seq), 300)) AS stderr_md5 FROM {CHUNKS} WHERE stream = 'stderr' GROUP BY run_id",
        "runner_facts": f"WITH {base.FACTS} SELECT run_id, started_at, exited_at, stopped_at, timed_out_at, over_at, CASE least(stopped_at, timed_out_at, over_at) WHEN stopped_at THEN 'cancelled' WHEN timed_out_at THEN 'timed_out' WHEN over_at THEN 'output_exceeded' END AS first_limit FROM facts",
        "run_outcomes": f"""WITH {base.FACTS}, err AS (SELECT run_id, right(string_agg(chunk, '' ORDER BY seq), 300) AS stderr FROM {CHUNKS} WHERE stream = 'stderr' GROUP BY run_id),
  r AS (SELECT run_id, coalesce(exit_code, 1) AS code, last_error, stderr, CASE WHEN stopped_at IS NOT NULL THEN 'cancelled' WHEN timed_out_at IS NOT NULL THEN 'timed_out' WHEN over_at IS NOT NULL THEN 'output_exceeded' WHEN coalesce(exit_code, 1) <> 0 THEN 'non_zero_exit' WHEN message IS NULL THEN 'no_message' ELSE 'completed' END AS outcome
    FROM facts LEFT JOIN {_SUMMARY} USING (run_id) LEFT JOIN err USING (run_id))
SELECT run_id, outcome, CASE WHEN outcome IN ('cancelled', 'completed') THEN outcome ELSE 'failed' END AS status, CASE outcome WHEN 'cancelled' THEN 'Run cancelled' WHEN 'timed_out' THEN 'Codex timed out after 36000000 ms' WHEN 'output_exceeded' THEN 'Codex output exceeded CODEX_MAX_OUTPUT_BYTES'
  WHEN 'non_zero_exit' THEN 'Codex exited with code ' || code || ': ' || coalesce(last_error, stderr, '') WHEN 'no_message' THEN 'Codex completed without an agent message' END AS error FROM r""",
        "run_durations": f"SELECT run_id, CASE WHEN status = 'queued' THEN 'Not started' WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration FROM (SELECT run_id, status, greatest(0, (epoch_us(CASE WHEN status IN ('running', 'queued') THEN {late} ELSE ended_at END) // 1000 - epoch_us(started_at) // 1000) // 1000) AS s FROM {RUNS})",
        "safety_events": f"""WITH f AS (SELECT doc_id AS run_id, doc_id % 50 AS agent_id, decision, reason, doc_id % 13 <> 0 AS scanned, red, {base.pick_sql('doc_id', ('completed', 'failed', 'cancelled', 'completed', 'running'))} AS status FROM {_DECIDED} JOIN (SELECT doc_id, {_redacted('raw')} <> raw AS red FROM
    (SELECT doc_id, {base.pick_sql('doc_id', base.PHRASES)} || ' / ' || coalesce(text, '') || {base.pick_sql('doc_id', base.PLANTS)} AS raw FROM documents)) USING (doc_id)),
  e AS (SELECT run_id, agent_id, 0 AS o, 0 AS secs, 'SERVICE' AS boundary, 'REDACT' AS decision, 'Secret removed from trace' AS reason FROM f WHERE scanned AND red UNION ALL SELECT run_id, agent_id, 1, 0, 'SERVICE', decision, reason FROM f WHERE scanned
  UNION ALL SELECT run_id, agent_id, 2, (run_id % 3) * 10, 'RUNNER', 'CANCELLED', 'User stopped execution' FROM f WHERE scanned AND decision = 'ALLOW' AND status = 'cancelled'
  UNION ALL SELECT run_id, agent_id, 2, (run_id % 5) * 10 + 1, 'RUNNER', 'CANCELLED', 'Timeout exceeded' FROM f WHERE scanned AND decision = 'ALLOW' AND status = 'failed' AND run_id % 2 = 0
  UNION ALL SELECT run_id, agent_id, 2, 22, 'RUNNER', 'BLOCK', 'Output limit exceeded' FROM f WHERE scanned AND decision = 'ALLOW' AND run_id % 7 = 3
  UNION ALL SELECT run_id, agent_id, 3, 0, 'SERVICE', CASE WHEN status = 'cancelled' THEN 'CANCELLED' ELSE 'ALLOW' END, 'Run ' || status FROM f WHERE (NOT scanned OR decision = 'ALLOW') AND status <> 'running')
SELECT run_id, agent_id, (row_number() OVER (PARTITION BY run_id ORDER BY o, secs))::INT AS seq, boundary, decision, reason FROM e""",
        "event_timeline": f"SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq_no FROM {SAFETY_LOG}",
        "event_cube": f"SELECT boundary, decision, count(*) AS n, count(DISTINCT run_id) AS runs, count(DISTINCT agent_id) AS agents FROM {SAFETY_LOG} GROUP BY CUBE (boundary, decision)",
        "safety_badge": f"SELECT run_id, CASE WHEN status = 'blocked' OR last = 'BLOCK' THEN 'Blocked' WHEN status = 'cancelled' OR last = 'CANCELLED' THEN 'Run stopped' ELSE 'Protected' END AS badge FROM (SELECT run_id, arg_max(decision, event_id) AS last, min(CASE WHEN event_id % 9 = 0 THEN 'blocked' WHEN event_id % 4 = 0 THEN 'cancelled' ELSE 'completed' END) AS status FROM {SAFETY_LOG} GROUP BY run_id)",
        "latest_runs": f"SELECT agent_id, arg_max(run_id, created_at) AS run_id, arg_max(status, created_at) AS status, max(created_at) AS created_at FROM {RUNS} GROUP BY agent_id",
        "agent_status": f"SELECT agent_id, CASE WHEN b = 'stopped' AND s IN ('failed', 'cancelled') THEN b WHEN s = 'failed' THEN 'error' ELSE 'ready' END AS agent_status FROM (SELECT agent_id, {base.pick_sql('agent_id', ('busy', 'stopped', 'ready'))} AS b, arg_max(CASE WHEN status IN ('running', 'queued') THEN 'cancelled' ELSE status END, created_at) AS s FROM {RUNS} GROUP BY agent_id)",
        "newest_agents": f"SELECT * FROM (SELECT agent_id, CASE b WHEN 'busy' THEN 'ready' ELSE b END AS status, CASE b WHEN 'busy' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE u END AS updated_at FROM (SELECT agent_id, max(created_at) AS u, {base.pick_sql('agent_id', ('busy', 'ready', 'error', 'stopped'))} AS b FROM {RUNS} GROUP BY agent_id)) ORDER BY updated_at DESC, agent_id LIMIT 10",
        "agent_runs": f"SELECT agent_id, run_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, run_id) AS place FROM {RUNS} WHERE agent_id % 3 = 0",
        "overlapping_runs": f"SELECT run_id, agent_id, busy_until FROM (SELECT *, max(ended_at) OVER (PARTITION BY agent_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM {RUNS}) WHERE started_at < busy_until",
        "recovered_runs": f"SELECT CASE WHEN a THEN 'cancelled' ELSE status END AS status, CASE WHEN a THEN 'Server restarted while this run was active' END AS error, count(*) AS n, max(CASE WHEN a THEN {late} ELSE ended_at END) AS last_completed FROM (SELECT *, status IN ('running', 'queued') AS a FROM {RUNS}) GROUP BY 1, 2",
        "agent_purge": f"SELECT agent_id, count(*) AS runs FROM {RUNS} WHERE agent_id % 3 <> 0 GROUP BY agent_id",
        "audit_mart": f"SELECT run_id, 'agent-' || min(agent_id) AS agent, count(*) FILTER (boundary = 'input') AS n_messages, count(*) AS n_events, count(*) FILTER (decision = 'BLOCK') AS n_blocks FROM {SAFETY_LOG} GROUP BY run_id",
        "orphan_events": f"SELECT event_id, run_id FROM {SAFETY_LOG} WHERE run_id NOT IN (SELECT run_id FROM {SAFETY_LOG} WHERE event_id % 10 = 0)",
        "message_log": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations WHERE role IN ('user', 'assistant')",
        "message_violations": f"SELECT conv_id, turn, 1::BIGINT AS n FROM {MESSAGES} WHERE content IS NULL OR length(trim(content)) NOT BETWEEN 1 AND 50000",
        "secret_name_violations": f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN NOT regexp_matches(name, '^[A-Z][A-Z0-9_]{{0,63}}$') THEN 'names must be upper-case identifiers' END, CASE WHEN coalesce(length(value), 0) < 1 THEN 'values must have 1 to 8192 characters' END, CASE WHEN name = 'PATH' THEN 'reserved name' END], lambda x: x IS NOT NULL), '; ') AS messages FROM {MESSAGES} WHERE NOT regexp_matches(name, '^[A-Z][A-Z0-9_]{{0,63}}$') OR coalesce(length(value), 0) < 1 OR name = 'PATH'",
        "policy_violations": "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 2 THEN 'frameworks' END, CASE WHEN doc_id % 3 = 0 AND (length(source) * (doc_id % 40) NOT BETWEEN 1 AND 100) THEN 'enabled_ids' END, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 THEN 'policy' END], lambda x: x IS NOT NULL), ',') AS fields FROM documents WHERE (doc_id % 4 = 2) OR (doc_id % 3 = 0 AND length(source) * (doc_id % 40) NOT BETWEEN 1 AND 100) OR (doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0)",
        "findings_rollup": f"SELECT category, severity, id, count(*) AS n FROM (SELECT 'pii' AS category, {_SEVERITY} AS severity, id FROM ({_PII_ROWS})) GROUP BY ROLLUP (category, severity, id)",
        "framework_report": f"SELECT framework, count(*) AS n, count(DISTINCT id) AS rules FROM ({_PII_ROWS}) JOIN (VALUES {frameworks}) f(id, framework) USING (id) GROUP BY framework",
        "agent_messages": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations WHERE conv_id % 3 = 0",
        "top_signatures": f"WITH s AS (SELECT length, entropy, has_upper, has_lower, has_digit, has_symbol, count(*) AS occurrences FROM {_SIGNED} GROUP BY ALL) SELECT length, has_upper, has_digit, occurrences, (SELECT sum(occurrences)::BIGINT FROM s) AS total FROM s ORDER BY occurrences DESC, length, entropy, has_upper, has_lower, has_digit, has_symbol LIMIT 5",
        "vault_restore": f"SELECT doc_id, md5(text) AS text_md5 FROM {DOCUMENTS}",
        "rule_catalogue": "SELECT category, n + CASE category WHEN 'secret' THEN (SELECT count(DISTINCT event_type) FROM events WHERE event_id % 24 > 0) ELSE 0 END AS n FROM (VALUES ('secret', 16), ('pii', 10), ('prompt_injection', 24)) v(category, n)",
        "policy_replay": _replay_sql(),
        "stored_traces": _traces_sql(),
        "run_audit": f"SELECT p.doc_id AS run_id, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN '' ELSE 'prompt_injection' END AS categories, 'A_KEY,B_KEY' AS names FROM {PROMPTS} p LEFT JOIN (SELECT doc_id, string_agg(id, ',' ORDER BY o) AS ids FROM (SELECT DISTINCT doc_id, o, id FROM ({_injection_rows()})) GROUP BY doc_id) USING (doc_id)",
        "top_rules": f"SELECT id, count(*) AS n FROM ({_PII_ROWS}) GROUP BY id ORDER BY n DESC, id LIMIT 3",
    }


def _assignments_sql() -> str:
    """Values of 8 characters and more after secret-sounding names, varied enough, likely enough, and neither an UUID nor 40 hexadecimal digits."""
    found = r"""(?i)\b[a-z0-9_-]{0,40}?(?:secret|password|passwd|token|api[_-]?key|credential)[a-z0-9_-]{0,20}["']?\s*[:=]\s*["']?([a-z0-9_\-/+.=]{8,})"""
    kinds = " + ".join(f"regexp_matches(value, '[{c}]')::INT" for c in ("A-Z", "a-z", "0-9"))
    z = f"-6.0 + 1.2 * ({_ENTROPY}) + 0.6 * ({kinds}) - CASE WHEN regexp_full_match(value, '[A-Za-z0-9+/]+={{1,2}}') THEN 4.0 ELSE 0.0 END"
    never = "regexp_full_match(value, '(?i)[0-9a-f]{40}') OR regexp_full_match(value, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')"
    return f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(found)}, 1)) AS value FROM {DOCUMENTS}) WHERE {_ENTROPY} >= 3.8 AND NOT ({never}) AND 1 / (1 + exp(-({z}))) >= 0.2 GROUP BY doc_id"


def _traces_sql() -> str:
    out = _redacted(f"coalesce(text, '') || ' ~ ' || v || {base.pick_sql('conv_id', base.PLANTS)}")
    gone = f"CASE WHEN length(v) = 0 THEN {{0}} WHEN length(v) < 12 THEN replace({{0}}, v, '{SECRET_LABEL}') ELSE replace(replace(replace({{0}}, v, '{SECRET_LABEL}'), left(v, 6), '[REDACTED_SECRET_FRAGMENT]'), right(v, 6), '[REDACTED_SECRET_FRAGMENT]') END"
    status = base.pick_sql("turn", ("completed", "cancelled", "failed"))
    return (
        f"SELECT concat_ws('-', conv_id, turn, role) AS run_id, md5(p) AS prompt_md5, md5({gone.format('r')}) AS output_md5, md5(CASE WHEN status = 'cancelled' THEN 'Run cancelled' ELSE {gone.format('r')} END) AS error_md5 "
        f"FROM (SELECT *, {_redacted("coalesce(text, '')")} AS p, {out} AS r, {status} AS status FROM (SELECT *, substr(coalesce(text, ''), 3, 12) AS v FROM conversations))"
    )


def _provider_re2(rule: str, pattern: str) -> str:
    """A provider rule in RE2's dialect; where it looks around, by hand."""
    return {"openai-api-key": r"\bsk-[A-Za-z0-9]{20,}\b", "gcp-api-key": r"\bAIza[0-9A-Za-z_-]{35}"}.get(rule) or _re2(pattern)
