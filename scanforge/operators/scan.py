"""Scan, decide, redact and pseudonymise: narrow column work, no shuffle.

A finding is struct<id,category,severity,start,end,ordinal>, offsets in code points, end exclusive.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.arrays import once, replace_ranges, scan_left, walk_ranges
from scanforge.functions.rules import ENCODED_ID, PII_LABEL, SECRET_LABEL, Rule
from scanforge.functions.text import LEFT, RIGHT, UUID, normalize_for_injection_scan

from .policy import Policy

FINDING = "struct<id:string,category:string,severity:string,start:int,end:int,ordinal:int>"
SPAN = "struct<start:int,end:int>"
ALLOW_REASON = "No blocking findings"


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _matches(text: Column, pattern: str, prefix: bool = False, gate=None) -> list[Column]:
    """What a pattern cuts a text into: what lies before each match, the matches, their second groups (prefix) and whether gate lets them pass."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if prefix else found
    return [F.split(text, pattern, -1).alias("gaps"), found.alias("found"), (values if prefix else F.lit(None).cast("array<string>")).alias("values"), (F.transform(values, gate) if gate else F.lit(None).cast("array<boolean>")).alias("ok")]


def _spans(m: Column) -> Column:
    """array<struct<start,end>> of what _matches gives as a struct: the values that pass, left to right."""
    size = lambda a, name: F.transform(a, F.length).alias(name)
    zipped = F.arrays_zip(size(m["gaps"], "gap"), size(m["found"], "whole"), F.coalesce(size(m["values"], "v"), size(m["found"], "v")).alias("value"), F.coalesce(m["ok"], F.transform(m["found"], lambda x: F.lit(True))).alias("ok"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + x["whole"]
        one = F.array(F.struct((end - x["value"]).alias("start"), end.alias("end")))
        return end, F.when(x["ok"], one).otherwise(F.array().cast(f"array<{SPAN}>"))

    # one gap more than matches lies behind the last
    return scan_left(F.filter(zipped, lambda x: x["whole"].isNotNull()), F.lit(0), step, SPAN)


def match_spans(text: Column, pattern: str, prefix: bool = False, gate=None) -> Column:
    """array<struct<start,end>> of a pattern's matches, left to right; prefix: of the second group alone; gate: on the value."""
    return once(F.struct(*_matches(text, pattern, prefix, gate)), _spans)


#: Rules that share a bit set.
WORD_BITS = 60


def candidates(text: Column, lowered: Column, rules: list[Rule]) -> Column:
    """A bit set of the rules (WORD_BITS at most, the first is bit 0) that may have findings in a text."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(r.possible(text, lowered), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)))


def _all(text: Column, rules: list[Rule], active: Column | None = None) -> Column:
    """Findings of all rules. active: a bit set of the rules that apply, the first is bit 0; then there are WORD_BITS rules at most.

    Each rule gives its matches alone, of texts that may have any, and one look tells those without a match. Offsets are
    worked out in one place for all rules, so that the plan stays small.
    """
    if active is not None and len(rules) > WORD_BITS:
        raise ValueError(f"at most {WORD_BITS} rules with a bit set")
    about = [{"id": r.id, "category": r.category, "severity": r.severity, "avoid_uuid": r.avoid_uuid} for r in rules]
    about = F.from_json(F.lit(json.dumps(about)), "array<struct<id:string,category:string,severity:string,avoid_uuid:boolean>>")  # a constant

    def hits(t: Column, at: int) -> Column:
        part = rules[at : at + WORD_BITS]
        bit = lambda m, i: m.bitwiseAND(F.lit(1 << i).cast("long")) != 0
        hit = lambda m, i, r: F.when(bit(m, i) & t.rlike(r.pattern), F.struct(F.lit(at + i).alias("ordinal"), *_matches(t, r.pattern, r.prefix, r.gate)))
        maybe = once(F.lower(t), lambda low: candidates(t, low, part))
        maybe = maybe if active is None else maybe.bitwiseAND(active)
        return once(maybe, lambda m: F.filter(F.array(*[hit(m, i, r) for i, r in enumerate(part)]), lambda h: h.isNotNull()))

    def found(t: Column, taken: Column) -> Column:
        free = lambda s: ~F.exists(taken, lambda u: (s["start"] < u["end"]) & (s["end"] > u["start"]))

        def of(h: Column) -> Column:
            rule = F.get(about, h["ordinal"])
            spans = _spans(h)
            if any(r.avoid_uuid for r in rules):
                spans = F.when(rule["avoid_uuid"] & (F.size(taken) > 0), F.filter(spans, free)).otherwise(spans)
            return F.transform(spans, lambda s: F.struct(rule["id"].alias("id"), rule["category"].alias("category"), rule["severity"].alias("severity"), s["start"].alias("start"), s["end"].alias("end"), h["ordinal"].alias("ordinal")))

        return F.flatten(F.transform(F.concat(*[hits(t, at) for at in range(0, len(rules), WORD_BITS)]), of))

    def uuids(t: Column) -> Column:
        return F.when(t.rlike(UUID), match_spans(t, UUID)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return once(text, lambda t: once(uuids(t) if any(r.avoid_uuid for r in rules) else F.array().cast(f"array<{SPAN}>"), lambda taken: found(t, taken)))


def find(text: Column, rules: Iterable[Rule], active: Column | None = None) -> Column:
    """All findings of all rules, in catalogue order."""
    rules = list(rules)
    return _all(text, rules, active) if rules else _none()


def find_injection(text: Column, rules: tuple[Rule, ...], active: Column | None = None) -> Column:
    """Findings on normalised text, with the one for encoded payloads that are to be run (active: bit len(rules))."""
    if not rules:
        return _none()
    both = lambda t: t.rlike(f"(?i){LEFT}base64{RIGHT}") & t.rlike(f"(?i){LEFT}(?:decode|execute|run){RIGHT}")
    on = F.lit(True) if active is None else active.bitwiseAND(F.lit(1 << len(rules)).cast("long")) != 0
    one = F.array(F.struct(F.lit(ENCODED_ID).alias("id"), F.lit("prompt_injection").alias("category"), F.lit("medium").alias("severity"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1000).alias("ordinal")))
    return once(text, lambda t: F.concat(_all(t, list(rules), active), F.when(on & both(t), one).otherwise(_none())))


def resolve(findings: Column) -> Column:
    """The findings to redact: by start, longer first, then catalogue order; greedily those that overlap no earlier one."""
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("start"), (f["start"] - f["end"]).alias("short"), f["ordinal"].alias("ordinal"), f.alias("f")))

    def step(cursor: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= cursor
        return F.when(free, x["f"]["end"]).otherwise(cursor), F.when(free, F.array(x["f"])).otherwise(_none())

    return scan_left(F.array_sort(keyed), F.lit(0), step, FINDING)


def label(finding: Column) -> Column:
    return F.when(finding["category"] == "pii", F.lit(PII_LABEL)).otherwise(F.lit(SECRET_LABEL))


def replace_spans(text: Column, kept: Column, new) -> Column:
    """text with each kept span replaced by new(finding, value)."""
    return replace_ranges(text, kept, new)


def placeholder(kind: Column, salt: str, row_id: Column, value: Column) -> Column:
    """[PRIVATE_<kind>_<id>]: the same for the same value of a row, unrelated across rows. The salt is a job's secret."""
    h = F.sha2(F.concat_ws("|", F.lit(salt), row_id.cast("string"), value), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("[PRIVATE_"), kind, F.lit("_"), F.concat_ws("-", *parts), F.lit("]"))


def _kinds(text: Column, kept: Column) -> Column:
    """array<string>: P or S (its kind) before the value of each kept finding, left to right."""
    kind = lambda f: F.when(f["category"] == "pii", F.lit("P")).otherwise(F.lit("S"))
    return walk_ranges(text, kept, lambda gap, f, value: F.array(F.concat(kind(f), value)))["out"]


def pseudonymise(text: Column, kept: Column, entries: Column, salt: str, row_id: Column) -> Column:
    """text with its kept values replaced by their placeholders. entries: see vault_entries."""
    own = lambda f: F.when(f["category"] == "pii", F.lit("PII")).otherwise(F.lit("SECRET"))
    listed = lambda v: F.element_at(F.filter(entries, lambda e: e["value"] == v), 1)["placeholder"]
    # the list is asked only where a value was found as both kinds
    mixed = F.size(entries) < F.size(F.array_distinct(_kinds(text, kept)))
    return once(mixed, lambda m: replace_spans(text, kept, lambda f, v: F.when(m, listed(v)).otherwise(placeholder(own(f), salt, row_id, v))))


def vault_entries(text: Column, kept: Column, salt: str, row_id: Column) -> Column:
    """array<struct<placeholder,value,kind>> of a row's distinct values; a value seen as both kinds takes its rightmost one."""
    value = lambda x: F.substring(x, F.lit(2), F.lit(1 << 30))

    def entries(seen: Column) -> Column:
        of = lambda kind: F.transform(F.filter(seen, lambda x: x.startswith(kind)), value)
        both = F.array_intersect(of("P"), of("S"))  # hardly ever any
        last = lambda v: F.element_at(F.filter(seen, lambda x: value(x) == v), -1)
        lost = F.transform(both, lambda v: F.concat(F.when(last(v).startswith("P"), F.lit("S")).otherwise(F.lit("P")), v))
        return F.array_except(seen, lost)  # distinct, in order

    kind = lambda x: F.when(x.startswith("P"), F.lit("PII")).otherwise(F.lit("SECRET"))
    return F.transform(once(_kinds(text, kept), entries), lambda x: F.struct(placeholder(kind(x), salt, row_id, value(x)).alias("placeholder"), value(x).alias("value"), kind(x).alias("kind")))


def blocking(findings: Column, policy: Policy) -> Column:
    """Distinct ids of the injection findings whose severity blocks, in catalogue order."""
    stops = (lambda s: F.array_contains(policy.block_on, s)) if isinstance(policy.block_on, Column) else (lambda s: s.isin(*policy.block_on))
    hit = F.filter(findings, lambda f: (f["category"] == "prompt_injection") & stops(f["severity"]))
    return F.array_distinct(F.transform(hit, lambda f: f["id"]))


def decision(findings: Column, policy: Policy) -> Column:
    return F.when(F.size(blocking(findings, policy)) > 0, F.lit("BLOCK")).otherwise(F.lit("ALLOW"))


def reason(findings: Column, policy: Policy) -> Column:
    ids = blocking(findings, policy)
    return F.when(F.size(ids) > 0, F.concat(F.lit("Blocked: matched "), F.array_join(ids, ", "))).otherwise(F.lit(ALLOW_REASON))


def public(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.struct(f["id"].alias("id"), f["category"].alias("category"), f["severity"].alias("severity")))


def redact_text(text: Column, policy: Policy = Policy()) -> Column:
    """Redaction alone, for outputs and errors."""
    return replace_spans(text, resolve(find(text, policy.redaction_rules())), lambda f, v: label(f))


def evaluate(df: DataFrame, text_col: str = "text", policy: Policy = Policy(), row_id: str | None = None, salt: str = "", learned: Column | None = None) -> DataFrame:
    """Adds decision, reason, redacted, execution (pseudonymised, if row_id is given), was_redacted and findings.

    learned: further findings on the text (see mining.learned_findings). A null text counts as empty. The policy is one for
    all rows, or has columns for switches (history.RowPolicy).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = find(text, policy.redaction_rules(), policy.active)
    if learned is not None and policy.redaction_enabled:
        found = F.concat(found, F.coalesce(learned, _none()))
    out = df.withColumn("__sensitive", found).withColumn("__injection", find_injection(normalize_for_injection_scan(text), policy.injection_rules(), policy.injection_active))
    out = out.withColumn("__kept", resolve(F.col("__sensitive"))).withColumn("__all", F.concat("__sensitive", "__injection"))
    cols = {
        "decision": decision(F.col("__all"), policy), "reason": reason(F.col("__all"), policy), "redacted": replace_spans(text, F.col("__kept"), lambda f, v: label(f)),
        "was_redacted": F.size("__kept") > 0, "findings": public(F.col("__all")),
    }
    if row_id:
        entries = vault_entries(text, F.col("__kept"), salt, F.col(row_id))
        out = out.withColumn("__vault", entries)
        cols["execution"] = pseudonymise(text, F.col("__kept"), F.col("__vault"), salt, F.col(row_id))
    out = out.withColumns(cols)
    return out.withColumn("was_redacted", F.col("redacted") != text).drop("__sensitive", "__injection", "__kept", "__all", "__vault")


def vault(df: DataFrame, row_id: str, entries: str) -> DataFrame:
    """Rows (row_id, placeholder, value) of the values that stand behind placeholders: for restricted storage alone.

    entries: a column of vault_entries.
    """
    return df.select(row_id, F.inline(entries)).select(row_id, "placeholder", "value")


def restore_from(df: DataFrame, text: str, row_id: str, values: DataFrame) -> DataFrame:
    """df with the values of a vault table put back into `text`; rows without any stay as they are."""
    own = values.groupBy(row_id).agg(F.collect_list(F.struct("placeholder", "value")).alias("__values"))  # the values of one text
    return df.join(own, row_id, "left").withColumn(text, F.coalesce(restore(F.col(text), F.col("__values")), F.col(text))).drop("__values")


def restore(text: Column, entries: Column) -> Column:
    """Pseudonymised text with its values again."""
    return F.aggregate(entries, text, lambda a, e: F.replace(a, e["placeholder"], e["value"]))


def scrub_declared(text: Column, secrets: Column, allow_partial: bool = False) -> Column:
    """Declared values (map name -> value) removed literally, and of long ones both ends."""
    return scrub_values(text, F.map_values(secrets), allow_partial)


def scrub_values(text: Column, values: Column, allow_partial: bool = False) -> Column:
    """The same for an array of values, in its order; null removes nothing."""

    def one(a: Column, v: Column) -> Column:
        n = F.length(v)
        new = F.lit(SECRET_LABEL)
        if allow_partial:
            new = F.when(n > 6, F.concat(F.lit("[PARTIAL_SECRET:"), F.left(v, F.lit(3)), F.lit("…"), F.right(v, F.lit(3)), F.lit("]"))).otherwise(new)
        full, part = F.replace(a, v, new), F.lit("[REDACTED_SECRET_FRAGMENT]")
        ends = F.replace(F.replace(full, F.left(v, F.lit(6)), part), F.right(v, F.lit(6)), part)
        return F.when(n == 0, a).when(n < 12, full).otherwise(ends)

    return F.when(values.isNull(), text).otherwise(F.aggregate(values, text, one))
