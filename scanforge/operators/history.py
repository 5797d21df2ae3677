"""Scan rows with the policy that was in force when they were written: versioned policies, replayed in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions.rules import INJECTION_RULES, PII_RULES, SECRET_RULES, Rule, generic_rule

from . import scan
from .policy import Policy

#: Fields of a patch besides scope, version and valid_from; null leaves a field as it was before.
FIELDS = {
    "redaction_enabled": "boolean", "prompt_safety_enabled": "boolean", "frameworks": "array<string>", "enabled_ids": "array<string>", "disabled_ids": "array<string>",
    "block_on": "array<string>", "unknown_enabled": "boolean", "min_confidence": "double",
}
PATCH = "scope string, version long, valid_from timestamp, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
#: Versions up to which their table is broadcast.
SMALL_VERSIONS = 100_000


def _literal(value) -> Column:
    return F.array(*[F.lit(x) for x in value]).cast("array<string>") if isinstance(value, tuple) else F.lit(value)


def versions(patches: DataFrame, start: Policy = Policy()) -> DataFrame:
    """Whole policies (scope, version, valid_from, valid_to and FIELDS) from patches: each field is the last one that was given.

    Patches of one time apply in the order of their versions, and the last of them is the one in force.
    """
    w = Window.partitionBy("scope").orderBy("valid_from", "version")
    whole = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), _literal(getattr(start, c))) for c in FIELDS}
    out = patches.select("scope", "version", "valid_from", F.lead("valid_from").over(w).alias("valid_to"), *[v.alias(c) for c, v in whole.items()])
    return out.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def _bits(flags: list[Column]) -> Column:
    """A bit set, the first flag as bit 0."""
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)), F.lit(0).cast("long"))


def rule_bits(pii: tuple[Rule, ...] = PII_RULES) -> Column:
    """Which redaction rules (secrets, the generic one, PII) a version's fields switch on: disabled ids win, then enabled ids, then frameworks."""
    listed = lambda c, rule: F.array_contains(c, rule.id)
    of = lambda rule: F.arrays_overlap("frameworks", F.array(*[F.lit(f) for f in rule.frameworks])) if rule.frameworks else F.lit(True)
    active = [~listed("disabled_ids", r) & (listed("enabled_ids", r) | of(r)) for r in pii]
    return F.when(F.col("redaction_enabled"), _bits([F.lit(True)] * (len(SECRET_RULES) + 1) + active)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class RowPolicy:
    """A policy whose switches are columns of the rows that are scanned: all rules are planned, each row runs its own."""

    active: Column
    injection_active: Column
    block_on: Column
    min_confidence: Column
    redaction_enabled: bool = True

    def redaction_rules(self) -> tuple[Rule, ...]:
        return (*SECRET_RULES, generic_rule(self.min_confidence), *PII_RULES)

    def injection_rules(self) -> tuple[Rule, ...]:
        return INJECTION_RULES


def replay(rows: DataFrame, patches: DataFrame, scope: str, ts: str, text_col: str = "text", start: Policy = Policy(), row_id: str | None = None, salt: str = "") -> DataFrame:
    """Rows with policy_version (null: before any version of their scope, with the policy `start`) and the columns of scan.evaluate.

    patches: see PATCH. Rows without a time or a scope take `start` too.
    """
    done = versions(patches, start)
    switches = {
        "active_": rule_bits(), "injection_": F.when(F.col("prompt_safety_enabled"), F.lit((1 << (len(INJECTION_RULES) + 1)) - 1)).otherwise(F.lit(0)).cast("long"),
        "confidence_": F.when(F.col("unknown_enabled"), F.col("min_confidence")).otherwise(F.lit(0.0)), "block_": F.col("block_on"),
    }
    kept = done.select(F.col("scope").alias("scope_"), F.col("version").alias("policy_version"), F.col("valid_from").alias("from_"), F.col("valid_to").alias("to_"), *[v.alias(c) for c, v in switches.items()])
    few = kept.count() <= SMALL_VERSIONS
    inside = (F.col(scope) == F.col("scope_")) & (F.col(ts) >= F.col("from_")) & (F.col("to_").isNull() | (F.col(ts) < F.col("to_")))
    joined = rows.join(F.broadcast(kept) if few else kept, inside, "left").drop("scope_", "from_", "to_")
    # what `start` means, worked out from its fields like any version
    first = rows.sparkSession.range(1).select(*[_literal(getattr(start, c)).cast(t).alias(c) for c, t in FIELDS.items()]).select(*[v.alias(c) for c, v in switches.items()]).first()
    plain = {c: F.coalesce(F.col(c), _literal(tuple(first[c]) if isinstance(first[c], list) else first[c])) for c in switches}
    joined = joined.withColumns(plain)
    policy = RowPolicy(F.col("active_"), F.col("injection_"), F.col("block_"), F.col("confidence_"))
    return scan.evaluate(joined, text_col, policy, row_id, salt).drop(*switches)
