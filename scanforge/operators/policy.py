"""Scan policies: resolved on the driver before the scan is planned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanforge.functions.rules import FRAMEWORKS, INJECTION_RULES, MIN_CONFIDENCE, PII_RULES, SECRET_RULES, Rule, generic_rule
from scanforge.functions.text import secret_confidence, trimmed


@dataclass(frozen=True)
class Policy:
    redaction_enabled: bool = True
    prompt_safety_enabled: bool = True
    frameworks: tuple[str, ...] = ("GDPR", "CCPA")
    enabled_ids: tuple[str, ...] = ()
    disabled_ids: tuple[str, ...] = ()
    block_on: tuple[str, ...] = ("critical", "high")
    unknown_enabled: bool = True
    min_confidence: float = MIN_CONFIDENCE
    extra_rules: tuple[Rule, ...] = ()
    #: How likely a value is a secret; another one may be trained (see confidence.scorer).
    confidence: Callable[[Column], Column] = secret_confidence

    active = injection_active = None  # the rules are chosen before the plan, not row by row

    def patched(self, **changes) -> Policy:
        """Named fields replaced, None and omitted ones unchanged."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in changes.items() if v is not None})

    def pii_active(self, rule: Rule) -> bool:
        """Disabled ids win, then enabled ids, then rules of no framework, then any selected framework."""
        if rule.id in self.disabled_ids:
            return False
        return rule.id in self.enabled_ids or not rule.frameworks or bool(set(rule.frameworks) & set(self.frameworks))

    def redaction_rules(self) -> tuple[Rule, ...]:
        if not self.redaction_enabled:
            return ()
        extra = tuple(r for r in self.extra_rules if r.category != "prompt_injection")
        generic = generic_rule(self.min_confidence if self.unknown_enabled else None, self.confidence)
        return (*SECRET_RULES, generic, *(r for r in PII_RULES if self.pii_active(r)), *extra)

    def injection_rules(self) -> tuple[Rule, ...]:
        extra = tuple(r for r in self.extra_rules if r.category == "prompt_injection")
        return (*INJECTION_RULES, *extra) if self.prompt_safety_enabled else ()


def parse_frameworks(value: Column) -> Column:
    """struct<frameworks, unknown> of a comma-separated list; null gives the default, blank gives none."""
    names = F.filter(F.transform(F.split(value, ","), lambda x: F.upper(trimmed(x))), lambda x: x != "")
    known = F.array(*[F.lit(f) for f in FRAMEWORKS])
    default = F.array(*[F.lit(f) for f in Policy().frameworks])
    got = F.coalesce(names, default)
    return F.struct(F.array_intersect(got, known).alias("frameworks"), F.array_except(got, known).alias("unknown"))
