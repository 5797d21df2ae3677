"""Row contracts. A rejected row says which fields fail and never repeats a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.rules import FRAMEWORKS
from scanforge.functions.text import trimmed

# Names that a declared secret may not take, and the shape that it must have.
RESERVED = ("PATH", "HOME", "TMPDIR", "CODEX_HOME", "ARK_API_KEY", "NO_COLOR", "HTTP_PROXY", "HTTPS_PROXY", "NO_PROXY")
NAME = "^[A-Z][A-Z0-9_]{0,63}$"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

Check = tuple[str, str, Column]


def violations(checks: list[Check]) -> Column:
    """array<struct<field,message>> of the checks (field, message, ok) that do not hold; a null check does not hold."""
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, m, ok in checks]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def validate(df: DataFrame, checks: list[Check], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows: the columns to keep, which hold no content, and `violations`)."""
    marked = df.withColumn("violations", violations(checks))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0).select(*keep, "violations")


def message_checks(content: str = "content") -> list[Check]:
    return [(content, "must have 1 to 50000 characters", F.length(trimmed(F.col(content))).between(1, 50_000))]


def secret_checks(secrets: str = "secrets") -> list[Check]:
    """For a map of names to values; null declares none."""
    s = F.coalesce(F.col(secrets), F.create_map().cast("map<string,string>"))
    return [
        (secrets, "names must be upper-case identifiers", F.forall(F.map_keys(s), lambda k: k.rlike(NAME))),
        (secrets, "values must have 1 to 8192 characters", F.forall(F.map_values(s), lambda v: F.length(v).between(1, 8192))),
        (secrets, "at most 20 entries", F.cardinality(s) <= 20),
        (secrets, "reserved name", ~F.arrays_overlap(F.map_keys(s), F.array(*[F.lit(x) for x in RESERVED]))),
    ]


def entry_checks(entries: str = "entries") -> list[Check]:
    """For an array of struct<name,value> as a form sends it."""
    names = F.transform(entries, lambda e: e["name"])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return [
        (entries, "duplicate name", F.cardinality(F.array_distinct(names)) == F.cardinality(names)),
        (entries, "name and value go together", F.forall(entries, lambda e: blank(e["name"]) == blank(e["value"]))),
    ]


def agent_checks() -> list[Check]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [
        ("name", "must have 1 to 80 characters", F.length(trimmed(text("name"))).between(1, 80)),
        ("description", "at most 500 characters", F.length(text("description")) <= 500),
        ("instructions", "at most 10000 characters", F.length(text("instructions")) <= 10_000),
    ]


def id_checks(*columns: str) -> list[Check]:
    return [(c, "must be a UUID", F.col(c).rlike(UUID)) for c in columns]


def known_fields(json: str, allowed: list[str]) -> list[Check]:
    return [(json, "unknown field", F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed]))) == 0)]


def policy_checks() -> list[Check]:
    """redaction_enabled, frameworks, enabled_ids, disabled_ids: a boolean and arrays, or null; at least one is given."""
    ids = [
        (c, "at most 50 ids of 1 to 100 characters", F.col(c).isNull() | ((F.size(c) <= 50) & F.forall(c, lambda x: F.length(x).between(1, 100))))
        for c in ("enabled_ids", "disabled_ids")
    ]
    known = F.col("frameworks").isNull() | (F.size(F.array_except("frameworks", F.array(*[F.lit(f) for f in FRAMEWORKS]))) == 0)
    return [("frameworks", "unknown framework", known), *ids, ("policy", "no field", F.col("redaction_enabled").isNotNull() | F.coalesce(F.col("frameworks"), F.col("enabled_ids"), F.col("disabled_ids")).isNotNull())]
