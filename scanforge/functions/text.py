"""Scalar text functions as Column expressions. Lengths and offsets count code points."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as scripts on the web know it (for a character class), invisible characters, and the form of a UUID.
SPACES = r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
INVISIBLE = r"[\u200B-\u200F\u202A-\u202E\uFEFF]"
#: ASCII word boundaries, before and after a word character.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # not Arrow's utf8_normalize, which leaves letters and their accents apart
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts with non-ASCII characters carry content to Python; the others stay here."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def normalize_for_injection_scan(text: Column) -> Column:
    return collapse_spaces(strip_invisible(nfkc(text)))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; empty has 0. Terms are added in order of first appearance."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.split(value, "")), lambda c: -share(c) * F.log2(share(c)))
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits, other characters left out, pass the Luhn check."""
    d = digits(value)
    return F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def aba(value: Column) -> Column:
    """Whether nine digits pass the routing-number check (weights 3, 7, 1)."""
    d = digits(value)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate([3, 7, 1] * 3)), F.lit(0))
    return (F.length(d) == 9) & F.coalesce(total % 10 == 0, F.lit(False))


def signature(value: Column) -> Column:
    """The shape of a secret: never the value itself."""
    has = lambda pattern: value.rlike(pattern)
    return F.struct(
        F.length(value).alias("length"), (F.floor(entropy(value) * 100 + 0.5) / 100).cast("double").alias("entropy"),
        has("[A-Z]").alias("has_upper"), has("[a-z]").alias("has_lower"), has("[0-9]").alias("has_digit"), has("[^A-Za-z0-9]").alias("has_symbol"),
    )


def learned_rule_id(name: Column) -> Column:
    return F.concat(F.lit("learned-"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"))


def uuids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UUID), F.lit(0))


def run_duration(started: Column, ended: Column, as_of: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((F.unix_millis(F.coalesce(ended, as_of)) - F.unix_millis(started)) / 1000)).cast("long")
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat((s / 60).cast("long").cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return F.when(started.isNull(), F.lit("Not started")).otherwise(text)


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))


def tool_summary(calls: Column) -> Column:
    """Summary of struct<commands,file_edits,other>: the total, and its parts in brackets; null: not reported."""
    total = calls["commands"] + calls["file_edits"] + calls["other"]
    other = F.when(calls["other"] > 0, F.concat(calls["other"].cast("string"), F.lit(" other")))
    parts = F.concat_ws(", ", _plural(calls["commands"], "command", "commands"), _plural(calls["file_edits"], "file edit", "file edits"), other)
    text = F.when(total == 0, F.lit("None \u2014 text only")).otherwise(F.concat(total.cast("string"), F.lit(" ("), parts, F.lit(")")))
    return F.when(calls.isNull(), F.lit("Not reported")).otherwise(text)


def usage_summary(usage: Column) -> Column:
    number = lambda c: F.coalesce(usage[c], F.lit(0)).cast("string")
    return F.when(usage.isNull(), F.lit("Pending")).otherwise(F.concat(number("input_tokens"), F.lit(" in / "), number("output_tokens"), F.lit(" out")))


def never_secret(value: Column) -> Column:
    """UUIDs and 40 hexadecimal digits."""
    return value.rlike(f"(?i)^{UUID[4:]}$") | value.rlike("(?i)^[0-9a-f]{40}$")


def secret_confidence(value: Column) -> Column:
    """How likely a value is a secret, 0 to 1. UUIDs and 40 hexadecimal digits are none; padded Base64 is unlikely."""
    padded = value.rlike(r"^[A-Za-z0-9+/]+={1,2}$")
    kinds = sum((value.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    z = F.lit(-6.0) + F.lit(1.2) * entropy(value) + F.lit(0.6) * kinds - F.when(padded, F.lit(4.0)).otherwise(F.lit(0.0))
    return F.when(never_secret(value), F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))
