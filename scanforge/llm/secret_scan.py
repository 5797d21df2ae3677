"""Secrets in text: three base patterns, and tokens that look random to a pair of Markov models.

Everything on this path is a DataFrame expression. The models are character bigram tables, one of random
strings and one of ordinary identifiers, counted in Spark from labelled samples. A token is reported when
its log-likelihood ratio passes a threshold. The ratio table has a fixed size (SYMBOLS squared), so it
travels as a constant.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.arrays import once, scan_left

from .common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORD = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a match of 16 characters or more is a whole run, so the length can be part of the pattern
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
MIN_ASSIGNED = 8
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1  # 0 stands for the token's start
SMOOTHING = 0.5
#: Occurrences that a symbol's overall frequency counts for after any one symbol.
PRIOR = 4.0
#: Natural logarithm of the odds that a token must reach, in all and for each character.
MIN_RATIO, MIN_RATIO_EACH = 12.0, 0.25
#: Documents whose tokens are the labelled sample, chosen by hash; and distinct tokens of each label at most.
SAMPLE_DOCUMENTS, SAMPLE_TOKENS = 2_000, 50_000
KINDS = ("assign", "access", "hex", "markov")
_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, order: int, value_group: int | None = None, wanted=None) -> Column:
    """array<struct<start,kind,end>> of the non-overlapping matches, in code points; order: the kind's place in KINDS.

    wanted: a condition on the match (or its value_group). It is checked before a span is kept, and no match is looked up in
    the text again, so that a long text with very many matches costs no more than those that are wanted.
    """
    def spans(found: Column) -> Column:
        values = found if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        ok = F.transform(values, wanted or (lambda v: F.lit(True)))
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        return scan_left(F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("len"), ok.alias("ok")), F.lit(0), step, _SPAN)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["len"]).alias("end")))
        return start + x["len"], F.when(x["ok"], one).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _or_empty(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, by start and then kind. text must not be null."""
    assign = _or_empty(text.rlike(ASSIGN_WORD), _spans(text, ASSIGN, 0, 2, lambda v: F.length(v) >= MIN_ASSIGNED))
    access = _or_empty(text.contains("AKIA"), _spans(text, ACCESS, 1))
    hexes = _or_empty(text.rlike(HEX), _spans(text, HEX, 2))
    return F.array_sort(F.concat(assign, access, hexes))


def samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """Labelled tokens (token, random) of a bounded sample: `documents` rows chosen by hash of their id.

    Random: what base patterns find there, and digests of the ids in the alphabets that keys use.
    Ordinary: the distinct other tokens, `tokens` at most.
    """
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = cut(docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id"))  # `documents` ids at most
    assigned = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.regexp_replace(v, r"\.", "_"))
    found = F.concat(F.filter(assigned, lambda v: F.length(v) >= 16), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    digest = F.sha2(F.concat(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    made = F.array(F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", ""), F.substring(digest, 1, 40), F.upper(F.substring(F.conv(F.substring(digest, 1, 15), 16, 36), 1, 16)))
    random = rows.select(F.explode(F.concat(found, made)).alias("token"), F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = rows.select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    some = lambda d: d.distinct().orderBy(F.xxhash64("token"), "token").limit(tokens)  # noqa: E731  # the same ones however rows are dealt
    return some(random).unionByName(some(ordinary))


def train(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each symbol after each, SYMBOLS squared of them.

    labelled: token, random (boolean); null tokens and symbols outside ALPHABET are left out. With no
    samples all ratios are 0.
    """
    chars = F.filter(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    ids = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), ids), ids, lambda a, b: F.when(b.isNotNull(), a * SYMBOLS + b))
    counted = labelled.where(F.col("token").isNotNull()).select("random", F.explode(pairs).alias("pair")).where(F.col("pair").isNotNull())
    counts = {(r.random, r.pair): r.n for r in counted.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # 2 * SYMBOLS**2 rows at most
    before = {(k, p): sum(counts.get((k, p * SYMBOLS + c), 0) for c in range(1, SYMBOLS)) for k in (True, False) for p in range(SYMBOLS)}
    alone = {(k, c): smoothing + sum(counts.get((k, p * SYMBOLS + c), 0) for p in range(SYMBOLS)) for k in (True, False) for c in range(1, SYMBOLS)}
    total = {k: sum(alone[k, c] for c in range(1, SYMBOLS)) for k in (True, False)}

    def log(k: bool, p: int, c: int) -> float:
        """After a symbol that was seen little, a symbol is as likely as it is anywhere."""
        return math.log((counts.get((k, p * SYMBOLS + c), 0) + PRIOR * alone[k, c] / total[k]) / (before[k, p] + PRIOR))

    return [0.0 if c == 0 else log(True, p, c) - log(False, p, c) for p in range(SYMBOLS) for c in range(SYMBOLS)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token that is made of ALPHABET."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to a constant once, on the driver
    zero = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        return F.struct(at.alias("prev"), (a["sum"] + F.get(table, a["prev"] * SYMBOLS + at)).alias("sum"))

    return F.aggregate(F.split(token, ""), zero, step, lambda a: a["sum"])


def scan(docs: DataFrame, model: list[float], min_ratio: float = MIN_RATIO, min_each: float = MIN_RATIO_EACH) -> DataFrame:
    """Adds `base` and `spans`, arrays of struct<start,kind,end> in code points (end exclusive; kind: place in KINDS).

    spans holds the base spans and the tokens that the models call random and that overlap no base span.
    Other columns pass through; columns named base or spans are replaced. A null text counts as empty, and
    an empty one has no spans. Each row is judged alone, so repeated rows and empty tables need no care.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("base", base_spans(text))
    tokens = _spans(text, TOKEN, 3, wanted=lambda v: ratio(v, model) >= F.greatest(F.lit(min_ratio), F.length(v) * F.lit(min_each)))
    judged = F.filter(tokens, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base", _or_empty(text.rlike(TOKEN), judged))))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample of docs and scan them all."""
    return scan(docs, train(samples(docs)))
