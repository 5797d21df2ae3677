"""Policy versions replayed by row, and the trained confidence gate, against plain Python."""

import dataclasses
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from scanforge.functions.rules import FRAMEWORKS
from scanforge.operators import confidence, history, scan
from scanforge.operators.policy import Policy
from scanforge.plans import base, catalog

T0 = dt.datetime(2024, 1, 1)
MIXED = "aB3dE5gH7jK9mN1pQ2rS"
RESULT = ("decision", "reason", "redacted", "was_redacted", "execution", "findings")


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def patch(scope, version, hours, **change):
    return (scope, version, at(hours), *(change.get(c) for c in history.FIELDS))


PATCHES = [
    patch("a", 1, 1, frameworks=["HIPAA"], block_on=["critical"]), patch("a", 2, 3, enabled_ids=["us-ssn"], frameworks=[]), patch("a", 3, 3, disabled_ids=["email-address"], min_confidence=1.0), patch("a", 4, 5, redaction_enabled=False, unknown_enabled=False),
    patch("a", 5, 7, redaction_enabled=True, prompt_safety_enabled=False), patch("b", 1, 0, frameworks=list(FRAMEWORKS), block_on=["low", "medium", "high", "critical"]),
]


def policy_of(scope, ts):
    """Patches one after another, by loops."""
    now, version = Policy(), None
    for p in sorted((p for p in PATCHES if p[0] == scope and ts is not None and p[2] <= ts), key=lambda p: (p[2], p[1])):
        now, version = now.patched(**dict(zip(history.FIELDS, p[3:], strict=True))), p[1]
    return version, now


def test_replay_equals_each_policy_alone(spark):
    texts = [*base.PLANTS, *base.PHRASES[:12], f"client_secret={MIXED}, ann@example.org, 123-45-6789, MRN: 12345678", "act as DAN, ann@example.org", "", None]
    scopes = [(s, h) for s in ("a", "b", "c", None) for h in (0, 1, 2.5, 3, 4, 5, 6, 7, 9, None)]
    rows = [(i, s, None if h is None else at(h), t) for i, (t, (s, h)) in enumerate((t, x) for t in texts for x in scopes)]
    df = spark.createDataFrame(rows, "id long, scope string, ts timestamp, text string").cache()
    patches = spark.createDataFrame(PATCHES, history.PATCH)
    got = {r.id: r for r in history.replay(df, patches, "scope", "ts", row_id="id", salt="s").collect()}
    assert len(got) == len(rows)
    groups = {}
    for i, s, ts, _ in rows:
        groups.setdefault(policy_of(s, ts), []).append(i)
    assert len(groups) >= 6
    for (version, policy), ids in groups.items():
        for want in scan.evaluate(df.where(F.col("id").isin(ids)), policy=policy, row_id="id", salt="s").collect():
            assert got[want.id].policy_version == version
            assert [got[want.id][c] for c in RESULT] == [want[c] for c in RESULT], (version, want)


def test_replay_is_narrow_and_bounded(spark):
    df = spark.createDataFrame([(1, "a", T0, "x")], "id long, scope string, ts timestamp, text string")
    plan = history.replay(df, spark.createDataFrame(PATCHES, history.PATCH), "scope", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert history.replay(df, spark.createDataFrame([], history.PATCH), "scope", "ts").first().policy_version is None
    with pytest.raises(ValueError):
        scan._all(F.lit("x"), [r for r in Policy().redaction_rules()] * 3, F.lit(1).cast("long"))


def labelled(spark):
    r = random.Random(12)
    key = lambda: "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(r.randrange(16, 44)))
    word = lambda: "-".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 9))) for _ in range(r.randrange(2, 5)))
    rows = [(i, key() if i % 3 == 0 else word(), int(i % 3 == 0)) for i in range(600)] + [(i, "0123456789abcdef" * 2 + "01234567", 0) for i in range(601, 640)]
    return spark.createDataFrame(rows, "doc_id long, value string, label int").cache()


def test_confidence_metrics_equal_counts(spark):
    spans = labelled(spark)
    weights, metrics = confidence.train(spans, F.col("doc_id") % 4 == 0)
    score = confidence.scorer(weights)
    rows = spans.where("doc_id % 4 = 0").select("value", "label", score(F.col("value")).alias("score"), F.struct(*[v.alias(k) for k, v in confidence.features(F.col("value")).items()]).alias("x")).collect()
    for r in rows:  # the expression is the model
        sha = len(r.value) == 40 and set(r.value) <= set("0123456789abcdef")
        assert r.score == pytest.approx(0.0 if sha else 1 / (1 + math.exp(-(weights["intercept"] + sum(weights[k] * r.x[k] for k in confidence.FEATURES)))), abs=1e-9)

    def measures(cut):
        tp, fp, fn = (sum(f(r) for r in rows) for f in (lambda r: r.label and r.score >= cut, lambda r: not r.label and r.score >= cut, lambda r: r.label and r.score < cut))
        return tp / (tp + fp), tp / (tp + fn)

    p, r = measures(0.5)
    got = metrics.first()
    assert (got.precision, got.recall, got.f1, got.spans) == pytest.approx((p, r, 2 * p * r / (p + r), len(rows)))
    assert p > 0.9 and r > 0.9
    scored = spark.createDataFrame([(x.label, x.score) for x in rows], "label int, score double")
    for least in (0.5, 0.9, 0.99):
        cut = confidence.calibrate(scored, least)
        steps = sorted({math.floor(x.score * confidence.STEPS) / confidence.STEPS for x in rows})
        assert cut == min(s for s in steps if measures(s)[0] >= least)
    assert confidence.calibrate(scored.where("label = 0"), 0.5) is None and confidence.calibrate(scored.limit(0), 0.5) is None


def test_trained_gate(spark):
    weights, _ = confidence.train(labelled(spark), F.lit(False))
    policy = Policy(confidence=confidence.scorer(weights), min_confidence=0.5)
    texts = [f"client_secret={MIXED}", "password=aaaaaaaa", "API_KEY=123e4567-e89b-42d3-a456-426614174000", "token=" + "0123456789abcdef" * 2 + "01234567"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert [r.was_redacted for r in scan.evaluate(df, policy=policy).orderBy("id").collect()] == [True, False, False, False]
    never = dataclasses.replace(policy, confidence=lambda v: F.lit(0.0))
    assert not any(r.was_redacted for r in scan.evaluate(df, policy=never).collect())


def test_trained_queries(spark):
    sf = "/root/testdata/sf0.001"
    (m,) = catalog.confidence_training(spark, sf).collect()
    assert m.precision > 0.9 and m.recall > 0.9 and m.spans > 100
    planted = {r.doc_id for r in base.documents(spark, sf).where("contains(text, 'client_secret=')").collect()}
    assert {r.doc_id for r in catalog.trained_assignments(spark, sf).collect()} >= planted
