"""Train and evaluate a secret classifier on labelled spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions.text import entropy, never_secret

FEATURES = ("entropy", "length", "kinds", "digit_share", "hex", "padded")


def features(value: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    return {
        "entropy": entropy(value), "length": F.log1p(F.length(value).cast("double")), "kinds": sum((value.rlike(p).cast("double") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "digit_share": F.length(F.regexp_replace(value, "[^0-9]", "")) / n, "hex": value.rlike("^[0-9a-fA-F-]+$").cast("double"), "padded": value.rlike("={1,2}$").cast("double"),
    }


def scorer(weights: dict[str, float]) -> Callable[[Column], Column]:
    """Trained weights as a function of a value, for Policy.confidence: a column expression, no model is shipped."""

    def score(value: Column) -> Column:
        x = features(value)
        z = sum((F.lit(weights[name]) * x[name] for name in FEATURES), F.lit(weights["intercept"]))
        return F.when(never_secret(value), F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))

    return score


#: Steps of a threshold.
STEPS = 1_000


def calibrate(scored: DataFrame, precision: float) -> float | None:
    """The least threshold, in steps of 1 / STEPS, from which on at least that share of what passes is secret; None if there is none.

    scored: label, score. Rows are counted by step before they meet, so that STEPS + 1 rows are looked at in one place.
    """
    steps = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") != 1).alias("fp"))
    above = Window.orderBy(F.desc("step"))
    right, wrong = F.sum("tp").over(above), F.sum("fp").over(above)
    best = steps.select("step", (right / (right + wrong)).alias("p")).where(F.col("p") >= precision).agg(F.min("step")).first()[0]
    return None if best is None else best / STEPS


def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    """One row (precision, recall, f1, spans) of rows (label, score); a measure whose divisor is 0 is null."""
    hit, secret = F.col("score") >= threshold, F.col("label") == 1
    c = scored.agg(F.count_if(secret & hit).alias("tp"), F.count_if(~secret & hit).alias("fp"), F.count_if(secret & ~hit).alias("fn"), F.count("*").alias("spans"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), "spans")


def train(spans: DataFrame, held_out: Column) -> tuple[dict[str, float], DataFrame]:
    """(weights, metrics at 0.5): a class-balanced logistic regression on rows (value, label) outside held_out, and its measures inside.

    Only weights and sums leave. Values that are never secrets count as such in both.
    """
    rows = spans.withColumn("held_out", held_out)
    x = rows.withColumns(features(F.col("value")))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(x.withColumn("label", F.col("label").cast("double")))
    learn = x.where("not held_out")
    n = {r.label: r.n for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, sum(n.values()) / 2 / max(1, n.get(1.0, 0))).otherwise(sum(n.values()) / 2 / max(1, n.get(0.0, 0)))
    model = LogisticRegression(featuresCol="x", weightCol="w", maxIter=50, regParam=1e-3).fit(learn.withColumn("w", weight))
    weights = dict(zip((*FEATURES, "intercept"), [*map(float, model.coefficients), float(model.intercept)], strict=True))
    return weights, evaluate(rows.where("held_out").select("label", scorer(weights)(F.col("value")).alias("score")), 0.5)
