"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def _ratio(a, b):
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b)).cast("double")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every label seen in truth or prediction, then the accuracy, the
    plain mean and the mean by support. Rows are counted once, by pair; all else works on those counts."""
    pairs = confusion(df, label, prediction).select(F.col(label).cast("string").alias("t"), F.col(prediction).cast("string").alias("p"), "n")
    each = pairs.select(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right"))
    each = each.union(pairs.select("p", F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    each = each.groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "said", "right")])
    precision, recall = _ratio(F.col("right"), F.col("said")), _ratio(F.col("right"), F.col("support"))
    each = each.select("label", precision.alias("precision"), recall.alias("recall"), "support", "right")
    each = each.withColumn("f1_score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1_score")
    n = F.sum("support")
    right = F.sum("right") / n
    summary = each.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *[right.alias(c) for c in scores], right.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in scores], n.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in scores], n.alias("support")),
        ).alias("rows")
    )
    columns = ["label", *scores, "support"]
    return each.select(*columns).unionByName(summary.select(F.inline("rows")).select(*columns))


def weighted_loss(df: DataFrame, probability: str = "probability", weight: str = "loss_weight") -> DataFrame:
    """The mean of -ln of the true label's probability, by weight; a probability of 0 counts as 1e-15."""
    lost = -F.log(F.greatest(F.col(probability), F.lit(1e-15)))
    return df.agg((F.sum(lost * F.col(weight)) / F.sum(F.when(F.col(probability).isNotNull(), F.col(weight)))).alias("loss"))


def best_run(runs: DataFrame, by: str = "loss") -> DataFrame:
    """The run with the least loss, or the greatest accuracy."""
    whole = F.struct(*runs.columns)
    pick = F.min_by(whole, F.col(by)) if by == "loss" else F.max_by(whole, F.col(by))
    return runs.agg(pick.alias("r")).select("r.*")
