"""Training and inference with Spark ML on hashed characters."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .sampling import hash_rank


def pipeline(features: int = 1 << 14, text: str = "text", label: str = "label_id", weight: str = "loss_weight", max_iter: int = 20, **params: float) -> Pipeline:
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, maxIter=max_iter, family="multinomial", **params)
    return Pipeline(stages=[
        SQLTransformer(statement=f"select *, split({text}, '') as chars from __THIS__"),
        HashingTF(inputCol="chars", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        model,
    ])


def loss_weight(df: DataFrame, class_weights: DataFrame, label: str) -> DataFrame:
    """Add the product of the class's and the row's weight."""
    return df.join(F.broadcast(class_weights), label, "left").withColumn("loss_weight", F.col("class_weight") * F.col("weight"))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in a seeded order, for training in batches, with their place in it from 0; the same whatever the
    partitions. The key should be unique."""
    places = hash_rank(df, key, seed).select(key, (F.col("rank") - 1).alias("place"))
    return df.join(places, key).orderBy("place")


def evaluate(said: DataFrame, metric: str, label: str = "label_id", weight: str = "loss_weight") -> float:
    """A metric of what a model has said; the loss is weighted."""
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    return (scorer.setWeightCol(weight) if metric == "logLoss" else scorer).evaluate(said)


def grid_search(train: DataFrame, valid: DataFrame, cfg: Config = Config(), features: int = 1 << 14, max_iter: int = 20) -> tuple[PipelineModel, list[dict[str, float]]]:
    """Fit a model for each grid point and keep the best by our own validation set. A fit ends by itself when it
    no longer improves, or after max_iter rounds."""
    best, runs = None, []
    names = sorted(cfg.grid)
    for values in product(*(cfg.grid[k] for k in names)):
        params = dict(zip(names, values, strict=True))
        model = pipeline(features, max_iter=max_iter, **params).fit(train)
        said = model.transform(valid).select("label_id", "loss_weight", "probability", "prediction").persist()
        run = params | {"loss": evaluate(said, "logLoss"), "accuracy": evaluate(said, "accuracy")}
        said.unpersist()
        runs.append(run)
        score = run["loss"] if cfg.select_by == "loss" else -run["accuracy"]
        if best is None or score < best[0]:
            best = (score, model)
    return best[1], runs


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
