"""Joining first and second labels to the estimation sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import sample_weight, truthy, without_dots
from .sampling import per_group


def checked_answers(rows: DataFrame, cfg: Config = Config(), answer: str = "answer") -> DataFrame:
    """true_ind from the second answer: dots removed; spelling made even too, if asked for."""
    said = without_dots(F.col(answer))
    if cfg.normalise_answer:
        said = F.initcap(F.regexp_extract(F.trim(said), "^(?i)(yes|no)\\b", 1))
    return rows.withColumn("true_ind", said)


def passed(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    return rows.filter(F.col("true_ind") == cfg.accepted_answer)


def merge_indicator(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join with a column that says where a key was found."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full_outer")
    said = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return both.withColumn("merge", said).drop("_l", "_r")


def unpassed(pool: DataFrame, taken: DataFrame, key: str = "posting_id") -> DataFrame:
    """Rows of the pool whose key isn't taken. Null keys are equal to each other here."""
    keys = taken.select(F.col(key).alias("_key")).distinct()
    return pool.join(keys, pool[key].eqNullSafe(keys["_key"]), "left_anti")


def estimation(pool: DataFrame, checked: DataFrame, cfg: Config = Config(), key: str = "posting_id", code: str = "soc_code") -> DataFrame:
    """Checked rows that passed and a sample of the rest, with weights. Codes of the excluded group and
    rows without a description are out."""
    part1 = passed(checked, cfg)
    rest = unpassed(pool, part1 if cfg.pool_excludes == "passed" else checked, key)
    if "description" in rest.columns:
        rest = rest.filter(F.col("description").isNotNull())
    both = part1.unionByName(per_group(rest, code, cfg.rest_cap, key, cfg.seed), allowMissingColumns=True)
    both = both.filter(~F.col(code).startswith(cfg.excluded_code_prefix))
    return both.withColumn("weight", sample_weight(truthy(F.col("true_ind")), cfg.weight_checked, cfg.weight_other))
