"""The recruitment pipeline end to end: screening, labelling, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.classify import Classifier, ask_checks, ask_titles
from ..functions.columns import feature_text, truthy, without_dashes
from ..operators import assemble, encode, linear, report, sampling, screen, titles, train
from ..schema import LABELLED_COLUMNS
from ..sources.postings import read_shards
from ..sources.sinks import counted, write_stage


def screening(spark: SparkSession, raw_path: str, out: str, cfg: Config = Config(), pattern: str | None = None) -> dict[str, int]:
    """Raw shards to screened postings, attributes, descriptions and the frequent titles' shards. One
    exchange: duplicates by their key. Returns row counts before and after."""
    raw, seen = counted(read_shards(spark, raw_path, pattern), "raw")
    write_stage(screen.screen(raw, cfg), f"{out}/screened", "shard")
    screened = spark.read.parquet(f"{out}/screened")
    write_stage(screen.attributes(screened), f"{out}/attributes")
    write_stage(screen.descriptions(screened), f"{out}/descriptions")
    counts = titles.frequent(screened, cfg.min_title_count)
    write_stage(titles.shards(counts, cfg.title_shards), f"{out}/titles", "shard")
    return {"raw": seen.get["rows"], "screened": screened.count()}


def labelling(spark: SparkSession, out: str, crosswalk: DataFrame, classifier: Classifier, cfg: Config = Config()) -> None:
    """Codes for titles, postings in scope, a second opinion on a sample, and the estimation sample. Both
    rounds of answers are written once, since asking again costs and may differ."""
    frequent = spark.read.parquet(f"{out}/titles")
    write_stage(ask_titles(frequent, classifier, cfg.title_concurrency), f"{out}/answers")
    postings = spark.read.parquet(f"{out}/screened")
    coded = titles.label_join(postings, titles.labels(spark.read.parquet(f"{out}/answers"))).select(*LABELLED_COLUMNS)
    from ..functions.columns import broad_code

    coded = coded.withColumn("soc_code", broad_code(F.col("soc_code")))
    coded = titles.within(coded, titles.universe(crosswalk))
    write_stage(titles.large_groups(coded, cfg.min_group), f"{out}/labelled")
    labelled = spark.read.parquet(f"{out}/labelled")
    sample = sampling.per_group(labelled, "soc_code", cfg.check_cap, "posting_id", cfg.seed)
    write_stage(ask_checks(sample, classifier, cfg.check_concurrency), f"{out}/checks")
    checked = assemble.checked_answers(spark.read.parquet(f"{out}/checks"), cfg).drop("answer")
    write_stage(assemble.estimation(labelled, checked, cfg), f"{out}/estimation")


def training(spark: SparkSession, out: str, cfg: Config = Config(), features: int = 1 << 14, max_iter: int = 25) -> tuple[DataFrame, DataFrame]:
    """The runs of the grid on the validation set, and the report of the best of them on the test set. Texts are read once,
    and their characters' counts stored; the models are in the store at out/model, where a run that was cut off goes on."""
    sample = spark.read.parquet(f"{out}/estimation").withColumn("soc_code", without_dashes(F.col("soc_code"))).withColumn("true_ind", truthy(F.col("true_ind")))
    ids = encode.label_ids(sample, "soc_code")
    whole = encode.encode(sampling.split(sample, "posting_id", cfg.seed), ids, "soc_code")
    whole = whole.withColumn("text", feature_text(F.col("title"), F.col("description"), cfg.title_repeats)).drop("title", "description")
    write_stage(linear.hashed_counts(whole, "text", features), f"{out}/split", "split")
    whole = spark.read.parquet(f"{out}/split")
    parts = {k: whole.filter(F.col("split") == k) for k in ("train", "valid", "test")}
    weights = encode.class_weights(parts["train"], "label_id")
    weighted = {k: train.loss_weight(df, weights, "label_id").fillna(1.0, ["loss_weight"]) for k, df in parts.items()}
    grid = linear.Grid.of(cfg, features, ids.count())
    idf = linear.rarity(weighted["train"], features)
    linear.fit(weighted["train"], grid, idf, f"{out}/model", max_iter)
    write_stage(linear.run_table(weighted["valid"], grid, idf, f"{out}/model"), f"{out}/runs")
    runs = spark.read.parquet(f"{out}/runs")
    best = report.best_run(runs, cfg.select_by).first()
    said = linear.predict(parts["test"].select("label_id", "places", "counts"), grid, idf, f"{out}/model", best.model).select("label_id", "prediction")
    said = encode.decode(encode.decode(said, ids, "soc_code", "label_id"), ids, "soc_code", "prediction")
    return runs, report.classification_report(said, "label_id", "prediction")
