"""Features, classifier and threshold as one saved bundle; daily scoring with it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.functions import text as tx
from threadsieve.operators import evaluation, rows, tfidf, trees
from threadsieve.session import scratch_path, store
from threadsieve.sources import writers

KEYS = ["snapshot_id", "thread_id", "time", "data_type"]


def build_features(
    corpus: DataFrame, max_features: int = 990, stop_words: list[str] | None = None, path: str | None = None
) -> tuple[PipelineModel, DataFrame]:
    """Fit the vectoriser on the train rows and store the feature table.

    The table is written to shared storage and read back: training passes over
    it many times, and a lost executor must not bring back the text cleaning.
    """
    spark = corpus.sparkSession
    cleaned = path or scratch_path(spark, "features")
    writers.write_shards(corpus, f"{cleaned}/texts")
    texts = spark.read.parquet(f"{cleaned}/texts")
    train = texts.where("data_type = 'train'")
    vectors = tfidf.fit_vectors(train, max_features=max_features, stop_words=stop_words)
    keys = [k for k in KEYS if k in texts.columns]
    table = tfidf.feature_table(tfidf.vectorize(vectors, texts), keys).withColumnRenamed("target_variable", "target")
    writers.write_shards(table, f"{cleaned}/vectors")
    return vectors, spark.read.parquet(f"{cleaned}/vectors")


def train_bundle(
    corpus: DataFrame, path: str, min_recall: float = evaluation.MIN_RECALL, max_features: int = 990,
    stop_words: list[str] | None = None, **tree_options,
) -> str:
    """Train on train rows, stop early and calibrate on val rows, save the bundle."""
    vectors, table = build_features(corpus, max_features, stop_words)
    seen = tfidf.has_features(table).where("data_type IN ('train', 'val')").withColumn(
        "is_val", F.col("data_type") == "val"
    )
    model = trees.train_gbt(seen, validation="is_val", **tree_options)
    val = trees.score(model, table.where("data_type = 'val'")).select("target", trees.PROB)
    best = evaluation.threshold_for_recall(val, min_recall, trees.PROB).first()
    bundle = PipelineModel([*vectors.stages, model])
    return writers.save_bundle(bundle, best.best_threshold if best else None, path)


def score_messages(df: DataFrame, model: PipelineModel, threshold: float | None) -> DataFrame:
    """Clean, score and label messages; those left empty get probability 0.

    Batch and stream scoring share this function, and cleaning is the same as in
    training.
    """
    cleaned = df if "preprocessed_email" in df.columns else df.withColumn(
        "preprocessed_email", tx.clean(tx.normalise_quotes(F.col("email")))
    )
    scored = trees.score(model, cleaned)
    prob = F.when(F.length("preprocessed_email") > 0, F.col(trees.PROB)).otherwise(0.0)
    return rows.apply_threshold(scored.withColumn(trees.PROB, prob), trees.PROB, threshold)


def daily_batch(df: DataFrame, model: PipelineModel, threshold: float | None) -> DataFrame:
    """Batch scoring in which empty messages bypass the model.

    Both routes read the cleaned texts, so these are stored once.
    """
    cleaned = store(df.withColumn("preprocessed_email", tx.clean(tx.normalise_quotes(F.col("email")))), "cleaned")
    routed = rows.route_empty(cleaned, lambda part: trees.score(model, part))
    return rows.apply_threshold(routed, trees.PROB, threshold)
