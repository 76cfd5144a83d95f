"""Training, saving and scoring over message texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from registry import query
from registry.text import _HIT, cleaned, sentence_list
from registry.views import EMAILS, TARGET, TARGET_WIDE, TEST_MONTH, emails
from threadsieve.operators import evaluation, tfidf, trees
from threadsieve.plans import corpus, training
from threadsieve.session import scratch_path, store
from threadsieve.sources import writers

START, END = "2022-08-01", "2023-09-30"


def _corpus(spark, d):
    """Labelled and cleaned messages with their split; feedback counts as positive."""
    messages = corpus.select_messages(emails(spark, d, heavy=True), START, END, dedup="target")
    return corpus.clean_texts(corpus.split_and_label(messages, TEST_MONTH), separator="\n")


def _bundle(spark, d):
    path = scratch_path(spark, "bundle")
    training.train_bundle(_corpus(spark, d), path, min_recall=0.6)
    return writers.load_bundle(spark, path)


_DIGEST = "md5(CAST(snapshot_id AS VARCHAR))"
_SLOT = "('0x' || substr(md5('101:' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT"
CORPUS = f"""WITH {EMAILS},
kept AS (SELECT * FROM emails WHERE length(email) > 0 AND state = 'closed'
  AND time BETWEEN TIMESTAMP '2022-08-01 00:00:00' AND TIMESTAMP '2023-09-30 00:00:00'),
one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY is_complaint DESC NULLS LAST, time DESC, snapshot_id) = 1),
lab AS (SELECT snapshot_id, time, email, CASE WHEN time < DATE '2023-08-01' THEN 'train' ELSE 'test' END AS kind,
  CASE WHEN time < DATE '2023-08-01' THEN {TARGET_WIDE} ELSE {TARGET} END AS target FROM one WHERE time < DATE '2023-09-01'),
newest AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY time DESC, {_DIGEST}) AS r, count(*) OVER (PARTITION BY target) AS n FROM lab WHERE kind = 'train'),
split AS (SELECT snapshot_id, email, target, CASE WHEN r <= floor(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS data_type FROM newest),
num AS (SELECT *, row_number() OVER (PARTITION BY data_type, target ORDER BY {_DIGEST}, snapshot_id) AS pos, count(*) OVER (PARTITION BY data_type, target) AS n FROM split),
draws AS (SELECT data_type, unnest(range(0, n * 5)) AS draw FROM (SELECT DISTINCT data_type, n FROM num WHERE target = 1)),
final AS (SELECT snapshot_id, email, target, data_type, NULL::BIGINT AS draw FROM num WHERE target = 1
  UNION ALL SELECT n.snapshot_id, n.email, n.target, n.data_type, s.draw FROM draws s JOIN num n ON n.data_type = s.data_type AND n.target = 0 AND n.pos = {_SLOT} % n.n + 1
  UNION ALL SELECT snapshot_id, email, target, 'test', NULL FROM lab WHERE kind = 'test'),
lines AS (SELECT snapshot_id, unnest(string_split(q, chr(10))) AS p, generate_subscripts(string_split(q, chr(10)), 1) AS i
  FROM (SELECT snapshot_id, replace(replace(email, '`', chr(39)), '’', chr(39)) AS q FROM lab)),
joined AS (SELECT snapshot_id, string_agg(p, chr(10) ORDER BY i) AS t FROM (SELECT snapshot_id, p, min(i) AS i FROM lines GROUP BY ALL) GROUP BY snapshot_id),
said AS (SELECT snapshot_id, array_to_string(list_filter({sentence_list('t')}, lambda s: NOT ({_HIT})), ' ') AS t FROM joined),
texts AS (SELECT snapshot_id, {cleaned('t')} AS preprocessed_email FROM said)
SELECT snapshot_id, data_type, target, draw, preprocessed_email FROM final JOIN texts USING (snapshot_id)"""


@query("prepare_corpus", CORPUS)
def prepare_corpus(spark, d):
    messages = corpus.select_messages(emails(spark, d, heavy=True), START, END, dedup="target")
    # Balance first: texts that are not drawn need no cleaning.
    balanced = corpus.balance(corpus.split_and_label(messages, TEST_MONTH), 5)
    cleaned_texts = corpus.clean_texts(balanced, separator="\n")
    return cleaned_texts.select("snapshot_id", "data_type", "target", "draw", "preprocessed_email")


@query("train_gbt")
def train_gbt(spark, d):
    _, table = training.build_features(_corpus(spark, d))
    seen = tfidf.has_features(table).withColumn("is_val", F.col("data_type") == "val")
    model = trees.train_gbt(seen.where("data_type <> 'test'"), validation="is_val")
    return trees.score(model, table).select("snapshot_id", "data_type", "target", trees.PROB)


@query("train_rf_cv")
def train_rf_cv(spark, d):
    _, table = training.build_features(_corpus(spark, d))
    seen = tfidf.has_features(table).where("data_type <> 'test'")
    model = trees.train_rf_cv(seen)
    return trees.score(model, table).select("snapshot_id", "data_type", "target", trees.PROB)


@query("bundle_roundtrip")
def bundle_roundtrip(spark, d):
    model, threshold = _bundle(spark, d)
    vocab = tfidf.vocabulary_of(model)
    texts = _corpus(spark, d)
    long = tfidf.explode_vectors(tfidf.vectorize(model, texts), vocab)
    return long.withColumn("best_threshold", F.lit(threshold).cast("double"))


@query("score_batch")
def score_batch(spark, d):
    model, threshold = _bundle(spark, d)
    scored = training.daily_batch(emails(spark, d, heavy=True), model, threshold)
    return scored.select("snapshot_id", trees.PROB, "predicted_label", "pred_response")


@query("bundle_sanity")
def bundle_sanity(spark, d):
    model, threshold = _bundle(spark, d)
    test = trees.score(model, _corpus(spark, d).where("data_type = 'test'"))
    # The metrics read the scores several times; the texts are scored once.
    test = store(test.select("snapshot_id", "target", trees.PROB), "predictions")
    return evaluation.evaluate(test, threshold, trees.PROB)


_ROWS = CORPUS.split("newest AS (")[0].rstrip().rstrip(",") + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY time DESC, md5(CAST(snapshot_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY target) AS n FROM lab WHERE kind = 'train'),
parts AS (SELECT snapshot_id, target, CASE WHEN r <= floor(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS data_type FROM ranked
  UNION ALL SELECT snapshot_id, target, 'test' FROM lab WHERE kind = 'test')"""


def _scored_rows(scored):
    return scored.select("snapshot_id", "data_type", "target", F.col(trees.PROB).between(0, 1).alias("in_range"))


@query("gbt_rows", _ROWS + " SELECT snapshot_id, data_type, target, true AS in_range FROM parts")
def gbt_rows(spark, d):
    """What is determined of the scores of a trained model: rows, splits, labels and range."""
    return _scored_rows(train_gbt(spark, d))


@query("forest_rows", _ROWS + " SELECT snapshot_id, data_type, target, true AS in_range FROM parts")
def forest_rows(spark, d):
    return _scored_rows(train_rf_cv(spark, d))


@query("bundle_vectors", _ROWS + " SELECT snapshot_id, true AS same_vector FROM parts")
def bundle_vectors(spark, d):
    """A saved and loaded bundle makes the vectors of the model that was fitted."""
    texts = store(_corpus(spark, d), "corpus")
    path = scratch_path(spark, "bundle")
    training.train_bundle(texts, path, min_recall=0.6, rounds=3)
    fitted = tfidf.fit_vectors(texts.where("data_type = 'train'"), max_features=990)
    loaded, _ = writers.load_bundle(spark, path)
    sides = [tfidf.vectorize(m, texts.select("snapshot_id", tfidf.TEXT)).select(
        "snapshot_id", F.to_json(F.unwrap_udt("features")).alias(name)) for m, name in ((fitted, "a"), (loaded, "b"))]
    return sides[0].join(sides[1], "snapshot_id").select("snapshot_id", (F.col("a") == F.col("b")).alias("same_vector"))


@query("batch_labels", f"""WITH {EMAILS} SELECT snapshot_id, true AS label_agrees, true AS empty_is_zero FROM emails""")
def batch_labels(spark, d):
    """Batch scores: the label is the score above the threshold, and a message left empty scores 0."""
    model, threshold = _bundle(spark, d)
    scored = training.daily_batch(emails(spark, d, heavy=True), model, threshold)
    prob = F.col(trees.PROB)
    return scored.select(
        "snapshot_id", (F.col("predicted_label") == (prob > threshold).cast("int")).alias("label_agrees"),
        (F.coalesce(F.length("preprocessed_email") > 0, F.lit(False)) | (prob == 0)).alias("empty_is_zero"))


@query("sanity_counts", _ROWS + " SELECT count(*) AS n, count(*) FILTER (target = 1) AS positives, true AS adds_up FROM parts WHERE data_type = 'test'")
def sanity_counts(spark, d):
    """The counts of the evaluation of a loaded bundle."""
    return bundle_sanity(spark, d).select("n", "positives", (F.col("tp") + F.col("fn") == F.col("positives")).alias("adds_up"))


def _punctuation_model():
    """Stand-in for an outside model: logits from length and punctuation."""
    def logits(texts):
        size = np.array([len(t) for t in texts], dtype=float)
        marks = np.array([t.count("!") + t.count("?") for t in texts], dtype=float)
        return np.stack([np.log1p(size) / 10, marks / 5], axis=1)
    return logits


@query("score_map_in_pandas", r"""SELECT doc_id AS snapshot_id, round(1 / (1 + exp(ln(1 + length(coalesce(text, ''))) / 10
- (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '!?', ''))) / 5.0::DOUBLE)), 9) AS prob_pred FROM documents""")
def score_map_in_pandas(spark, d):
    messages = emails(spark, d, heavy=True)
    scored = trees.score_in_batches(messages, _punctuation_model, "email", ["snapshot_id"])
    return scored.select("snapshot_id", F.round(trees.PROB, 9).alias(trees.PROB))
