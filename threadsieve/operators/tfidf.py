"""N-gram vocabulary, smoothed idf and unit-length TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.functions.text import TERM, terms

TEXT = "preprocessed_email"


# Rows whose words a task counts at once.
ROWS_AT_ONCE = 1000


def gram_counts(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 1- and 2-grams of lists of words, and for each list and gram of it the list's place, the gram's place and its count."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), sizes)
    coded = words.flatten().dictionary_encode()
    known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(len(known), 1)
    left = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[left] * width + code[left + 1], return_inverse=True)
    first, second = np.divmod(pairs, width)
    joined = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), pa.scalar(" ", known.type))
    grams = pa.concat_arrays([known, joined])
    each = max(len(grams), 1)
    cells, n = np.unique(np.append(row * each + code, row[left] * each + len(known) + pair), return_counts=True)
    return grams, *np.divmod(cells, each), n


def _rows_of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for at in range(0, len(whole), ROWS_AT_ONCE)):
            grams, row, gram, n = gram_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), grams.take(pa.array(gram)), pa.array(n, pa.int32())], names=[batch.schema.names[0], "term", "n"])


def _sums_of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for at in range(0, len(whole), ROWS_AT_ONCE)):
            grams, _, gram, n = gram_counts(batch.column(0))
            tf, df = np.zeros(len(grams), np.int64), np.bincount(gram, minlength=len(grams))
            np.add.at(tf, gram, n)
            yield pa.RecordBatch.from_arrays([grams, pa.array(tf), pa.array(df, pa.int64())], names=["term", "tf", "df"])


def term_counts(df: DataFrame, text: str = TEXT, row_id: str = "snapshot_id", stop_words: list[str] | None = None) -> DataFrame:
    """(row, term, n) for 1- and 2-grams, counted inside each row: words are made by Spark, once per text, and counted in batches."""
    rows = df.select(row_id, terms(F.col(text), stop_words).alias("_words"))
    return rows.mapInArrow(_rows_of_grams, rows.select(row_id).schema.add("term", "string").add("n", "integer"))


def vocabulary(
    df: DataFrame, text: str = TEXT, min_df: int = 2, max_df: float = 0.9,
    max_features: int | None = 7000, stop_words: list[str] | None = None, row_id: str = "snapshot_id",
) -> DataFrame:
    """Vocabulary with corpus count, document count and idf.

    Terms in fewer than ``min_df`` documents or in more than the share
    ``max_df`` of them are left out; of the rest the ``max_features`` with the
    highest corpus count are kept, ties by term. One shuffle, on the term, after
    sums over batches and tasks: a frequent term ships one row per task.
    """
    documents = df.select(F.count("*").alias("n")).scalar()
    fitted = (
        df.select(terms(F.col(text), stop_words).alias("_words"))
        .mapInArrow(_sums_of_grams, "term string, tf long, df long")
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .withColumn("documents", documents)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("documents")))
        .select("term", "tf", "df", (F.log((1 + F.col("documents")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    if max_features is not None:
        fitted = fitted.orderBy(F.col("tf").desc(), "term").limit(max_features)
    return fitted


def weigh(counts: DataFrame, vocab: DataFrame, row_id: str = "snapshot_id", small: bool = True) -> DataFrame:
    """Long form (row, term, tfidf) by a join with a vocabulary table.

    For vocabularies too large for vectors; ``small`` says that ``vocab`` was
    limited by ``max_features`` and may be broadcast.
    """
    raw = counts.join(F.broadcast(vocab) if small else vocab, "term").select(
        row_id, "term", (F.col("n") * F.col("idf")).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(row_id)))
    return raw.select(row_id, "term", (F.col("_w") / norm).alias("tfidf"))


def fit_vectors(
    df: DataFrame, text: str = TEXT, output: str = "features", max_features: int = 7000,
    min_df: int = 2, max_df: float = 0.9, stop_words: list[str] | None = None, row_id: str = "snapshot_id",
) -> PipelineModel:
    """Pipeline from text to a sparse unit-length TF-IDF vector.

    Fitting brings the ``max_features`` vocabulary rows to the driver, sorted by
    term; transforming is row-local.
    """
    rows = vocabulary(df, text, min_df, max_df, max_features, stop_words, row_id).select("term", "idf").collect()
    if not rows:
        raise ValueError("no term passes min_df and max_df")
    rows = sorted(rows, key=lambda r: r.term)
    return vector_pipeline([r.term for r in rows], [r.idf for r in rows], text, output, stop_words)


def vector_pipeline(
    vocab: list[str], idf: list[float], text: str = TEXT, output: str = "features",
    stop_words: list[str] | None = None,
) -> PipelineModel:
    words = f"regexp_extract_all(lower({text}), r'{TERM}', 0)"
    if stop_words:
        listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
        words = f"filter({words}, w -> w NOT IN ({listed}))"
    grams = SQLTransformer(statement=(
        "SELECT *, CASE WHEN size(_words) > 1 THEN concat(_words, zip_with("
        "slice(_words, 1, size(_words) - 1), slice(_words, 2, size(_words) - 1), "
        "(a, b) -> concat_ws(' ', a, b))) ELSE _words END AS _grams "
        f"FROM (SELECT *, {words} AS _words FROM __THIS__)"
    ))
    counts = CountVectorizerModel.from_vocabulary(vocab, inputCol="_grams", outputCol="_counts")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=output)
    return PipelineModel([grams, counts, scaled, unit])


def vectorize(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_words", "_grams", "_counts", "_scaled")


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


def explode_vectors(df: DataFrame, vocab: list[str], features: str = "features", row_id: str = "snapshot_id") -> DataFrame:
    """Long form (row, term, tfidf) of sparse vectors, without a shuffle."""
    parts = F.unwrap_udt(F.col(features))
    names = df.sparkSession.createDataFrame([(vocab,)], "v array<string>").scalar()
    cells = F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("v"))
    return df.select(row_id, F.explode(cells).alias("c")).select(
        row_id, F.get(names, F.col("c.i")).alias("term"), F.col("c.v").alias("tfidf")
    )


def has_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows with at least one vocabulary hit."""
    return df.where(F.size(F.unwrap_udt(F.col(features))["indices"]) > 0)


def feature_table(
    df: DataFrame, keys: list[str], target: str = "target", features: str = "features",
    extra: list[str] | None = None,
) -> DataFrame:
    """Keys, label and one feature vector; ``extra`` numeric columns are appended to it."""
    if extra:
        df = VectorAssembler(inputCols=[features, *extra], outputCol="_joined", handleInvalid="keep").transform(df)
        df = df.drop(features).withColumnRenamed("_joined", features)
    return df.select(*keys, F.col(target).alias("target_variable"), features)
