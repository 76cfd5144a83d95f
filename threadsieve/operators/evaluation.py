"""Threshold curves, calibration, ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.functions.keys import digest, digest_level, score_levels_desc
from threadsieve.operators.ranking import rank_cuts, running_totals

# The calibration grids (start, step, size) and the default cut.
FINE_GRID = (0.0, 0.0001, 10100)
COARSE_GRID = (0.01, 0.01, 99)
DEFAULT_THRESHOLD = 0.5
MIN_RECALL = 0.85

_ALL = "_all"


def _grouped(df: DataFrame, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _grid_value(i: Column, grid: tuple[float, float, int]) -> Column:
    return F.lit(grid[0]) + i.cast("double") * F.lit(grid[1])


def _grid_slot(score: Column, grid: tuple[float, float, int]) -> Column:
    """Largest grid index whose value is <= score (-1 below the grid and for a null score).

    The quotient may miss by one in floating point, so it is corrected by
    comparing with the grid values themselves.
    """
    guess = F.floor((score - grid[0]) / grid[1])
    slot = (
        F.when(_grid_value(guess + 1, grid) <= score, guess + 1)
        .when(_grid_value(guess, grid) > score, guess - 1)
        .otherwise(guess)
    )
    # least and greatest skip nulls: a null score must not reach the top of the grid
    return F.when(score.isNull(), -1).otherwise(F.greatest(F.least(slot, F.lit(grid[2] - 1)), F.lit(-1))).cast("int")


def threshold_curve(
    df: DataFrame, prob: str = "prob", target: str = "target", by: list[str] | None = None,
    grid: tuple[float, float, int] = FINE_GRID, positives_only: bool = False,
) -> DataFrame:
    """tp, predicted, precision, recall and F1 at every grid threshold (score >= t).

    One aggregation into grid buckets, then a running sum over the buckets.
    """
    if positives_only:
        df = df.where(F.col(target) == 1)
    df, by = _grouped(df, by)
    hist = df.groupBy(*by, _grid_slot(F.col(prob), grid).alias("i")).agg(
        F.count("*").alias("_n"), F.sum(target).alias("_pos")
    )
    full = hist.groupBy(*by).agg(F.sum("_pos").alias("positives")).select(
        *by, "positives", F.explode(F.sequence(F.lit(0), F.lit(grid[2] - 1))).alias("i")
    )
    w = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, predicted, positives = F.col("tp"), F.col("predicted"), F.col("positives")
    return (
        full.join(hist, [*by, "i"], "left")
        .withColumns({
            "tp": F.coalesce(F.sum("_pos").over(w), F.lit(0)),
            "predicted": F.coalesce(F.sum("_n").over(w), F.lit(0)),
        })
        .select(
            *[c for c in by if c != _ALL], "i", _grid_value(F.col("i"), grid).alias("threshold"),
            "tp", "predicted", "positives",
            _ratio(tp, predicted).alias("precision"), _ratio(tp, positives).alias("recall"),
            _ratio(2 * tp, predicted + positives).alias("f1"),
        )
    )


def threshold_for_recall(
    df: DataFrame, min_recall: float | list[float] = MIN_RECALL, prob: str = "prob", target: str = "target",
    by: list[str] | None = None, positives_only: bool = False,
) -> DataFrame:
    """Threshold of highest precision among those with recall > min_recall.

    Ties go to the largest threshold; no threshold left gives null. A list of
    minimum recalls gives one row each from the same curve.
    """
    wanted = min_recall if isinstance(min_recall, list) else [min_recall]
    curve, by = _grouped(threshold_curve(df, prob, target, by, positives_only=positives_only), by)
    best = F.struct("precision", "i", "threshold", "recall", "f1")
    found = [
        F.struct(F.lit(float(r)).alias("min_recall"), F.max(F.when(F.col("recall") > r, best)).alias("b"))
        for r in wanted
    ]
    return (
        curve.groupBy(*by).agg(F.array(*found).alias("_m")).select(*by, F.inline("_m"))
        .select(
            *[c for c in by if c != _ALL], "min_recall", F.col("b.threshold").alias("best_threshold"),
            F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
        )
    )


def threshold_for_f1(
    df: DataFrame, prob: str = "prob", target: str = "target", by: list[str] | None = None
) -> DataFrame:
    """Smallest threshold of the coarse grid with the highest F1; null if all are zero."""
    curve, by = _grouped(threshold_curve(df, prob, target, by, COARSE_GRID), by)
    best = F.when(F.col("f1") > 0, F.struct("f1", (-F.col("i")).alias("_i"), "threshold"))
    return curve.groupBy(*by).agg(F.max(best).alias("b")).select(
        *[c for c in by if c != _ALL], F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("f1")
    )


def curve_points(
    df: DataFrame, prob: str = "prob", target: str = "target", by: list[str] | None = None
) -> DataFrame:
    """Exact ROC and PR points: one row per distinct score, with the counts
    standing at and before it (higher scores first). Rows without a score are no points."""
    df, by = _grouped(df.where(F.col(prob).isNotNull()), by)
    high, low, exact = score_levels_desc(F.col(prob))
    counts = df.groupBy(*by, high.alias("_l1"), low.alias("_l2"), exact.alias("_o")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    totals = running_totals(counts, by, ["_l1", "_l2"], "_o", ["pos", "neg"])
    return totals.select(
        *by, (-F.col("_o")).alias("threshold"), "pos", "neg", "pos_before", "neg_before",
        (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"),
    )


def areas(points: DataFrame, by: list[str]) -> DataFrame:
    """ROC AUC and PR AUC of curve points.

    PR AUC is the trapezoid over recall, starting at recall 0, precision 1. Every
    row knows the counts before it, so no neighbour has to be looked up.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    before = F.col("pos_before") + F.col("neg_before")
    prior = F.when(before == 0, 1.0).otherwise(F.col("pos_before") / before)
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    return (
        points.groupBy(*by)
        .agg(
            F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
            F.sum(neg * (F.col("pos_before") + pos / 2)).alias("_roc"),
            F.sum(pos * (prior + here) / 2).alias("_pr"),
        )
        .select(
            *by,
            F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                   F.col("_roc") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
            F.when(F.col("_p") > 0, F.col("_pr") / F.col("_p")).alias("pr_auc"),
        )
    )


def roc_pr_curve(df: DataFrame, prob: str = "prob", target: str = "target", by: list[str] | None = None) -> DataFrame:
    """threshold, tp, fp, precision and recall per distinct score."""
    points = curve_points(df, prob, target, by)
    totals = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    if by:
        # One row per group.
        known = points.join(F.broadcast(points.groupBy(*by).agg(*totals)), by)
    else:
        known = points.withColumn("_t", points.select(F.struct(*totals).alias("t")).scalar()).select("*", "_t.*")
    return known.select(
        *(by or []), "threshold", "tp", "fp",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("_p")).alias("recall"),
        _ratio(F.col("fp"), F.col("_n")).alias("fpr"),
    )


def counts_above(target: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates n, positives, tp, fp, fn of a boolean prediction."""
    p = F.coalesce(predicted, F.lit(False))
    return {
        "n": F.count("*"),
        "positives": F.count_if(target == 1),
        "tp": F.count_if((target == 1) & p),
        "fp": F.count_if((target == 0) & p),
        "fn": F.count_if((target == 1) & ~p),
    }


def rates() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def evaluate(
    df: DataFrame, threshold: float | Column | None = DEFAULT_THRESHOLD, prob: str = "prob", target: str = "target",
    by: list[str] | None = None,
) -> DataFrame:
    """The evaluation row per group: positives, errors, precision, recall, F1, areas.

    A row counts as predicted when its score is strictly above the threshold,
    a number or a column of the row. Without a threshold no row is predicted.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    rows, keys = _grouped(df, by)
    named = counts_above(F.col(target), F.col(prob) > limit)
    counts = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in named.items()]).withColumns(rates())
    under = areas(curve_points(df, prob, target, by), keys)
    if by:
        return counts.join(under, keys)
    both = under.select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
    return counts.withColumn("_a", both).select(*[c for c in counts.columns if c != _ALL], "_a.*")


def evaluate_at(
    df: DataFrame, thresholds: DataFrame, prob: str = "prob", target: str = "target", by: list[str] | None = None,
) -> DataFrame:
    """Evaluate many thresholds per group in one pass.

    ``thresholds`` is a report-sized table with the ``by`` columns and
    ``threshold``. Each row is sorted into the gap between two thresholds and
    counted there, so rows are never repeated per threshold.
    """
    df, keys = _grouped(df, by)
    thresholds, _ = _grouped(thresholds, by)
    listed = thresholds.where(F.col("threshold").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_set("threshold")).alias("_ts")
    )
    below = F.size(F.filter("_ts", lambda t: t < F.col(prob)))
    placed = df.join(F.broadcast(listed), keys) if by else df.withColumn("_ts", listed.select("_ts").scalar())
    gaps = placed.groupBy(*keys, "_ts", below.alias("_gap")).agg(
        F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) == 0).alias("_neg")
    )
    above = F.col("_gap") > F.col("_q")
    scored = (
        gaps.select(*keys, "_gap", "_pos", "_neg", F.posexplode("_ts").alias("_q", "threshold"))
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.sum("_pos").alias("positives"),
            F.sum(F.when(above, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("_neg")).otherwise(0)).alias("fp"),
        )
        .withColumn("fn", F.col("positives") - F.col("tp"))
    )
    return scored.withColumns(rates()).drop(_ALL)


def recall_sweep(
    val: DataFrame, test: DataFrame, min_recalls: list[float], prob: str = "prob", target: str = "target",
    by: list[str] | None = None,
) -> DataFrame:
    """Thresholds calibrated on ``val`` for several minimum recalls, and the
    default one, evaluated on ``test``; repeated recalls keep the first row
    (the default, then rising minimum recall)."""
    by = by or []
    tuned = threshold_for_recall(val, min_recalls, prob, target, by).select(
        *by, "min_recall", F.col("best_threshold").alias("threshold")
    )
    default = tuned.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("min_recall"), F.lit(DEFAULT_THRESHOLD).alias("threshold")
    ) if by else val.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("min_recall"), F.lit(DEFAULT_THRESHOLD).alias("threshold")
    )
    named = tuned.unionByName(default)
    scored = named.join(evaluate_at(test, named, prob, target, by), [*by, "threshold"])
    w = Window.partitionBy(*by, "recall").orderBy(F.col("min_recall").asc_nulls_first())
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def pr_points(sweep: DataFrame, floor: float = 0.9) -> DataFrame:
    """Points with recall above a floor, next to the precision of flagging all."""
    return sweep.where(F.col("recall") > floor).withColumn(
        "baseline_precision", F.col("positives") / F.col("n")
    )


def _cells(df: DataFrame, target: str, predicted: str) -> DataFrame:
    t, p = F.col(target), F.col(predicted)
    return df.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, target: str = "target", predicted: str = "predicted_label") -> DataFrame:
    """The four cells, zero ones included."""
    return _cells(df, target, predicted).select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for t, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    ])))


def classification_report(df: DataFrame, target: str = "target", predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, accuracy."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"),
        )

    lines = _cells(df, target, predicted).select(
        line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"),
        total.alias("total"), _ratio(tn + tp, total).alias("accuracy"),
    )

    def mean(name: str, wa: Column, wb: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), *[
            ((F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb) / (wa + wb)).alias(m)
            for m in ("precision", "recall", "f1")
        ], F.col("total").alias("support"))

    accuracy = F.struct(
        F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"),
        F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), F.col("total").alias("support"),
    )
    return lines.select(F.inline(F.array(
        F.col("a"), F.col("b"), accuracy, mean("macro avg", F.lit(1.0), F.lit(1.0)),
        mean("weighted avg", F.col("a.support"), F.col("b.support")),
    ))).withColumn("support", F.col("support").cast("long"))


def _top_shares(df: DataFrame, shares: list[float], prob: str, target: str, row_id: str) -> DataFrame:
    """Rows and positives among the ``floor(n * p)`` highest scores, per share p. A null score ranks last."""
    score = F.coalesce(F.col(prob), F.lit(-1.0))
    high, low, exact = score_levels_desc(score)
    rows = df.select(
        F.lit(0).alias(_ALL), score.alias("_s"), F.col(target).alias("_t"),
        digest(F.col(row_id)).alias("_digest"), high.alias("_l1"), low.alias("_l2"), exact.alias("_l3"),
    ).withColumn("_l4", digest_level(F.col("_digest")))
    totals = rows.groupBy(_ALL).agg(F.count("*").alias("n"), F.sum("_t").alias("positives"))
    sized = totals.select(_ALL, "n", "positives", F.inline(F.array(*[
        F.struct(F.lit(p).alias("share"), F.floor(F.col("n") * F.lit(p)).alias("top_n")) for p in shares
    ])))
    wanted = sized.where(F.col("top_n") > 0).groupBy(_ALL).agg(F.collect_set("top_n").alias("ks"))
    cuts = rank_cuts(
        rows, wanted, [_ALL], ["_l1", "_l2", "_l3", "_l4"], ["_digest"], ["_s", "_digest"]
    ).select(F.sort_array(F.collect_list(F.struct("rank", "_s", "_digest"))).alias("c")).scalar()

    def outside(c: Column) -> Column:
        return (F.col("_s") < c["_s"]) | ((F.col("_s") == c["_s"]) & (F.col("_digest") > c["_digest"]))

    bands = rows.withColumn("_cuts", cuts).groupBy(
        "_cuts", F.size(F.filter("_cuts", outside)).alias("_band")
    ).agg(F.sum("_t").alias("_pos"))
    hits = (
        bands.select("_band", "_pos", F.posexplode("_cuts").alias("_q", "_cut"))
        .groupBy(F.col("_cut.rank").alias("top_n"))
        .agg(F.sum(F.when(F.col("_band") <= F.col("_q"), F.col("_pos")).otherwise(0)).alias("hits"))
    )
    return sized.join(hits, ["top_n"], "left").select(
        "share", F.concat(F.floor(F.col("share") * 100).cast("string"), F.lit("%")).alias("top"),
        "n", "positives", "top_n", F.coalesce("hits", F.lit(0)).alias("hits"),
    )


def lift_gain(
    df: DataFrame, shares: list[float], prob: str = "prob", target: str = "target", row_id: str = "snapshot_id"
) -> DataFrame:
    """Positives found in the top share, against a random pick of that size."""
    gain = F.try_divide(F.col("hits"), F.col("positives") * F.col("share"))
    return _top_shares(df, shares, prob, target, row_id).withColumn("gain", F.round(gain, 2))


def response_rate(
    df: DataFrame, shares: list[float], prob: str = "prob", target: str = "target", row_id: str = "snapshot_id"
) -> DataFrame:
    """Precision inside the top share; null when the share holds no row."""
    rate = F.when(F.col("top_n") > 0, F.col("hits") / F.col("top_n"))
    return _top_shares(df, shares, prob, target, row_id).withColumn("response_rate", rate)


def top_scores(df: DataFrame, n: int, prob: str = "prob", row_id: str = "snapshot_id") -> DataFrame:
    return df.orderBy(F.col(prob).desc(), row_id).limit(n)
