"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Each document should be taken ``target / source size`` times. The whole part is certain; the fractions are rounded by
the pivotal method: two of them exchange mass, in a random direction whose odds keep both expectations, until one is 0
or 1. Mass is counted in words, so the words taken from a source do not change. Groups of about ``GROUP`` documents of a
source fold into one residual each; the residuals fold again, level by level, until each source has one left, which goes
to the nearer side. The words taken therefore miss a source's target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadsieve.llm.common import digest, expand, one_row_each, row_digest, same
from threadsieve.session import store

GROUP = 16
WEIGHTS = (3, 1, 2)
_DONE = "array<struct<doc_id:bigint,digest:bigint,taken:int>>"


def targets(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size, target``: ``share`` of all sizes split by weight, none above ``limit`` times its own.

    Sources take the weights in turn, ordered by code point, null last. Sources below the common level of excess are full; filling
    in the order of ``limit * size / weight`` reaches the same end as resharing again and again. The windows
    see one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("w", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("full", F.col("cap") / F.col("w"))
    fill = Window.orderBy("full", F.col("source").isNull(), "source")
    earlier, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = F.max("level").over(every)
    return rows.withColumn("level", left / F.sum("w").over(onward)).select(
        "source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _uniform(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(items: str, seed: int) -> Column:
    """Pivotal rounding along an array of ``doc_id, digest, p, s``; ends with one residual and the decided ones."""
    def state(x, p, done):
        return F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("digest"), p.cast("double").alias("p"),
                        x["s"].alias("s"), done.alias("done"))

    def decided(i, x, taken):
        new = F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("digest"), F.lit(taken).alias("taken"))
        return F.concat(i["done"], F.array(new))

    def step(i, j):
        mass_i, mass_j = i["p"] * i["s"], j["p"] * j["s"]
        free_i, free_j = (1 - i["p"]) * i["s"], (1 - j["p"]) * j["s"]
        up, down = F.least(free_i, mass_j), F.least(mass_i, free_j)
        rises = _uniform(seed, i["doc_id"], i["digest"], j["doc_id"], j["digest"]) * (up + down) < down
        one = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        return (
            F.when(rises & (free_i <= mass_j), state(j, one((mass_j - free_i) / j["s"]), decided(i, i, 1)))
            .when(rises, state(i, one((mass_i + mass_j) / i["s"]), decided(i, j, 0)))
            .when(mass_i <= free_j, state(j, one((mass_i + mass_j) / j["s"]), decided(i, i, 0)))
            .otherwise(state(i, one((mass_i - free_j) / i["s"]), decided(i, j, 1)))
        )

    first = F.col(items)[0]
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), state(first, first["p"], F.array().cast(_DONE)), step)


def rounded(items: DataFrame, seed: int) -> DataFrame:
    """``source, doc_id, digest, taken``: each fraction ``p`` of weight ``s`` rounded to 0 or 1."""
    rest, done, level = items, None, 0
    while True:
        per = rest.groupBy("source").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / GROUP)).alias("per")
        most = per.agg(F.max("groups")).first()[0]
        if most is None:
            last = rest.select("source", "doc_id", "digest", F.lit(0).alias("taken"))
            return last if done is None else done.unionByName(last)
        grouped = rest.alias("rest").join(per.withColumnRenamed("source", "of"), same("source", "of")).select(
            "source", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "digest"), "groups").alias("bucket"),
            F.struct("doc_id", "digest", "p", "s").alias("item"))
        folded = grouped.groupBy("source", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = store(folded.select("source", _fold("items", seed).alias("out")).select("source", "out.*"), "folded")
        own = folded.select("source", F.explode("done").alias("x")).select("source", "x.*")
        done = own if done is None else done.unionByName(own)
        rest, level = folded.select("source", "doc_id", "digest", "p", "s"), level + 1
        if most == 1:
            return done.unionByName(rest.select("source", "doc_id", "digest", (F.col("p") >= 0.5).cast("int").alias("taken")))


def _decide(docs: DataFrame, key: Column, share, limit, weights, seed) -> DataFrame:
    """Classes of identical rows ``doc_id, source, digest, size, n`` with source_size, target and ``copies`` of the class."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("digest"), words.alias("size"))
    classes = store(rows.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sizes, share, limit, weights).withColumnRenamed("source", "of")
    wanted = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * F.col("n")
    rows = classes.join(aims, same("source", "of")).drop("of").withColumn("wanted", wanted)
    rows = store(rows.withColumn("sure", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("sure")), "wanted")
    items = rows.where("p > 0 and size > 0").select("source", "doc_id", "digest", "p", F.col("size").cast("double").alias("s"))
    taken = rounded(items, seed).select(
        F.col("source").alias("_s"), F.col("doc_id").alias("_i"), F.col("digest").alias("_g"), "taken")
    both = rows.join(taken, same("source", "_s") & same("doc_id", "_i") & same("digest", "_g"), "left")
    return both.withColumn("copies", F.col("sure") + F.coalesce("taken", F.lit(0))).drop("_s", "_i", "_g", "taken", "sure", "p", "wanted")


def mixture(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per document: the words of it that the mix takes.

    Takes ``doc_id, text, source``; other columns are ignored. ``size`` counts words (null text: 0). A null source is a
    source of its own. Of identical rows as many are taken as of one row of their joint probability, spread evenly. Texts without words take nothing.
    Choices come from hashes of id and text, so reruns agree whatever the partitioning. An empty table has no rows.
    """
    classes = _decide(docs, digest("text"), share, limit, weights, seed)
    each = F.expr("copies div n") + F.when(F.col("_copy") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return expand(classes, "n", "_copy").select("doc_id", "size", "source_size", "target", (F.col("size") * each).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The documents of the mix: whole rows, each as often as it is taken, with the columns of ``docs``."""
    classes = _decide(docs, row_digest(docs), share, limit, weights, seed).where("copies > 0").select("doc_id", "digest", "copies")
    rows = one_row_each(docs).join(classes, same("_id", "doc_id") & same("_digest", "digest"))
    return expand(rows.select("row", "copies"), "copies", "_copy").select("row.*")
