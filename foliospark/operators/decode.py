"""CTC decoding of scores in time as a window and a dictionary join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scores import best_class, best_probability

UNKNOWN = "[UNK]"
#: A dictionary up to this many tokens is broadcast (vocabularies have some 20,000).
BROADCAST_TOKENS = 200_000


def best_classes(steps: DataFrame, scores: str = "scores") -> DataFrame:
    """steps plus k, the best class, and p, its probability."""
    return steps.withColumns({"k": best_class(F.col(scores)), "p": best_probability(F.col(scores))})


def collapse(steps: DataFrame, sample: str = "sample", time: str = "t", blank: int = 0) -> DataFrame:
    """The steps that emit a token: not blank, and not the class of the step before (a blank ends a run)."""
    before = F.lag("k").over(Window.partitionBy(sample).orderBy(time))
    return steps.withColumn("before", before).filter((F.col("k") != blank) & ~F.col("k").eqNullSafe(F.col("before"))).drop("before")


def token_text(emitted: DataFrame, dictionary: DataFrame) -> DataFrame:
    """emitted plus token and fallback: classes outside the dictionary (idx, token) become UNKNOWN."""
    small = dictionary.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    side = F.broadcast(dictionary) if small else dictionary
    return (
        emitted.join(side, F.col("k") == F.col("idx"), "left")
        .withColumns({"fallback": F.col("idx").isNull(), "token": F.coalesce("token", F.lit(UNKNOWN))})
        .drop("idx")
    )


def decode(steps: DataFrame, dictionary: DataFrame, sample: str = "sample", time: str = "t", scores: str = "scores", blank: int = 0) -> DataFrame:
    """One row per sample: text, token_ids, confidence (mean probability, 1.0 if nothing is emitted), fallback_count.

    One shuffle by sample serves the window and the grouping.
    """
    emitted = token_text(collapse(best_classes(steps.select(sample, time, scores), scores).drop(scores), sample, time, blank), dictionary)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), "k", "token")))
    decoded = emitted.groupBy(sample).agg(ordered.alias("run"), F.avg("p").alias("confidence"), F.count_if("fallback").alias("fallback_count"))
    return steps.select(sample).distinct().join(decoded, sample, "left").select(
        sample,
        F.coalesce(F.array_join(F.transform("run", lambda x: x["token"]), ""), F.lit("")).alias("text"),
        F.coalesce(F.array_join(F.transform("run", lambda x: x["k"].cast("string")), ","), F.lit("")).alias("token_ids"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("fallback_count", F.lit(0)).alias("fallback_count"),
    )
