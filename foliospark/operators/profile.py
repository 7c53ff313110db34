"""Summaries of timings: medians of both kinds, shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.workspace import written

#: Relative rank error of the quantiles that bracket a median: one sample in so many.
ACCURACY = 10_000


def middle_samples(samples: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The two middle samples per key, exactly: keys, lower, upper (equal for an odd count), n. Nulls don't count.

    Approximate quantiles around the middle, with a margin of their own error, bracket it. The
    samples below the bracket are counted, and only those inside it (some 4 in ACCURACY and ties)
    are ranked: no task sorts a key with all its samples, and no buffer holds them.
    """
    known = samples.filter(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"))
    margin = 2.0 / ACCURACY
    ends = known.groupBy(*keys).agg(F.percentile_approx("_x", [0.5 - margin, 0.5 + margin], ACCURACY).alias("q"), F.count("*").alias("n"))
    ends = written(ends.select(*keys, "n", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high")), "brackets")
    ends = ends.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    placed = known.join(ends, same).drop(*[f"_k_{k}" for k in keys])  # small by the number of keys: Spark broadcasts it if it is
    # equal samples are one row from here on
    inside = placed.groupBy(*keys, "n", F.when(F.col("_x") >= F.col("low"), F.when(F.col("_x") <= F.col("high"), F.col("_x"))).alias("v"), (F.col("_x") < F.col("low")).alias("under")).agg(
        F.count("*").alias("c")
    ).filter("v IS NOT NULL OR under")
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("under"), "v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto).filter("v IS NOT NULL")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))  # noqa: E731  ranks from 0
    return ranked.groupBy(*keys, "n").agg(at(F.floor((F.col("n") - 1) / 2)).alias("lower"), at(F.floor(F.col("n") / 2)).alias("upper")).select(*keys, "lower", "upper", "n")


def breakdown(samples: DataFrame, keys: list[str], x: str, least: float, top: int) -> DataFrame:
    """Sum, count and share of the total per key, the largest `top` of those above `least`.

    The share is of everything, what is hidden included. The total comes from the grouped rows.
    """
    grouped = samples.groupBy(*keys).agg(F.sum(x).alias("total"), F.count("*").alias("n"))
    whole = grouped.agg(F.sum("total").alias("whole"))
    shared = grouped.join(F.broadcast(whole)).withColumn("percent", F.col("total") * 100 / F.col("whole")).drop("whole")
    return shared.filter(F.col("total") >= least).orderBy(F.desc("total"), *keys).limit(top)


def stage_medians(samples: DataFrame, keys: list[str], stages: list[str], extremes: list[str]) -> DataFrame:
    """One row per key: n, the median of each stage (of an even number the mean of the two in the middle), and min_ and max_ of the columns in extremes.

    Stages are laid one below the other, so that one pass brackets all their medians; a stage
    without a sample has a null median. Keys come from all samples, so a key whose stages are all null stays.
    """
    long = samples.select(*keys, *[F.col(s).cast("double").alias(s) for s in stages]).unpivot(keys, stages, "_stage", "_sample")
    middle = middle_samples(long, [*keys, "_stage"], "_sample").withColumn("_median", (F.col("lower") + F.col("upper")) / 2)
    wide = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_stage") == s, F.col("_median"))).alias(s) for s in stages])
    ends = samples.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in extremes for name, f in (("min", F.min), ("max", F.max))])
    # a null key is a key
    renamed = wide.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *stages)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return ends.join(renamed, same, "left").drop(*[f"_k_{k}" for k in keys])


def throughput(samples: DataFrame, keys: list[str], images: str, seconds: str, memory: list[str]) -> DataFrame:
    """One row per key: n, the median, least and largest images per second of its passes, and the median and peak of each memory column."""
    rated = samples.withColumn("per_second", F.try_divide(F.col(images), F.col(seconds)))
    told = stage_medians(rated, keys, ["per_second", *memory], ["per_second", *memory])
    return told.select(*keys, "n", "per_second", "min_per_second", "max_per_second", *[c for m in memory for c in (m, f"max_{m}")])
