"""Token dictionaries as tables of (idx, token); index 0 is the blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.groups import running_totals

BLANK = "[blank]"


def build(tokens: DataFrame, token: str, order: list[str], space: bool = True) -> DataFrame:
    """Tokens in order from index 1, the blank before them and, if asked, the space after them.

    Tokens are numbered by ranges of the order, so that no task sees them all.
    """
    counted = running_totals(tokens.select(F.col(token).alias("token"), *[F.col(c).alias(f"_order_{c}") for c in order]), [f"_order_{c}" for c in order], tokens=F.lit(1))
    numbered = counted.select((F.col("before_tokens") + 1).cast("int").alias("idx"), "token")
    spark = tokens.sparkSession
    rows = numbered.unionByName(spark.createDataFrame([(0, BLANK)], "idx int, token string"))
    if space:
        rows = rows.unionByName(numbered.agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("idx")).select("idx", F.lit(" ").alias("token")))
    return rows


def reverse(dictionary: DataFrame) -> DataFrame:
    """The first index of each token."""
    return dictionary.groupBy("token").agg(F.min("idx").alias("idx"))


def duplicates(lines: DataFrame, token: str, line: str) -> DataFrame:
    """Each token that comes again, with its first line and the line it first comes again on."""
    numbered = lines.select(F.col(token).alias("token"), F.col(line).alias("line")).withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("line")))
    return numbered.filter("k <= 2").groupBy("token").agg(F.min("line").alias("first_line"), F.max("line").alias("again_line"), F.count("*").alias("k")).filter("k = 2").drop("k")


def clean_token(line: Column) -> Column:
    """A dictionary line as its token: trimmed, or as it is where nothing but white space is left; null for an empty line."""
    bare = F.regexp_replace(F.regexp_replace(line, "^﻿", ""), r"[\r\n]+$", "")
    trimmed = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.when(bare == "", None).when(trimmed == "", bare).otherwise(trimmed)
