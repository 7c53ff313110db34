"""Running totals and numbers over a whole table's order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.workspace import written


def running_totals(rows: DataFrame, order: list[str], **weights: Column) -> DataFrame:
    """rows plus, for each weight, before_<name>: the sum of that weight over the rows before, in a total order.

    Rows are dealt by ranges of the order and written, so that a row's range is the same however often it is
    read. Each range has one sum; a row's total is the sums of the ranges before (one small row
    per partition, broadcast) and those of its own range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_w_{n}": F.coalesce(w, F.lit(0)) for n, w in weights.items()})
    dealt = written(named.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are partitions
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in weights])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.join(F.broadcast(offsets), "_part").withColumns({f"before_{n}": F.col(f"_o_{n}") + F.coalesce(F.sum(f"_w_{n}").over(own), F.lit(0)) for n in weights})
    return totals.select(*rows.columns, *[f"before_{n}" for n in weights])


def memory_groups(images: DataFrame, order: list[str], weight: Column, bound: int) -> DataFrame:
    """images plus group: neighbours in the order together, none over the bound but images that are so by themselves.

    An image over half the bound is a group of its own (-1, -2, ...). Of the others, those whose
    running total begins in the same half of the bound are a group: a half, and what the last one
    adds, half at most. A null weight is 0.
    """
    heavy = F.coalesce(weight, F.lit(0)) * 2 > bound
    totals = running_totals(images, order, light=F.when(~heavy, weight).otherwise(0), heavies=heavy.cast("long"))
    group = F.when(heavy, -1 - F.col("before_heavies")).otherwise(F.floor(F.col("before_light") * 2 / bound))
    return totals.withColumn("group", group.cast("long")).drop("before_light", "before_heavies")


def output_hashes(rows: DataFrame, values: str) -> DataFrame:
    """rows plus output_hash: FNV-1a over the bytes of an array of 32-bit floats, the low ones first, in their order; 16 hexadecimal digits, null for a null array."""
    names = rows.columns
    at = names.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at)
            sizes = np.array([len(v.values) if v.is_valid else 0 for v in given], np.int64)
            octets = given.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").view(np.uint8)
            sizes *= 4
            first = np.cumsum(sizes) - sizes
            h = np.full(len(sizes), 0xCBF29CE484222325, np.uint64)
            for k in range(int(sizes.max(initial=0))):  # one place of all rows at a time
                some = np.flatnonzero(sizes > k)
                h[some] = (h[some] ^ octets[first[some] + k].astype(np.uint64)) * np.uint64(0x100000001B3)
            told = [f"{x:016x}" if v.is_valid else None for x, v in zip(h.tolist(), given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], [*names, "output_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, output_hash string")
