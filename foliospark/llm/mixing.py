"""Mixing sources to target weights: Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import shuffle_partitions, table, written

#: A mean above this is split into equal draws whose sum has the same distribution.
LARGEST_MEAN = 32.0
#: Terms of the cumulative distribution; at LARGEST_MEAN the rest is below 1e-25.
TERMS = 128
#: Up to this many sources the rates are broadcast (about 1 KB each, with the terms).
BROADCAST_SOURCES = 10_000
#: A task makes up to this many copies of a row, about; where a rate is larger, blocks of copies are dealt out first.
COPIES_AT_ONCE = 1024
SEED = "mix-1"
#: The share of a source grows with its rows to this power: below 1 small sources gain.
TEMPERATURE = 0.5
#: Rows out, as a multiple of rows in (expected).
EPOCHS = 1.0


def uniform(seed: str, key: Column, draw: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed, key and draw."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_terms(mean: Column) -> Column:
    """The cumulative Poisson distribution of mean at 0, 1, ... TERMS - 1, as an array."""
    first = F.exp(-mean)
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(F.concat(acc["cdf"], F.array(c)).alias("cdf"), p.alias("p"), c.alias("c"))

    return F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(TERMS - 1)), start, step, lambda acc: acc["cdf"])


def target_rates(
    docs: DataFrame, source_col: str = "source", weights: dict | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE
) -> DataFrame:
    """One row per source: source, n_rows, rate, draws and the terms to invert.

    weights gives target shares by source (sources it leaves out get none); without it a source's
    share goes with n_rows ** temperature. rate is the mean number of copies of each row.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "source string, weight double")
        counts = counts.join(F.broadcast(given.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    counts = written(counts, "source-counts")
    total = counts.agg(F.sum("n_rows").alias("total_rows"), F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("total_weight"))
    share = F.col("weight") / F.col("total_weight")
    rate = F.when(F.col("total_weight") > 0, share * F.col("total_rows") * F.lit(epochs) / F.col("n_rows")).otherwise(0.0)
    rated = counts.join(F.broadcast(total)).select("source", "n_rows", rate.alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int"))
    return written(rated.withColumn("cdf", poisson_terms(F.col("rate") / F.col("draws"))), "source-rates")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict | None = None,
    epochs: float = EPOCHS,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
) -> DataFrame:
    """Repeat and drop rows so that sources reach their target shares, in one global random order.

    Each row is repeated by a Poisson number with its source's rate as mean: the inverse of the
    distribution at a uniform number hashed from seed and id. Rows with equal ids get equal
    counts; a null source is a source of its own; a null id counts as the id "null". Returns the
    columns of docs plus copy (from 0), n_copies and mix_key; the order is that of mix_key within
    a partition, and the partition is a hash of mix_key and the text (so that many rows with a null
    or repeated id are dealt out too), so that the whole is shuffled. Columns
    of docs with these three names are replaced. An empty table gives an empty result.

    A source of few rows and a large share gives a row very many copies: such copies are dealt out in
    blocks before they are made. The rates are broadcast up to BROADCAST_SOURCES sources. Beyond that they're joined by source
    and one of 64 salts, so that a source with a third of all rows is still dealt out.
    """
    spark = docs.sparkSession
    out = [c for c in docs.columns if c not in ("copy", "n_copies", "mix_key")]
    rates = target_rates(docs, source_col, weights, epochs, temperature).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("_source"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf")
    )
    # the columns travel in a struct, so that their names can't clash with those used here
    keyed = docs.select(
        F.struct(*out).alias("_doc"), F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_source")
    )
    n_sources, most_draws = rates.agg(F.count("*"), F.max("_draws")).first()
    if n_sources <= BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(rates), "_source")
    else:
        salts = F.explode(F.array(*[F.lit(i) for i in range(64)]))
        rated = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id", *([f"_doc.{text_col}"] if text_col in out else [])), F.lit(64)).cast("int")).join(rates.withColumn("_salt", salts), ["_source", "_salt"])

    def invert(draw: Column) -> Column:
        u = uniform(seed, F.col("_id"), draw)
        return F.size(F.filter("_cdf", lambda c: c <= u))

    one = invert(F.lit(0))
    many = F.aggregate(F.sequence(F.lit(0), F.col("_draws") - 1), F.lit(0), lambda acc, i: acc + invert(i))
    counted = rated.withColumn("n_copies", F.when(F.col("_draws") == 1, one).otherwise(many).cast("int")).filter("n_copies > 0")
    if (most_draws or 0) * LARGEST_MEAN > COPIES_AT_ONCE:
        blocks = counted.withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1, F.lit(COPIES_AT_ONCE))))
        dealt = blocks.repartition(shuffle_partitions(spark), "_id", "_first", *([F.xxhash64(f"_doc.{text_col}")] if text_col in out else []))
        last = F.least(F.col("_first") + COPIES_AT_ONCE, F.col("n_copies")) - 1
        copies = dealt.withColumn("copy", F.explode(F.sequence("_first", last)))
    else:
        copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return (
        copies.select("_doc.*", "copy", "n_copies", key.alias("mix_key"))
        .repartition(shuffle_partitions(spark), "mix_key", *([F.xxhash64(text_col)] if text_col in out else []))
        .sortWithinPartitions("mix_key")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}

ORACLE_SQL = {
    "op10_mixing": """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source
), total AS (
  SELECT sum(n_rows)::BIGINT AS total_rows, sum(weight::DECIMAL(38, 12))::DOUBLE AS total_weight FROM counts
), rated AS (
  SELECT source, weight / total_weight * total_rows * 1.0 / n_rows AS rate FROM counts, total
), drawn AS (
  SELECT source, greatest(ceil(rate / 32.0), 1)::INT AS draws, rate / greatest(ceil(rate / 32.0), 1)::INT AS mean FROM rated
), cdf(source, k, mean, p, c) AS (
  SELECT source, 0, mean, exp(-mean), exp(-mean) FROM drawn
  UNION ALL
  SELECT source, k + 1, mean, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 127
), drawn_docs AS (
  SELECT d.doc_id, d.source, i AS draw,
         ('0x' || substr(md5('mix-1|' || d.doc_id || '|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN drawn ON d.source = drawn.source, range(0, 64) t(i) WHERE i < drawn.draws
), counted AS (
  SELECT x.doc_id, count(*)::INT AS n_copies
  FROM drawn_docs x JOIN cdf ON cdf.source = x.source AND cdf.c <= x.u GROUP BY x.doc_id
)
SELECT d.*, copy::INT AS copy, n_copies, md5('mix-1|order|' || d.doc_id || '|' || copy) AS mix_key
FROM documents d JOIN counted USING (doc_id), range(0, 10000) r(copy) WHERE copy < n_copies
"""
}
