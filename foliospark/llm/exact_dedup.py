"""Exact dedup: tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import SPACE, table, text_of, written

#: Runs are halved this many times in a round: 4 bits make each merge sixteen-way.
ROUND_BITS = 4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the digest of its normalised text, and what decides ties."""
    text = text_of(text_col)
    bare = F.regexp_replace(text, SPACE + "+", "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.char_length(text).cast("long").alias("n_chars"),
        bare.alias("bare"),
        F.monotonically_increasing_id().alias("row"),
    ).select(
        "doc_id", "text_key", "n_chars", "row",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.octet_length("bare").cast("long").alias("n_bytes"),
    )


def merge_round(runs: DataFrame, best: Column, members: Column) -> DataFrame:
    """Merge 2**ROUND_BITS neighbouring runs: the best row and the members of each digest.

    A key is a run and a digest, and tasks reduce their own rows first, so a key's rows are at most
    one from each task that holds the runs merged: no task gathers a hot digest, at any level.
    Digests of texts with different lengths never merge.
    """
    merged = runs.withColumn("run", F.shiftright("run", ROUND_BITS))
    return merged.groupBy("run", "digest", "n_bytes").agg(F.min(best).alias("best"), F.sum(members).alias("members"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents have equal texts, and which of them stays.

    Texts are equal when identical without the characters of SPACE; null counts as empty, and
    empty texts are equal to each other. Of equal texts the row with the most code points stays,
    then the smallest id (null ids last), then the first row read: of repeated rows exactly one
    stays. Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars,
    text_key (hash of the original text). An empty table gives an empty result; other columns are
    not read.

    A run is what one task wrote. Each task sorts and reduces its own run, and neighbouring runs
    merge in rounds until one is left. The result then flows back in two joins: to the runs of the
    first round (as many rows of a digest as there are such runs at most) and to the rows (such a
    run's share of a digest at most). Equal texts are known by SHA-256 and length.
    """
    rows = written(digests(docs, id_col, text_col).withColumn("run", F.spark_partition_id()), "digests")
    last = rows.agg(F.max("run")).first()[0] or 0
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    runs = merged = merge_round(rows, best, F.lit(1))
    while last := last >> ROUND_BITS:
        merged = merge_round(merged, F.col("best"), F.col("members"))
    final = merged.select(
        "digest", "n_bytes", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("members").alias("group_size")
    )
    back = runs.select("run", "digest", "n_bytes").join(final, ["digest", "n_bytes"])
    return rows.withColumn("run", F.shiftright("run", ROUND_BITS)).join(back, ["run", "digest", "n_bytes"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars", "text_key",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are found again by id and text; where several rows agree in both, one of them stays.
    """
    # written, so that Spark knows its size and needn't shuffle the texts where it's small
    kept = written(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "kept")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_doc_id"), F.xxhash64(text_of(text_col)).alias("_doc_key"))
    found = keyed.join(kept, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_key") == F.col("_key")), "left_semi")
    again = docs.groupBy(id_col).agg(F.count("*").alias("_times")).filter("_times > 1").limit(1).count()
    return (found.dropDuplicates(["_doc_id", "_doc_key"]) if again else found).select("_doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM bare
"""
}
