"""Queries that decode class scores: the embeddings stand for scores, their label for a line, their order for time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.scores import best_class, best_probability, is_distribution
from foliospark.functions.sizes import valid_steps
from foliospark.operators.decode import best_classes, collapse, decode
from foliospark.plans.tables import table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample"), t.alias("t"), F.col("embedding").alias("scores"))


def part_dictionary(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    """Tokens 1 to last from the parts' names: their first letters and number."""
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey").between(1, last))
    return part.select(F.col("p_partkey").cast("int").alias("idx"), F.concat(F.substring("p_name", 1, 1), F.col("p_partkey").cast("string")).alias("token"))


def _decoded(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    return decode(steps(spark, sf_dir), part_dictionary(spark, sf_dir, last)).select(
        "sample", "text", "token_ids", F.round("confidence", 5).alias("confidence"), "fallback_count"
    )


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, 63)


def ctc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, 31)


def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", best_class(F.col("embedding")).alias("k"))


def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(best_probability(F.col("embedding")), 5).alias("p"), is_distribution(F.col("embedding")).alias("distribution"))


def ctc_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the steps that belong to a crop count: a width of 7 * (label + 20) in a batch of 320."""
    s = steps(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("sample"))
    kept = s.withColumn("n", n.cast("int")).filter(F.col("t") <= valid_steps(7 * (F.col("sample") + 20), F.lit(320), F.col("n")))
    emitted = collapse(best_classes(kept.drop("n")))
    return emitted.groupBy("sample").agg(F.count("*").alias("emitted"), F.sum("k").alias("sum_k"), F.round(F.avg("p"), 5).alias("confidence"))


def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four scores as page angles: class, angle and score of the best, and how many pages each angle gets."""
    e = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 4).alias("scores"))
    angle = F.get(F.array(*[F.lit(a) for a in (0, 90, 180, 270)]), best_class(F.col("scores")))
    return e.groupBy("label", angle.alias("angle")).agg(F.count("*").alias("pages"), F.round(F.max(F.array_max("scores").cast("double")), 5).alias("best_score"))


def collapse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as a class sequence: repeats collapse, and a view is the blank."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("t"), F.col("event_type").alias("k"))
    before = F.lag("k").over(Window.partitionBy("user_id").orderBy("t"))
    kept = e.withColumn("before", before).filter((F.col("k") != "view") & ~F.col("k").eqNullSafe(F.col("before")))
    run = F.array_sort(F.collect_list(F.struct("t", "k")))
    return kept.groupBy("user_id").agg(F.array_join(F.transform(run, lambda x: x["k"]), " ").alias("sequence"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f for f in (ctc_decode, ctc_fallback, argmax_class, softmax_confidence, ctc_valid_prefix, orientation_vote, collapse_events)
}

_SCORED = """
scored AS (
  SELECT vec_id, label AS sample, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS t,
         list_position(embedding, list_max(embedding)) - 1 AS k,
         CASE WHEN list_min(embedding) >= -1e-4 AND list_max(embedding) <= 1 + 1e-4
                   AND abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - 1) <= 1e-3
              THEN least(greatest(list_max(embedding)::DOUBLE, 0), 1)
              ELSE 1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) END AS p,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings
)"""


def _decode_sql(last: int) -> str:
    return f"""
WITH {_SCORED}, emitted AS (
  SELECT *, lag(k) OVER (PARTITION BY sample ORDER BY t) AS before FROM scored
), told AS (
  SELECT e.sample, e.t, e.k, e.p, d.p_partkey IS NULL AS fallback, coalesce(substr(d.p_name, 1, 1) || d.p_partkey, '[UNK]') AS token
  FROM emitted e LEFT JOIN part d ON d.p_partkey = e.k AND d.p_partkey <= {last}
  WHERE k <> 0 AND k IS DISTINCT FROM before
)
SELECT s.sample, coalesce(string_agg(token, '' ORDER BY t), '') AS text, coalesce(string_agg(k::VARCHAR, ',' ORDER BY t), '') AS token_ids,
       round(coalesce(avg(p), 1), 5) AS confidence, count(*) FILTER (fallback) AS fallback_count
FROM (SELECT DISTINCT label AS sample FROM embeddings) s LEFT JOIN told USING (sample) GROUP BY s.sample
"""


ORACLE_SQL = {
    "ctc_decode": _decode_sql(63),
    "ctc_fallback": _decode_sql(31),
    "argmax_class": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS k FROM embeddings",
    "softmax_confidence": f"""WITH {_SCORED} SELECT e.vec_id, round(p, 5) AS p,
      list_min(embedding) >= -1e-4 AND list_max(embedding) <= 1 + 1e-4 AND abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - 1) <= 1e-3 AS distribution
      FROM scored s JOIN embeddings e USING (vec_id)""",
    "ctc_valid_prefix": f"""WITH {_SCORED}, kept AS (
      SELECT *, lag(k) OVER (PARTITION BY sample ORDER BY t) AS before FROM scored
      WHERE t <= least(greatest(round(((n::FLOAT / 320::FLOAT) * (7 * (sample + 20))::FLOAT)::DOUBLE), 1), n))
      SELECT sample, count(*) AS emitted, sum(k)::BIGINT AS sum_k, round(avg(p), 5) AS confidence FROM kept
      WHERE k <> 0 AND k IS DISTINCT FROM before GROUP BY sample""",
    "orientation_vote": """SELECT label, 90 * (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::INT AS angle,
      count(*) AS pages, round(max(list_max(embedding[1:4])::DOUBLE), 5) AS best_score FROM embeddings GROUP BY ALL""",
    "collapse_events": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS sequence, count(*) AS n FROM e
      WHERE event_type <> 'view' AND event_type IS DISTINCT FROM before GROUP BY user_id""",
}
