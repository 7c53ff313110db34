"""Queries about token dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import fraction, rounded
from foliospark.functions.scores import label_angle
from foliospark.operators import dictionary as d
from foliospark.plans.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as dictionary lines, with spaces around some and some of them repeated."""
    part = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.col("p_type"), F.lit("\t"))).otherwise(F.col("p_type"))
    return part.select(F.col("p_partkey").alias("line"), d.clean_token(raw).alias("token"))


def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of all names of nations and parts, each once, in alphabetical order."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("token")).union(table(spark, sf_dir, "part").select("p_name"))
    return d.build(names.filter("token IS NOT NULL").distinct(), "token", ["token"])


def dictionary_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.reverse(_lines(spark, sf_dir).select(F.col("line").alias("idx"), "token"))


def dictionary_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.duplicates(_lines(spark, sf_dir), "token", "line")


def label_to_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels such as 90_degree: the leading digits, if they're a quarter turn."""
    label = F.concat((F.pmod(F.col("o_orderkey"), F.lit(9)) * 45).cast("string"), F.when(F.col("o_custkey") % 2 == 0, "_degree").otherwise(""))
    label = F.when(F.col("o_orderkey") % 11 == 0, "upright").otherwise(label)
    return table(spark, sf_dir, "orders").select(label.alias("label")).select("label", label_angle(F.col("label")).alias("angle")).groupBy("label", "angle").agg(F.count("*").alias("n"))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as a quotient, with zeros and words among them."""
    part = table(spark, sf_dir, "part")
    bottom = F.when(F.col("p_partkey") % 7 == 0, "x").when(F.col("p_partkey") % 5 == 0, "0").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".")))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1./"), bottom)).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    return part.select("p_partkey", text.alias("text"), rounded(fraction(text), 6).alias("value"))


QUERIES = {f.__name__: f for f in (dictionary_build, dictionary_reverse, dictionary_duplicates, label_to_angle, number_parse)}

ORACLE_SQL = {
    "dictionary_build": """WITH n AS (SELECT n_name AS token FROM nation UNION SELECT p_name FROM part), t AS (SELECT row_number() OVER (ORDER BY token)::INT AS idx, token FROM n WHERE token IS NOT NULL)
      SELECT * FROM t UNION ALL SELECT 0, '[blank]' UNION ALL SELECT max(idx) + 1, ' ' FROM t""",
    "dictionary_reverse": "SELECT trim(p_type, ' ' || chr(9)) AS token, min(p_partkey) AS idx FROM part GROUP BY 1",
    "dictionary_duplicates": """WITH l AS (SELECT p_type AS token, p_partkey AS line, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)
      SELECT token, min(line) FILTER (k = 1) AS first_line, min(line) FILTER (k = 2) AS again_line FROM l WHERE k <= 2 GROUP BY token HAVING count(*) = 2""",
    "label_to_angle": """WITH l AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'upright' ELSE ((o_orderkey % 9) * 45)::VARCHAR || CASE WHEN o_custkey % 2 = 0 THEN '_degree' ELSE '' END END AS label FROM orders),
      a AS (SELECT label, try_cast(regexp_extract(label, '^([0-9]*)', 1) AS INT) AS a FROM l)
      SELECT label, CASE WHEN a IN (0, 90, 180, 270) THEN a END AS angle, count(*) AS n FROM a GROUP BY ALL""",
    "number_parse": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1./' || CASE WHEN p_partkey % 7 = 0 THEN 'x' WHEN p_partkey % 5 = 0 THEN '0' ELSE p_size || '.' END
        ELSE ' ' || p_size || '.5' END AS text FROM part),
      n AS (SELECT *, string_split(trim(text), '/') AS q FROM t)
      SELECT p_partkey, text, round_even(CASE WHEN len(q) = 1 THEN try_cast(q[1] AS DOUBLE) WHEN try_cast(q[2] AS DOUBLE) <> 0 THEN try_cast(q[1] AS DOUBLE) / try_cast(q[2] AS DOUBLE) END * 1000000, 0) / 1000000 AS value FROM n""",
}
