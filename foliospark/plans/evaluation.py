"""Queries that compare results with references, and summaries of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import rounded
from foliospark.operators.evaluate import detection_report, greedy_matches, overlapping, similarity
from foliospark.operators.profile import breakdown, middle_samples, stage_medians, throughput
from foliospark.plans.tables import table


#: Parts that the rows of one line are dealt to.
SALTS = 16


def _boxes(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Line items as boxes on a page of an hour's orders: reference boxes, and the same shifted and resized."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    x, y = F.col("p") % 40 * 5.0, F.col("s") % 20 * 8.0
    w, h = 10.0 + F.col("q") / 5, F.lit(9.0)
    if which == "predicted":
        x, y, w = x + F.col("q") % 4, y + F.col("l_linenumber") % 3, w + F.col("q") % 3
    page = F.floor(F.col("l_orderkey") / 4)
    return lines.select(page.alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(_boxes(spark, sf_dir, "reference"), _boxes(spark, sf_dir, "predicted"), "page", 16.0, 0.5)


def iou_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("image", "l", "r", rounded("iou", 5).alias("iou"))


def iou_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_matches(_pairs(spark, sf_dir)).select("image", "l", "r", rounded("iou", 5).alias("iou"))


def iou_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reference boxes some prediction overlaps, and the reverse, per hundred pages."""
    pairs = _pairs(spark, sf_dir).groupBy(F.floor(F.col("image") / 100).alias("block")).agg(F.countDistinct("l").alias("hit"), F.countDistinct("r").alias("right"))
    boxes = _boxes(spark, sf_dir, "reference").groupBy(F.floor(F.col("page") / 100).alias("block")).agg(F.count("*").alias("n"))
    told = detection_report(F.col("hit"), F.col("n"), F.col("n"))
    return boxes.join(pairs, "block", "left").na.fill(0).select("block", "n", "hit", "right", *[rounded(c, 5).alias(k) for k, c in told.items()])


def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the name of the next part of the same brand and size."""
    part = table(spark, sf_dir, "part")
    pairs = part.alias("a").join(part.alias("b"), (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("b.p_partkey") == F.col("a.p_partkey") + F.col("a.p_size")))
    return pairs.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), rounded(similarity(F.col("a.p_name"), F.col("b.p_name")), 5).alias("similarity"))


def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reference (quality) and prediction (toxic): counts and rates by source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counted = rows.groupBy("source").agg(
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("matched"), F.count_if(F.col("toxic") == 1).alias("predicted"),
        F.count_if(F.col("quality") == 1).alias("reference"), F.count_if(F.col("quality") == F.col("toxic")).alias("exact"), F.count("*").alias("n"),
    )
    told = detection_report(F.col("matched"), F.col("predicted"), F.col("reference"))
    return counted.select("source", "matched", "predicted", "reference", *[rounded(c, 5).alias(k) for k, c in told.items()], rounded(F.col("exact") / F.col("n"), 5).alias("exact_rate"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def line_semi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that other documents have too, by document: how many of its lines are known elsewhere."""
    lines = _lines(spark, sf_dir).filter("text <> ''")
    shared = lines.groupBy("text").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high")
    # equal lines of a document go as one, and a line that very many documents share is dealt to several tasks
    own = lines.groupBy("doc_id", "text").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = shared.select("text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return own.join(salted, ["text", "salt"], "left_semi").groupBy("doc_id").agg(F.sum("n").alias("shared_lines"))


def line_anti_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the lines that aren't benchmark texts."""
    lines = _lines(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select("text").distinct(), "text", "left_anti")
    return lines.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("docs"))


def latency_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of median, extremes and rates of the events' values by type."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    ends = e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    middle = middle_samples(e, ["event_type"], "value")
    median = (F.col("lower") + F.col("upper")) / 2
    return ends.join(middle, "event_type").select(
        "event_type", rounded(median, 5).alias("median"), "least", "most", "n", rounded(1000 / median, 4).alias("per_second"), F.col("upper").alias("upper_median")
    )


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of three stages: the median of each by type and quarter, and the extremes of their sum."""
    e = table(spark, sf_dir, "events").select(
        "event_type", (F.col("event_id") % 4).alias("quarter"), F.col("value").alias("detection"), F.when(F.col("event_id") % 5 > 0, F.col("value") * 0.5).alias("recognition"),
        F.floor(F.col("value")).cast("double").alias("decoding"), (F.col("value") * 2).alias("total"),
    )
    told = stage_medians(e, ["event_type", "quarter"], ["detection", "recognition", "decoding"], ["total"])
    return told.select("event_type", "quarter", "n", *[rounded(c, 5).alias(c) for c in ("detection", "recognition", "decoding")], rounded("min_total", 5).alias("least"), rounded("max_total", 5).alias("most"))


def throughput_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as passes over so many images: images per second and memory by return flag."""
    passes = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("images"), (F.col("l_linenumber") * 0.25).alias("seconds"), F.floor("l_extendedprice").cast("double").alias("memory"))
    told = throughput(passes, ["l_returnflag"], "images", "seconds", ["memory"])
    return told.select("l_returnflag", "n", *[rounded(c, 5).alias(c) for c in ("per_second", "min_per_second", "max_per_second", "memory", "max_memory")])


def profile_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time by event type and hour, the largest 40, with their share of all."""
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), (F.col("value") * 100).cast("long").alias("ms"))
    return breakdown(e, ["event_type", "hour"], "ms", 5, 40).select("event_type", "hour", "total", "n", rounded("percent", 4).alias("percent"))


def profile_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up whole, and by what stands before their first space where that fails."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.substring_index("p_type", " ", 1).alias("head"))
    known = table(spark, sf_dir, "part").filter("p_size <= 3").select(F.col("p_type").alias("name"), F.col("p_size").alias("origin"))
    exact = known.groupBy("name").agg(F.min("origin").alias("origin"))
    prefix = known.groupBy(F.substring_index("name", " ", 1).alias("head")).agg(F.min("origin").alias("by_head"))
    found = part.join(exact, F.col("p_type") == F.col("name"), "left").join(prefix, "head", "left")
    return found.groupBy("p_type").agg(F.count("*").alias("n"), F.min(F.coalesce("origin", "by_head")).alias("origin"))


def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with broken input among them: every page keeps its slot, with a result or an error."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?is)<title>([^<]*)</title>", 1)
    error = F.when(F.col("html").isNull() | (F.col("html") == ""), "empty").when(F.col("page_id") % 13 == 0, "injected").when(title == "", "no title")
    return pages.select("page_id", error.alias("error"), F.when(error.isNull(), F.char_length(title)).alias("title_chars")).select(
        "page_id", "error", "title_chars", F.col("error").isNull().alias("ok")
    )


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_isolation(spark, sf_dir).groupBy("ok", "error").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        iou_match_candidates, iou_greedy_match, iou_report, char_similarity, parity_report, line_semi_match, line_anti_match, latency_medians, stage_latency, throughput_report, profile_breakdown,
        profile_origin, error_isolation, error_counts,
    )
}


def _r(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE"


_PAIRS = """
b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
ref AS (SELECT l_orderkey // 4 AS page, l_orderkey * 10 + l_linenumber AS id, p % 40 * 5.0::DOUBLE AS x1, s % 20 * 8.0::DOUBLE AS y1, 10.0::DOUBLE + q / 5 AS w, q, l_linenumber AS ln FROM b),
l AS (SELECT page, id, x1, y1, x1 + w AS x2, y1 + 9 AS y2 FROM ref),
r AS (SELECT page, id, x1 + q % 4 AS x1, y1 + ln % 3 AS y1, x1 + q % 4 + (w + q % 3) AS x2, y1 + ln % 3 + 9 AS y2 FROM ref),
o AS (SELECT l.page AS image, l.id AS l, r.id AS r, greatest(least(l.x2, r.x2) - greatest(l.x1, r.x1), 0) * greatest(least(l.y2, r.y2) - greatest(l.y1, r.y1), 0) AS i,
        (l.x2 - l.x1) * (l.y2 - l.y1) AS a, (r.x2 - r.x1) * (r.y2 - r.y1) AS c FROM l JOIN r USING (page)),
pairs AS (SELECT image, l, r, i / (a + c - i) AS iou FROM o WHERE i / (a + c - i) >= 0.5)"""
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"

ORACLE_SQL = {
    "iou_match_candidates": f"WITH {_PAIRS} SELECT image, l, r, {_r('iou', 5)} AS iou FROM pairs",
    # the best pairs first, page by page, with the boxes taken so far
    "iou_greedy_match": f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, l, r) AS k FROM pairs),
      g(image, k, l, r, iou, taken, left_ids, right_ids) AS (
        SELECT image, k, l, r, iou, true, [l], [r] FROM k WHERE k = 1
        UNION ALL SELECT k.image, k.k, k.l, k.r, k.iou, NOT list_contains(left_ids, k.l) AND NOT list_contains(right_ids, k.r),
          CASE WHEN list_contains(left_ids, k.l) OR list_contains(right_ids, k.r) THEN left_ids ELSE list_append(left_ids, k.l) END,
          CASE WHEN list_contains(left_ids, k.l) OR list_contains(right_ids, k.r) THEN right_ids ELSE list_append(right_ids, k.r) END
        FROM g JOIN k ON k.image = g.image AND k.k = g.k + 1)
      SELECT image, l, r, {_r('iou', 5)} AS iou FROM g WHERE taken""",
    "iou_report": f"""WITH {_PAIRS}, n AS (SELECT page // 100 AS block, count(*) AS n FROM l GROUP BY 1),
      h AS (SELECT image // 100 AS block, count(DISTINCT l) AS hit, count(DISTINCT r) AS "right" FROM pairs GROUP BY 1),
      s AS (SELECT block, n, coalesce(hit, 0) AS hit, coalesce("right", 0) AS "right", coalesce(hit, 0)::DOUBLE / n AS p, coalesce(hit, 0)::DOUBLE / n AS r FROM n LEFT JOIN h USING (block))
      SELECT block, n, hit, "right", {_r('p', 5)} AS precision, {_r('r', 5)} AS recall, {_r(_F1, 5)} AS f1 FROM s""",
    "char_similarity": f"""SELECT a.p_partkey AS a, b.p_partkey AS b, {_r("1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name))", 5)} AS similarity
      FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + a.p_size""",
    "parity_report": f"""WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS matched, count(*) FILTER (toxic = 1) AS predicted,
        count(*) FILTER (quality = 1) AS reference, count(*) FILTER (quality = toxic) AS exact, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
      s AS (SELECT *, matched::DOUBLE / greatest(predicted, 1) AS p, matched::DOUBLE / greatest(reference, 1) AS r FROM c)
      SELECT source, matched, predicted, reference, {_r('p', 5)} AS precision, {_r('r', 5)} AS recall, {_r(_F1, 5)} AS f1, {_r('exact::DOUBLE / n', 5)} AS exact_rate FROM s""",
    "stage_latency": f"""SELECT event_type, event_id % 4 AS quarter, count(*) AS n, {_r('median(value)', 5)} AS detection, {_r('median(CASE WHEN event_id % 5 > 0 THEN value * 0.5::DOUBLE END)', 5)} AS recognition,
      {_r('median(floor(value))', 5)} AS decoding, {_r('min(value * 2)', 5)} AS least, {_r('max(value * 2)', 5)} AS most FROM events GROUP BY ALL""",
    "throughput_report": f"""WITH p AS (SELECT l_returnflag, CASE WHEN l_linenumber > 0 THEN l_quantity / (l_linenumber * 0.25::DOUBLE) END AS r, floor(l_extendedprice) AS m FROM lineitem)
      SELECT l_returnflag, count(*) AS n, {_r('median(r)', 5)} AS per_second, {_r('min(r)', 5)} AS min_per_second, {_r('max(r)', 5)} AS max_per_second, {_r('median(m)', 5)} AS memory, {_r('max(m)', 5)} AS max_memory FROM p GROUP BY 1""",
    "line_semi_match": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
      s AS (SELECT text FROM l WHERE text <> '' GROUP BY text HAVING count(DISTINCT doc_id) > 1)
      SELECT doc_id, count(*) AS shared_lines FROM l WHERE text IN (SELECT text FROM s) GROUP BY doc_id""",
    "line_anti_match": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT source, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM l WHERE line NOT IN (SELECT text FROM benchmark) GROUP BY source""",
    "latency_medians": f"""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      SELECT event_type, {_r('median(value)', 5)} AS median, min(value) AS least, max(value) AS most, count(*) AS n, {_r('1000 / median(value)', 4)} AS per_second,
        max(value) FILTER (k = n // 2 + 1) AS upper_median FROM s GROUP BY event_type""",
    "profile_breakdown": f"""WITH g AS (SELECT event_type, hour(ts)::INT AS hour, sum(trunc(value * 100)::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1, 2),
      s AS (SELECT *, total * 100::DOUBLE / sum(total) OVER () AS percent FROM g)
      SELECT event_type, hour, total, n, {_r('percent', 4)} AS percent FROM s WHERE total >= 5 ORDER BY total DESC, event_type, hour LIMIT 40""",
    "profile_origin": """WITH k AS (SELECT p_type AS name, min(p_size) AS origin FROM part WHERE p_size <= 3 GROUP BY 1),
      h AS (SELECT split_part(name, ' ', 1) AS head, min(origin) AS by_head FROM k GROUP BY 1)
      SELECT p_type, count(*) AS n, min(coalesce(origin, by_head)) AS origin FROM part LEFT JOIN k ON name = p_type LEFT JOIN h ON head = split_part(p_type, ' ', 1) GROUP BY p_type""",
    "error_isolation": """WITH t AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title FROM pages),
      e AS (SELECT page_id, title, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN page_id % 13 = 0 THEN 'injected' WHEN title = '' THEN 'no title' END AS error FROM t)
      SELECT page_id, error, CASE WHEN error IS NULL THEN length(title)::INT END AS title_chars, error IS NULL AS ok FROM e""",
    "error_counts": """WITH t AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title FROM pages),
      e AS (SELECT CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN page_id % 13 = 0 THEN 'injected' WHEN title = '' THEN 'no title' END AS error FROM t)
      SELECT error IS NULL AS ok, error, count(*) AS n FROM e GROUP BY ALL""",
}
