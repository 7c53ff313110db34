"""Quality rules: a decision list learned by sequential covering from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import SPACE, table, text_of, words_of, written

#: Labelled rows that the rules are learned from: about this many, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Thresholds tried for each statistic lie between so many quantiles of the labelled sample.
QUANTILES = 40
#: A rule must be right on this share of the held-back rows that it covers, or it isn't used.
MIN_PRECISION = 0.97
#: And cover this many of them at least.
MIN_COVERED = 4

#: The statistics that conditions may test, as SQL over the columns of text_statistics.
RATIOS = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "shouts_per_word": "n_shouts / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "repeated_words_share": "n_repeat_words / n_words",
    "repeated_lines_share": "n_dup_lines / n_lines",
    # by the root: the plain share falls with the length of any text
    "distinct_words_by_root": "n_distinct_words / sqrt(n_words)",
    "words_per_line": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    """A statistic above its threshold, or not above it."""

    stat: str
    threshold: float
    above: bool

    def column(self) -> Column:
        return F.col(self.stat) > self.threshold if self.above else F.col(self.stat) <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions; a document that meets all of them is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        found = F.lit(True)
        for c in self.conditions:
            found = found & c.column()
        return found

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def repeated_positions(words: Column) -> Column:
    """How many words are in a three-word window that is found twice or more.

    Windows are compared by their 64-bit hashes within one text. Sorting (hash, position) puts
    equal windows side by side; the positions found are sorted again, and each adds the words up
    to the next one, three at most.
    """
    hashed = F.slice(
        F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
        F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return F.array_sort(hashed)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the statistics of its whole text, in one pass without a shuffle.

    Null texts have no words. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines (lines with a word), n_shouts (exclamation marks), n_capitals,
    n_digits, n_distinct_words.
    """
    split = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), words_of(text_of(text_col)).alias("words"),
        F.filter(F.split(text_of(text_col), "\n"), lambda x: F.regexp_replace(x, SPACE + "+", "") != "").alias("lines"),
    ).withColumn("windows", repeated_positions(F.col("words")))
    hashes = F.col("windows")

    def same(x: Column, k: Column) -> Column:
        near = lambda j: F.coalesce(F.get(hashes, j)["h"] == x["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    found = split.withColumn("found", F.array_sort(F.transform(F.filter(hashes, same), lambda x: x["i"])))
    at = F.col("found")
    repeated = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )


def with_ratios(stats: DataFrame) -> DataFrame:
    """stats plus one double column per entry of RATIOS; 0 where a text has no words."""
    return stats.select(
        "*", *[F.when(F.col("n_words") > 0, F.expr(c)).otherwise(0.0).alias(f"_{name}") for name, c in RATIOS.items()]
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Statistics of about `rows` labelled documents with whether they're bad (label 0)."""
    total = labels.filter(F.col(label_col).isNotNull()).count()
    share = min(1.0, rows / max(total, 1))
    picked = (
        labels.filter(F.col(label_col).isNotNull())
        .filter(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    )
    # the sample has a bound by construction, so it may be broadcast to the scan of the texts
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    one = joined.groupBy("_doc").agg(F.min("_text").alias("_text"))  # an id with several texts counts once
    stats = with_ratios(text_statistics(one, "_doc", "_text"))
    # the label is joined again rather than carried through the statistics
    return stats.join(F.broadcast(picked), stats["doc_id"] == picked["_id"]).select(
        *[F.col(f"_{name}") for name in RATIOS], (F.col("label") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held"),
    )


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    if p <= 0 or p0 <= 0:
        return 0.0
    return p * (log2((p + 1) / (p + n + 1)) - log2((p0 + 1) / (p0 + n0 + 1)))


def learn_rules(sample: DataFrame) -> list[Rule]:
    """Sequential covering over a bounded sample of labelled statistics.

    Spark finds the thresholds and the sample's bins; the driver counts them (one small number per
    row and statistic, of SAMPLE_ROWS rows). A rule grows on two thirds of the rows: each step
    counts bad and good rows per statistic and bin and adds the condition of the largest gain,
    until no good row is covered or no condition gains. It is pruned on the other third to the
    prefix with the best (bad - good) / (bad + good), and is used if that reaches MIN_PRECISION
    there. The rows that it covers then leave both parts; covering ends when a rule isn't used.
    Without labels, or without bad rows, there are no rules.
    """
    names = list(RATIOS)
    points = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = sample.agg(*[F.percentile_approx(f"_{n}", points, 1000).alias(n) for n in names], F.sum("bad").alias("bad")).first()
    if not cuts["bad"]:
        return []
    # halfway between neighbouring quantiles: a value just beyond what was seen falls on its side
    thresholds = {n: [(a + b) / 2 for a, b in pairwise(sorted(set(cuts[n])))] for n in names}

    def bin_of(name: str) -> Column:
        """How many of the statistic's thresholds the value is above."""
        cut = F.array(*[F.lit(float(t)) for t in thresholds[name]])
        return F.size(F.filter(cut, lambda t: F.col(f"_{name}") > t))

    rows = sample.select("bad", F.col("held").cast("int").alias("held"), *[bin_of(n).alias(n) for n in names]).collect()  # the bounded sample
    bad, held, *bins = np.array([tuple(r) for r in rows], np.int64).T
    bins = np.array(bins)
    open_, rules = np.ones(len(bad), bool), []

    def met(condition: tuple[int, int, bool]) -> np.ndarray:
        stat, at, above = condition
        return bins[stat] > at if above else bins[stat] <= at

    def best_condition(covered: np.ndarray) -> tuple[int, int, bool] | None:
        p0, n0 = int(bad[covered].sum()), int((1 - bad[covered]).sum())
        best = (1e-9, None)
        for j, name in enumerate(names):
            size = len(thresholds[name]) + 1
            low = [np.cumsum(np.bincount(bins[j][covered], weights=w[covered], minlength=size)) for w in (bad, 1 - bad)]
            for at in range(size - 1):
                p, n = int(low[0][at]), int(low[1][at])
                best = max(best, (_gain(p0, n0, p, n), (j, at, False)), (_gain(p0, n0, p0 - p, n0 - n), (j, at, True)), key=lambda x: x[0])
        return best[1]

    while True:
        chosen: list[tuple[int, int, bool]] = []
        covered = open_ & (held == 0)
        while bad[covered].any() and not bad[covered].all() and (found := best_condition(covered)):
            chosen.append(found)
            covered &= met(found)
        if not chosen:
            return rules
        prefix, worth = open_ & (held == 1), []
        for k, condition in enumerate(chosen):
            prefix = prefix & met(condition)
            p, n = int(bad[prefix].sum()), int((1 - bad[prefix]).sum())
            worth.append(((p - n) / max(1, p + n), -k, p, n))
        _, k, p, n = max(worth)
        if p + n < MIN_COVERED or p < MIN_PRECISION * (p + n):
            return rules
        chosen = chosen[: 1 - k]
        rules.append(Rule(tuple(Condition(f"_{names[j]}", float(thresholds[names[j]][at]), above) for j, at, above in chosen)))
        open_ &= ~np.all([met(c) for c in chosen], axis=0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule met (from 1), or 0."""
    if not rules:
        return F.lit(0)
    found = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        found = found.when(rule.column(), F.lit(k))
    return found.otherwise(F.lit(0))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Statistics of every document, whether it fails the base rules, and whether it is kept.

    The base rules reject texts with fewer than 50 words, or with more than half of their words in
    three-word windows found twice or more. Of the rest, the learned decision list rejects what
    one of its rules covers. Null and empty texts have no words and fail; ties and repeated rows
    are scored alike; an empty table gives an empty result; other columns are not read.
    """
    rules = learn_rules(written(labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows), "labelled"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        with_ratios(text_statistics(docs, id_col, text_col))
        .withColumns({"base_failed": failed, "rule": verdict(rules)})
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
        )
    )


def without_rejects(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score_quality keeps, with all their columns and without a shuffle."""
    rules = learn_rules(written(labelled_sample(docs, labels, id_col, text_col, "quality", SAMPLE_ROWS), "labelled"))
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("_doc"), F.col(text_col).alias("_text"))
    stats = with_ratios(text_statistics(whole, "_doc", "_text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # a filter isn't moved below a column like this one; below, Catalyst would copy the statistics'
    # expressions into it again and again, and not come to an end
    stats = stats.withColumn("_at", F.monotonically_increasing_id())
    return stats.filter((F.col("_at") >= 0) & ~failed & (verdict(rules) == 0)).select("doc_id.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {}
