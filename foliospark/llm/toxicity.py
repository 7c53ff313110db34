"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text."""

from __future__ import annotations

import string
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import table, written

#: Labelled rows that the lexicon and the curve are learned from: about this many, by a hash of the id.
SAMPLE_ROWS = 12_000
#: Entries are word beginnings of these lengths, in folded characters, and whole words of any.
SHORTEST, LONGEST = 4, 12
#: An entry is found in so many toxic documents at least; the log of how much more often than in
#: others. Its log-likelihood ratio must be above what the best of all entries reaches by chance.
LEAST_FOUND = 4
LEAST_WEIGHT = 1.4
THRESHOLD = 0.3

# Characters that look like a Latin letter, after compatibility decomposition.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ƅ": "b", "օ": "o", "ո": "n", "ս": "u", "ß": "ss", "ø": "o", "ł": "l", "đ": "d",
}
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


def _folding() -> dict[int, str | None]:
    table_: dict[int, str | None] = {ord(c): " " for c in string.punctuation + string.whitespace}
    table_ |= {c: None for c in range(0x300, 0x370)}  # combining marks
    table_ |= {0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0xAD: None}  # invisible characters
    table_ |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    # i, l and 1 are written for each other
    return {k: v.replace("l", "i") if v else v for k, v in table_.items()} | {ord("l"): "i"}


FOLDING = _folding()


def folded(text: str) -> str:
    """Lower case without marks, with homoglyphs and digits as letters and punctuation as spaces."""
    low = text.lower()
    # decomposing makes capitals again, of mathematical letters for one
    return (low if low.isascii() else unicodedata.normalize("NFKD", low).lower()).translate(FOLDING)


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries (a leading space: at a word's start; a closing one: to its end), phrases that excuse them, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def total_weight(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """The weight of the entries found in a folded text, and its number of words.

    Entries inside a phrase of the exceptions don't count. The time goes with the text's length.
    """
    words = text.split()
    text = f" {' '.join(words)} "
    if not len(automaton):
        return 0.0, len(words)
    hits, excused = [], []
    for end, (n, w) in automaton.iter(text):
        (excused if w is None else hits).append((end - n + 1, end, w))
    if excused:
        excused.sort(key=lambda x: x[0])
        starts = [a for a, _, _ in excused]
        reach = list(accumulate((b for _, b, _ in excused), max))  # how far the phrases that start up to here go
        hits = [h for h in hits if (k := bisect_right(starts, h[0])) == 0 or h[1] > reach[k - 1] + 1]
    return float(sum(w for _, _, w in hits)), len(words)


def features(weight: float, words: int) -> tuple[float, float]:
    """What the curve sees: the weight, and the weight normalised by the length, both damped."""
    return float(np.log1p(max(weight, 0.0))), float(np.log1p(max(weight, 0.0) * 100 / max(words, 1)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """About `rows` labelled documents outside the held-out quarter: (text, label), written once.

    Null ids, null labels and ids without a label are left out; a null text is empty; an id with
    several labels is toxic if one of them is; equal texts are one row.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    share = min(1.0, rows / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = picked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))  # bounded: may be broadcast
    found = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    # copies of a text would count its words again and again
    return written(found.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "labelled")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def candidate_counts(rows: DataFrame) -> DataFrame:
    """In how many toxic and other documents each word beginning and whole word is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
            keys = list(counts[0] | counts[1])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))], ["entry", "a", "b"])

        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = set(folded(text.as_py()).split())
                entries = {f" {w[:n]}" for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f" {w} " for w in words}
                counts[int(label.as_py() == 1)].update(entries)
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield out(counts)
                    counts = (Counter(), Counter())
        yield out(counts)

    return rows.mapInArrow(run, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def evidence(toxic: int, other: int) -> Column:
    """The log-likelihood ratio that an entry found in a of the toxic and b of the other documents favours the toxic ones; 0 if it doesn't."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    whole = (a + b) / (toxic + other)

    def term(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.ln(1 - p)).otherwise(0.0)

    found = 2 * (term(a, toxic, a / toxic) + term(b, other, b / other) - term(a, toxic, whole) - term(b, other, whole))
    return F.when(a / toxic > b / other, found).otherwise(0.0)


def choose_entries(candidates: list[tuple[str, float, float]]) -> dict[str, float]:
    """Weights of the entries to use, from (entry, evidence, weight).

    Entries are taken by their evidence. One that begins a taken entry, or begins with one, tells
    the same and is left out.
    """
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for entry, _, weight in sorted(candidates, key=lambda c: (-c[1], -len(c[0]), c[0])):
        if entry in beginnings or any(entry[:n] in chosen for n in range(1, len(entry))):
            continue
        chosen[entry] = weight
        beginnings |= {entry[:n] for n in range(1, len(entry))}
    return chosen


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression of y on the two features, by Newton's method with a ridge."""
    z = np.c_[np.ones(len(x)), x]
    w = np.array([-2.0, 0.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w * [0, 1, 1]
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn_lexicon(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exception phrases and curve from a bounded sample of labelled rows (text, label).

    A row is toxic if its label is 1, null texts aren't expected (training_rows makes them empty).
    Weights are the log of the ratio of an entry's shares of toxic and other documents. Used are
    entries whose evidence is over 2 ln(tried): of so many entries without a meaning, about one is
    beyond that. Without toxic or other rows the lexicon is empty and every score the same.
    """
    total = rows.agg(F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, other = total["toxic"], total["n"] - total["toxic"]
    if not toxic or not other:
        return Lexicon()
    counted = written(candidate_counts(rows), "entries")
    weight = F.ln((F.col("a") + 0.5) / (toxic + 1)) - F.ln((F.col("b") + 0.5) / (other + 1))
    told = counted.filter(F.col("a") >= LEAST_FOUND).select("entry", evidence(toxic, other).alias("g"), weight.alias("w"))
    told = told.filter((F.col("g") > 2 * float(np.log(max(counted.count(), 2)))) & (F.col("w") >= LEAST_WEIGHT))
    # words of the sample that are telling beyond chance: the sample bounds them
    weights = choose_entries([(r["entry"], r["g"], r["w"]) for r in told.collect()])
    given = tuple(f" {' '.join(folded(p).split())} " for p in exceptions)
    lexicon = Lexicon(weights, given)
    if not exceptions:
        lexicon = Lexicon(weights, learn_exceptions(rows, lexicon))
    scored = rows.select("text", "label").mapInArrow(feature_batches(lexicon), "label int, x double, per_word double").collect()  # the bounded sample, two numbers a row
    x = np.array([[r["x"], r["per_word"]] for r in scored])
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(x, np.array([r["label"] == 1 for r in scored], float)))


def learn_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Phrases of an entry's word and the one before or after that are found in clean documents alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            phrases, labels = [], []
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = f" {' '.join(folded(text.as_py()).split())} "
                found = set()
                for end, (n, _) in automaton.iter(words) if len(automaton) else ():
                    start = end - n + 1
                    stop = words.find(" ", start + 1)
                    after = words.find(" ", stop + 1)
                    before = words.rfind(" ", 0, start)
                    found |= {words[start : after + 1]} if after > 0 else set()
                    found |= {words[before : stop + 1]} if before >= 0 else set()
                phrases += found
                labels += [label.as_py()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], ["phrase", "label"])

    counted = rows.select("text", "label").mapInArrow(run, "phrase string, label int").groupBy("phrase").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("a"), F.sum((F.col("label") != 1).cast("long")).alias("b")
    )
    found = counted.filter((F.col("b") >= LEAST_FOUND) & (F.col("a") * 20 <= F.col("b")))
    return tuple(sorted(r["phrase"] for r in found.collect()))


def feature_batches(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([features(*total_weight(folded(t.as_py()), automaton)) for t in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], ["label", "x", "per_word"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted and weight for every whole text; one pass, no shuffle.

    Null and empty texts have the weight 0; repeated rows get equal scores; an empty table gives
    an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [total_weight(folded(t.as_py() or ""), automaton) for t in batch.column(1)]
            x = np.array([features(*f) for f in found]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(lexicon.curve[0] + x @ np.array(lexicon.curve[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([f[0] for f in found], pa.float64())],
                ["doc_id", "score", "predicted", "weight"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, weight double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(training_rows(docs, labels, "doc_id", "text", "toxic", SAMPLE_ROWS))
    return score_toxicity(docs, lexicon).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL = {}
