"""LM scoring: the marginal probability of a text over all segmentations into pieces of a subword vocabulary.

The vocabulary and its scores are those of a given piece file. Pieces don't cross words, so a text's
lattice falls into those of its words, and each distinct word of the corpus is worked on once. A
word of the training rows is a piece of its own lattice too, weighted by its discounted count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise
from math import log, log10

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import table, written

VOCABULARY = "piece_bpe_32k.model"
#: Rounds of expectation and maximisation over the training words.
ROUNDS = 2
#: So many of the most frequent words are sent to all tasks with their values; the others are joined. It changes no result.
FREQUENT = 1 << 16
#: Bytes of words whose lattices are worked on at once; a longer word is worked on alone. It changes no result.
BYTES_AT_ONCE = 1 << 16
#: A task hands on its counts at so many distinct words. It changes no result.
WORDS_AT_ONCE = 1 << 19
#: Words above this length are known by their digest among the frequent ones.
LONG_WORD = 64
#: Expected counts are summed as whole numbers of this fraction, so that their sum has no order.
UNIT = 4096
#: The piece that begins a word; a blank stands for it, which no word holds.
BEGIN = "▁"
#: The end of a text among the words; no word is empty.
END = b""


class Pieces:
    """The distinct strings of the file's pieces, their weights by the file, and an automaton that finds them.

    Strings are bytes, written as Latin-1 for the automaton; single bytes are pieces too, so that every word
    has a segmentation. Two pieces with the same string are one, with the sum of their weights. The
    file's scores are ranks (0, -1, -2, ...), so a piece weighs 1 / (rank + 1), by Zipf's law, and
    those without a rank weigh as much as the last one. The last number is the end of a text.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [-model.get_score(k) for k in range(len(model)) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        last = max(r for r in ranked if r < 1e8)
        weights: Counter[str] = Counter()
        for k in range(len(model)):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                string, rank = chr(int(piece[3:-1], 16)), last
            elif model.is_control(k) or model.is_unknown(k) or BEGIN in piece[1:]:
                continue  # a blank within a piece would cross words
            else:
                string, rank = piece.replace(BEGIN, " ").encode().decode("latin-1"), min(-model.get_score(k), last)
            if string == " " or string not in "\t\n\x0b\x0c\r ":
                weights[string] += 1 / (rank + 1)
        # a byte 0x20 isn't in any word; as a piece the blank is the beginning alone
        self.strings = sorted(weights)
        self.end = len(self.strings)
        found = np.array([*(weights[s] for s in self.strings), 1 / (last + 1)])
        self.prior = found / found.sum()
        self.automaton = ahocorasick.Automaton()
        for k, s in enumerate(self.strings):
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(s) for s in self.strings])


@cache
def pieces_of(path: str) -> Pieces:
    """One per Python worker."""
    return Pieces(path)


class Lattices:
    """The lattices of many words: every edge that a piece makes, and log sums over all of them at once.

    A word's places are those before, between and after its bytes, with the blank that begins it. The
    forward recursion takes the edges of all words that end at the first place, then those that end at
    the second, and so on; the backward one does the same from the ends.
    """

    def __init__(self, words: list[bytes], pieces: Pieces, weights: np.ndarray):
        string = b"".join([b" " + w for w in words]).decode("latin-1")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(sizes) - sizes
        found = np.fromiter(chain.from_iterable(pieces.automaton.iter(string)), np.int64)
        last, self.piece = found[::2], found[1::2]
        self.word = np.repeat(np.arange(len(words)), sizes)[last]
        # no piece has a blank but at its beginning, so none crosses words; a word has a place more than bytes
        self.end = last + 1 + self.word
        self.start = self.end - pieces.lengths[self.piece]
        self.zero = first + np.arange(len(words))
        self.one = self.zero + sizes
        self.weight = weights[self.piece]
        self.places = len(string) + len(words)

    def _sums(self, at: np.ndarray, other: np.ndarray, step: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Log sums at places: of the edges at each place, their weights and the sums at their other ends, which have smaller steps."""
        sums = np.full(self.places, -np.inf)
        sums[seeds] = 0.0
        order = np.lexsort((at, step))
        at, other, weight = at[order], other[order], self.weight[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(step[order]) != 0]), len(order)] if len(order) else []
        for low, high in pairwise(cuts):
            terms = sums[other[low:high]] + weight[low:high]
            new = np.r_[True, np.diff(at[low:high]) != 0]
            begin = np.flatnonzero(new)
            top = np.maximum.reduceat(terms, begin)
            total = np.add.reduceat(np.exp(terms - top[np.cumsum(new) - 1]), begin)
            sums[at[low:high][begin]] = top + np.log(total)
        return sums

    def forward(self) -> np.ndarray:
        return self._sums(self.end, self.start, self.end - self.zero[self.word], self.zero)

    def logs(self) -> np.ndarray:
        """The natural log of each word's probability: the sum over all its segmentations."""
        return self.forward()[self.one]

    def expected(self) -> np.ndarray:
        """How often each edge's piece is expected in its word's segmentations, by forward and backward sums."""
        forward = self.forward()
        backward = self._sums(self.start, self.end, self.one[self.word] - self.start, self.one)
        return np.exp(forward[self.start] + self.weight + backward[self.end] - forward[self.one][self.word])


def parts_of(words: list[bytes]) -> Iterator[list[int]]:
    """The numbers of words to work on at once: of similar lengths, and of BYTES_AT_ONCE together at most."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    part, size = [], 0
    for k in order:
        if part and size + len(words[k]) > BYTES_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(k)
        size += len(words[k]) + 1
    if part:
        yield part


def word_logs(words: list[bytes], pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """The natural log of each word's probability; END's is that of its own weight."""
    found = np.full(len(words), weights[pieces.end])
    for part in parts_of(words):
        at = [k for k in part if words[k] != END]
        if at:
            found[at] = Lattices([words[k] for k in at], pieces, weights).logs()
    return found


def digest_of(words: Iterable[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each word, by which it is known in joins."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), "<i8").reshape(-1, 2)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lowered. bytes.split() without arguments splits at exactly the contract's six characters."""
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and c, its count in the rows of texts (text, held) that aren't held out; END is counted per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text, held in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if held:
                    counts.update(dict.fromkeys(words, 0))
                else:
                    counts.update(words)
                counts[END] += not held
                if len(counts) > WORDS_AT_ONCE:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    return texts.select("text", "held").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, and what each count is discounted by."""

    tokens: int
    distinct: int
    discount: float


def totals_of(words: DataFrame) -> Totals:
    """The discount is that of absolute discounting, n1 / (n1 + 2 n2) for n1 words met once and n2 met twice."""
    count = lambda c: F.count(F.when(c, 1))
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), count(F.col("c") > 0).alias("v"), count(F.col("c") == 1).alias("n1"), count(F.col("c") == 2).alias("n2")).first()
    return Totals(r["n"], r["v"], r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5)


def trained(words: DataFrame, path: str, rounds: int) -> np.ndarray:
    """The pieces' probabilities: the file's weights, improved by expected counts over the distinct training words.

    The lattice speaks for words that weren't met, so each word counts once. Each round sums
    expected counts per piece; a piece of the file keeps a share by its first
    weight, one count per piece on average. What comes to the driver has a row per piece of the file.
    """
    spark = words.sparkSession
    pieces = pieces_of(path)
    found, size = pieces.prior, len(pieces.prior)
    train = words.filter("c > 0")
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(np.log(found))  # one number per piece of the file

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            own, weights = pieces_of(path), given.value
            sums = np.zeros(size, np.int64)
            for batch in batches:
                words = batch.column(0).to_pylist()
                for part in parts_of(words):
                    some = Lattices([words[k] for k in part if words[k] != END], own, weights)
                    counts = np.bincount(some.piece, np.rint(some.expected() * UNIT), size)  # whole numbers, far below 2 ** 53
                    sums += counts.astype(np.int64)
                sums[own.end] += UNIT * words.count(END)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["piece", "n"])

        summed = train.select("word").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = size * pieces.prior
        for r in summed:
            counts[r["piece"]] += r["n"] / UNIT
        found = counts / counts.sum()
        given.unpersist()
    return found


def with_counts(logs: np.ndarray, counts: np.ndarray, totals: Totals) -> np.ndarray:
    """Words' log probabilities when each word is a piece itself, with its discounted count; the lattice has what was taken off."""
    if not totals.tokens:
        return logs
    rest = log(totals.discount * totals.distinct) + logs
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(counts - totals.discount, 0.0))
    return np.logaddexp(own, rest) - log(totals.tokens)


def scored_words(words: DataFrame, path: str, probabilities: np.ndarray, totals: Totals) -> DataFrame:
    """words plus hi, lo (its digest) and log_p, the log10 of its marginal probability."""
    given = words.sparkSession.sparkContext.broadcast(np.log(probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = pieces_of(path), 1 / log(10)
        for batch in batches:
            found = batch.column(0).to_pylist()
            digest = digest_of(found)
            logs = scale * with_counts(word_logs(found, own, given.value), batch.column(1).to_numpy(), totals)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(logs, pa.float64())], ["word", "c", "hi", "lo", "log_p"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, hi long, lo long, log_p double")


def known_by(word: bytes) -> bytes:
    """The word itself among the frequent ones, or a blank and its digest if it is long."""
    return word if len(word) <= LONG_WORD else b" " + xxhash.xxh3_128_digest(word)


def text_parts(texts: DataFrame, frequent: dict[bytes, tuple[int, float]], id_type: str) -> DataFrame:
    """Per text the sums over its frequent words (n_tokens, n_known, base, score), and its other words as arrays hi, lo, tf.

    base is the sum of log10(c + 1).
    """
    given = texts.sparkSession.sparkContext.broadcast({w: (c > 0, log10(c + 1), p) for w, (c, p) in frequent.items()})  # FREQUENT entries at most
    names = ["id", "held", "n_tokens", "n_known", "base", "score", "hi", "lo", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = given.value
        for batch in batches:
            sums: list[list] = [[], [], [], []]
            others, offsets, times = [], [0], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = words_of(text)
                tokens, known, base, score = len(words) + 1, 0, 0.0, 0.0
                counts = Counter(words)
                counts[END] = 1
                for w, n in counts.items():
                    v = values.get(w if len(w) <= LONG_WORD else known_by(w))
                    if v is None:
                        others.append(w)
                        times.append(n)
                    else:
                        known += n * v[0]
                        base += n * v[1]
                        score += n * v[2]
                for x, value in zip(sums, (tokens, known, base, score), strict=True):
                    x.append(value)
                offsets.append(len(others))
            digest = digest_of(others)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(sums[2], pa.float64()), pa.array(sums[3], pa.float64()), *lists], names
            )

    schema = f"id {id_type}, held boolean, n_tokens long, n_known long, base double, score double, hi array<bigint>, lo array<bigint>, tf array<int>"
    return texts.select("text", "held", "id").mapInArrow(run, schema)


def least_frequent(words: DataFrame, most: int) -> int:
    """A count that as many words as can be reach, but at most `most`: from a histogram of counts, eight bars to a power of two."""
    bars = words.filter("c > 0").groupBy(F.floor(F.log2("c") * 8).alias("bar")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # some hundreds
    least, total = (1 << 63) - 1, 0
    for bar in sorted(bars, key=lambda r: -r["bar"]):
        total += bar["n"]
        if total > most:
            break
        least = bar["least"]
    return least


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rounds: int = ROUNDS, frequent: int = FREQUENT
) -> DataFrame:
    """log10 probabilities of every whole text by a word model with add-one smoothing and by the subword lattice.

    Both learn from the rows where held_out is false. Words are lower-cased (A-Z); each text ends in
    an end token. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end alone. Each row counts and is scored, repeated ids and rows
    too. Without training rows the file's own weights are used. An empty table gives an empty
    result; other columns aren't read. A word of any length is one lattice, in one task.

    The words of the whole corpus are counted with a shuffle of distinct words per task. A text's
    other than frequent words go to the counts by a join on digests, one row per text and word;
    texts aren't shuffled. A common word's rows never meet in a task, as the frequent ones are sent out.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    words = written(word_counts(texts), "words")
    totals = totals_of(words)
    scored = written(scored_words(words, path, trained(words, path, rounds), totals), "scored-words")
    common = scored.filter(F.col("c") >= least_frequent(scored, frequent))
    # long words come as their digests, so that an entry has a bound
    common = common.select(F.when(F.length("word") <= LONG_WORD, F.col("word")).alias("word"), "hi", "lo", "c", "log_p").collect()
    values = {r["word"] if r["word"] is not None else b" " + np.array([r["hi"], r["lo"]], "<i8").tobytes(): (r["c"], r["log_p"]) for r in common}
    kind = docs.schema[id_col].dataType.simpleString()
    # the numbers of rows hold, as they are written before they are used twice
    parts = written(text_parts(texts, {bytes(w): v for w, v in values.items()}, kind).withColumn("row", F.monotonically_increasing_id()), "text-parts")
    other = parts.select("row", F.explode(F.arrays_zip("hi", "lo", "tf")).alias("w")).select("row", "w.hi", "w.lo", "w.tf")
    found = other.join(scored.select("hi", "lo", "c", "log_p"), ["hi", "lo"])
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("_base"), F.sum(F.col("tf") * F.col("log_p")).alias("_score")
    )
    both = parts.drop("hi", "lo", "tf").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log10(totals.tokens + totals.distinct + 1))).alias("base_score"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op12_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)


QUERIES = {"op12_lattice_score": op12_lattice_score}
ORACLE_SQL = {}
