"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A table-driven transducer reads the UTF-8 bytes once. It counts what the filters test and hands
over the words' spans, which go into a hash table that is verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import table, written

FILTERS = "ABCDE"
#: Classes of bytes: white space, A-Z, symbols, other bytes that begin a code point, bytes that continue one.
BLANK, CAPITAL, SYMBOL, START, CONTINUED = range(5)
OUTSIDE, INSIDE = range(2)
#: What a step of the transducer tells, as bits.
WORD_BEGINS, WORD_ENDS, CODE_POINT, CAPITAL_SEEN, SYMBOL_SEEN = 1, 2, 4, 8, 16
#: Bytes of texts that are worked on at once; a longer text is worked on alone. It changes no result.
BYTES_AT_ONCE = 1 << 21
#: Words are compared eight bytes at a time up to this length, longer ones as a whole.
LONG_WORD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def classes(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The class of each byte."""
    found = np.full(256, START, np.uint8)
    found[0x80:0xC0] = CONTINUED
    found[ord("A") : ord("Z") + 1] = CAPITAL
    found[list(b" \t\n\x0b\x0c\r")] = BLANK
    found[list(symbols)] = SYMBOL
    return found


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the output for each state and class."""
    state, output = np.zeros((2, 5), np.uint8), np.zeros((2, 5), np.uint8)
    for c in (CAPITAL, SYMBOL, START, CONTINUED):
        state[:, c] = INSIDE
        output[OUTSIDE, c] |= WORD_BEGINS
    output[INSIDE, BLANK] |= WORD_ENDS
    for c, told in ((BLANK, CODE_POINT), (START, CODE_POINT), (CAPITAL, CODE_POINT | CAPITAL_SEEN), (SYMBOL, CODE_POINT | SYMBOL_SEEN)):
        output[:, c] |= told
    return state, output


class Transducer:
    """Runs the tables over the bytes of many texts at once.

    The state after a byte hangs on that byte alone (checked when the tables are made), so the
    states of all bytes are one lookup, and the outputs one more by state before and class.
    """

    def __init__(self) -> None:
        self.classes = classes()
        self.state, self.output = transitions()
        if (self.state[OUTSIDE] != self.state[INSIDE]).any():
            raise ValueError("the state after a byte must not hang on the state before it")
        self.after = self.state[OUTSIDE][self.classes]

    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The output of each byte. Every text begins OUTSIDE; a word that ends with its text isn't told."""
        before = np.empty(len(data), np.uint8)
        before[1:] = self.after[data[:-1]]
        before[starts[starts < len(data)]] = OUTSIDE
        return self.output[before, self.classes[data]]


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    return np.searchsorted(at := np.flatnonzero(flags), bounds[1:]) - np.searchsorted(at, bounds[:-1])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros after the end; a view without a copy of the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))


def load(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next min(8, left) bytes at each place as a number."""
    got = np.ascontiguousarray(windows[at]).view("<u8").ravel()
    return np.where(left >= 8, got, got & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)))


def span_hashes(windows: np.ndarray, data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each span's owner, length and bytes."""
    h = (owner.astype(np.uint64) * _ODD) ^ length.astype(np.uint64)
    long = np.flatnonzero(length > LONG_WORD)
    short = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(short):
        h[short] = (h[short] ^ load(windows, start[short] + at, length[short] - at)) * _ODD
        h[short] ^= h[short] >> np.uint64(29)
        at += 8
        short = short[length[short] > at]
    for k in long:
        digest = hashlib.blake2b(data[start[k] : start[k] + length[k]], digest_size=8).digest()
        h[k] ^= np.uint64(int.from_bytes(digest, "little"))
    return h ^ (h >> np.uint64(32))


def equal_spans(windows: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of each two spans of equal length are the same."""
    same = np.ones(len(a), bool)
    for k in np.flatnonzero(length > LONG_WORD):
        same[k] = (data[a[k] : a[k] + length[k]] == data[b[k] : b[k] + length[k]]).all()
    open_ = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(open_):
        left = length[open_] - at
        same[open_] &= load(windows, a[open_] + at, left) == load(windows, b[open_] + at, left)
        at += 8
        open_ = open_[same[open_] & (length[open_] > at)]
    return same


def first_of_kind(data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which spans aren't equal to an earlier inserted one of the same owner.

    All spans are inserted into one open-addressing table at once, at most half full. In each
    round the spans that are still open try their slot: one takes it if it is free; then all of
    them are held against the slot's span, owner, length and bytes. The equal ones are done, the
    others go to the next slot.
    """
    new = np.zeros(len(start), bool)
    if not len(start):
        return new
    windows = eights(data)
    mask = (1 << int(2 * len(start)).bit_length()) - 1
    slot = (span_hashes(windows, data, owner, start, length) & np.uint64(mask)).astype(np.int64)
    slots = np.full(mask + 1, -1, np.int32 if len(start) < 1 << 31 else np.int64)
    open_ = np.arange(len(start))
    while len(open_):
        at = slot[open_]
        free = open_[slots[at] < 0]
        slots[slot[free]] = free  # of several the last one stays
        holder = slots[at].astype(np.int64)
        mine = holder == open_
        new[open_[mine]] = True
        alike = (owner[holder] == owner[open_]) & (length[holder] == length[open_]) & ~mine
        k = np.flatnonzero(alike)
        alike[k] = equal_spans(windows, data, start[holder[k]], start[open_[k]], length[open_[k]])
        open_ = open_[~(mine | alike)]
        slot[open_] = (slot[open_] + 1) & mask
    return new


def counts_of(transducer: Transducer, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text of data, which are cut at bounds."""
    starts = bounds[:-1]
    told = transducer.run(data, starts) if len(data) else np.zeros(0, np.uint8)
    begin = np.flatnonzero(told & WORD_BEGINS)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    # a word ends where the transducer says so, or with its text
    end = np.flatnonzero(told & WORD_ENDS)
    k = np.searchsorted(end, begin)
    stop = np.where(k < len(end), end[np.minimum(k, len(end) - 1)], len(data)) if len(end) else np.full(len(begin), len(data))
    stop = np.minimum(stop, bounds[owner + 1])
    new = first_of_kind(data, owner, begin, stop - begin)
    distinct = np.bincount(owner[new], minlength=len(starts))
    words = np.bincount(owner, minlength=len(starts))
    return [words, distinct, *(per_text(told & bit, bounds) for bit in (CAPITAL_SEEN, CODE_POINT, SYMBOL_SEEN))]


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, carry, words, distinct_words, capitals, code_points, symbols (long) and the text's SHA-256.

    One pass over Arrow's buffers without a shuffle. Null texts are empty; every row is counted,
    repeated ones too; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer()
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)) if len(texts) else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, side="right")))
                part = texts.slice(at, upto - at)
                bounds = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, 8 * part.offset)
                values = part.buffers()[2]
                data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
                bounds = bounds - bounds[0]
                found = counts_of(transducer, data, bounds)
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                rest = [batch.column(k).slice(at, upto - at) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x.astype(np.int64)) for x in found), pa.array(digests, pa.binary())], names)
                at = upto

    kept = docs.select(id_col, *carry)
    counted = ("words", "distinct_words", "capitals", "code_points", "symbols")
    names = [*kept.columns, *counted, "digest"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{n} long" for n in counted), "digest binary"])
    return docs.select(F.coalesce(text_col, F.lit("")).alias("_text"), id_col, *carry).mapInArrow(run, schema)


def failed_bits(conditions: list[Column]) -> Column:
    """The failed conditions of a row as a number, the first one as its lowest bit. A null isn't a failure."""
    found = F.lit(0)
    for k, c in enumerate(conditions):
        found = found + F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return found


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """rows with good and toxic (int), 1 where any label of the id is 1. Rows without an id have none and stay out of the join."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_of")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    joined = rows.filter(F.col("_id").isNotNull()).join(known, F.col("_id") == F.col("_label_of"), "left").drop("_label_of")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("good", "toxic")})
    return joined.unionByName(rows.filter(F.col("_id").isNull()).withColumns({n: F.lit(0) for n in ("good", "toxic")}))


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """How many documents of each part and kind of labels fail exactly which filters: part, bits, good, toxic, n.

    Equal texts are told by their SHA-256. Rows are grouped by id and text, then by text and the
    few values that count; of a text that fills a third of the table each task sends a few rows.
    """
    counts = text_counts(docs.select(id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part")).withColumnRenamed(id_col, "_id"), "_id", text_col, ("_part",))
    bits = failed_bits([
        F.col("words") < 200, 100 * F.col("distinct_words") < 50 * F.col("words"), 100 * F.col("capitals") > 2 * F.col("code_points"), F.col("symbols") > 0,
    ])
    rows = counts.select("_id", "_part", "digest", bits.alias("bits")).groupBy("_id", "_part", "digest", "bits").agg(F.count("*").alias("n"))
    # read twice, and so that texts aren't read again
    rows = with_labels(written(rows, "filters"), labels, id_col)
    grouped = rows.groupBy("digest", "bits", "_part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("first"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("without_id")
    )
    grouped = written(grouped, "texts")
    least = grouped.groupBy("digest").agg(F.min("first._id").alias("least"))
    # a digest has a row per part and kind of labels here, so that no key is hot
    told = grouped.join(least, "digest").withColumn(
        "stays", F.col("without_id") + F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    )
    bit = 1 << FILTERS.index("E")
    split = told.select("_part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits"), F.col("stays").alias("n")), F.struct((F.col("bits") + bit).alias("bits"), (F.col("n") - F.col("stays")).alias("n")),
    )).alias("x"))
    return split.groupBy(F.col("_part").alias("part"), F.col("x.bits").alias("bits"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def orders() -> Column:
    """Every order of the filters and every step: (filter_order, step, own bit, bits of the earlier ones)."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for k, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            rows.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'own', {own}, 'earlier', {earlier})")
            earlier |= own
    return F.expr(f"array({', '.join(rows)})")


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, per part.

    The filters: A under 200 words; B fewer distinct words than half of all; C over 2 percent
    capitals; D any of #$%&*|; E a text equal to that of a smaller id. Returns part, filter_order,
    step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every row counts, repeated ones too: rows that share id and text aren't copies of each other.
    Null texts are empty, a null part is the empty string. A null id has no labels, is no copy of
    another row and makes none. Of several labels of an id each that is 1 counts. An empty table gives an
    empty result; other columns aren't read. The texts are read once and not shuffled; what is
    gathered per part are at most 32 sets of failures.
    """
    n = 1 << len(FILTERS)
    counted = failures(docs, labels, id_col, text_col, part_col)
    kinds = {"total": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    sums = {f"{k}_{b}": F.sum(F.when((F.col("bits") == b) & c, F.col("n")).otherwise(0)) for k, c in kinds.items() for b in range(n)}
    parts = counted.groupBy("part").agg(*[c.alias(name) for name, c in sums.items()])
    parts = parts.select("part", *[F.array(*[f"{k}_{b}" for b in range(n)]).alias(k) for k in kinds])
    steps = parts.select("part", *kinds, F.explode(orders()).alias("o"))
    own, earlier = F.col("o.own"), F.col("o.earlier")

    def total(kind: str, met) -> Column:
        """The documents whose bits meet a condition."""
        return F.aggregate(F.transform(kind, lambda c, b: F.when(met(b), c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)

    def removed(b: Column) -> Column:
        return (b.bitwiseAND(own) != 0) & (b.bitwiseAND(earlier) == 0)

    # of the 120 orders a filter comes first among m failed ones in 120 / m
    share = F.aggregate(
        F.transform("total", lambda c, b: F.when(b.bitwiseAND(own) != 0, c * F.lit(120)).otherwise(F.lit(0).cast("long")) / F.greatest(F.bit_count(b), F.lit(1))),
        F.lit(0.0), lambda a, c: a + c,
    )
    return steps.select(
        "part", F.col("o.filter_order").alias("filter_order"), F.col("o.step").alias("step"),
        total("total", lambda b: b.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), total("total", removed).alias("removed"),
        total("total", lambda b: (b.bitwiseAND(own) != 0) & (b.bitwiseAND(earlier) != 0)).alias("redundant"), total("total", lambda b: b == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS bits
    FROM t LEFT JOIN l USING (doc_id)
), c AS (
    SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v (letter, bit)
), o AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS b
    FROM x a JOIN x b ON b.bit <> a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN x e ON a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), s AS (
    SELECT filter_order, step, b[step] AS own, coalesce(list_sum(b[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r (step)
), h AS (
    SELECT part, bit, sum(n * 120 // bit_count(bits)) AS shapley FROM c JOIN x ON bits & bit <> 0 GROUP BY ALL
)
SELECT p.part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (bits & (own + earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bits & own <> 0 AND bits & earlier <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (good = 1 AND bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (toxic = 1 AND bits & own <> 0 AND bits & earlier = 0), 0)::BIGINT AS toxic_lost,
    coalesce(max(shapley), 0)::BIGINT AS shapley
FROM c p CROSS JOIN s LEFT JOIN h ON h.part = p.part AND h.bit = s.own GROUP BY p.part, filter_order, step
""",
}
