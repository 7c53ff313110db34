"""Best-fit packing: exact-complement hashing over the histogram of lengths."""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm.shared import table, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024

#: A unit of a text: white space and what follows it up to the next white space, or up to a stop after a plain letter.
UNIT = re.compile(r"[ \t\n\r]*+[^ \t\n\r.,;:!?]*[A-Za-z](?=[.,;:!?])|[ \t\n\r]*+[^ \t\n\r]++|[ \t\n\r]++")
#: White space other than that, in any library's view.
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
#: Where a text may be cut.
BORDER = re.compile(r"(?<=[^ \t\n\r])(?=[ \t\n\r])")
#: Units up to this length are remembered, so many at once, and about so many characters are cut
#: into units at once; the three bound memory and change no id.
REMEMBERED_CHARS, REMEMBERED, CHARS_AT_ONCE = 24, 1 << 20, 1 << 21


class Ids:
    """The ids of texts by the tokenizer file at path, as little-endian unsigned 32-bit numbers; one per Python worker.

    No token of the file's pattern holds white space after another character, or a stop after a
    letter, so a text may be cut between any character and a space, tab or line end after it, and
    between a letter and a stop, and its ids are those of its units one after the other. Units come again and again, so most are looked up. A text with other white
    space, on which libraries differ, is a single unit.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def of_parts(self, parts: list[str]) -> list[bytes]:
        units = [[p] if OTHER_SPACE.search(p) else UNIT.findall(p) for p in parts]
        known = self.known
        new = list(set(filterfalse(known.__contains__, chain.from_iterable(units))))
        if new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known.update((u, struct.pack(f"<{len(e)}I", *e.ids)) for u, e in zip(new, encoded, strict=True))
        found = [b"".join(map(known.__getitem__, u)) for u in units]
        if len(known) > REMEMBERED:
            self.known = {}
        elif new:
            for u in new:
                if len(u) > REMEMBERED_CHARS:
                    del known[u]
        return found

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > CHARS_AT_ONCE and not OTHER_SPACE.search(text):
                yield from self.of_parts(held)
                held, size = [], 0
                yield b"".join(self.of_parts([part])[0] for part in cut_parts(text))
                continue
            held.append(text)
            size += len(text)
            if size > CHARS_AT_ONCE:
                yield from self.of_parts(held)
                held, size = [], 0
        yield from self.of_parts(held)


def cut_parts(text: str) -> Iterator[str]:
    """A text cut at borders, in parts of CHARS_AT_ONCE characters or as soon after as there is one."""
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + CHARS_AT_ONCE)
        end = border.start() if border else len(text)
        yield text[at:end]
        at = end


@cache
def ids_by(path: str) -> Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Ids(path)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: whole unless over capacity; then a shorter first piece, if any, and full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, (first if a < first else capacity)) for a in starts]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """Tokenise every whole text and cut what is over capacity: a row per piece, without the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = ids_by(path), struct.pack("<I", END_ID)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(ids_of.of_texts([text or "" for text in batch.column(1).to_pylist()])):
                ids += end
                for j, (a, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    rows.append(k)
                    piece.append(j)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class SumIndex:
    """Singles, pairs and triples of lengths by their sum, under the counts of what is left.

    A sum's pairs are listed when it is first asked for, smallest larger part first, and those of a
    triple as the pairs beside its largest part. Counts only fall, so what they no longer allow is
    taken out of the lists for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self._pairs: dict[int, list[tuple[int, int]]] = {}
        self._largest: dict[int, list[int]] = {}

    def allowed(self, pattern: tuple[int, ...]) -> bool:
        return all(self.left[n] >= c for n, c in Counter(pattern).items())

    def pairs(self, total: int) -> list[tuple[int, int]]:
        if total not in self._pairs:
            larger = np.flatnonzero(self.left[:total] > 0)
            larger = larger[(2 * larger >= total) & (self.left[total - larger] > 0)]
            self._pairs[total] = [(int(a), total - int(a)) for a in larger]
        return self._pairs[total]

    def pair(self, total: int, held: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """The pair with the largest part, up to most, that is there beside the lengths held."""
        found = self.pairs(total)
        for k in range(bisect_right(found, (most, total)) - 1, -1, -1):
            if self.allowed((*held, *found[k])):
                return found[k]
            if not self.allowed(found[k]):
                del found[k]
        return None

    def triple(self, total: int, held: tuple[int, ...]) -> tuple[int, int, int] | None:
        """The triple with the largest part, and then pair, that is there beside the lengths held."""
        if total not in self._largest:
            self._largest[total] = [int(a) for a in np.flatnonzero(self.left[:total] > 0) if 3 * a >= total]
        found = self._largest[total]
        for k in range(len(found) - 1, -1, -1):
            a = found[k]
            if self.allowed((*held, a)) and (rest := self.pair(total - a, (*held, a), a)):
                return (a, *rest)
            if not self.left[a] or not self.pairs(total - a):
                del found[k]
        return None

    def filling(self, n: int, capacity: int) -> tuple[int, ...] | None:
        """n and none, one, two or three lengths that fill up the capacity exactly, or None."""
        gap = capacity - n
        if gap == 0:
            return (n,)
        if self.allowed((n, gap)):
            return (n, gap)
        found = self.pair(gap, (n,), gap) or self.triple(gap, (n,))
        return (n, *found) if found else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, for a histogram of lengths.

    The largest length left leaves a gap. Singles, pairs and triples of lengths are looked up by
    their sum; a combination that fills the gap exactly is used as often as its counts allow, all
    at once. Lengths for which no combination is left are filled up by best fit: again and again
    the largest length that fits. The table has one entry per length at most, so the work
    depends on capacity and not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    sums = SumIndex(left)
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = int(min(left[n] // c for n, c in need.items()))
        for n, c in need.items():
            left[n] -= c * times
        patterns.append((pattern, times))

    for n in range(capacity, 0, -1):
        while left[n] > 0 and (found := sums.filling(n, capacity)):
            use(found)
        while left[n] > 0:
            pattern, gap = [n], capacity - n
            free = left.copy()
            free[n] -= 1
            while gap > 0 and len(fits := np.flatnonzero(free[: gap + 1] > 0)):
                pattern.append(int(fits[-1]))
                free[fits[-1]] -= 1
                gap -= int(fits[-1])
            use(tuple(pattern))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length its slots in order of rank: (first rank, first sequence, offset)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            found.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    return found


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Where every piece of every document goes in sequences of at most capacity tokens.

    A document is the ids of its whole text and END_ID; null and empty texts are END_ID alone.
    Only documents over capacity are cut. Each row of docs is packed, repeated ids and rows too;
    an empty table gives an empty result; other columns are not read. Returns doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.

    Tokenising needs no shuffle. The histogram of lengths (capacity entries) is planned on the
    driver. The ranks within a length come from counts per task and length, so that a length
    with a third of all pieces is still ranked everywhere at once.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    cut = written(pieces(docs, id_col, text_col, capacity, path).withColumn("part", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    placed = slots(plan({r["length"]: r["n"] for r in counts}, capacity))
    # ranks: the pieces of a length in earlier parts, and those before in its own part
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    return ranked_and_placed(cut, by_part, placed)


def ranked_and_placed(cut: DataFrame, by_part: DataFrame, placed: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    spark = cut.sparkSession
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    table_ = {n: tuple(np.array(x, np.int64).T) for n, x in placed.items()}
    given = spark.sparkContext.broadcast(table_)  # one entry per length and slot of a pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, sequences, offsets = given.value[int(n)]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = sequences[slot] + rank[at] - ranks[slot]
                offset[at] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL = {}
