"""Suffix-array dedup: bytes of passages that are found elsewhere, by a hash-compared suffix sort.

Every string of LENGTH bytes is a suffix cut to LENGTH. To sort all of them in one place would move
LENGTH times the corpus, so they are first dealt by a content-defined anchor: the ANCHOR bytes
inside the string with the smallest hash. Equal strings have equal anchors at equal distances, so
each group can be sorted by itself, and strings with an anchor of their own need no sorting.
Neighbouring strings with the same anchor are one run; runs with equal bytes, by a 128-bit BLAKE2b
digest of them, need no sorting either. What is left, runs with an anchor in common that differ
somewhere, is sorted suffix by suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import shuffle_partitions, table, text_of, written

LENGTH = 200
ANCHOR = 50
#: Strings are hashed in blocks of so many starts, so that a very long text needs no more memory.
BLOCK = 1 << 19
#: The strings of anchors with more distinct runs are dealt out by their digests, so that no task sorts more for an anchor
#: (about 1 MB). Either way gives the same result; dealing moves a row per string, which costs more than sorting here.
MOST_RUNS = 4096
#: Rows of one anchor that are held before it counts as such.
MOST_ROWS = 1 << 20
#: Bytes of runs that are held, and strings that are sorted, at once.
SORT_BYTES, STRINGS_AT_ONCE = 1 << 20, 1 << 17

#: The base of the polynomial hashes, modulo 2**64, and its inverse. The texts for which this modulus is
#: known to fail have 1,024 bytes or more, and strings have LENGTH.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
POSITION = np.uint64((1 << 24) - 1)
FULL, FULL_AND_SORTED, SORTED, DEALT, EDGE = 0, 1, 2, 4, 8


@cache
def powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, whose low bits depend on few bits of the text."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Prefix polynomial hashes of bytes: equal substrings have equal hashes, in constant time each."""

    def __init__(self, data: np.ndarray, most: int):
        self.up = powers(BASE, most)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, most)[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.up[starts]


def digests(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 128-bit digests of substrings as two rows of numbers."""
    found = [blake2b(data[a : a + n], digest_size=16).digest() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2).T


def runs_of(data: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of a text, by blocks of `size` starts: anchor hash, digest (2), first start, strings, distance of the anchor from the first start."""
    width = LENGTH - ANCHOR + 1
    for at in range(0, len(data) - LENGTH + 1, size):
        block = data[at : at + size + LENGTH - 1]
        n = len(block) - LENGTH + 1
        prefixes = Prefixes(block, size + LENGTH)
        hashes = mixed((prefixes.sums[ANCHOR:] - prefixes.sums[:-ANCHOR]) * prefixes.up[: len(block) - ANCHOR + 1])
        # the smallest hash in each window of `width`, the leftmost of equal ones: minima of the parts
        # before and after the edges of blocks of that width
        keys = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        keys = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
        head = np.minimum.accumulate(keys, axis=1).ravel()
        tail = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        owner = (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[first, n])
        anchor = owner[first]
        # equal bytes have equal anchors at equal distances, so the bytes are all that the digest needs
        yield hashes[anchor], *digests(block.tobytes(), first, count + LENGTH - 1), first + at, count, anchor - first


def packed(start: np.ndarray, count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """A run's place in its text as one number."""
    return (start << 16) | (count << 8) | distance


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 255, place & 255


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


RUN_SCHEMA = "anchor long, run long, run_2 long, row long, place long, tag int"
MARK_NAMES = ["row", "place", "anchor", "state", "n"]


def text_runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per run of (row, data), equal runs of a batch apart from their first: anchor, run and run_2 (digest), row, place, tag.

    tag: 0 for the only such run of its batch, 1 for the first of several, 2 for the others. What
    is known to be a copy is dealt anywhere, so that a hot passage sends one row per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, data in zip(batch.column(0), batch.column(1), strict=True):
                for anchor, low, high, start, count, distance in runs_of(np.frombuffer(data.as_buffer(), np.uint8), block) if data.is_valid else ():
                    place = packed(start, count, distance).view(np.uint64)
                    found.append((anchor, low, high, np.full(len(anchor), row.as_py(), np.int64).view(np.uint64), place))
            if not found:
                continue
            table_ = np.concatenate([np.stack(x) for x in found], axis=1)
            table_ = table_[:, np.lexsort((table_[2], table_[1], table_[0]))]
            same = (table_[:3, 1:] == table_[:3, :-1]).all(axis=0)
            tag = np.where(np.r_[False, same], 2, np.r_[same, False].astype(np.int64))
            table_[0] = np.where(tag == 2, mixed(table_[3] + table_[4]), table_[0])
            yield pa.RecordBatch.from_arrays([*_longs(*table_), pa.array(tag.astype(np.int32))], ["anchor", "run", "run_2", "row", "place", "tag"])

    return docs.mapInArrow(run, RUN_SCHEMA)


def marked(runs: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """The runs that matter: row, place, anchor and state.

    FULL: all its strings are found elsewhere, as an equal run is. SORTED: no equal run, but others
    with its anchor. FULL_AND_SORTED: the one of the equal runs that those are compared with. DEALT
    is added where the anchor has more than most_runs distinct runs.

    Rows are dealt by ranges of anchor and digest, so that a hot anchor is spread over tasks while
    equal runs meet. The anchors at a task's two edges may go on in the next ones: their distinct runs
    are counted per task, and the sums (two anchors per task at most, hence the broadcast) tell.
    """
    spark = runs.sparkSession
    dealt = runs.repartitionByRange(shuffle_partitions(spark), "anchor", "run").sortWithinPartitions("anchor", "run", "run_2")

    def marks(rows: list[np.ndarray], state: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        keep = state >= 0
        return pa.RecordBatch.from_arrays([*_longs(rows[3][keep], rows[4][keep], rows[0][keep]), pa.array(state[keep].astype(np.int32)), *_longs(n[keep])], MARK_NAMES)

    def copies_marked(rows: list[np.ndarray]) -> pa.RecordBatch:
        return marks(rows, np.full(len(rows[0]), FULL), np.zeros(len(rows[0]), np.int64))

    def compared(rows: list[np.ndarray], edges: list[int]) -> pa.RecordBatch:
        """The marks of rows sorted by anchor and digest."""
        anchor, tag = rows[0], rows[5]
        change = lambda x: np.r_[True, x[1:] != x[:-1]]
        new_anchor = change(anchor)
        new_run = new_anchor | change(rows[1]) | change(rows[2])
        run_id = np.cumsum(new_run) - 1
        anchor_id = np.cumsum(new_anchor) - 1
        members = np.bincount(run_id)[run_id]
        runs_ = np.bincount(anchor_id[new_run])[anchor_id]
        full = (members > 1) | (tag == 1)
        at_edge = np.isin(anchor, edges)
        shared = (runs_ > 1) | at_edge
        state = np.where(full, np.where(shared & new_run, FULL_AND_SORTED, FULL), np.where(shared, SORTED, -1))
        state = np.where((state > FULL) & (runs_ > most_runs) & ~at_edge, state | DEALT, state)
        return marks(rows, np.where((state > FULL) & at_edge, state | EDGE, state), np.where(at_edge & new_run, 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(6)]
        edges: list[int] = []
        for batch in batches:
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
            copies = rows[5] == 2
            if copies.any():
                yield copies_marked([r[copies] for r in rows])
            held = [np.concatenate([h, r[~copies]]) for h, r in zip(held, rows, strict=True)]
            if not edges and len(held[0]):
                edges.append(int(held[0][0]))
            if len(held[0]) < 1 << 17:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
            if not cut and len(held[0]) >= MOST_ROWS:
                edges.append(int(held[0][-1]))
                cut = int(np.searchsorted(held[1], held[1][-1]))  # the last run of the hot anchor may go on
                if not cut:  # one run with very many members: two of them will do for the others
                    yield copies_marked([h[2:] for h in held])
                    held = [h[:2] for h in held]
                    continue
            if cut:
                yield compared([h[:cut] for h in held], edges)
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield compared(held, [*edges, int(held[0][-1])])

    found = written(dealt.mapInArrow(run, "row long, place long, anchor long, state int, n long"), "marks")
    totals = found.filter(F.col("state") >= EDGE).groupBy("anchor").agg(F.sum("n").alias("total"))
    base = F.col("state") - EDGE
    resolved = (
        F.when(F.col("total").isNull() | (F.col("state") < EDGE), F.col("state"))
        .when((F.col("total") == 1) & (base == FULL_AND_SORTED), FULL)
        .when(F.col("total") > most_runs, base + DEALT)
        .otherwise(base)
    )
    told = found.join(F.broadcast(totals), "anchor", "left")
    return told.filter(F.col("total").isNull() | (F.col("total") > 1) | (F.col("state") != SORTED + EDGE)).select("row", "place", "anchor", resolved.cast("int").alias("state"))


def common_extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the strings at a and b have in common, up to LENGTH: a binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
    whole = prefixes.hashes(a, LENGTH) == prefixes.hashes(b, LENGTH)
    low[whole] = LENGTH
    at = np.flatnonzero(~whole)
    a, b, lo, hi = a[at], b[at], low[at], high[at] - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = prefixes.hashes(a, mid) == prefixes.hashes(b, mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    low[at] = lo
    return low


def suffix_sort(data: np.ndarray, prefixes: Prefixes, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the strings at starts within each group (rows of a group are together): a bottom-up mergesort.

    In each round an element's place in the merged run is its own rank plus that among the
    neighbouring run, by binary search. All groups are merged at once.
    """
    n = len(starts)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    begin = np.repeat(first, np.diff(np.r_[first, n]))
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    order = starts.copy()
    source = np.arange(n)
    width = 1
    while width < int((end - begin).max(initial=0)):
        place = np.arange(n) - begin
        left = (place // width) % 2 == 0
        own = begin + (place // width) * width
        other_low = np.where(left, own + width, own - width)
        other_high = np.minimum(other_low + width, end)
        some = np.flatnonzero(other_low < other_high)  # a last run without a neighbour stays
        lo, hi = other_low[some], other_high[some]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            a, b = order[mid], order[some[open_]]
            common = common_extension(prefixes, a, b)
            inside = np.minimum(common, LENGTH - 1)
            less = np.where(common < LENGTH, data[a + inside].astype(np.int16) < data[b + inside], ~left[some[open_]])  # equal: the left run goes first
            lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
        target = np.arange(n)
        target[some] = np.minimum(own[some], other_low[some]) + (some - own[some]) + (lo - other_low[some])
        moved, moved_source = np.empty_like(order), np.empty_like(source)
        moved[target], moved_source[target] = order, source
        order, source = moved, moved_source
        width *= 2
    return source


def found_twice(data: np.ndarray, run_start: np.ndarray, count: np.ndarray, distance: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether each string of the runs is found twice or more; runs lie one after the other in data."""
    found = np.zeros(int(count.sum()), bool)
    first = np.cumsum(count) - count
    _, kind, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
    runs = np.flatnonzero(sizes[kind] > 1)
    prefixes = Prefixes(data, 2 * SORT_BYTES if len(data) < 2 * SORT_BYTES else len(data) + 1)
    # equal strings have equal anchors at equal distances, so some distances are sorted at a time
    step = max(STRINGS_AT_ONCE // max(len(runs), 1), 1)
    for low in range(0, LENGTH - ANCHOR + 1, step):
        offset = distance[runs, None] - np.arange(low, min(low + step, LENGTH - ANCHOR + 1))
        at_run, at_distance = np.nonzero((offset >= 0) & (offset < count[runs, None]))
        offset, of = offset[at_run, at_distance], runs[at_run]
        order = np.lexsort((at_distance, kind[of]))
        of, offset, at_distance = of[order], offset[order], at_distance[order]
        group = np.cumsum(np.r_[True, (kind[of[1:]] != kind[of[:-1]]) | (at_distance[1:] != at_distance[:-1])])[: len(of)]
        several = np.bincount(group)[group] > 1
        if not several.any():
            continue
        of, offset, group = of[several], offset[several], group[several]
        starts, place = run_start[of] + offset, first[of] + offset
        sorted_ = suffix_sort(data, prefixes, starts, group)
        at = starts[sorted_]
        near = np.flatnonzero((group[1:] == group[:-1]) & (common_extension(prefixes, at[1:], at[:-1]) == LENGTH))
        for k in range(0, len(near), 1 << 14):  # equal hashes are held against the bytes
            pair = near[k : k + (1 << 14)]
            span = np.arange(LENGTH)
            pair = pair[(data[at[pair][:, None] + span] == data[at[pair + 1][:, None] + span]).all(axis=1)]
            found[place[sorted_[pair]]] = found[place[sorted_[pair + 1]]] = True
    return found


def ranges(flags: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """Flagged strings as rows (row, start, count), neighbours in one."""
    at = np.flatnonzero(flags)
    row, start = row[at], start[at]
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return _longs(row[first], start[first], np.diff(np.r_[first, len(at)]))


def sorted_ranges(contexts: DataFrame) -> DataFrame:
    """Strings that the suffix sort finds twice, in runs that aren't known to be copies: row, start, count."""
    spark = contexts.sparkSession
    dealt = contexts.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(part: pa.Table) -> pa.RecordBatch:
            anchor, row, place = (part.column(k).to_numpy() for k in range(3))
            state = part.column(3).to_numpy()
            start, count, distance = unpacked(place)
            data = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
            run_start = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
            flags = found_twice(data, run_start, count, distance, anchor) & np.repeat(state == SORTED, count)
            run_of = np.repeat(np.arange(len(count)), count)
            starts = start[run_of] + np.arange(len(run_of)) - np.repeat(np.cumsum(count) - count, count)
            return pa.RecordBatch.from_arrays(ranges(flags, row[run_of], starts), ["row", "start", "count"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                size += int(((held[-1].column(2).to_numpy() >> 8) & 255).sum()) + LENGTH * held[-1].num_rows
                if size < SORT_BYTES:
                    continue
                whole = pa.Table.from_batches(held)
                anchors = whole.column(0).to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                if cut:
                    yield out(whole.slice(0, cut))
                    held, size = whole.slice(cut).to_batches(), 0
        if held:
            yield out(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "row long, start long, count long")


def dealt_ranges(strings: DataFrame) -> DataFrame:
    """The same for single strings (low, high, row, start, known) of anchors with too many runs: dealt by their digests."""
    spark = strings.sparkSession
    dealt = strings.select("low", "high", "row", "start", "known").repartition(shuffle_partitions(spark), "low").sortWithinPartitions("low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[np.ndarray], equal: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(equal & (rows[4] == 0))
            return pa.RecordBatch.from_arrays(_longs(rows[2][at], rows[3][at], np.ones(len(at), np.int64)), ["row", "start", "count"])

        # the last string waits for the one after it; before: whether it's equal to the one before
        last, before = [np.zeros(0, np.int64) for _ in range(5)], False
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(last, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            yield found([r[:-1] for r in rows], np.r_[before, same][:-1] | same)
            last, before = [r[-1:] for r in rows], bool(np.r_[before, same][-1])
        yield found(last, np.full(len(last[0]), before))

    return dealt.mapInArrow(run, "row long, start long, count long")


def compressed(docs: DataFrame) -> DataFrame:
    """(row, data) with data compressed, so that a shuffle of whole texts moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(x.as_buffer()) for x in batch.column(1)], pa.binary())], ["row", "data"])

    return docs.mapInArrow(run, "row long, data binary")


def run_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the runs wanted (row, list of anchor, place, state), from the texts that have any.

    Runs to sort come with their bytes; DEALT ones as one row per string, with its digest in anchor and high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "row", "place", "state", "data", "high"]
        for batch in batches:
            for k in range(batch.num_rows):
                data = zstandard.ZstdDecompressor().decompress(batch.column(1)[k].as_py())
                wanted_ = batch.column(2)[k].values
                anchor, place, state = (wanted_.field(j).to_numpy() for j in range(3))
                start, count, _ = unpacked(place)
                cool = state < DEALT
                row = batch.column(0)[k].as_py()
                pieces = [data[s : s + c + LENGTH - 1] for s, c in zip(start[cool].tolist(), count[cool].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*_longs(anchor[cool], np.full(len(pieces), row, np.int64), place[cool]), pa.array(state[cool].astype(np.int32)), pa.array(pieces, pa.binary()), pa.nulls(len(pieces), pa.int64())], names
                )
                for s, c, known in zip(start[~cool].tolist(), count[~cool].tolist(), (state[~cool] & 3 == FULL_AND_SORTED).tolist(), strict=True):
                    low, high = digests(data, np.arange(s, s + c), np.full(c, LENGTH))
                    yield pa.RecordBatch.from_arrays(
                        [*_longs(low, np.full(c, row, np.int64), s + np.arange(c)), pa.array(np.full(c, DEALT + int(known), np.int32)), pa.nulls(c, pa.binary()), *_longs(high)], names
                    )

    joined = compressed(docs).join(wanted, "row").select("row", "data", "wanted")
    return joined.mapInArrow(run, "anchor long, row long, place long, state int, data binary, high long")


def without_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per text: what is left after removing every byte that a string in found (row, start, count) covers."""
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = zstandard.ZstdDecompressor().decompress(batch.column(1)[k].as_py())
                removed, spans, kept = 0, 0, data
                if batch.column(2)[k].is_valid:
                    found_ = batch.column(2)[k].values
                    start, count = (found_.field(j).to_numpy() for j in range(2))
                    change = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + count + LENGTH - 1, minlength=len(data) + 1)
                    covered = np.cumsum(change)[:-1] > 0
                    removed = int(covered.sum())
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                rows.append((len(data), removed, spans, kept))
            sizes = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *sizes, pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]), pa.array([r[3] for r in rows], pa.binary())],
                ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    joined = compressed(docs).join(by_row, "row", "left").select("row", "data", "found")
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_runs: int = MOST_RUNS, block: int = BLOCK) -> DataFrame:
    """Remove each byte covered by a string of LENGTH bytes that also starts anywhere else.

    Texts are UTF-8 bytes and matches never cross texts; strings are judged on the input. Null
    counts as empty; texts under LENGTH bytes have no such string. Every row is a text of its own,
    with repeated ids and rows too; an empty table gives an empty result; other columns are not
    read. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept
    (the bytes left; they needn't be whole characters).

    Rows are told apart by their ids if those are integers that don't repeat; otherwise the table
    is written once with numbered rows.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("data"))
    distinct = docs.schema[id_col].dataType.simpleString() in ("bigint", "int") and (
        docs.groupBy(id_col).agg(F.count("*").alias("_times")).filter(F.col(id_col).isNull() | (F.col("_times") > 1)).limit(1).count() == 0
    )
    if distinct:
        numbered = whole.withColumn("row", F.col("doc_id").cast("long"))
    else:
        numbered = written(whole.withColumn("row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select("row", "data")
    marks = marked(written(text_runs(texts, block), "runs"), most_runs)
    wanted = marks.filter(F.col("state") != FULL).groupBy("row").agg(F.collect_list(F.struct("anchor", "place", F.col("state").cast("long").alias("state"))).alias("wanted"))
    contexts = run_bytes(texts, wanted)
    if marks.filter(F.col("state") >= DEALT).limit(1).count():
        contexts = written(contexts, "contexts")
        strings = contexts.filter(F.col("state") >= DEALT).select(
            F.col("anchor").alias("low"), "high", "row", F.col("place").alias("start"), (F.col("state") - DEALT).alias("known")
        )
        found = sorted_ranges(contexts.filter(F.col("state") < DEALT)).unionByName(dealt_ranges(strings))
    else:
        found = sorted_ranges(contexts)
    known = marks.filter(~F.col("state").isin(SORTED, SORTED | DEALT)).select(
        "row", F.shiftright("place", 16).alias("start"), F.shiftright("place", 8).bitwiseAND(F.lit(255)).alias("count")
    )
    found = written(known.unionByName(found), "repeats")
    left = without_ranges(texts, found)
    if distinct:
        return left.withColumnRenamed("row", "doc_id").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    return left.join(numbered.select("row", "doc_id"), "row").drop("row")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL = {}
