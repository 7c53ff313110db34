"""SimHash near-dedup: pigeonring filtering of fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import shuffle_partitions, table, written
from foliospark.operators.graph import components

WORDS = 3
SEED = 42
BITS = 64
MAX_DIFFERENT = 3
#: Buckets up to this size are compared by shifted rows; larger ones by a search that shrinks. Both
#: apply the chain of budgets, then the full check.
SMALL_BUCKET = 48
#: Buckets over this size are dealt again by longer keys.
LARGE_BUCKET = 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles: bit b is set if it is in over half of the hashes."""
    # bytes.split() without arguments splits at exactly the six bytes of white space in the contract
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(found))
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id and fp, the fingerprint as a signed long.

    Null and empty texts have the fingerprint 0; a text with fewer words than a shingle is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def chain_passed(a: Column, b: Column, most: int, segments: int) -> Column:
    """Whether two fingerprints pass the pigeonring and then differ in `most` bits at most.

    From some segment on, every chain of consecutive segments, up to the whole ring, differs in its
    share of `most` bits at most. For any two fingerprints within `most` bits there is such a segment.
    """
    width = BITS // segments
    x = a.bitwiseXOR(b)
    parts = [F.bit_count(F.shiftrightunsigned(x, width * s).bitwiseAND(F.lit((1 << width) - 1))) for s in range(segments)]
    chains = F.lit(False)
    for ring in range(segments):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, segments):
            total = total + parts[(ring + length - 1) % segments]
            ok = ok & (total <= length * most // segments)
        chains = chains | ok
    return chains & (F.bit_count(x) <= most)


def ring_keys(fp: str) -> list[Column]:
    """The first bucket keys of a fingerprint: 8, two for the chains that start at each of 4 segments.

    By the pigeonring principle, if two fingerprints differ in 3 bits at most, then from some
    segment on the first is equal, the first two differ in 1 bit at most, the first three in 2.
    The budgets become keys: the first segment, and one of the second's two halves, of which at
    least one is equal. No pair within MAX_DIFFERENT is lost.
    """
    keys = []
    for ring in range(4):
        for half in range(2):
            key = segment(fp, ring) * 256 + F.shiftright(segment(fp, ring + 1), 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(key * 8 + (ring * 2 + half))
    return keys


def segment(fp: str, s: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 16 * (s % 4)).bitwiseAND(F.lit(0xFFFF))


#: How the key of a large bucket goes on: the low bit and width of each part of the chain's next segment.
#: The third segment differs in 2 bits at most and the fourth in 3, so one of 3 and of 4 parts is equal.
NEXT_PARTS = [((0, 5), (5, 5), (10, 6)), ((0, 4), (4, 4), (8, 4), (12, 4))]


def next_keys(fp: str, key: str, level: int) -> list[Column]:
    """The keys of a large bucket's fingerprints, longer by a part of the chain's next segment. No pair is lost here either."""
    at = F.pmod(F.shiftright(F.col(key).bitwiseAND(F.lit(7)), 1) + 2 + level, F.lit(4))
    value = F.when(at == 0, segment(fp, 0)).when(at == 1, segment(fp, 1)).when(at == 2, segment(fp, 2)).otherwise(segment(fp, 3))
    parts = [F.shiftright(value, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in NEXT_PARTS[level]]
    return [F.col(key) + F.shiftleft((part * 4 + k).cast("long"), (27, 35)[level]) for k, part in enumerate(parts)]


def within_chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs pass the chain of budgets, before the full Hamming check.

    From some segment on, the first one, two and three consecutive segments may differ in 0, 1 and
    2 bits at most, in proportion to 3 bits for all four.
    """
    x = a ^ b
    parts = np.stack([np.bitwise_count((x >> np.uint64(16 * s)) & np.uint64(0xFFFF)) for s in range(4)]).astype(np.int8)
    passed = np.zeros(len(x), bool)
    for ring in range(4):
        total = np.zeros(len(x), np.int8)
        ok = np.ones(len(x), bool)
        for length in range(1, 4):
            total = total + parts[(ring + length - 1) % 4]
            ok &= total <= (length * MAX_DIFFERENT) // 4
        passed |= ok
    return passed


def links_in_buckets(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the buckets connect; rows are sorted by key.

    Small buckets give all their links. A large bucket is searched from one fingerprint to those
    not reached yet, so it gives a tree: fewer links than rows, with the same components.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    most = int(sizes[sizes <= SMALL_BUCKET].max(initial=0))
    small = size_of <= SMALL_BUCKET
    for shift in range(1, most):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        if not len(at):
            break
        a, b = fps[at], fps[at + shift]
        chained = within_chain(a, b)
        a, b = a[chained], b[chained]
        near = np.bitwise_count(a ^ b) <= MAX_DIFFERENT
        left.append(a[near])
        right.append(b[near])
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        open_ = fps[start : start + size]
        while len(open_) > 1:
            frontier, open_ = [open_[0]], open_[1:]
            while frontier and len(open_):
                f = frontier.pop()
                near = within_chain(open_, f)
                near[near] = np.bitwise_count(open_[near] ^ f) <= MAX_DIFFERENT
                if near.any():
                    found = open_[near]
                    left.append(np.full(len(found), f))
                    right.append(found)
                    frontier.extend(found)
                    open_ = open_[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def searched(keyed: DataFrame, largest: int | None) -> DataFrame:
    """Links (a, b) within the buckets of (fp, key), key null; and the rows (fp, fp, key) of buckets over `largest`, not searched."""
    spark = keyed.sparkSession
    dealt = keyed.select("fp", "key").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            left = np.zeros(len(k), bool)
            if largest is not None:
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                sizes = np.diff(np.r_[starts, len(k)])
                left = (np.repeat(sizes, sizes) > largest) | ((k == hot) if hot is not None else False)
            a, b = (x.view(np.int64) for x in links_in_buckets(k[~left], f[~left]))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            rest = f[left].view(np.int64)
            key = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(k[left])])
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([pairs[:, c], rest])) for c in (0, 1)), key], ["a", "b", "key"])

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(1).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(0).to_numpy().view(np.uint64)])
            if len(held_k) < 1 << 16:
                continue
            cut = int(np.searchsorted(held_k, held_k[-1]))  # the last bucket may go on in the next batch
            if not cut and largest is not None:
                cut, hot = len(held_k), int(held_k[-1])
            if cut:
                yield out(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield out(held_k, held_f)

    return dealt.mapInArrow(run, "a long, b long, key long")


def near_links(classes: DataFrame, largest: int = LARGE_BUCKET) -> DataFrame:
    """Links (a < b, unsigned order aside) between the distinct fingerprints in column fp.

    Buckets over `largest` aren't searched where they are: they're dealt by longer keys, with parts
    of the chain's third and fourth segment. Those that are too large even then are cut into blocks,
    and every pair of blocks is a bucket. No task holds much more than 2 * largest fingerprints of a key.
    """
    keyed = classes.select("fp", F.explode(F.array(*ring_keys("fp"))).alias("key"))
    links = None
    for level in range(4):
        found = written(searched(keyed, largest if level < 3 else None), "ring-links")
        near = found.filter("key IS NULL").select("a", "b")
        links = near if links is None else links.union(near)
        rest = found.filter("key IS NOT NULL").select(F.col("a").alias("fp"), "key")
        if level == 3 or rest.isEmpty():
            break
        if level < 2:
            keyed = rest.select("fp", F.explode(F.array(*next_keys("fp", "key", level))).alias("key"))
            continue
        blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / largest).alias("blocks"))
        own = rest.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        cells = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        keyed = cells.select("fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
    return links.distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The fingerprint of every document, and the smallest id that its links reach.

    Documents with fingerprints that differ in MAX_DIFFERENT bits at most are linked; equal
    fingerprints are one class and are linked through it, without pairs of documents. Null and
    empty texts have the fingerprint 0 and are linked like any other. Null ids count only where a
    component has no other; repeated rows stay and get the same result; an empty table gives an
    empty result; other columns are not read. Returns doc_id, fp (signed), component_id.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(near_links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns.

    Of rows that share that id, one stays.
    """
    kept = written(near_dedup(docs, id_col, text_col, words).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")), "kept")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_doc_id"))
    found = keyed.join(kept, F.col("_doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = docs.groupBy(id_col).agg(F.count("*").alias("_times")).filter("_times > 1").limit(1).count()
    return (found.dropDuplicates(["_doc_id"]) if again else found).select("_doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL = {}
