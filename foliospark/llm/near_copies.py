"""Near copies for a stage: SimHash fingerprints filtered by the pigeonring, confirmed by word shingles.

Candidates meet in the prefixes of rare shingles that similar sets must share. A fingerprint of 64
bits has no key that holds all pairs within 20 bits; the pigeonring prunes the candidates instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import written
from foliospark.llm.simhash import chain_passed, majority
from foliospark.operators.graph import components

WORDS = 5
#: Texts are near copies from FIFTHS / 5 on, a similarity of 0.8.
FIFTHS = 4
#: Bits in which the fingerprints of near copies may differ, and the segments of the ring. At the
#: similarity pairs differ in 10 bits on average (standard deviation 3), unlike texts in 32 (4).
MAX_DIFFERENT, SEGMENTS = 20, 8
#: Documents whose shingles are counted for the order, about; the order changes no result.
ORDER_DOCS = 20_000
#: Shingles that as many of those documents share are common, up to MOST_COMMON of them.
COMMON, MOST_COMMON = 3, 100_000
#: Buckets up to this size give all their pairs at once; larger ones go by rounds with so many times
#: more pivots each.
SMALL_BUCKET, MORE_PIVOTS = 8, 64
_SEED = 42


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles of lower-cased words, ascending; one shingle where there are fewer words."""
    # bytes.split() without arguments splits at exactly the six bytes of white space in the contract
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(found))
    hash_ = xxhash.xxh64_intdigest
    hashes = [hash_(joined[a:b], _SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all: those not common by hash, then the common ones by rank.

    Of two sets with enough shared shingles, the first shared one is in the prefixes of both,
    whatever the order is, as long as all sets are in the same order.
    """
    n = len(hashes)
    if not n:
        return hashes
    at = np.searchsorted(common, hashes)
    at[at == len(common)] = 0
    is_common = common[at] == hashes if len(common) else np.zeros(n, bool)
    ordered = np.concatenate([hashes[~is_common], hashes[is_common][np.argsort(rank[at[is_common]], kind="stable")]])
    return ordered[: n - (FIFTHS * n + 4) // 5 + 1]


def common_shingles(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents share, ascending, and their ranks from the rarest on. A count over some documents, for the order alone."""
    every = max(1, docs.count() // ORDER_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words))], ["h"])

    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0).select(F.col(text_col).alias("text"))
    counts = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = found.column("h").to_numpy(), found.column("count").to_numpy()
    order = np.lexsort((h, n))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    by_hash = np.argsort(h)
    return h[by_hash], rank[by_hash]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per document: doc_id, sig (128 bits of its set of shingles), n (their number), fp (SimHash of the set) and prefix."""
    common, rank = common_shingles(docs, id_col, text_col, words)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((common, rank))  # MOST_COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [shingles(t.as_py(), words) for t in batch.column(1)]
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                fps = np.fromiter((majority(s.view(np.uint64)) for s in sets), np.uint64, len(sets)).view(np.int64)
                arrays = [batch.column(0), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([prefix(s, *order) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sig", "n", "fp", "prefix"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, sig binary, n long, fp long, prefix array<long>")


def _may_be_near(a: str, b: str):
    """Whether sizes and places leave room for the similarity, and the fingerprints pass the pigeonring and the full Hamming check.

    Where the bucket's shingle is the first that both share, all before it in either set is not
    shared, so no more than what follows can be. Similar pairs pass in that bucket at least.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 5 * F.least(n, m) >= FIFTHS * F.greatest(n, m)
    most = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    room = (5 + FIFTHS) * most >= FIFTHS * (n + m)
    return sizes & room & chain_passed(F.col(f"{a}.fp"), F.col(f"{b}.fp"), MAX_DIFFERENT, SEGMENTS)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; sets are made again from the texts of these nodes alone."""
    pairs = written(pairs.distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(classes.select("node", "sig", "low").join(ends, "node"), "near-ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [shingles(t.as_py(), words) for t in batch.column(2)]
                # an id may stand for several texts: the node's own is known by its signature
                own = np.array([xxhash.xxh3_128_digest(s.tobytes()) == sig.as_py() for s, sig in zip(sets, batch.column(1), strict=True)], bool)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([sets[k] for k in at], pa.list_(pa.int64()))], ["node", "hashes"])

    read = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["low"])).select("node", "sig", "text")
    found = written(read.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"]), "near-sets")
    left, right = (found.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("a_set", "b_set")))
    near = (5 + FIFTHS) * F.col("shared") >= FIFTHS * (F.size("a_set") + F.size("b_set"))
    return written(both.filter(near).select("a", "b"), "near-links")


def near_links(classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links (a < b) between nodes that connect what all pairs of near copies connect.

    Nodes meet in the buckets of their prefixes' shingles, of which most hold one node and are left
    at once. Those that pass the pigeonring are confirmed. Small buckets give all their pairs. Of a
    larger one the members are first held against the one with the fewest shingles before the
    bucket's own, the least edited of a group of near copies, which connects most groups with as many
    pairs as there are members. Then only members that aren't connected yet are compared, in rounds of
    ever more pivots, until every member that can be one has been a pivot or all are connected. The
    smaller set of a similar pair has a ninth of its shingles at most before the bucket's own: only
    such members are pivots. Two members that came from the same open bucket before this one are held
    against each other there, in this round or another, and not here again.
    """
    keys = classes.select("node", F.posexplode("prefix").alias("at", "h"))
    # counted by grouping, so that a shingle's members needn't meet in one task: the join splits a hot one
    counts = written(keys.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "near-counts")
    shared = keys.join(counts, "h")
    met = written(shared.join(classes.select("node", "n", "fp"), "node").withColumn("u", F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)), "near-buckets")
    small, large = met.filter(F.col("m") <= SMALL_BUCKET), met.filter(F.col("m") > SMALL_BUCKET)

    early = (5 + FIFTHS) * F.col("at") <= (5 - FIFTHS) * F.col("n")

    def pairs(found: DataFrame) -> DataFrame:
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def still_open(links: DataFrame) -> DataFrame:
        """Members, with their roots, of large buckets that hold several components."""
        at = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = at.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min(F.when(early, F.col("n"))).alias("least")).filter("r <> s")
        with_room = 5 * F.col("n") - (5 + FIFTHS) * F.col("at") >= FIFTHS * F.col("least")  # even for the smallest pivot
        open_ = at.join(several.select("h", "least"), "h").filter(with_room).drop("least")
        return written(open_.withColumn("before", F.lag("h").over(Window.partitionBy("node").orderBy("at"))), "near-open")

    first = large.groupBy("h").agg(F.min(F.struct("at", "u", "node", "n", "fp")).alias("p")).select("h", "p.*")
    all_pairs = small.alias("x").join(small.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & _may_be_near("x", "y"))
    to_first = large.alias("x").join(first.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.node") != F.col("y.node")) & _may_be_near("x", "y"))
    links = _confirmed(pairs(all_pairs).union(pairs(to_first)), classes, docs, words)
    met_before = F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
    apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & ~met_before & _may_be_near("x", "y")
    low, high = 0, MORE_PIVOTS
    while True:
        open_ = still_open(links).filter(F.col("m") > low)
        most = open_.agg(F.max("m")).first()[0]
        if not most:
            break
        pivots = open_.filter(early & (F.col("u") * F.col("m") >= low) & (F.col("u") * F.col("m") < high))
        links = links.union(_confirmed(pairs(pivots.alias("x").join(open_.alias("y"), apart)), classes, docs, words))
        if high >= most:
            break
        low, high = high, high * MORE_PIVOTS
    return links


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of their group of near copies, with all their columns.

    Texts are near copies when the Jaccard similarity of their sets of shingles is FIFTHS / 5 at
    least, and the SimHashes of these sets differ in MAX_DIFFERENT bits at most, by the pigeonring;
    groups are the components of such pairs. Prefixes and sizes only leave out pairs that cannot
    be similar; pairs at the similarity differ in 10 bits on average, so the fingerprints leave out
    hardly any. The rest are compared by their whole sets (of 64-bit hashes). Null and texts without
    words are equal. Of rows that share the id, one stays. An empty table gives an empty result.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, id_col, text_col, words), "signatures")
    grouped = signed.groupBy("sig").agg(F.min("doc_id").alias("low"), F.min(F.struct("n", "fp", "prefix")).alias("p"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "sig", "low", "p.n", "p.fp", "p.prefix"), "shingle-classes")
    roots = components(near_links(classes, read, words))
    rooted = classes.select("node", "low").join(roots, "node", "left").select("low", F.coalesce("root", "node").alias("root"))
    kept = written(rooted.groupBy("root").agg(F.min("low").alias("_id")).select("_id"), "near-kept")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_doc_id"))
    found = keyed.join(kept, F.col("_doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = docs.groupBy(id_col).agg(F.count("*").alias("_times")).filter("_times > 1").limit(1).count()
    return (found.dropDuplicates(["_doc_id"]) if again else found).select("_doc.*")
