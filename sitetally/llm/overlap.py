"""Near copies by exact overlap of word shingles.

Two texts are near copies if their sets of 5-word shingles have a Jaccard similarity of at least 0.8. A few changed words
spread over any radius of SimHash bits that can still be probed, so candidates come from prefixes: with the shingles of each
text in one common order, two near copies share one of their first ones, about a fifth. The order is by how often a shingle
occurs, from COUNTERS counters that all shingles share, so texts that have just a common passage don't meet: its shingles come
last. Any order is right; the counters only make it a good one.

SimHash, as of op1, comes first: texts with fingerprints at 2 or fewer differing bits are verified as near copies. The prefixes find the
others, whose fingerprints are farther apart. Members of a shingle are first held against its least and its greatest member only, so a large group of near copies takes two
comparisons a text. Next, members of crowded shingles pick the likest one of another component among BLOCK others, in rounds as long as
that brings many together: a pick a text, so a group whose members are alike but not all near merges without all of its pairs.
Then the members of a shingle that are still in different components meet, if the shingle's places in both
prefixes let it be the first one they share: what follows it in the smaller rest must be enough. A pair is verified on the whole sets
unless its sizes or parities rule it out: a set has PARITIES bits, each whether it holds an odd number of shingles of that bit, so two sets differ in
as many shingles as bits at least. No near pair is lost. Only picks are estimated, from sketches (FUNCTIONS minima, 4 bits of each) within
DEVIATIONS standard deviations; what they miss meets afterwards with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .common import prepare, text_bytes, written
from .graph import components
from .simhash import fingerprint
from .simhash import links as simhash_links
from .skew import lookup, marks, with_mark

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Minima of a sketch, and how far below its mean an estimate may lie.
FUNCTIONS = 256
DEVIATIONS = 6.5
#: Bits of a set's parities, a power of 2: long sets fill them up and then rule out less.
PARITIES = 1024
#: Members of a shingle from which on they pick first, how many of them look at each other, and the share of picks that must be near for a further round.
CROWDED = 64
BLOCK = 512
WORTH = 0.1
#: Counters of shingles: 4 MB a task, however many shingles there are; in so many slices their sums are gathered.
COUNTERS = 1 << 20
SLICES = 64
#: Order of rows without a doc_id: after all others.
LAST = (1 << 63) - 1
SEED = 43
#: Shingles whose minima are taken at once: bounds memory on very long texts.
STEP = 1 << 10

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_ADDED = _RANDOM.integers(0, 2**64, FUNCTIONS, dtype=np.uint64)


def shingles(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, in lower case (A-Z); a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - words_each + 1)
    spans = zip((ends - sizes)[:n].tolist(), ends[min(words_each, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles that isn't empty."""
    least = np.full(FUNCTIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), STEP):
        mixed = found[at : at + STEP, None] * _FACTORS + _ADDED
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(0), out=least)
    return least


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(44)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            np.add.at(counts, _counter(shingles(text)), 1)
    parts = np.split(counts, SLICES)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "data": pa.array([pack([p]) for p in parts], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = sum(unpack(b)[0][0] for b in table.column("data").to_pylist())
    return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([pack([total])], pa.binary())})


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts of the column `text` hold a shingle of each counter: COUNTERS numbers, whatever the number of texts."""
    added = texts.select("text").mapInArrow(_counted, "slice int, data binary").groupBy("slice").applyInArrow(_added, "slice int, data binary")
    found = {r["slice"]: unpack(bytes(r["data"]))[0][0] for r in added.collect()}
    return np.concatenate([found[i] for i in range(SLICES)]).astype(np.uint32) if found else np.zeros(COUNTERS, np.uint32)


def prefix(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rarest counters first: sets at the similarity share one of these."""
    order = np.lexsort((found, counts[_counter(found)]))
    return found[order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]] if len(found) else found


def _lists(found: list[np.ndarray]) -> pa.Array:
    """A list column from arrays, without a Python object per number."""
    ends = np.cumsum([0, *map(len, found)])
    whole = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole))


def _prefixes(counts, similarity: float):
    """Per text its mark of equality, its SimHash, the size of its set and its prefix."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, prints, sizes, keys = [], [], [], []
            for text in text_bytes(batch.column(2)):
                same.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                prints.append(fingerprint(text))
                whole = shingles(text)
                sizes.append(len(whole))
                keys.append(prefix(whole, counts.value, similarity))
            arrays = [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(prints, "<u8").view("<i8"), pa.int64()),
                      pa.array(sizes, pa.int32()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", "ref", "same", "fp", "size", "keys"])

    return found


def sketch(found: np.ndarray) -> np.ndarray:
    """FUNCTIONS minima of a set that isn't empty, 4 bits each, as unsigned 64-bit numbers."""
    bits = (minima(found) >> np.uint64(40) & np.uint64(15)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).view("<u8")


def parities(found: np.ndarray) -> np.ndarray:
    """For each of PARITIES bits whether the set holds an odd number of its shingles, as unsigned 64-bit numbers."""
    odd = np.bincount((found & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in text_bytes(batch.column(1))]
        sketches = [sketch(f) if len(f) else np.zeros(FUNCTIONS // 16, np.uint64) for f in found]
        arrays = [batch.column(0), pa.array([len(f) for f in found], pa.int32()), _lists(sketches), _lists([parities(f) for f in found]), _lists(found)]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "size", "sketch", "parities", "shingles"])


def _least_agreeing(similarity: float) -> float:
    """How many minima of a pair at the similarity agree at least, but for DEVIATIONS."""
    agree = similarity + (1 - similarity) / 16
    return FUNCTIONS * agree - DEVIATIONS * math.sqrt(FUNCTIONS * agree * (1 - agree))


def _may_be_near(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and parities let a pair reach the similarity; true of every pair that does."""
    differing = F.lit(0)
    for i in range(PARITIES // 64):
        differing = differing + F.bit_count(F.col(f"{a}.parities")[i].bitwiseXOR(F.col(f"{b}.parities")[i]))
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.lit(similarity) * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    return sizes & (differing * F.lit(1 + similarity) <= F.lit(1 - similarity) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6)


def _may_be_first(a: str, b: str, similarity: float) -> Column:
    """Whether a shingle `left` shingles before the end of both sets, itself included, may be the first that a near pair shares."""
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    return F.least(f"{a}.left", f"{b}.left") * F.lit(1 + similarity) >= F.lit(similarity) * sizes - 1e-6


def _picked(similarity: float):
    """Of a block of a shingle's members each one's likest member of another component, if the pair may be near."""
    def picked(block: pa.Table) -> pa.Table:
        node, size = block.column("node").to_numpy(), block.column("size").to_numpy().astype(float)
        root, sketches = block.column("root").to_numpy(), pc.list_flatten(block.column("sketch")).to_numpy().view(np.uint64).reshape(len(node), -1)
        differing = np.zeros((len(node), len(node)), np.int32)
        for word in sketches.T:
            x = word[:, None] ^ word
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differing += np.bitwise_count(x & np.uint64(0x1111111111111111))
        alike = (FUNCTIONS - differing >= _least_agreeing(similarity)) & (np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size) - 1e-9)
        differing[~alike | (root[:, None] == root)] = FUNCTIONS + 1
        best = differing.argmin(1)
        least = differing[np.arange(len(node)), best]
        some = least <= FUNCTIONS
        return pa.table({"node": node[some], "other": node[best[some]], "differing": least[some]})

    return picked


def _picks(crowded: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): for each member of crowded shingles (key, node, root, n, size, sketch) the likest one that it meets in the blocks of a turn."""
    block = F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.ceil(F.col("n") / BLOCK)).alias("block")
    blocks = crowded.select("key", block, "node", "root", "size", "sketch").repartition(int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "block")
    found = blocks.groupBy("key", "block").applyInArrow(_picked(similarity), "node long, other long, differing int")
    best = found.groupBy("node").agg(F.min(F.struct("differing", "other")).alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").filter(shared >= F.lit(similarity) * (F.size("_a") + F.size("_b") - shared) - 1e-9).select("a", "b")


def _row_keys(docs: DataFrame) -> DataFrame:
    """docs as (row, at, ref, text): the row's columns, its place in the order of rows, a hash of doc_id and text."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("row", F.coalesce("_id", F.lit(LAST)).alias("at"), F.xxhash64("_id", "text").alias("ref"), "text")


def near_pairs(rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (at, ref, text): all rows (at, ref, same, n); distinct texts (same, node, least), and components (node, root) of near copies.

    node is the ref of the text's first row; n numbers rows as they stand.
    """
    counts = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows))
    found = rows.select("at", "ref", "text").mapInArrow(_prefixes(counts, similarity), "at long, ref long, same binary, fp long, size int, keys array<long>")
    marked = written(found.withColumn("n", F.monotonically_increasing_id()), "overlap")
    first = written(marked.groupBy("same").agg(F.min(F.struct("at", "n", "ref")).alias("least")).withColumn("node", F.col("least.ref")), "overlap-first")
    # a copy that shares the mark of a first text takes part, as a near copy of it
    heads = with_mark(marked.select("ref", "fp", "size", "keys"), F.col("ref"), written(marks(first, F.col("node")), "overlap-marks"), "_head").filter("_head")
    entries = heads.select(F.col("ref").alias("node"), "size", F.posexplode("keys").alias("pos", "key")).select("node", "key", (F.col("size") - F.col("pos")).alias("left"))
    shared = written(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high"), "overlap-shared")
    once = with_mark(entries, F.col("key"), written(marks(shared, F.col("key")), "overlap-marks"), "_shared").filter("_shared").select("node", "key", "left")
    met = written(lookup(once, shared, ["key"]).select("key", "node", "left", "low", "high"), "overlap-met")
    wanted = written(marks(met, F.col("node")), "overlap-marks")
    sets = written(with_mark(rows.select("ref", "text"), F.col("ref"), wanted, "_met").filter("_met").select("ref", "text").mapInArrow(
        _sets, "node long, size int, sketch array<long>, parities array<long>, shingles array<long>").dropDuplicates(["node"]), "overlap-sets")
    sketches, sizes = sets.select("node", "size", "sketch"), sets.select("node", "size", "parities")

    # near fingerprints are held against each other first; equal ones meet their least text
    prints = written(with_mark(heads.select("ref", "fp"), F.col("ref"), wanted, "_met").filter("_met").select(F.col("ref").alias("node"), "fp").distinct(), "overlap-prints")
    firsts = written(prints.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "overlap-firsts")
    a, b = (firsts.select(F.col("fp").alias(x), F.col("head").alias(f"_{x}")) for x in "ab")
    alike = simhash_links(firsts.select("fp")).distinct().join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    alike = alike.union(lookup(prints, firsts, ["fp"]).filter("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")))
    alike = written(_verified(alike, sets, similarity), "overlap-alike")

    led = met.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).union(
        met.filter("node < high").select(F.col("node").alias("a"), F.col("high").alias("b"))).distinct()
    a, b = sizes.alias("a"), sizes.alias("b")
    close = led.alias("p").join(a, F.col("p.a") == F.col("a.node")).join(b, F.col("p.b") == F.col("b.node")).filter(_may_be_near("a", "b", similarity))
    linked = written(_verified(close.select("p.a", "p.b"), sets, similarity).union(alike), "overlap-linked")
    roots = written(components(linked), "overlap-roots")

    def apart(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (key, node, left, root) of all shingles, and the shingles (key, n) that several components hold."""
        labelled = met.join(roots, "node", "left").select("key", "node", "left", F.coalesce("root", "node").alias("root"))
        mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
        return labelled, mixed

    turn, worth = 0, True
    while worth:
        labelled, mixed = apart(roots)
        full = written(mixed.filter(F.col("n") > CROWDED), "overlap-full")
        if full.isEmpty():
            break
        picks = written(_picks(labelled.join(full, "key").join(sketches, "node"), similarity, turn), "overlap-picks")
        near = written(_verified(picks, sets, similarity), "overlap-near")
        found = near.count()
        worth, turn = found > 0 and found >= WORTH * picks.count(), turn + 1
        if found:
            linked = linked.union(near)
            roots = written(components(linked), "overlap-roots")

    labelled, mixed = apart(roots)
    rest = written(labelled.join(mixed, "key", "left_semi").join(sizes, "node"), "overlap-rest")
    a, b = rest.alias("a"), rest.alias("b")
    others = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.node") < F.col("b.node"))
                    & _may_be_first("a", "b", similarity) & _may_be_near("a", "b", similarity)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return marked.drop("keys", "fp", "size"), first, components(linked.union(_verified(written(others, "overlap-others"), sets, similarity)))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least doc_id, null ones last, then the one that stands first.

    A group is what links of at least the similarity reach. Texts that are equal but for white space and the case of A-Z are copies;
    null and empty texts are copies of each other. Rows that are equal in doc_id and text stand for each other. An empty table gives no
    rows. Only rows that share a mark with one that goes are shuffled.
    """
    prepare(docs.sparkSession)
    rows = _row_keys(docs)
    marked, first, members = near_pairs(rows, similarity)
    chosen = first.join(members, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least")).select("least.at", "least.ref")
    chosen = written(chosen, "overlap-chosen")
    ids = marked.groupBy("at", "ref").agg(F.count("*").alias("n"))
    stay = ids.join(chosen.withColumn("_stays", F.lit(True)), ["at", "ref"], "left")
    touched = written(stay.filter("_stays is null or n > 1").select("at", "ref", F.col("_stays").isNotNull().alias("_stays")), "overlap-touched")
    asked = with_mark(rows.select("row", "at", "ref"), F.col("ref"), written(marks(touched, F.col("ref")), "overlap-marks"), "_touched")
    told = asked.filter("_touched").join(touched, ["at", "ref"], "left").filter(F.coalesce("_stays", F.lit(True)))
    once = told.filter("_stays is null").select("row").union(told.filter("_stays").groupBy("at", "ref").agg(F.first("row").alias("row")).select("row"))
    return asked.filter(~F.col("_touched")).select("row").union(once).select("row.*")
