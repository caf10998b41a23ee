"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints at 2 or fewer differing bits differ by at most one bit in
the first segment, or not at all in the second. So every distinct fingerprint probes a table of segments with the Hamming
ball of that radius around its own segment (33 + 1 keys), and each match is verified on all 64 bits.

A segment value that many distinct fingerprints share is split further: within it the other segment has few differing
bits, so one of its `radius + 1` parts is equal, and that part joins the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, text_bytes, written
from .graph import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints on one segment value from which on the value is split by parts of the other segment.
CROWDED = 256
#: Shingles voted on at once: bounds memory on very long texts.
VOTES = 1 << 16


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, cut at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < words_each:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - words_each + 1], ends[words_each - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), VOTES):
        spans = zip(starts[at : at + VOTES].tolist(), ends[at : at + VOTES].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[batch.schema.names[0], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def segment_radii(radius: int) -> list[int]:
    """Ball radius of each of the two segments; -1: that segment needs no probe."""
    share, rest = divmod(radius, 2)
    return [share, share if rest else share - 1]


def ball(bits: int, radius: int) -> list[int]:
    """Masks of the Hamming ball: every choice of at most `radius` of `bits` bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _segment(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if number == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _parts(fp: Column, number: int, radius: int) -> Column:
    """The radius + 1 parts of the segment other than `number`, each tagged with its place."""
    cuts = [round(i * 32 / (radius + 1)) for i in range(radius + 2)]
    other = _segment(fp, 1 - number)
    return F.array(*(
        F.shiftright(other, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit((i + 1) << 32) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ))


def _keyed(fps: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(fp, segment, key): one row per segment and mask; the key holds the segment's number above its 32 bits."""
    fp = F.col("fp")
    keys = [F.struct(F.lit(s).alias("segment"), (_segment(fp, s).bitwiseXOR(F.lit(m)) + F.lit(s << 32)).alias("key")) for s in (0, 1) for m in masks[s]]
    return fps.select("fp", F.inline(F.array(*keys)))


def links(fps: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints of column fp at `radius` or fewer differing bits; a pair may come twice."""
    radii = segment_radii(radius)
    stored = _keyed(fps, [[0] if r >= 0 else [] for r in radii])
    probes = _keyed(fps, [ball(32, r) for r in radii])
    full = stored.groupBy("key").count().filter(F.col("count") > crowded).select("key", F.lit(True).alias("full"))

    def split(rows: DataFrame) -> DataFrame:
        parts = F.when(F.col("segment") == 0, _parts(F.col("fp"), 0, radius)).otherwise(_parts(F.col("fp"), 1, radius))
        rows = rows.join(full, "key", "left")
        return rows.select("fp", "key", F.explode(F.when(F.col("full"), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))

    a, b = split(probes).alias("a"), split(stored).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")) & near
    return a.join(b, met).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the least doc_id that links reach.

    Equal fingerprints (all copies) are merged before any link is searched, so a group of copies counts as one.
    Rows without words share the fingerprint 0 and link like others. A repeated doc_id gives repeated rows; a null doc_id
    never is a component_id unless nothing else is in the component. Empty table: no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    marked = written(fingerprints(docs), "simhash")
    first = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    members = cut_lineage(components(links(first.select("fp"), radius)))
    least = (
        members.join(first, members["node"] == first["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
        .join(members, "root").select(F.col("node").alias("fp"), "component_id")
    )
    label = first.join(least, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """A written table (id, row): each row of docs with a struct of its doc_id and a number of its own."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id")).alias("id")
    return written(docs.select(key, whole), name)


def least_row() -> Column:
    """Aggregate: the id that stands first, by doc_id with nulls last, then by the row's number."""
    return F.min(F.struct(F.col("id.doc_id").isNull().alias("unnamed"), F.col("id.doc_id").alias("doc_id"), F.col("id.row_id").alias("row_id")))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, null ones last.

    Components choose among rows, not ids: rows without a doc_id and rows that share one are dropped only for a row of their own component.
    """
    prepare(docs.sparkSession)
    rows = numbered(docs, "simhash-rows")
    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.select("id", F.col("row.text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, f"id {kind}, fp long")
    first = cut_lineage(marked.groupBy("fp").agg(least_row().alias("least")))
    members = cut_lineage(components(links(first.select("fp"), radius)))
    rooted = first.join(members, first["fp"] == members["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_id").alias("_chosen"))
    return rows.join(chosen, F.col("id.row_id") == F.col("_chosen"), "left_semi").select("row.*")
