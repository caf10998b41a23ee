"""Removal of passages that stand earlier in the corpus, by difference-cover anchors.

A window is `window` consecutive words of one document; every word inside a window that also starts earlier goes. Order is
by doc_id (null last), then start.

Anchors are runs of words at the positions p of a document with p mod PERIOD in a difference cover: a set whose differences
give every remainder. Whatever the two starts of a repeated window, some anchor inside lies at a cover position of both.
So only 4 of 13 positions are hashed and compared, and a window without a repeated anchor needs no further look. The others
extend to hashes of the whole window (112 bits), and the least (doc_id, start) of each hash stays.

Copies of a whole text are found first: one of them takes part, the others go whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .common import cut_lineage, prepare, text_bytes, text_or_empty
from .skew import lookup, marks, with_mark

WINDOW = 20
#: Longest period of a cover; its cover is found by trying all sets.
LONGEST_PERIOD = 21
SEED = 44
#: Anchors or windows that a task holds to merge equal ones before they are shuffled.
HELD = 1 << 20
#: Anchors or windows of a bucket, which a task compares at once; windows to expect for a repeated anchor, bytes of a word: these set the number of buckets.
BUCKET = 1 << 20
WINDOWS_EACH = 4
WORD_BYTES = 6
#: Bits that anchors and the second hash of windows do without: anchors have 48, windows 64 + 48.
DROPPED_BITS = 16
#: Order of documents without an id: after all others.
LAST = (1 << 63) - 1


def difference_cover(period: int) -> list[int]:
    """A smallest set of remainders whose differences give all remainders of the period."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return [0]


@cache
def plan_of(window: int) -> tuple[int, list[int], int]:
    """Period, cover and words of an anchor for a window: an anchor at any of the first `period` words ends inside."""
    period = max(1, min(2 * window // 3, LONGEST_PERIOD))
    return period, difference_cover(period), window - period + 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))


@cache
def _factors(number: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, number]).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, n: int, number: int) -> np.ndarray:
    """Hash of the n words from each start: a sum with random factors, one set of factors a number."""
    found = np.zeros(len(starts), np.uint64)
    for k, factor in enumerate(_factors(number, n)):
        found += hashes[starts + k] * factor
    return found


def anchor_places(n_words: int, window: int) -> np.ndarray:
    period, cover, length = plan_of(window)
    places = (np.arange(0, n_words + period, period)[:, None] + np.array(cover)).ravel()
    return places[places + length <= n_words] if n_words >= window else np.zeros(0, np.int64)


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    begins = np.ones(len(sorted_keys[0]), bool)
    begins[1:] = False
    for key in sorted_keys:
        begins[1:] |= key[1:] != key[:-1]
    return begins


def _runs(sorted_key: np.ndarray) -> Iterator[tuple[int, int]]:
    begins = np.flatnonzero(_heads(sorted_key)).tolist() if len(sorted_key) else []
    return zip(begins, [*begins[1:], len(sorted_key)], strict=True)


def _dealt(buckets: int, docs: list[np.ndarray], keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Held rows in order of their first key, dealt to buckets by ranges of it, each bucket's rows packed with their documents.

    Rows that are known to be repeated need not meet others: they are dealt evenly, so a hot key fills no bucket.
    """
    ranged = ((keys[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    bucket = np.where(known, (doc + place) % buckets, ranged)
    order = np.lexsort((known, bucket))
    out: dict[str, list] = {"bucket": [], "rows": [], "data": []}
    for a, b in _runs(bucket[order]):
        inside = order[a:b]
        met, told = inside[~known[inside]], inside[known[inside]]
        used, number = np.unique(doc[np.concatenate([met, told])], return_inverse=True)
        columns = [*(k[met] for k in keys), number, place[met], place[told], *(c[used].view(np.uint64) for c in docs)]
        out["bucket"].append(int(bucket[inside[0]]))
        out["rows"].append(b - a)
        out["data"].append(pack(columns))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int64()), "rows": pa.array(out["rows"], pa.int64()), "data": pa.array(out["data"], pa.binary())})


def _gathered(data: list[bytes], n_keys: int, n_docs: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of a bucket: keys, documents' columns, places, and whether they are known (those come without keys: 0)."""
    keys, docs, places, known = [[] for _ in range(n_keys)], [[] for _ in range(n_docs)], [], []
    for blob in data:
        columns = unpack(blob)[0]
        number, met, told = (c.astype(np.int64) for c in columns[n_keys : n_keys + 3])
        for k in range(n_keys):
            keys[k].append(np.append(columns[k], np.zeros(len(told), np.uint64)))
        for k in range(n_docs):
            docs[k].append(columns[n_keys + 3 + k].view(np.int64)[number])
        places.append(np.append(met, told))
        known.append(np.append(np.zeros(len(met), bool), np.ones(len(told), bool)))
    return [np.concatenate(k) for k in keys], [np.concatenate(d) for d in docs], np.concatenate(places), np.concatenate(known)


def _sent_home(buckets: int, docs: list[np.ndarray], places: np.ndarray) -> pa.Table:
    """(bucket, data): places with their documents, packed by ranges of the documents' hashes."""
    home = ((docs[-1].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((places, *docs[::-1], home))
    out: dict[str, list] = {"bucket": [], "data": []}
    for a, b in _runs(home[order]):
        inside = order[a:b]
        begins = _heads(*(d[inside] for d in docs))
        out["bucket"].append(int(home[inside[0]]))
        out["data"].append(pack([np.cumsum(begins) - 1, places[inside], *(d[inside][begins].view(np.uint64) for d in docs)]))
    return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "data": pa.array(out["data"], pa.binary())})


def _by_document(names: list[str]):
    """One row a document, with its places; all of a document's come home to one bucket."""
    def found(table: pa.Table) -> pa.Table:
        parts = [unpack(b)[0] for b in table.column("data").to_pylist()]
        places = np.concatenate([p[1] for p in parts]).view(np.int64)
        docs = [np.concatenate([p[2 + k][p[0].astype(np.int64)] for p in parts]).view(np.int64) for k in range(len(names))]
        order = np.lexsort((places, *docs[::-1]))
        docs, places = [d[order] for d in docs], places[order]
        begins = np.flatnonzero(_heads(*docs))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(places)), pa.int32()), pa.array(places, pa.int64()))
        return pa.table([*(pa.array(d[begins], pa.int64()) for d in docs), lists], names=[*names, "places"])

    return found


def _anchors(window: int, buckets: int):
    length = plan_of(window)[2]

    def merged(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """One row per held hash meets others; further rows of a hash are known to repeat, and so is the first."""
        if held:
            refs = np.array([h[0] for h in held], np.int64)
            doc = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
            key, place = np.concatenate([h[1] for h in held]) >> np.uint64(DROPPED_BITS), np.concatenate([h[2] for h in held])
            key <<= np.uint64(DROPPED_BITS)
            order = np.argsort(key, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            begins = _heads(key)
            group = np.cumsum(begins) - 1
            repeated = np.bincount(group)[group] > 1
            # the first row of a repeated hash goes both ways: it tells others and is known itself
            twice = np.flatnonzero(begins & repeated)
            known = np.append(~begins, np.ones(len(twice), bool))
            key, doc, place = (np.append(c, c[twice]) for c in (key, doc, place))
            yield from _dealt(buckets, [refs], [key], doc, place, known)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for ref, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                places = anchor_places(len(words), window)
                held.append((ref, run_hashes(word_hashes(words), places, length, 0), places))
                n += len(places)
                if n >= HELD:
                    yield from merged(held)
                    held, n = [], 0
        yield from merged(held)

    return found


def _met_anchors(buckets: int):
    """Places of a bucket's anchors that occur more than once."""
    def found(table: pa.Table) -> pa.Table:
        (key,), (ref,), place, known = _gathered(table.column("data").to_pylist(), 1, 1)
        asked = np.flatnonzero(~known)
        order = asked[np.argsort(key[asked], kind="stable")]
        group = np.cumsum(_heads(key[order])) - 1 if len(order) else np.zeros(0, np.int64)
        repeated = np.append(order[np.bincount(group)[group] > 1] if len(order) else order, np.flatnonzero(known))
        return _sent_home(buckets, [ref[repeated]], place[repeated])

    return found


def candidate_starts(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at `places`."""
    period = plan_of(window)[0]
    change = np.zeros(n_words + 2, np.int64)
    np.add.at(change, np.maximum(places - period + 1, 0), 1)
    np.add.at(change, places + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: max(0, n_words - window + 1)] > 0)


def _windows(window: int, buckets: int):
    def merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The first held row of each window meets others; later ones are known to go."""
        if held:
            at, ref = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            key, check, start = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            order = np.lexsort((start, ref[doc], at[doc], check, key))
            key, check, doc, start = key[order], check[order], doc[order], start[order]
            begins = _heads(key, check)
            first = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(key) else np.zeros(0, np.int64)
            known = ~((at[doc] == at[doc[first]]) & (ref[doc] == ref[doc[first]]) & (start == start[first]))
            sent = begins | known
            yield from _dealt(buckets, [at, ref], [key[sent], check[sent]], doc[sent], start[sent], known[sent])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at, ref, places = (batch.column(i).to_pylist() for i in range(3))
            for a, r, p, text in zip(at, ref, places, text_bytes(batch.column(3)), strict=True):
                words = text.split()
                # a document of another text under the same hash of id and text would only add candidates
                repeated = np.array([x for x in p if x < len(words)], np.int64)
                starts = candidate_starts(len(words), repeated, window)
                hashes = word_hashes(words)
                check = run_hashes(hashes, starts, window, 2) >> np.uint64(DROPPED_BITS)
                held.append((a, r, run_hashes(hashes, starts, window, 1), check, starts))
                n += len(starts)
                if n >= HELD:
                    yield from merged(held)
                    held, n = [], 0
        yield from merged(held)

    return found


def _later_windows(buckets: int):
    """Starts of a bucket's windows that aren't the first of their words."""
    def found(table: pa.Table) -> pa.Table:
        (key, check), (at, ref), start, known = _gathered(table.column("data").to_pylist(), 2, 2)
        asked = np.flatnonzero(~known)
        order = asked[np.lexsort((start[asked], ref[asked], at[asked], check[asked], key[asked]))]
        begins = _heads(key[order], check[order]) if len(order) else np.zeros(0, bool)
        first = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(order) else order
        later = (at[order] != at[first]) | (ref[order] != ref[first]) | (start[order] != start[first])
        gone = np.append(order[later], np.flatnonzero(known))
        return _sent_home(buckets, [at[gone], ref[gone]], start[gone])

    return found


def covered(n_words: int, starts: list[int], window: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    change = np.zeros(n_words + window + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.array(starts, np.int64) + window, -1)
    return np.cumsum(change)[:n_words] > 0


def _kept(window: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, whole = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, s, w in zip(text_bytes(batch.column(1)), starts, whole, strict=True):
                words = text.split()
                n_words.append(len(words))
                if w and len(words) >= window:
                    left = []
                elif s:
                    gone = covered(len(words), s, window)
                    left = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "text"])

    return found


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row: text holds the words that stay, joined by a space.

    Null and empty texts have no words; a text shorter than the window loses none. Rows are documents in the order of doc_id, null
    last, then of a hash of id and text. Rows that are equal in doc_id and text count as one document, given twice: they lose
    the same words and none to each other. A long text is handled by one task, but its windows are shuffled like all others. An
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    text, doc_id = text_or_empty(), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.xxhash64("doc_id", "text").alias("ref"), "text")
    order = F.struct("at", "ref")

    ids = cut_lineage(rows.select("at", "ref", F.unhex(F.md5("text")).alias("same"), F.octet_length("text").alias("bytes")))
    first = cut_lineage(ids.groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    copies = lookup(ids, first.filter("n > 1"), ["same"]).filter(order > F.col("first")).select("at", "ref").distinct()
    heads = cut_lineage(marks(first, F.col("first.ref")))
    # a copy that shares the mark of a first text takes part, and loses its windows to that text
    singles = with_mark(rows, F.col("ref"), heads, "_head").filter("_head")

    packed = "bucket long, rows long, data binary"
    held = ids.agg(F.sum("bytes")).first()[0] or 0
    buckets = 1 + int(held / WORD_BYTES * len(plan_of(window)[1]) / plan_of(window)[0] / BUCKET)
    anchors = singles.select("ref", "text").mapInArrow(_anchors(window, buckets), packed)
    met = anchors.groupBy("bucket").applyInArrow(_met_anchors(buckets), "bucket long, data binary")
    places = cut_lineage(met.groupBy("bucket").applyInArrow(_by_document(["ref"]), "ref long, places array<long>"))
    buckets = 1 + (places.agg(F.sum(F.size("places"))).first()[0] or 0) * WINDOWS_EACH // BUCKET
    asked = with_mark(singles, F.col("ref"), cut_lineage(marks(places, F.col("ref"))), "_asked").filter("_asked")
    windows = asked.select("at", "ref", "text").join(places, "ref").select("at", "ref", "places", "text").mapInArrow(_windows(window, buckets), packed)
    later = windows.groupBy("bucket").applyInArrow(_later_windows(buckets), "bucket long, data binary")
    starts = later.groupBy("bucket").applyInArrow(_by_document(["at", "ref"]), "at long, ref long, places array<long>")
    gone = cut_lineage(
        starts.withColumnRenamed("places", "starts").withColumn("whole", F.lit(False))
        .unionByName(copies.withColumns({"starts": F.lit(None).cast("array<long>"), "whole": F.lit(True)}))
        .groupBy("at", "ref").agg(F.max("starts").alias("starts"), F.max("whole").alias("whole")))
    losing = with_mark(rows, F.col("ref"), cut_lineage(marks(gone, F.col("ref"))), "_loses")
    none = {"starts": F.lit(None).cast("array<long>"), "whole": F.lit(False)}
    told = losing.filter("_loses").join(gone, ["at", "ref"], "left").select("doc_id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    rest = losing.filter(~F.col("_loses")).withColumns(none).select("doc_id", "text", "starts", "whole")
    return told.unionByName(rest).mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, text string")
