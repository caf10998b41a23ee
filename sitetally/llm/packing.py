"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

Only how many pieces have each length matters, so the packing is made on a histogram of at most `capacity` lengths: sets of
lengths that provably dominate are fixed first (as often as their counts allow), the rest goes best-fit in descending
length. The plan says, for each length, which bin and offset its n-th piece takes; numbering the pieces of a length and
looking the plan up is the only work on rows.

Dominance, for the longest open piece j and a capacity c (a set of pieces beside j dominates every other choice of
company for j if each other choice fits into pieces of the set, one by one):
* nothing fits beside j: j alone;
* a piece fills c - j exactly: j with it;
* no two pieces fit beside j: j with the longest that fits;
* no three fit beside j, and no two that fit are longer together than the longest one that fits: j with that one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes, written
from .ranks import number_within
from .tokens import END_ID, encoder

CAPACITY = 4096


class _Plan:
    """Runs (length, first rank, ranks, first bin, pieces per bin, offset): ranks of a length, dealt to bins in order."""

    def __init__(self):
        self.runs, self.ranks, self.bins = [], {}, 0

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def put(self, length: int, first_bin: int, bins: int, each: int, offset: int) -> None:
        first = self.ranks.get(length, 0)
        self.runs.append((length, first, bins * each, first_bin, each, offset))
        self.ranks[length] = first + bins * each


def reduce_by_dominance(counts: dict[int, int], capacity: int, plan: _Plan) -> dict[int, int]:
    """Fix dominating sets of one or two pieces into bins of the plan; the counts that are left."""
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.pop(bisect_left(lengths, length))

    def least(n: int, but: int) -> list[int]:
        """The n shortest pieces beside one piece of length `but`; fewer if there are no more."""
        out = []
        for k in lengths:
            out += [k] * min(n - len(out), left[k] - (k == but))
            if len(out) == n:
                break
        return out

    def longest_fit(room: int, but: int) -> int | None:
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and left[lengths[at]] - (lengths[at] == but) < 1:
            at -= 1
        return lengths[at] if at >= 0 else None

    def longest_pair(room: int, but: int) -> int:
        """Sum of the longest two pieces that fit into room together."""
        best = 0
        for k in lengths:
            rest = room - k
            if rest < k:
                break
            at = bisect_left(lengths, rest + 1) - 1
            while at >= 0 and lengths[at] >= k and left[lengths[at]] - (lengths[at] == but) - (lengths[at] == k) < 1:
                at -= 1
            if at >= 0 and lengths[at] >= k and left[k] - (k == but) >= 1:
                best = max(best, k + lengths[at])
        return best

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            mate = longest_fit(room, j)
            if mate is None:
                n = 1 if room >= j else left[j]
                plan.put(j, plan.open(n), n, 1, 0)
                take(j, n)
                continue
            few = least(3, j)
            if not (mate == room or sum(few[:2]) > room or len(few) < 2 or ((len(few) < 3 or sum(few) > room) and longest_pair(room, j) <= mate)):
                break
            n = left[j] // 2 if mate == j else min(left[j], left[mate])
            if mate != room and mate in few:
                n = 1  # the shortest pieces change with each set: look again
            first = plan.open(n)
            if mate == j:
                plan.put(j, first, n, 2, 0)
                take(j, 2 * n)
            else:
                plan.put(j, first, n, 1, 0)
                plan.put(mate, first, n, 1, j)
                take(j, n)
                take(mate, n)
    return left


def best_fit(counts: dict[int, int], capacity: int, plan: _Plan) -> None:
    """Best fit in descending length; bins of one filling stand in one group (first bin, bins)."""
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def keep(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, bins))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                bins, rest = divmod(n, each)
                first = plan.open(bins + bool(rest))
                if bins:
                    plan.put(length, first, bins, each, 0)
                    keep(capacity - each * length, first, bins)
                if rest:
                    plan.put(length, first + bins, 1, rest, 0)
                    keep(capacity - rest * length, first + bins, 1)
                break
            room = rooms[at]
            first, bins = groups[room].pop()
            # the fullest bin stays the best fit while the length still fits into it
            each = room // length
            used, rest = divmod(n, each)
            used = min(bins, used)
            if used:
                plan.put(length, first, used, each, capacity - room)
                keep(room - each * length, first, used)
                n -= used * each
            if used < bins and n and n < each:
                plan.put(length, first + used, 1, n, capacity - room)
                keep(room - n * length, first + used, 1)
                used, n = used + 1, 0
            if used < bins:
                groups[room].append((first + used, bins - used))
            if not groups[room]:
                del groups[room]
                rooms.remove(room)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> _Plan:
    plan = _Plan()
    best_fit(reduce_by_dominance(counts, capacity, plan), capacity, plan)
    return plan


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            doc_ids, which, starts, sizes, sums = [], [], [], [], []
            for doc_id, found in zip(batch.column(0).to_pylist(), words.encode(text_bytes(batch.column(1))), strict=True):
                ids = np.frombuffer(found + end, words.dtype).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    doc_ids.append(doc_id)
                    which.append(piece)
                    starts.append(at)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(which, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placed(runs: list[tuple], capacity: int):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    span = int((table[:, 1] + table[:, 2]).max()) if len(table) else 1
    keys = table[:, 0] * span + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            found = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - found[:, 1]
            bins, place = found[:, 3] + nth // found[:, 4], found[:, 5] + nth % found[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(place)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_bins(counts, capacity)
    numbered = number_within(pieces, ["length"], F.xxhash64("doc_id", "start"), ["doc_id", "start", "ids_crc32"], "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(_placed(plan.runs, capacity), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document longer than the capacity is cut into pieces of that length, the last may be shorter; others are one
    piece. A null or empty text is a piece of one token. Repeated rows and ids are packed each for itself. An empty table
    gives no rows. The driver holds the counts of lengths and the plan, both bounded by the capacity, not by the rows.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pack_pieces(written(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "pieces"), capacity)
