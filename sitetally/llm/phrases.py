"""Phrases whose words stand together more often than their parts predict, counted by weighted acyclic automata.

Each task sorts the n-grams of a shard of its documents and builds count automata, one per language and prefix range. Every
position gives one path, its word and up to two more of its piece, so a single automaton holds the counts of all shorter phrases
as sums over prefixes. Single words, which would need all ranges, have automata of their own. The automata of a range are united and their weights added; candidates leave a range with the
weights of their prefixes. The parts of a candidate are looked up by composing candidates with the counts of their first and last
words: a join on the words that both share, hot words apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import DEPTH, CountAutomaton, summed
from .common import cut_lineage, prepare, text_bytes, text_or_empty, written
from .skew import lookup

MIN_COUNT = 10
TOP = 2000
#: A phrase goes if one that holds it occurs at least this often in a hundred of its own occurrences.
COVERED_PERCENT = 50
#: Positions of a shard, and n-grams of a range: what a task holds at once.
SHARD = 1 << 21
RANGE = 1 << 21
#: Crowded ranges whose list goes to all tasks; with more of them Spark shuffles both sides.
BROADCAST_RANGES = 50_000
#: A range is crowded from this many times RANGE on.
CROWDED = 4
SEED = 45
#: Bytes a word takes at least on average, with its separator: only sets the number of ranges.
WORD_BYTES = 6

_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with the end mark between pieces."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def paths(sequence: np.ndarray) -> np.ndarray:
    """One path a position of a sequence of word numbers (0: end of a piece): the word and the next ones of its piece."""
    padded = np.append(sequence, np.zeros(DEPTH - 1, sequence.dtype))
    grams = np.stack([padded[k : k + len(sequence)] for k in range(DEPTH)], axis=1)
    for k in range(1, DEPTH):
        grams[grams[:, k - 1] == 0, k] = 0
    return grams[grams[:, 0] > 0]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def prefix_ranges(hashes: np.ndarray, grams: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each path: that of the hash of its first two words."""
    mixed = hashes[grams[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + hashes[grams[:, 1]]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cut(automaton: CountAutomaton, place: np.ndarray) -> Iterator[tuple[int, CountAutomaton]]:
    """An automaton cut by a number of each path."""
    order = np.argsort(place, kind="stable")
    begins = np.flatnonzero(np.diff(place[order], prepend=-1)).tolist() if len(order) else []
    for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
        inside = order[a:b]
        yield int(place[inside[0]]), CountAutomaton.of(automaton.words, automaton.grams[inside], automaton.counts[inside])


def _shards(ranges: int, shard: int):
    def flush(langs: dict[str, tuple[_Numbers, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang in list(langs):
            numbers, held = langs.pop(lang)
            words, sequence = [b"" if w == _END else w for w in numbers], np.concatenate(held)
            del held
            counts = np.bincount(sequence, minlength=len(words))
            counts[0] = 0
            single = np.zeros((int((counts > 0).sum()), DEPTH), np.int32)
            single[:, 0] = np.flatnonzero(counts)
            grams = paths(sequence)
            hashes, cut = _word_hashes(words), []
            for kind, whole in ((1, CountAutomaton(words, single, counts[counts > 0])), (DEPTH, CountAutomaton(words, *summed(grams, np.ones(len(grams), np.int64))))):
                cut += [(kind, r, x) for r, x in _cut(whole, prefix_ranges(hashes, whole.grams, ranges))]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(cut), pa.string()), "kind": pa.array([k for k, _, _ in cut], pa.int32()), "range": pa.array([r for _, r, _ in cut], pa.int64()),
                "paths": pa.array([len(x.grams) for _, _, x in cut], pa.int64()), "automaton": pa.array([x.to_bytes() for _, _, x in cut], pa.binary())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if lang not in langs:
                    langs[lang] = _Numbers({_END: 0}), []
                numbers, held = langs[lang]
                held.append(np.array([*map(numbers.__getitem__, tokens(text)), 0], np.int32))
                n += len(held[-1])
                if n >= shard:
                    yield from flush(langs)
                    langs, n = {}, 0
        yield from flush(langs)

    return found


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Automata of a crowded range, cut further by their last words."""
    for batch in batches:
        for lang, where, parts, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            whole = CountAutomaton.from_bytes(data)
            last = _word_hashes(whole.words)[whole.grams[:, DEPTH - 1]] >> np.uint64(8)
            cut = list(_cut(whole, (last % np.uint64(parts)).astype(np.int64)))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(cut), pa.string()), "range": pa.array([where] * len(cut), pa.int64()),
                "part": pa.array([p for p, _ in cut], pa.int64()), "automaton": pa.array([x.to_bytes() for _, x in cut], pa.binary())})


def _united(min_count: int):
    def found(table: pa.Table) -> pa.Table:
        """Counts of a range: words, or phrases of two words and more, from min_count on; of a crowded range pairs as they are.

        The count of all words of a range of words comes as size 0.
        """
        whole = CountAutomaton.union([CountAutomaton.from_bytes(b) for b in table.column("automaton").to_pylist()])
        crowded, words = table.column("part")[0].as_py() >= 0, table.column("kind")[0].as_py() == 1
        sizes, phrases, counts = ([0], [""], [int(whole.counts.sum())]) if words else ([], [], [])
        for size in (1,) if words else range(2, DEPTH + 1):
            prefixes, weights = whole.prefixes(size)
            frequent = weights >= (1 if crowded and size < DEPTH else min_count)
            prefixes, weights = prefixes[frequent], weights[frequent]
            phrases += [b" ".join([whole.words[i] for i in p]).decode() for p in prefixes.tolist()]
            counts += weights.tolist()
            sizes += [size] * len(weights)
        lang = [table.column("lang")[0].as_py()] * len(sizes)
        return pa.table({"lang": pa.array(lang, pa.string()), "size": pa.array(sizes, pa.int32()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(counts, pa.int64())})

    return found


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, shard: int = SHARD, range_paths: int = RANGE) -> DataFrame:
    """(lang, size, phrase, f): counts of words and of phrases of 2 to DEPTH words that occur min_count times or more; size 0: of all words.

    A range that holds far more paths than the others (a hot pair of words) is cut by its last words.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, round(held / WORD_BYTES / range_paths))
    automata = written(rows.mapInArrow(_shards(ranges, shard), "lang string, kind int, range long, paths long, automaton binary"), "automata")
    sizes = automata.filter(F.col("kind") > 1).groupBy("lang", "kind", "range").agg(F.sum("paths").alias("paths")).filter(F.col("paths") > CROWDED * range_paths)
    crowded = cut_lineage(sizes.select("lang", "kind", "range", F.ceil(F.col("paths") / range_paths).cast("long").alias("parts")))
    key = ["lang", "kind", "range"]
    if crowded.count() <= BROADCAST_RANGES:  # a few numbers a range
        crowded = F.broadcast(crowded)
    whole = automata.join(crowded, key, "left_anti").select(*key, F.lit(-1).cast("long").alias("part"), "automaton")
    parts = automata.join(crowded, key).select("lang", "range", "parts", "automaton").mapInArrow(
        _split, "lang string, range long, part long, automaton binary").select("lang", F.lit(DEPTH).alias("kind"), "range", "part", "automaton")
    counted = whole.unionByName(parts).groupBy(*key, "part").applyInArrow(_united(min_count), "lang string, size int, phrase string, f long")
    summed_up = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return written(summed_up.filter((F.col("size") == 0) | (F.col("f") >= min_count)), "phrases")


def compose(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates (lang, size, phrase, f) with the counts l and r of both parts of each cut k."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.array_join(F.slice(F.split("phrase", " "), 1, F.col("k")), " ")
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("size")), " ")
    cuts = cut_lineage(cuts.withColumns({"first": first, "rest": rest}))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("weight"))
    for part, name in (("first", "l"), ("rest", "r")):
        asked = cuts.groupBy("lang", F.col(part).alias("part")).agg(F.count("*").alias("n"))
        found = cut_lineage(asked.join(known, ["lang", "part"]))
        cuts = lookup(cuts.withColumn("part", F.col(part)), found, ["lang", "part"]).withColumnRenamed("weight", name).drop("part", "n")
    return cuts


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered_percent: int = COVERED_PERCENT, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    score is floor(1000000 * a * a / (l * r)) of the cut with the lowest score, exact in 38 digits. Ties between phrases go by a, then by the
    bytes of the phrase; phrases are distinct, so ranks are too. Null texts are empty, a null language is `und`; a language without
    a candidate gives no rows, nor does an empty table. Repeated rows count as often as they come; other columns are not read.
    """
    counts = phrase_counts(docs, min_count, **sizes)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    frequent = counts.filter("size > 0")
    candidates = frequent.filter("size > 1")
    words = F.split("phrase", " ")
    longer = candidates.filter("size = 3").select("lang", F.explode(F.array(*(F.array_join(F.slice(words, i, 2), " ") for i in (1, 2)))).alias("phrase"), F.col("f").alias("_longer"))
    covering = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    left = candidates.join(covering, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered_percent * F.col("f"))).drop("_longer")
    whole = "cast({} as decimal(38,0))"
    score = F.expr(f"cast(1000000 as decimal(38,0)) * {whole.format('f')} * {whole.format('f')} div ({whole.format('l')} * {whole.format('r')})")
    cuts = compose(left, frequent).withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
