"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a share of all words in proportion to its weight, at most MAX_REPEATS times the source. Each
document is taken as often as the target allows for all of them; what is left of the target is a budget for one more copy
of some. That budget is fitted on the counts of exact lengths: a systematic sample over all lengths keeps the source's
shape and leaves a gap of a few documents, and a bounded-knapsack dynamic program over the copies left closes it. Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, prepare, written
from .ranks import number_within

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20
#: Words of budget that the dynamic program fits exactly.
WINDOW = 1 << 14


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Target of each source: shares of all words by weight, in code-point order with null last; above `most` times
    its size a source stops there, and the excess is shared again by weight."""
    named = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(named)}
    size, open_, out, rest = dict(named), [n for n, _ in named], {}, float(sum(n for _, n in named))
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if rest * weight[n] / total > most * size[n]]
        if not full:
            return out | {n: rest * weight[n] / total for n in open_}
        for n in full:
            out[n] = float(most * size[n])
        rest -= sum(out[n] for n in full)
        open_ = [n for n in open_ if n not in out]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make up the largest total of at most budget: bounded subset sum on bit sets.

    Counts are cut into powers of two. Bit t of a set says that total t can be reached; the sets before each item lead
    back from the best total.
    """
    items, reached, sets = [], 1, []
    mask = (1 << (budget + 1)) - 1
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, part = min(count, budget // length), 1
        while count > 0:
            n = min(part, count)
            items.append((i, n))
            sets.append(reached)
            reached |= (reached << (length * n)) & mask
            count, part = count - n, 2 * part
            if reached >> budget & 1:
                break
        if reached >> budget & 1:
            break
    total, taken = reached.bit_length() - 1, [0] * len(lengths)
    for (i, n), before in zip(reversed(items), reversed(sets), strict=True):
        if not before >> total & 1:
            taken[i] += n
            total -= n * lengths[i]
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, start: float, window: int = WINDOW) -> np.ndarray:
    """Copies of each length (ascending, above 0) that come to at most budget and as near to it as can be reached.

    start in [0, 1) is where the systematic sample begins.
    """
    total = int((lengths * counts).sum())
    if not total or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    share, taken, ends = (budget - window) / total, np.zeros(len(lengths), np.int64), np.cumsum(counts)
    while share > 0:
        sample = np.diff(np.floor(ends * share + start).astype(np.int64), prepend=0)
        over = int((sample * lengths).sum()) - budget
        if over <= 0:
            taken = sample
            break
        share -= (over + 1) / total
    rest = budget - int((taken * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):  # one length of many documents may leave a wide gap
        n = min(int(counts[i] - taken[i]), max(0, rest - window) // int(lengths[i]))
        taken[i] += n
        rest -= n * int(lengths[i])
    fit = np.flatnonzero((lengths <= rest) & (taken < counts))
    order = fit[np.random.default_rng(int(start * 2**32)).permutation(len(fit))]
    taken[order] += np.array(knapsack(lengths[order].tolist(), (counts - taken)[order].tolist(), rest), np.int64)
    return taken


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group[group["size"] > 0].sort_values("size")
    name, budget = (group["source"].iloc[0], int(group["budget"].iloc[0])) if len(group) else (None, 0)
    start = zlib.crc32(f"{SEED}/{name}".encode()) / 2**32
    group["take"] = fit_budget(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), budget, start)
    return group[["source", "size", "take"]]


def word_count(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _decide(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (row_id, doc_id, source, size; a written table) with source_size, target, copies and taken."""
    spark = rows.sparkSession
    histogram = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = [(r["source"], r["words"]) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()]  # one row per source
    goal, plan = targets(sizes, weights, most), []
    for name, words in sizes:
        whole = min(most, int(goal[name] // words)) if words else 0
        plan.append((name, words, goal[name], whole, round(goal[name] - whole * words) if whole < most else 0))
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, budget long")
    held = F.broadcast(sources)  # one row per source

    def with_source(df: DataFrame) -> DataFrame:
        renamed = held.withColumnRenamed("source", "_source")
        return df.join(renamed, df["source"].eqNullSafe(renamed["_source"])).drop("_source")

    fitted = with_source(histogram).groupBy("source").applyInPandas(_fit_source, "source string, size long, take long").filter("take > 0")
    fitted = fitted.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "take")
    ranked = number_within(rows, ["source", "size"], F.xxhash64(F.lit(SEED), F.col("doc_id")), ["doc_id", "row_id"], "rank")
    joined = ranked.join(fitted, ranked["source"].eqNullSafe(fitted["_source"]) & (ranked["size"] == fitted["_size"]), "left").drop("_source", "_size")
    copies = F.col("whole") + (F.col("rank") < F.coalesce("take", F.lit(0))).cast("int")
    return with_source(joined).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def _rows(docs: DataFrame, *more) -> DataFrame:
    text = F.col("text")
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; taken counts the words of all copies.

    size: words of the text, 0 for null and empty texts, which add nothing to a source however often they are copied. The
    null source stands last and is a source like others. Rows that repeat a doc_id are documents of their own. An empty
    table gives no rows. Other columns are not read. The same rows give the same mix.
    """
    prepare(docs.sparkSession)
    return _decide(written(_rows(docs), "mix-sizes"), weights, most).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """docs as mixed: each row as many times as it is taken, with the columns of docs."""
    prepare(docs.sparkSession)
    rows = written(_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "mix-rows")
    copies = _decide(rows.drop("row"), weights, most).filter("copies > 0").select("row_id", "copies")
    return rows.join(copies, "row_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
