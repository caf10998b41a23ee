"""Quality rules with thresholds that follow the data.

Base rules are fixed by the caller's contract (too few words, too much repetition). Beyond them, three shares of a text are
held against fences that each (language, source) sets for itself: a quantile sketch per group gives the quartiles, and
a document stands out if it lies FENCE times the quartile distance, plus a slack, outside of them.

Junk must not set the fence that is to catch it. So a quartile counts no farther from the median than the other one (junk on
one side then needs half of the group), and a group whose near quartile lies within the fence of its parent (language, then all
documents) doesn't go beyond that fence: part of it is like the others, so the rest is not just how the source is written.

The sketch counts values by logarithmic bucket (relative error ERROR). It is a table of counts: partial sums merge by
adding, so it is built with map-side combining, and groups with few documents fall back to the merged sketch of their
language, or of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, text_bytes, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Relative error of a sketched quantile.
ERROR = 0.01
#: Documents from which on a group sets its own fences.
GROUP_ROWS = 200
FENCE = 6.0
#: Groups whose fences go to all tasks; rows of a hot source then stay where they are.
BROADCAST_GROUPS = 50_000
#: Metric: share or length, slack beyond the fence, whether low values stand out too.
METRICS = {"symbol_share": (0.05, False), "dup_line_share": (0.5, False), "mean_word": (2.5, True)}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _pairs(ids: np.ndarray, apart: int) -> np.ndarray:
    """Number of each distinct (ids[i], ids[i + apart])."""
    return np.unique(ids[:-apart] * (int(ids.max()) + 1) + ids[apart:], return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of 8 words found twice or more. Windows are compared by numbered halves, so exactly."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    span = 1
    while span < window:
        ids = _pairs(ids, span)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of a text."""
    words = text.split()
    each = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return (
        len(words), int(each[_STARTS_CHAR & ~_IS_SPACE].sum()), int(each[_IS_SYMBOL].sum()),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measure(t) for t in text_bytes(batch.column(1))], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=["row", *MEASURES])


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, MEASURES): row is a struct of the named columns, so no other name can clash with them. Null text: none."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").cast("string").alias("text"))
    found = ", ".join(f"{m} bigint" for m in MEASURES)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_measured, f"row {kind}, {found}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "mean_word": share("word_chars", "n_words")}


_GAMMA = (1 + ERROR) / (1 - ERROR)


def sketch(measured: DataFrame, lang: str = "row.lang", source: str = "row.source") -> DataFrame:
    """(lang, source, metric, bucket, n): the quantile sketch of each group over the documents that pass the base rules.

    Bucket i holds values in (gamma^(i-1), gamma^i]; null is the bucket of 0."""
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in _values().items()))
    rows = measured.filter(~base_failed()).select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.inline(parts))
    bucket = F.when(F.col("value") > 0, F.ceil(F.ln("value") / math.log(_GAMMA)).cast("int"))
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, <metric>_low, <metric>_high) from sketches merged to keys; also <metric>_q1 and _q3, and the fences with mirrored
    quartiles, <metric>_low_near and _high_near."""
    merged = sketched.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*keys, "metric").orderBy(F.col("bucket").asc_nulls_first())
    cumulated = merged.withColumn("upto", F.sum("n").over(ordered)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys, "metric")))
    value = F.coalesce(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1), F.lit(0.0))
    reached = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
    quartiles = cumulated.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), reached(0.25).alias("q1"), reached(0.5).alias("q2"), reached(0.75).alias("q3"))
    at = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    spread = FENCE * (F.col("q3") - F.col("q1"))
    low, high = F.greatest("q1", 2 * F.col("q2") - F.col("q3")), F.least("q3", 2 * F.col("q2") - F.col("q1"))
    columns = []
    for m, (slack, both) in METRICS.items():
        columns += [at(m, F.col("q1")).alias(f"{m}_q1"), at(m, F.col("q3")).alias(f"{m}_q3")]
        columns.append(at(m, high + FENCE * (high - F.col("q1")) + slack).alias(f"{m}_high_near"))
        columns.append((at(m, low - FENCE * (F.col("q3") - low) - slack) if both else F.lit(None).cast("double")).alias(f"{m}_low_near"))
        columns.append(at(m, F.col("q3") + spread + slack).alias(f"{m}_high"))
        columns.append((at(m, F.col("q1") - spread - slack) if both else F.lit(None).cast("double")).alias(f"{m}_low"))
    return quartiles.groupBy(*keys).agg(F.max("rows").alias("rows"), *columns)


def judged(measured: DataFrame, lang: str = "row.lang", source: str = "row.source", group_rows: int = GROUP_ROWS, sketched: DataFrame | None = None) -> DataFrame:
    """measured with base_failed and kept. It is read for the sketch and for the verdicts: pass a written table, or the sketch."""
    sketched = cut_lineage(sketch(measured, lang, source) if sketched is None else sketched)
    bounds = [(m, end) for m in METRICS for end in ("high", "low")]
    whole = fences(sketched, []).first()  # one row
    own = cut_lineage(fences(sketched, ["lang", "source"]))
    needed = ["rows", *(f"{m}_{c}" for m in METRICS for c in ("q1", "q3", "high_near", "low_near"))]
    by_lang = fences(sketched, ["lang"]).select(F.col("lang").alias("_lang"), *(F.col(c).alias(f"_{c}") for c in needed))

    def fence(m: str, end: str, prefix: str, parent: Column) -> Column:
        near = F.col(f"{prefix}{m}_{end}_near")
        like = F.col(f"{prefix}{m}_q1") <= parent if end == "high" else F.col(f"{prefix}{m}_q3") >= parent
        closer = F.least(near, parent) if end == "high" else F.greatest(near, parent)
        return F.when(F.col(f"{prefix}rows") >= group_rows, F.when(like, closer).otherwise(near)).otherwise(parent)

    chosen = own.join(by_lang, own["lang"].eqNullSafe(by_lang["_lang"]), "left").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *(fence(m, end, "", fence(m, end, "_", F.lit(whole[f"{m}_{end}_near"]).cast("double"))).alias(f"_{m}_{end}") for m, end in bounds),
    )
    if own.count() <= BROADCAST_GROUPS:  # a few numbers a group; with more of them Spark shuffles both sides
        chosen = F.broadcast(chosen)
    rows = measured.withColumn("_l", F.col(lang).cast("string")).withColumn("_s", F.col(source).cast("string"))
    rows = rows.join(chosen, F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, value in _values().items():
        for end, kept in (("high", value <= F.col(f"_{m}_high")), ("low", value >= F.col(f"_{m}_low"))):
            inside = inside & F.coalesce(kept, F.lit(True))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & inside).select(*measured.columns, "base_failed", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept) of every row.

    Null and empty texts have no words and fail the base rules. A null language or source is a group like others. Repeated
    rows are judged alike. An empty table gives no rows. Columns other than doc_id, text, lang and source are not read.
    """
    prepare(docs.sparkSession)
    found = written(measures(docs, ["doc_id", "lang", "source"]), "quality")
    return judged(found).select("row.doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns; rows are judged as by `judge`.

    Texts are measured twice, for the sketch and for the verdicts, so that no copy of them has to be written.
    """
    prepare(docs.sparkSession)
    return judged(measures(docs, docs.columns), sketched=sketch(measures(docs, ["lang", "source"]))).filter("kept").select("row.*")
