"""Document fingerprints: a Merkle tree over runs of words, paragraphs and sections; DataFrame functions only.

Paragraphs are the \\n-split parts of a text, sections are SECTION_PARAGRAPHS paragraphs in a row. A paragraph's node is the
SHA-256 of its characters, a section's that of its paragraphs' nodes, the root's that of its sections' nodes, so equal roots
mean equal texts. Below a paragraph stand short runs of RUN_WORDS words with 32-bit hashes: they tell how much of a
paragraph is kept. Written out, a fingerprint is `root:sections:runs` in hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

SECTION_PARAGRAPHS = 16
RUN_WORDS = 8
#: Ranges of doc_id at most, rows in a block of neighbours about, and rows per range before there are more.
RANGES, BLOCK_ROWS, RANGE_ROWS = 256, 8192, 1024
#: Blocks whose heads are looked for by a broadcast table.
BROADCAST_BLOCKS = 100_000

_RUNS = f"(?: *+[^ ]++){{1,{RUN_WORDS}}}+(?: ++$)?+| ++"


def leaves(text: Column) -> Column:
    """struct(paragraphs array<string>, runs array<int>): the lowest nodes of a text that isn't null."""
    parts = F.split(text, "\n", -1)
    runs = F.flatten(F.transform(parts, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_RUNS), F.lit(0)), lambda r: F.hash(r))))
    return F.struct(F.transform(parts, lambda p: F.sha2(p, 256)).alias("paragraphs"), runs.alias("runs"))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the tree of a text column as struct `name`. Uses columns _leaves and _sections meanwhile."""
    step = df.withColumn("_leaves", leaves(F.col(text)))
    last = ((F.size("_leaves.paragraphs") - 1) / SECTION_PARAGRAPHS).cast("int")
    sections = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.sha2(F.array_join(F.slice(F.col("_leaves.paragraphs"), i * SECTION_PARAGRAPHS + 1, SECTION_PARAGRAPHS), ""), 256),
    )
    step = step.withColumn("_sections", sections)
    root = F.sha2(F.array_join("_sections", ""), 256)
    made = F.struct(root.alias("root"), F.col("_sections").alias("sections"), F.col("_leaves.paragraphs").alias("paragraphs"), F.col("_leaves.runs").alias("runs"))
    return step.withColumn(name, made).drop("_leaves", "_sections")


def fingerprint(root: Column, sections: Column, runs: Column) -> Column:
    short = F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 8)), "")
    digits = F.array_join(F.transform(runs, lambda r: F.lpad(F.lower(F.hex(r.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    return F.concat_ws(":", root, short, digits)


def likeness(root: Column, runs: Column, other_root: Column, other_runs: Column) -> Column:
    """1 for equal roots, else the Jaccard index of the distinct runs; 0 if neither text has any."""
    union = F.size(F.array_union(runs, other_runs))
    shared = F.size(F.array_intersect(runs, other_runs))
    return F.when(root == other_root, 1.0).when(union == 0, 0.0).otherwise(shared / union)


def differing_branches(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, section, paragraph, change): where two versions of a document (key, text) differ.

    Roots are compared first, then sections, and only the paragraphs of sections that differ. change is changed, added or
    removed. A document on one side only has all its paragraphs added or removed.
    """
    def versions(df: DataFrame, name: str) -> DataFrame:
        return with_tree(df.select(key, text_or_empty().alias("text")), "text", name).select(key, name)

    both = versions(before, "a").join(versions(after, "b"), key, "full")
    both = both.filter(~F.col("a.root").eqNullSafe(F.col("b.root")))
    sections = both.select(key, "a", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.size("a.sections"), F.size("b.sections"), F.lit(1)) - 1)).alias("section"))
    at = lambda side, level, i: F.get(F.col(f"{side}.{level}"), i)
    sections = sections.filter(~at("a", "sections", F.col("section")).eqNullSafe(at("b", "sections", F.col("section"))))
    first = F.col("section") * SECTION_PARAGRAPHS
    rows = sections.select(key, "section", F.explode(F.sequence(first, first + (SECTION_PARAGRAPHS - 1))).alias("paragraph"), "a", "b")
    old, new = at("a", "paragraphs", F.col("paragraph")), at("b", "paragraphs", F.col("paragraph"))
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("changed")
    return rows.filter(~old.eqNullSafe(new)).select(key, "section", "paragraph", change.alias("change"))


def with_next(df: DataFrame, order: str, tie: Column, columns: list[str]) -> DataFrame:
    """df with next_<column>: the columns of the next row in descending order, null order last; after the last row the first.

    Rows are dealt to blocks of neighbours: quantile ranges of the order column, cut into equal widths. Inside a block a
    window looks ahead. The last row of a block takes the head of the following one, from a table of one row per block.
    """
    df = df.withColumn("_tie", tie)
    keys = df.select(order, "_tie")
    n = keys.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    width = max(1, -(-n // (ranges * BLOCK_ROWS)))
    points = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.percentile_approx(order, points or [0.5]).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or [])) if points else []
    lows, highs = [found["low"], *cuts], [*cuts, found["high"]]
    value = F.col(order)
    bound = lambda values: F.array(*(F.lit(v).cast("double") for v in values))
    with_range = F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < value)) if cuts else F.lit(0))
    part = F.lit(0) if width == 1 else F.floor((value - F.get(bound(lows), F.col("_range"))) / (F.get(bound(highs), F.col("_range")) - F.get(bound(lows), F.col("_range")) + 1) * width)
    blocked = df.withColumn("_range", with_range).withColumn("_part", F.when(F.col("_range") < 0, 0).otherwise(F.coalesce(part, F.lit(0))).cast("long"))

    descending = [F.col(order).desc_nulls_last(), F.col("_tie").desc()]
    block = Window.partitionBy("_range", "_part").orderBy(*descending)
    ahead = blocked.select(
        "*", *(F.lead(c).over(block).alias(f"next_{c}") for c in columns),
        (F.lead(F.lit(1)).over(block)).isNull().alias("_ends"),
    )
    first = F.max(F.struct(F.col(order), F.col("_tie")))
    blocks = blocked.select("_range", "_part", order, "_tie").groupBy("_range", "_part").agg(first.alias("_first"))
    across = Window.orderBy(F.col("_range").desc(), F.col("_part").desc())  # a row per block
    follow = blocks.select("*", F.lead("_first").over(across).alias("_next"), F.first("_first").over(across).alias("_top"))
    follow = follow.select("_range", "_part", F.coalesce("_next", "_top").alias("_head"))
    wanted = follow.select(F.col("_head")[order].alias("_o"), F.col("_head")["_tie"].alias("_t")).distinct()
    if ranges * width <= BROADCAST_BLOCKS:  # two numbers a block; with more of them Spark shuffles both sides
        wanted = F.broadcast(wanted)
    held = F.struct(*columns)
    heads = df.join(wanted, df[order].eqNullSafe(wanted["_o"]) & (df["_tie"] == wanted["_t"])).groupBy("_o", "_t").agg(F.first(held).alias("_held"))
    follow = follow.join(heads, F.col("_head")[order].eqNullSafe(F.col("_o")) & (F.col("_head")["_tie"] == F.col("_t"))).select(
        F.col("_range").alias("_r"), F.col("_part").alias("_p"), "_held")
    joined = ahead.join(follow, (F.col("_range") == F.col("_r")) & (F.col("_part") == F.col("_p")) & F.col("_ends"), "left")
    made = [F.when(F.col("_ends"), F.col(f"_held.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns]
    return joined.select(*(c for c in df.columns if c != "_tie"), *made)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A null text is empty; an empty text has one empty paragraph and no runs. The next document is the one with the next
    lower doc_id (rows of one doc_id in descending order of a hash of their text, null doc_ids last), after the last the
    first; a table of one row has itself as next. An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    own = with_tree(rows, "text", "tree").select("doc_id", "text", F.col("tree.root").alias("root"), F.col("tree.sections").alias("sections"), F.col("tree.runs").alias("runs"))
    pairs = with_next(own, "doc_id", F.xxhash64("text"), ["text", "root", "runs"])
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = pairs.withColumn("n_chars", size.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next_text"), F.lit(1), cut))).drop("text", "next_text")
    both = with_tree(edited, "edited", "other")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("root"), F.col("sections"), F.col("runs")).alias("fingerprint"),
        fingerprint(F.col("other.root"), F.col("other.sections"), F.col("other.runs")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("runs"), F.col("other.root"), F.col("other.runs")).alias("near_edited"),
        likeness(F.col("root"), F.col("runs"), F.col("next_root"), F.col("next_runs")).alias("near_next"),
    )
