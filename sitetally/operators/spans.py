"""Plan pages, read from text spans.

``spans(job_id, page INT, seq BIGINT, text, size DOUBLE, x DOUBLE, y DOUBLE)``;
pages count from 1 and ``seq`` is the drawing order.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    LEVEL_PATTERN, NOT_A_ROOM_NAME, NUMERIC_LABEL_PATTERN, PAGE_TYPE_OTHER, PAGE_TYPES, SURFACE_PATTERN, TITLE_SIZE,
)
from ..functions.patterns import pattern_heads
from ..functions.text import norm_span, strip
from ..session import cut_lineage, ship_package

PAGE = ["job_id", "page"]
NAME_REACH = 40.0
#: Groups of texts over which entries without a required start are spread.
SPREAD = 16


def page_types(spans: DataFrame) -> DataFrame:
    """First known type, in list order, written in the large text of a page."""
    title = F.when(F.col("size") >= TITLE_SIZE, norm_span("text"))
    found = spans.groupBy(*PAGE).agg(*[
        F.max(F.coalesce(F.contains(title, F.lit(t.lower())), F.lit(False))).alias(t) for t in PAGE_TYPES])
    kind = F.coalesce(*[F.when(F.col(t), F.lit(t)) for t in PAGE_TYPES], F.lit(PAGE_TYPE_OTHER))
    return found.select(*PAGE, kind.alias("page_type"))


def level_hint(spans: DataFrame) -> DataFrame:
    """Digit of the first ``R<digit>`` of a plan."""
    return spans.where(F.col("text").rlike(LEVEL_PATTERN)).groupBy("job_id").agg(
        F.min_by(F.regexp_extract("text", LEVEL_PATTERN, 1), F.struct("page", "seq")).alias("niveau_hint"))


def looks_like_finish(text) -> Column:
    folded = norm_span(text)
    return F.exists(F.array(*map(F.lit, NOT_A_ROOM_NAME)), lambda word: F.contains(folded, word))


def room_labels(spans: DataFrame) -> DataFrame:
    """Room labels: each surface text takes the best name of its size to the right, else above.

    The range join goes over cells as wide as the reach of a name. Surfaces and
    names printed several times on one spot are merged first. Columns: job_id,
    page, idx (drawing order), name, surface, x, y; one row per distinct name of a page.
    """
    is_surface = F.col("text").rlike(SURFACE_PATTERN)
    cell_x, cell_y = F.floor(F.col("x") / NAME_REACH), F.floor(F.col("y") / NAME_REACH)
    spots = spans.where(is_surface).groupBy(*PAGE, "size", "x", "y").agg(
        F.min(F.struct("seq", "text")).alias("s"))
    surfaces = spots.select(*PAGE, "size", "x", "y", F.col("s.seq").alias("seq"), F.col("s.text").alias("surface"))
    near = surfaces.withColumn("cx", F.explode(F.sequence(cell_x - 1, cell_x + 1))).withColumn(
        "cy", F.explode(F.sequence(cell_y - 1, cell_y + 1)))
    names = spans.where(~is_surface & ~looks_like_finish("text")).groupBy(
        *PAGE, F.col("size").alias("n_size"), F.col("x").alias("nx"), F.col("y").alias("ny")
    ).agg(F.min(F.struct("seq", "text")).alias("n")).withColumns({
        "cx": F.floor(F.col("nx") / NAME_REACH), "cy": F.floor(F.col("ny") / NAME_REACH)})
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    right = (dx > 0) & (dx <= NAME_REACH) & (F.abs(dy) <= 3)
    above = (F.abs(dx) <= 6) & (dy >= -35) & (dy <= -5)
    key = F.struct(F.when(right, 0).otherwise(1).alias("style"), F.when(right, dx).otherwise(35 + dy).alias("d"),
                   F.col("n.seq").alias("seq"))
    best = (
        near.join(names, [*PAGE, "cx", "cy"])
        .where((F.abs(F.col("n_size") - F.col("size")) <= 0.3) & (right | above))
        .groupBy(*PAGE, "seq", "surface", "x", "y").agg(F.min_by("n.text", key).alias("name"))
    )
    first = best.withColumn("name_norm", norm_span("name")).where("name_norm <> ''").groupBy(*PAGE, "name_norm").agg(
        F.min(F.struct("seq", "name", "surface", "x", "y")).alias("r"))
    return first.select(*PAGE, F.col("r.seq").alias("idx"), strip("r.name").alias("name"), F.col("r.surface").alias("surface"),
                        F.col("r.x").alias("x"), F.col("r.y").alias("y"))


def room_pages(spans: DataFrame, rooms: DataFrame) -> DataFrame:
    """(job_id, page, rooms_page, n_rooms, reference_page): a page with fewer than three labels
    borrows those of the page with most (the first of them)."""
    counts = spans.select(*PAGE).distinct().join(rooms.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_rooms")), PAGE, "left").na.fill(
        0, ["n_rooms"])
    reference = counts.groupBy("job_id").agg(
        F.max_by("page", F.struct("n_rooms", (-F.col("page")).alias("p"))).alias("reference_page"))
    return counts.join(reference, "job_id").select(
        *PAGE, "n_rooms", "reference_page",
        F.when(F.col("n_rooms") >= 3, F.col("page")).otherwise(F.col("reference_page")).alias("rooms_page"))


def _from_start(pattern: str | Column) -> Column:
    return F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")"))


def catalog_candidates(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of a text (page_type, text) and a text entry of its page type whose pattern may match at the start.

    Entries are indexed by the letters their patterns require at the start. A text looks up its own first letters, one lookup
    per length of head in use, so it meets the entries that can match and those whose patterns require nothing. The latter meet
    every text; they are spread over SPREAD groups of texts.
    """
    ship_package(texts.sparkSession)
    headed = cut_lineage(entries.select("pattern").distinct().withColumn("head", F.explode(pattern_heads("pattern"))))
    indexed = entries.join(headed, "pattern")
    lengths = indexed.groupBy("page_type").agg(F.collect_set(F.length("head")).alias("_lengths"))  # at most HEAD_LETTERS + 1 numbers
    folded = F.translate("text", ascii_uppercase, ascii_lowercase)
    probes = texts.join(lengths, "page_type").withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("text")).select(
        "page_type", "text", F.substring(folded, F.lit(1), F.col("_n")).alias("head"))
    group = F.when(F.col("head") == "", F.pmod(F.hash("text"), F.lit(SPREAD))).otherwise(0)
    groups = F.when(F.col("head") == "", F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return probes.withColumn("_group", group).join(indexed.withColumn("_group", F.explode(groups)), ["page_type", "head", "_group"]).drop("head", "_group")


def catalog_match(spans: DataFrame, types: DataFrame, catalog: DataFrame) -> DataFrame:
    """First text entry of the page's type whose bounds hold and whose pattern matches at the start.

    Patterns are tried on distinct texts only, and only where the index lets them. The matching entries of a text travel
    as one array back to its spans, which test their bounds.
    """
    def within(value: Column, low: Column, high: Column) -> Column:
        return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))

    limits = ["min_font_size", "max_font_size", "min_x", "max_x", "min_y", "max_y"]
    entries = catalog.where("kind = 'text'").select(
        "page_type", "ord", "pattern", "article", "categorie", *limits, F.map_entries("expands").alias("expands"))
    typed = spans.join(types, PAGE)
    texts = typed.join(entries.select("page_type").distinct(), "page_type", "left_semi").select("page_type", "text").distinct()
    hits = catalog_candidates(texts, entries).where(F.rlike(F.col("text"), _from_start(F.col("pattern"))))
    number = F.call_function("regexp_extract", F.col("text"), _from_start(F.col("pattern")), F.lit(1))
    article = F.when(F.contains(F.col("article"), F.lit("{0}")), F.replace(F.col("article"), F.lit("{0}"), number)).otherwise(F.col("article"))
    matching = hits.groupBy("page_type", "text").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "pattern", article.alias("article"), "categorie", *limits, "expands"))).alias("entries"))

    def fits(e: Column) -> Column:
        return (within(F.col("size"), e["min_font_size"], e["max_font_size"]) & within(F.col("x"), e["min_x"], e["max_x"])
                & within(F.col("y"), e["min_y"], e["max_y"]))

    return (
        typed.join(matching, ["page_type", "text"]).withColumn("hit", F.get(F.filter("entries", fits), F.lit(0))).where("hit is not null")
        .select("job_id", "page", "seq", "page_type", F.col("text").alias("label"), F.col("hit.article").alias("article"),
                F.col("hit.categorie").alias("categorie"), "x", "y", F.lit("texte").alias("source"), F.lit(1.0).alias("confidence"),
                F.col("hit.expands").alias("expands"))
    )


def expand_catalog(symbols: DataFrame) -> DataFrame:
    """Composite catalogue entries become n copies of each listed article at the same point."""
    composite = F.coalesce(F.size("expands") > 0, F.lit(False))
    single = symbols.where(~composite).drop("expands").withColumn("copy", F.lit(0))
    copies = (
        symbols.where(composite).withColumn("_e", F.explode("expands")).where("_e.value > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_e.value"))))
        .withColumns({"label": F.concat("label", F.lit(" (déployé)")), "article": F.col("_e.key"), "source": F.lit("expansion")})
        .drop("_e", "expands")
    )
    return single.unionByName(copies)


def uncatalogued(spans: DataFrame, types: DataFrame, catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """Small texts of catalogued pages that no entry explains, counted per page type."""
    known_types = types.join(catalog.select("page_type").distinct(), "page_type", "left_semi")
    explained = matched.select("job_id", "page", F.col("label").alias("text")).distinct()
    return (
        spans.where((F.col("size") < 13) & (F.length("text") >= 2) & ~F.col("text").rlike(NUMERIC_LABEL_PATTERN))
        .groupBy("job_id", "page", "text").agg(F.count(F.lit(1)).alias("n"))
        .join(explained, ["job_id", "page", "text"], "left_anti").join(known_types, PAGE)
        .groupBy("job_id", "page_type", F.col("text").alias("label")).agg(F.sum("n").alias("occurrences"))
    )


def remarks(spans: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct longer texts of heading size, with their page; ``seq`` keeps the reading order."""
    big = spans.where(F.col("size").between(14.5, 21) & (F.length("text") > 20)).groupBy(*PAGE, "text").agg(F.min("seq").alias("seq"))
    text = F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(" ("), "page_type", F.lit(") : "), "text")
    return big.join(types, PAGE).select("job_id", "page", "seq", text.alias("remark"))

