"""Plan pages to counted symbols: text spans, detections and flooded cells in, symbols with rooms and ids out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RENDER_ZOOM
from ..functions import symbols as quality
from ..functions.text import py_round
from ..operators import overlay, spans, spatial
from ..session import cut_lineage
from ..sources import rules

PAGE = ["job_id", "page"]
#: Cells per point of the flooded page: a quarter of a rendered pixel.
CELL_SCALE = 0.25 * RENDER_ZOOM


def _scaled(c: str) -> Column:
    return F.floor(F.col(c) * CELL_SCALE).cast("bigint")


@dataclass
class PlanSymbols:
    """One extraction over any number of plans; each step is a property, so any table between can be read or written.

    ``spans(job_id, page, seq, text, size, x, y)``; ``catalog`` as of ``sources.rules``; ``detections(job_id, page, seq,
    article, categorie, x, y, score)`` of the image detectors, with ``seq`` after that of all spans; ``grid(job_id, page, x, y)`` the
    cells of a page that no wall covers, CELL_SCALE of them to a point. The last two are optional.
    """

    spans: DataFrame
    catalog: DataFrame
    detections: DataFrame | None = None
    grid: DataFrame | None = None

    @cached_property
    def page_types(self) -> DataFrame:
        return cut_lineage(spans.page_types(self.spans))

    @cached_property
    def labels(self) -> DataFrame:
        return cut_lineage(spans.room_labels(self.spans))

    @cached_property
    def rooms(self) -> DataFrame:
        """Labels that count on each page: its own, or those of the page with most."""
        pages = spans.room_pages(self.spans, self.labels).select(*PAGE, "rooms_page")
        return cut_lineage(pages.join(self.labels.withColumnRenamed("page", "rooms_page"), ["job_id", "rooms_page"]).drop("rooms_page"))

    @cached_property
    def cells(self) -> DataFrame | None:
        """(job_id, page, x, y, idx): the label that is nearest on foot, for each cell that one reaches."""
        if self.grid is None:
            return None
        spots = self.rooms.select(*PAGE, "idx", *(_scaled(c).alias(c) for c in ("x", "y")))
        return cut_lineage(spatial.flood(self.grid, spatial.place_seeds(spots, self.grid)).select(*PAGE, "x", "y", "idx"))

    @cached_property
    def found(self) -> DataFrame:
        """Text symbols and detections before rooms, duplicates and expansion."""
        texts = spans.catalog_match(self.spans, self.page_types, self.catalog)
        if self.detections is None:
            return cut_lineage(texts)
        seen = self.detections.join(self.page_types, PAGE).withColumns({
            "label": F.concat(F.lit("glyphe ("), F.col("score").cast("string"), F.lit(")")), "source": F.lit("vision"),
            "confidence": F.col("score").cast("double"), "expands": F.lit(None).cast(texts.schema["expands"].dataType)})
        return cut_lineage(texts.unionByName(seen.select(texts.columns)))

    @cached_property
    def placed(self) -> DataFrame:
        """Symbols with a room: that of the flooded cell around them, else of the nearest label; '' without labels."""
        points = self.found.select(*PAGE, "x", "y").distinct()
        nearest = spatial.nearest_room(points, self.rooms)
        if self.cells is None:
            return self.found.join(nearest, [*PAGE, "x", "y"])
        scaled = {c: _scaled(c) for c in ("x", "y")}
        asked = points.select(*PAGE, F.col("x").alias("_x"), F.col("y").alias("_y"), *(v.alias(c) for c, v in scaled.items()))
        label = self.rooms.select(*PAGE, "idx", F.struct("name", "x", "y").alias("_label"))
        named = spatial.ring_lookup(asked, self.cells).join(label, [*PAGE, "idx"])
        dx, dy = F.col("_label.x") - F.col("_x"), F.col("_label.y") - F.col("_y")
        walked = asked.join(named, [*PAGE, "x", "y"]).select(
            *PAGE, F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_label.name").alias("_name"), py_round(F.sqrt(dx * dx + dy * dy), 1).alias("_dist"))
        return self.found.join(nearest, [*PAGE, "x", "y"]).join(walked, [*PAGE, "x", "y"], "left").withColumns({
            "room": F.coalesce("_name", "room"), "room_dist": F.coalesce("_dist", "room_dist")}).drop("_name", "_dist")

    @cached_property
    def symbols(self) -> DataFrame:
        """Symbols without duplicates, composite entries expanded, with ids; ``seq`` and ``copy`` name a row."""
        kept = spatial.remove_duplicate_symbols(cut_lineage(self.placed), quality.duplicate_quality("source", "label"))
        every = spans.expand_catalog(kept).withColumns({
            "seq": F.struct("seq", "copy"), "detection_id": F.lit(""), "original_article": F.lit(""), "original_reference": F.lit("")})
        named = overlay.with_detection_metadata(every, rules.article_references(self.catalog))
        return named.withColumn("seq", F.col("seq.seq"))

    @cached_property
    def uncatalogued(self) -> DataFrame:
        return spans.uncatalogued(self.spans, self.page_types, self.catalog, self.found.where("source = 'texte'"))
