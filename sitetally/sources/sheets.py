"""Listing workbooks, read from ``sheet_rows``.

``sheet_rows(job_id, sheet_idx INT, sheet STRING, row_idx BIGINT, cells ARRAY<STRING>)``
holds every row of every sheet, counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CORRESPONDENCE_MARK, HEADER_ALIASES, HEADER_MARK, IGNORED_SHEETS,
    LISTING_COLUMNS, MATERIAL_CORRESPONDENCE, MERGED_CELL_COLUMNS, MISSING_COLUMNS_ERROR, NO_HEADER_ERROR, REQUIRED_COLUMNS,
    ROOM_CORRESPONDENCE,
)
from ..functions.amounts import sheet_quantity
from ..functions.identity import with_room_identity
from ..functions.text import norm_token, strip
from ..operators.ordered import carry_forward

SHEET = ["job_id", "sheet"]


def candidate_rows(sheet_rows: DataFrame) -> DataFrame:
    """Rows of the sheets that may hold a listing."""
    name = norm_token("sheet")
    return sheet_rows.where(~name.isin(IGNORED_SHEETS) & ~name.contains(CORRESPONDENCE_MARK))


def _canonical(label: Column) -> Column:
    aliases = F.create_map(*[F.lit(v) for pair in HEADER_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(aliases, norm_token(label)), F.lit(""))


def sheet_headers(sheet_rows: DataFrame) -> DataFrame:
    """One row per candidate sheet: header position, canonical columns, level fallback, error."""
    is_header = F.exists("cells", lambda c: norm_token(c) == HEADER_MARK)
    first_text = F.get(F.filter("cells", lambda c: strip(c) != ""), F.lit(0))
    per_sheet = candidate_rows(sheet_rows).groupBy(*SHEET).agg(
        F.min("sheet_idx").alias("sheet_idx"),
        F.min_by(F.struct("row_idx", "cells"), F.when(is_header, F.col("row_idx"))).alias("_header"),
        F.min(F.when(first_text.isNotNull(), F.struct("row_idx", strip(first_text).alias("text")))).alias("_first"),
    )
    labels = F.transform(F.col("_header.cells"), _canonical)
    positions = {f"pos_{c}": F.nullif(F.array_position(F.col("_labels"), F.lit(c)), F.lit(0)) for c in LISTING_COLUMNS}
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED_COLUMNS]), F.col("_labels"))
    return (
        per_sheet.withColumn("_labels", labels)
        .withColumns(positions)
        .select(
            *SHEET, "sheet_idx",
            F.col("_header.row_idx").alias("header_row"),
            *positions,
            F.when(strip("sheet") != "", strip("sheet"))
             .when(F.col("_first.row_idx") < F.col("_header.row_idx"), F.col("_first.text")).otherwise("").alias("sheet_level"),
            F.when(F.col("_header").isNull(), F.lit(NO_HEADER_ERROR))
             .when(F.size(missing) > 0, F.concat(F.lit(MISSING_COLUMNS_ERROR), F.array_join(missing, ", ")))
             .alias("error"),
        )
    )


def sheet_errors(sheet_rows: DataFrame) -> DataFrame:
    """Quarantine table: sheets that cannot be read, and why."""
    return sheet_headers(sheet_rows).where(F.col("error").isNotNull()).select(*SHEET, "header_row", "error")


def raw_listing(sheet_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells below the header, placed in the canonical columns; all-null rows dropped."""
    good = headers.where(F.col("error").isNull())
    joined = candidate_rows(sheet_rows).drop("sheet_idx").join(good, SHEET).where(F.col("row_idx") > F.col("header_row"))
    cells = joined.select(
        *SHEET, "sheet_idx", "row_idx", "sheet_level",
        *[F.get("cells", (F.col(f"pos_{c}") - 1).cast("int")).alias(c) for c in LISTING_COLUMNS],
    )
    return cells.where(F.coalesce(*LISTING_COLUMNS).isNotNull())


def fill_merged_cells(raw: DataFrame) -> DataFrame:
    """Merged cells keep their value on the first row only: carry it down each sheet."""
    return carry_forward(raw, SHEET, "row_idx", MERGED_CELL_COLUMNS)


def default_level(filled: DataFrame, raw: DataFrame) -> DataFrame:
    """A sheet without any level takes its own name as level; otherwise only the gaps do."""
    has_level = raw.groupBy(*SHEET).agg(F.max(strip("niveau") != "").alias("_has_level"))
    return filled.join(has_level, SHEET).withColumn(
        "niveau",
        F.when(F.col("_has_level"), F.coalesce("niveau", "sheet_level")).otherwise(F.col("sheet_level")),
    ).drop("_has_level")


def clean_rows(filled: DataFrame) -> DataFrame:
    """Typed, trimmed rows; placeholder rows such as ``(vide)`` keep the room but no material."""
    text = {c: strip(c) for c in LISTING_COLUMNS if c != "quantite"}
    typed = (
        filled.where(F.col("materiel").isNotNull())
        .withColumns({**text, "quantite": sheet_quantity("quantite")})
        .where(F.col("materiel") != "")
    )
    placeholder = F.col("materiel").rlike(r"^\(.*\)$")
    return with_room_identity(typed).withColumns({
        "quantite": F.when(placeholder, F.lit(0).cast("bigint")).otherwise(F.col("quantite")),
        "materiel": F.when(placeholder, F.lit("")).otherwise(F.col("materiel")),
    }).select(
        "job_id", "sheet_idx", "sheet", "row_idx", "niveau", "occupation", "piece", "numero",
        "categorie", "code_article", "materiel", "quantite", "room_id", "room_label", "scope_id",
    )


def read_listing(sheet_rows: DataFrame) -> DataFrame:
    """The cleaned listing of every job. Unreadable sheets are left to ``sheet_errors``."""
    raw = raw_listing(sheet_rows, sheet_headers(sheet_rows))
    return clean_rows(default_level(fill_merged_cells(raw), raw))


def read_correspondences(sheet_rows: DataFrame) -> DataFrame:
    """User overrides from correspondence sheets: (job_id, kind, source, target), last row wins."""
    rows = sheet_rows.where(norm_token("sheet").contains(CORRESPONDENCE_MARK))
    titles = F.transform("cells", norm_token)
    headers = rows.where(F.col("row_idx") == 0).select(
        *SHEET,
        F.explode(F.array(*[
            F.struct(
                F.lit(kind).alias("kind"),
                F.array_position(titles, F.lit(left)).cast("int").alias("left"),
                F.array_position(titles, F.lit(right)).cast("int").alias("right"),
            )
            for kind, (left, right) in (("room", ROOM_CORRESPONDENCE), ("material", MATERIAL_CORRESPONDENCE))
        ])).alias("h"),
    ).where((F.col("h.left") > 0) & (F.col("h.right") > 0)).select(*SHEET, "h.*")
    pairs = rows.where(F.col("row_idx") > 0).join(headers, SHEET).select(
        "job_id", "kind", "sheet_idx", "row_idx",
        F.get("cells", F.col("left") - 1).alias("source"),
        F.get("cells", F.col("right") - 1).alias("target"),
    ).where((F.col("source") != "") & (F.col("target") != ""))
    return (
        pairs.groupBy("job_id", "kind", strip("source").alias("source"))
        .agg(F.max_by(strip("target"), F.struct("sheet_idx", "row_idx")).alias("target"))
    )
