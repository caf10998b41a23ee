"""Saved analyses: ``analyses(job_id, owner_sub, created_at, updated_at, excel_name, pdf_name,
job_status, output, word_output, symboles_detectes, lignes)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .ordered import rank_by_range


def may_read(owner: str | None, allow_legacy: bool = False) -> Column:
    """Owners see their own rows; rows without an owner need ``allow_legacy``; no owner given sees all."""
    if owner is None:
        return F.lit(True)
    stored = strip("owner_sub")
    return F.when(stored != "", stored == owner.strip()).otherwise(F.lit(bool(allow_legacy)))


def history_list(analyses: DataFrame, owner: str | None, allow_legacy: bool = False) -> DataFrame:
    """Readable analyses with defaults filled; ``rank`` counts from the last modified one."""
    def filled(c: str, default) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias(c)

    shown = analyses.where(may_read(owner, allow_legacy)).select(
        "job_id", F.coalesce("created_at", "modified_at").alias("created_at"), "updated_at",
        filled("excel_name", "Excel non renseigné"), filled("pdf_name", "PDF non renseigné"), filled("job_status", "done"),
        F.coalesce("symboles_detectes", F.lit(0)).alias("symboles_detectes"), F.coalesce("lignes", F.lit(0)).alias("lignes"),
        "owner_sub", "modified_at")
    return rank_by_range(shown, [], [F.col("modified_at").desc_nulls_last(), "job_id"], "rank")


def file_name(path) -> Column:
    return F.coalesce(F.substring_index(F.col(path), "/", -1), F.lit(""))


def output_owner(analyses: DataFrame, names: DataFrame, owner: str | None, allow_legacy: bool = False) -> DataFrame:
    """(name, job_id): readable analysis that produced an exported file. ``names(name)`` holds bare file names."""
    files = analyses.where(may_read(owner, allow_legacy)).select(
        "job_id", F.explode(F.array_distinct(F.array(file_name("output"), file_name("word_output")))).alias("name"))
    return names.where("name <> '' and not contains(name, '/')").distinct().join(files, "name").select("name", "job_id")


def artefacts(analyses: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(job_id, name): files to remove for the analyses being deleted."""
    gone = analyses.join(tombstones.select("job_id").distinct(), "job_id", "left_semi")
    return gone.select("job_id", F.explode(F.array(
        F.concat(F.lit("analysis_"), F.col("job_id").cast("string"), F.lit(".json")), file_name("output"), file_name("word_output")
    )).alias("name")).where("name <> ''")


def without_deleted(analyses: DataFrame, tombstones: DataFrame) -> DataFrame:
    return analyses.join(tombstones.select("job_id").distinct(), "job_id", "left_anti")


def preserved_owners(versions: DataFrame) -> DataFrame:
    """Owner of a job: the first one recorded, whatever later versions claim. ``versions(job_id, version, owner_sub)``."""
    named = F.when(strip("owner_sub") != "", F.col("version"))
    return versions.groupBy("job_id").agg(F.min_by("owner_sub", named).alias("owner_sub"))
