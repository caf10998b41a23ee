"""Corrections laid over detections: identifiers, zones, edits, relations, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import relation_key
from ..functions.symbols import confidence, detection_base_id
from ..functions.text import norm_token, py_round, strip, text_or_blank
from .options import infer_scope, resolve_scopes
from .ordered import running_count
from .spatial import bounds, rectangle, zone_assign


def _or(*columns) -> Column:
    """First non-blank text, else ''."""
    return F.coalesce(*[F.nullif(text_or_blank(c), F.lit("")) for c in columns], F.lit(""))


# -- identifiers ------------------------------------------------------------------------------

def with_legacy_id(symbols: DataFrame) -> DataFrame:
    """``p<page>-d<n>``: running number of a symbol on its page."""
    numbered = running_count(symbols, ["job_id", "page"], "seq", "_n")
    return numbered.withColumn("legacy_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-d"), F.col("_n").cast("string"))).drop("_n")


def with_detection_metadata(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Stable ids (repeats get ``-2``, ``-3``…), confidence and original names.

    ``references(article, reference)`` is the catalogue's reference per article.
    """
    known = symbols.join(references.withColumnRenamed("reference", "_ref"), "article", "left")
    based = known.withColumn("_base", _or("detection_id", detection_base_id("page", "page_type", "_ref", "article", "x", "y")))
    counted = running_count(based, ["job_id", "_base"], "seq", "_n")
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")
    return counted.withColumns({
        "detection_id": F.concat("_base", suffix),
        "confidence": confidence(F.coalesce("confidence", F.lit(0.0)), "source", "label"),
        "original_article": _or("original_article", "article"),
        "original_reference": _or("original_reference", "_ref"),
    }).drop("_base", "_n", "_ref")


# -- zones ----------------------------------------------------------------------------------------

def zone_proposals(rooms: DataFrame, symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """A box around each room label and that room's symbols, on every counted page.

    ``rooms(job_id, idx, name, x, y)``; ``pages(job_id, page)``. The rows asked for
    are pages times rooms of a job; boxes are computed once per room before.
    """
    spread = symbols.groupBy("job_id", F.col("room").alias("name")).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    boxed = rooms.join(spread, ["job_id", "name"], "left").select(
        "job_id", "idx", "name",
        F.greatest(F.lit(0.0), F.least("x", "_x0") - 38.0).alias("x0"), (F.greatest("x", "_x1") + 38.0).alias("x1"),
        F.greatest(F.lit(0.0), F.least("y", "_y0") - 30.0).alias("y0"), (F.greatest("y", "_y1") + 30.0).alias("y1"))

    def widened(low: str, high: str, least: float, half: float) -> tuple[Column, Column]:
        narrow, middle = F.col(high) - F.col(low) < least, (F.col(low) + F.col(high)) / 2
        return (F.when(narrow, F.greatest(F.lit(0.0), middle - half)).otherwise(F.col(low)),
                F.when(narrow, middle + half).otherwise(F.col(high)))

    (x0, x1), (y0, y1) = widened("x0", "x1", 80.0, 40.0), widened("y0", "y1", 55.0, 28.0)
    fixed = boxed.select("job_id", "idx", "name", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    return fixed.join(pages.select("job_id", "page").distinct(), "job_id").select(
        "job_id", F.concat(F.lit("r"), F.col("page").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("id"), "page",
        F.col("name").alias("name_original"), "name", py_round("x0", 1).alias("x"), py_round("y0", 1).alias("y"),
        py_round(F.col("x1") - F.col("x0"), 1).alias("w"), py_round(F.col("y1") - F.col("y0"), 1).alias("h"),
        rectangle(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("points"),
        F.lit(False).alias("locked"), F.lit("proposition").alias("source"))


def merge_zones(zones: DataFrame, submitted: DataFrame) -> DataFrame:
    """Submitted zones replace proposals field by field; new ones are numbered after them.

    ``submitted(job_id, seq, id, page, name_original, name, x, y, w, h, points, locked)``;
    ``seq`` counts from 0 in each job, null fields keep the proposal's value.
    """
    fields = ["page", "name_original", "name", "x", "y", "w", "h", "points"]
    blank_id = text_or_blank("id") == ""
    given = submitted.withColumn("_key", F.when(blank_id, F.concat(F.lit("\x00"), F.col("seq").cast("string"))).otherwise(F.col("id")))

    def given_value(c: str) -> Column:
        filled = F.size(c) > 0 if c == "points" else (text_or_blank(c) != "") if c in ("name", "name_original") else F.col(c).isNotNull()
        return F.max_by(c, F.when(filled, F.col("seq"))).alias(f"_s_{c}")

    folded = given.groupBy("job_id", "_key").agg(
        *[given_value(c) for c in fields], F.max_by("locked", "seq").alias("_s_locked"), F.min("seq").alias("_first"))
    base = zones.withColumnRenamed("id", "_key").withColumn("_base", F.lit(True))
    fresh = folded.join(base.select("job_id", "_key"), ["job_id", "_key"], "left_anti").select("job_id", "_key", "_first")
    numbered = running_count(fresh, ["job_id"], "_first", "_n").drop("_first")
    counts = zones.groupBy("job_id").agg(F.count(F.lit(1)).alias("_zones"))
    merged = base.join(folded, ["job_id", "_key"], "full").join(numbered, ["job_id", "_key"], "left").join(counts, "job_id", "left")
    touched = F.col("_first").isNotNull()

    def value(c: str, default: Column) -> Column:
        return F.coalesce(f"_s_{c}", c, default)

    page = value("page", F.lit(1)).cast("int")
    x, y = (py_round(value(c, F.lit(0.0)), 1) for c in ("x", "y"))
    w, h = (py_round(F.greatest(F.lit(8.0), value(c, F.lit(d))), 1) for c, d in (("w", 80.0), ("h", 55.0)))
    original = _or("_s_name_original", "name_original", "_s_name")
    staged = merged.withColumns({
        "_page": page, "_original": original, "_rect": rectangle(x, y, w, h),
        "_points": F.transform(F.coalesce("_s_points", "points"), lambda p: F.struct(
            py_round(p["x"], 1).alias("x"), py_round(p["y"], 1).alias("y"))),
    }).withColumn("_points", F.when(F.coalesce(F.size("_points"), F.lit(0)) < 3, F.col("_rect")).otherwise(F.col("_points")))
    box = bounds(F.col("_points"))

    def out(c: str, new: Column) -> Column:
        return F.when(touched, new).otherwise(F.col(c)).alias(c)

    new_id = F.concat(F.lit("r"), F.col("_page").cast("string"), F.lit("-"), (F.coalesce("_zones", F.lit(0)) + F.col("_n")).cast("string"))
    return staged.select(
        "job_id", F.when(F.col("_key").startswith("\x00"), new_id).otherwise(F.col("_key")).alias("id"),
        out("page", F.col("_page")), out("name_original", F.col("_original")),
        out("name", strip(_or("_s_name", "_original", F.lit("Pièce sans nom")))),
        out("x", py_round(box["x"], 1)), out("y", py_round(box["y"], 1)),
        out("w", py_round(F.greatest(F.lit(8.0), box["w"]), 1)), out("h", py_round(F.greatest(F.lit(8.0), box["h"]), 1)),
        out("points", F.col("_points")), out("locked", F.coalesce("_s_locked", F.lit(False))), out("source", F.lit("utilisateur")))


def room_renames(zones: DataFrame) -> DataFrame:
    """(job_id, original, name): new name per original label, the last zone in page order wins."""
    named = zones.select("job_id", strip("name_original").alias("original"), strip("name").alias("new_name"), "page", "y", "x", "id")
    return named.where("original <> '' and new_name <> ''").groupBy("job_id", "original").agg(
        F.max_by("new_name", F.struct("page", "y", "x", "id")).alias("new_name"))


def rename_rooms(symbols: DataFrame, zones: DataFrame) -> DataFrame:
    """Room of each symbol after renaming, then overridden by the locked zone around it."""
    renames = room_renames(zones).withColumnRenamed("original", "room")
    inside = zone_assign(symbols, zones)
    moved = symbols.join(renames, ["job_id", "room"], "left").join(inside, ["job_id", "page", "x", "y"], "left")
    in_zone = text_or_blank("zone") != ""
    return moved.withColumns({
        "room": F.when(in_zone, F.col("zone")).otherwise(F.coalesce("new_name", "room")),
        "room_dist": F.when(in_zone, F.lit(0.0)).otherwise(F.col("room_dist")),
    }).drop("new_name", "zone")


def corrected_rooms(rooms: DataFrame, zones: DataFrame) -> DataFrame:
    """Room labels after renaming, plus zone names not seen yet; the first of a name is kept."""
    renames = room_renames(zones).withColumnRenamed("original", "name")
    labels = rooms.join(renames, ["job_id", "name"], "left").select(
        "job_id", F.coalesce("new_name", "name").alias("name"), "surface", "x", "y", "page",
        F.struct(F.lit(0).alias("part"), F.col("page").cast("double").alias("a"), F.col("idx").cast("double").alias("b"), F.lit(0.0).alias("c")).alias("o"))
    areas = zones.select(
        "job_id", strip("name").alias("name"), F.lit("").alias("surface"), (F.col("x") + F.col("w") / 2).alias("x"),
        (F.col("y") + F.col("h") / 2).alias("y"), "page",
        F.struct(F.lit(1).alias("part"), F.col("page").cast("double").alias("a"), F.col("y").alias("b"), F.col("x").alias("c")).alias("o"))
    both = labels.unionByName(areas).where("name <> ''")
    return both.groupBy("job_id", "name").agg(F.min_by(F.struct("surface", "x", "y", "page"), "o").alias("r"), F.min("o").alias("o")).select(
        "job_id", "name", "r.*", "o")


# -- edits -------------------------------------------------------------------------------------------

def _relabelled(rows: DataFrame, meta: DataFrame, reference: str, article: str) -> DataFrame:
    """Add ``m``: catalogue entry of the page type by reference, else by article."""
    entry = F.struct(*[F.col(c).alias(c) for c in ("article", "categorie", "reference")])
    table = meta.select(F.col("page_type"), F.col("lookup"), entry.alias("_m"))
    by_reference = table.select("page_type", F.col("lookup").alias("_k1"), F.col("_m").alias("_m1"))
    by_article = table.select("page_type", F.col("lookup").alias("_k2"), F.col("_m").alias("_m2"))
    return (
        rows.withColumns({"_k1": text_or_blank(reference), "_k2": text_or_blank(article)})
        .join(by_reference, ["page_type", "_k1"], "left").join(by_article, ["page_type", "_k2"], "left")
        .withColumn("m", F.coalesce("_m1", "_m2")).drop("_k1", "_k2", "_m1", "_m2")
    )


def apply_edits(symbols: DataFrame, edits: DataFrame, meta: DataFrame, zones: DataFrame) -> DataFrame:
    """Symbols after user edits: ignored ones dropped, others relabelled, moved, renamed.

    ``edits(job_id, object_id, ignored, reference, article, room)`` names a
    symbol by detection id or by its older running number.
    """
    patch = F.struct("ignored", "reference", "article", "room")
    by_id = edits.select("job_id", F.col("object_id").alias("detection_id"), patch.alias("_p1"))
    by_number = edits.select("job_id", F.col("object_id").alias("legacy_id"), patch.alias("_p2"))
    patched = with_legacy_id(symbols).join(by_id, ["job_id", "detection_id"], "left").join(
        by_number, ["job_id", "legacy_id"], "left").withColumn("p", F.coalesce("_p1", "_p2")).drop("_p1", "_p2", "legacy_id")
    kept = patched.where(~F.coalesce(F.col("p.ignored"), F.lit(False)))
    asked = (text_or_blank("p.reference") != "") | (text_or_blank("p.article") != "")
    looked_up = _relabelled(kept, meta, "p.reference", "p.article")
    changed = asked & F.col("m").isNotNull()
    labelled = looked_up.withColumns({
        "article": F.when(changed, F.col("m.article")).otherwise(F.col("article")),
        "categorie": F.when(changed, F.col("m.categorie")).otherwise(F.col("categorie")),
        "label": F.when(changed, F.concat("label", F.lit(" (corrigé)"))).otherwise(F.col("label")),
        "source": F.when(changed, F.lit("corrigé")).otherwise(F.col("source")),
        "_room": text_or_blank("p.room"),
    }).drop("p", "m")
    moved = rename_rooms(labelled, zones)
    by_hand = F.col("_room") != ""
    return moved.withColumns({
        "room": F.when(by_hand, F.col("_room")).otherwise(F.col("room")),
        "room_dist": F.when(by_hand, F.lit(0.0)).otherwise(F.col("room_dist")),
    }).drop("_room")


def manual_symbols(objects: DataFrame, types: DataFrame, meta: DataFrame, zones: DataFrame) -> DataFrame:
    """Objects placed by hand; the room is the given one, else a locked zone, else any zone.

    ``objects(job_id, seq, id, page, page_type, reference, article, x, y, room, label, ignored)``.
    """
    shown = objects.where(~F.coalesce("ignored", F.lit(False))).withColumn("page", F.coalesce("page", F.lit(1))).join(
        types.withColumnRenamed("page_type", "_type"), ["job_id", "page"], "left")
    typed = shown.withColumn("page_type", _or("page_type", "_type")).drop("_type")
    found = _relabelled(typed, meta, "reference", "article").where("m is not null")
    locked = zone_assign(found, zones).withColumnRenamed("zone", "_locked")
    any_zone = zone_assign(found, zones, locked_only=False).withColumnRenamed("zone", "_any")
    point = ["job_id", "page", "x", "y"]
    return found.join(locked, point, "left").join(any_zone, point, "left").select(
        "job_id", "seq", "page", "page_type", _or("label", F.lit("Ajout manuel")).alias("label"), F.col("m.article").alias("article"),
        F.col("m.categorie").alias("categorie"), "x", "y", _or("room", "_locked", "_any").alias("room"), F.lit(0.0).alias("room_dist"),
        F.lit("manuel").alias("source"), text_or_blank("id").alias("detection_id"), F.lit(1.0).alias("confidence"),
        F.col("m.article").alias("original_article"), F.col("m.reference").alias("original_reference"))


def marker_overlay(trace: DataFrame, edits: DataFrame, meta: DataFrame, uncounted: DataFrame, manual: DataFrame,
                   page_sizes: DataFrame) -> DataFrame:
    """Markers of the plan view: traced symbols with pending edits, uncounted texts, manual objects.

    Positions are percentages of the page as displayed. ``page_sizes(job_id,
    page, width, height, a, b, c, d, e, f)`` holds size and rotation matrix.
    """
    pending = edits.select("job_id", F.col("object_id").alias("detection_id"), F.struct("ignored", "reference", "article", "room").alias("p"))
    patched = trace.join(pending, ["job_id", "detection_id"], "left")
    lookup = meta.select("page_type", F.col("lookup").alias("_k"), F.struct("article", "categorie", "reference").alias("m"))
    known = patched.withColumn("_k", F.nullif(text_or_blank("p.reference"), F.lit(""))).join(lookup, ["page_type", "_k"], "left")
    counted = known.select(
        "job_id", "page", "detection_id", "x", "y",
        F.coalesce(F.col("m.reference"), F.col("p.reference"), F.col("reference")).alias("reference"),
        F.coalesce(F.col("m.article"), F.col("p.article"), F.col("article")).alias("article"),
        F.coalesce(F.col("p.room"), F.col("room")).alias("room"), F.coalesce(F.col("p.ignored"), F.lit(False)).alias("ignored"),
        F.lit("counted").alias("kind"), (F.col("needs_review") | F.col("statut").startswith("À")).alias("review"))
    blank, no = F.lit(""), F.lit(False)
    texts = uncounted.select("job_id", "page", F.col("label").alias("detection_id"), "x", "y", blank.alias("reference"), blank.alias("article"),
                             "room", no.alias("ignored"), F.lit("uncatalogued").alias("kind"), no.alias("review"))
    added = manual.select("job_id", "page", F.col("id").alias("detection_id"), "x", "y", "reference", text_or_blank("article").alias("article"),
                          text_or_blank("room").alias("room"), F.coalesce("ignored", no).alias("ignored"), F.lit("manual").alias("kind"), no.alias("review"))
    placed = counted.unionByName(texts).unionByName(added).join(page_sizes, ["job_id", "page"])
    turned = F.col("kind") != "manual"
    px = F.when(turned, F.col("x") * F.col("a") + F.col("y") * F.col("c") + F.col("e")).otherwise(F.col("x"))
    py = F.when(turned, F.col("x") * F.col("b") + F.col("y") * F.col("d") + F.col("f")).otherwise(F.col("y"))
    return placed.select("job_id", "page", "detection_id", "reference", "article", "room", "ignored", "kind", "review",
                         py_round(px / F.col("width") * 100, 4).alias("left"), py_round(py / F.col("height") * 100, 4).alias("top"))


def visible_markers(markers: DataFrame, mode: str) -> DataFrame:
    """``all``, ``review`` or one kind."""
    if mode == "all":
        return markers
    return markers.where(F.col("review") if mode == "review" else F.col("kind") == mode)


# -- saved corrections ----------------------------------------------------------------------------------

def fold_corrections(versions: DataFrame) -> DataFrame:
    """Latest value per (job, key) among the versions that sent the key: ``versions(job_id, version, key, value, present)``."""
    return versions.where("present").groupBy("job_id", "key").agg(F.max_by("value", "version").alias("value"))


def relations_from_lines(lines: DataFrame) -> DataFrame:
    """Object relations chosen in the document; the last line per key wins."""
    key = strip(_or("mapping_key", relation_key("room", "material")))
    plan = lines.where(F.lower(strip(_or("origin", F.lit("pdf")))) != "manual")
    return plan.groupBy("job_id", key.alias("mapping_key")).agg(F.max_by(F.struct(
        strip("comparison_room").alias("target_room_id"), strip("comparison_material").alias("target_material"),
        F.coalesce("is_addition", F.lit(False)).alias("is_addition")), "seq").alias("r")).where("mapping_key <> ''").select(
        "job_id", "mapping_key", "r.*")


def manual_lines_of(lines: DataFrame) -> DataFrame:
    return lines.where(F.lower(strip(_or("origin", F.lit("pdf")))) == "manual")


def excluded_keys(all_keys: DataFrame, lines: DataFrame) -> DataFrame:
    """Relation keys of the plan that the document no longer shows."""
    shown = relations_from_lines(lines).select("job_id", "mapping_key")
    return all_keys.select("job_id", "mapping_key").distinct().join(shown, ["job_id", "mapping_key"], "left_anti")


def scope_guards(requests: DataFrame, scope_ids: DataFrame) -> DataFrame:
    """(job_id, verdict) per document request: which lot check fails first, else OK.

    ``requests(job_id, computed, requested, corrections_scope, document_scope)``; ``scope_ids(job_id, scope_id)``.
    """
    known = scope_ids.where(strip("scope_id") != "").select("job_id", F.col("scope_id").alias("_id")).distinct()
    asked = requests.select("job_id", *[strip(c).alias(c) for c in ("computed", "requested", "corrections_scope", "document_scope")])
    table = (
        asked.join(known.select("job_id", F.col("_id").alias("computed"), F.lit(True).alias("_c")), ["job_id", "computed"], "left")
        .join(known.select("job_id", F.col("_id").alias("requested"), F.lit(True).alias("_r")), ["job_id", "requested"], "left")
    )
    wants = F.col("requested") != ""
    differ = (F.col("corrections_scope") != "") & (F.col("document_scope") != "") & (F.col("corrections_scope") != F.col("document_scope"))
    return table.select("job_id", F.when(differ, "409 corrections et document")
                        .when(F.col("computed") == "", "409 sans scope calculé")
                        .when(F.col("_c").isNull(), "422 scope calculé inconnu")
                        .when(wants & F.col("_r").isNull(), "422 scope demandé inconnu")
                        .when(wants & (F.col("requested") != F.col("computed")), "409 scope divergent")
                        .otherwise("OK").alias("verdict"))


def refreshed_scope(saved: DataFrame, scopes: DataFrame, rooms: DataFrame, targets: DataFrame, hints: DataFrame) -> DataFrame:
    """(job_id, scope_id): lot of a reopened analysis; '' when nothing is certain.

    ``saved(job_id, audit, selected, corrections, document)``: the first non-blank is asked for,
    then the lot is inferred again.
    """
    asked = saved.select("job_id", _or("audit", "selected", "corrections", "document").alias("target"))
    direct = resolve_scopes(asked, scopes).withColumnRenamed("scope_id", "_direct")
    inferred = infer_scope(scopes, rooms, targets, hints).select("job_id", F.col("scope_id").alias("_inferred"))
    return asked.withColumn("target", strip("target")).join(direct, ["job_id", "target"], "left").join(inferred, "job_id", "left").select(
        "job_id", F.coalesce("_direct", "_inferred", F.lit("")).alias("scope_id"))


def safe_rooms(room_options: DataFrame, scope_ids: DataFrame) -> DataFrame:
    """When the listing cannot be read again: only saved rooms of known lots stay on offer."""
    return room_options.join(scope_ids.select("job_id", "scope_id").where("scope_id <> ''").distinct(), ["job_id", "scope_id"], "left_semi")
