"""Counted objects against the listing: expansion, relations, aggregation, full outer join, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import rank_by_range
from ..fixed_values import (
    ADDED, MODIFIED, NOT_DETECTED, REPORT_COLUMNS, REPORT_STATUS_ORDER, TO_VALIDATE, TRACE_COUNTED, TRACE_EXCLUDED, UNCHANGED,
)
from ..functions.amounts import positive_quantity
from ..functions.identity import is_broken_reference, new_room_id, relation_key
from ..functions.symbols import confidence, needs_review
from ..functions.text import norm_token, py_round, strip, text_or_blank
from ..session import by_job, semi_join
from .options import resolve_rooms

PLAN, MANUAL = "pdf", "manual"
GROUP = ["job_id", "room_id", "categorie", "materiel"]


# -- after side --------------------------------------------------------------------------

def without_excluded(symbols: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop symbols whose relation the user excluded."""
    excluded = exclusions.select("job_id", strip("mapping_key").alias("mapping_key")).where("mapping_key <> ''").distinct()
    # not an anti join: Spark would take it below the dealing of rows by job
    return (
        symbols.withColumn("mapping_key", relation_key("room", "article"))
        .join(excluded.withColumn("_excluded", F.lit(True)), ["job_id", "mapping_key"], "left")
        .where(F.col("_excluded").isNull()).drop("_excluded")
    )


def merged_symbols(symbols: DataFrame) -> DataFrame:
    """Equal symbols merged into one row with a quantity, a first position and the ``last`` one.

    Everything after works on these rows, so a room, article or job that holds
    most symbols is reduced on the map side before the first shuffle.
    """
    return symbols.groupBy(
        "job_id", text_or_blank("room").alias("room"), "article", text_or_blank("categorie").alias("categorie"), "page", "label"
    ).agg(F.count(F.lit(1)).alias("quantity"), F.min("seq").alias("seq"), F.max("seq").alias("last"))


def count_objects(symbols: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Merged symbols without those whose relation the user excluded."""
    return without_excluded(merged_symbols(symbols).drop("last"), exclusions)


def expand_components(objects: DataFrame, components: DataFrame) -> DataFrame:
    """Composite articles become their items; the quantity is carried instead of repeating rows."""
    items = components.select(
        F.col("article_norm").alias("_norm"), "item_rank",
        F.nullif(text_or_blank("item_article"), F.lit("")).alias("item_article"),
        F.nullif(text_or_blank("item_categorie"), F.lit("")).alias("item_categorie"),
        F.greatest(F.lit(1), F.coalesce(F.col("quantity"), F.lit(1))).cast("bigint").alias("item_quantity"),
    )
    joined = objects.withColumn("_norm", norm_token("article")).join(items, "_norm", "left")
    composite = F.col("item_quantity").isNotNull()
    return joined.select(
        "job_id", strip("room").alias("source_room"), F.col("article").alias("source_material"),
        F.coalesce("item_article", "article").alias("article"),
        F.coalesce("item_categorie", "categorie").alias("categorie"),
        "page",
        F.when(composite, F.concat_ws(" · ", "label", "article")).otherwise(F.col("label")).alias("label"),
        "mapping_key", F.lit(PLAN).alias("origin"),
        (F.col("quantity") * F.coalesce("item_quantity", F.lit(1))).alias("quantity"),
        F.struct(F.lit(0).alias("part"), F.col("seq").alias("at"), F.coalesce("item_rank", F.lit(0)).alias("item")).alias("seq"),
        F.lit(None).cast("struct<target_room_id:string,target_material:string,is_addition:boolean>").alias("inline"),
    )


def manual_rows(manual_lines: DataFrame) -> DataFrame:
    """Lines typed by the user; without a positive quantity or a material they do not count.

    ``manual_lines(job_id, seq, id, mapping_key, room, material, category, label,
    quantity_after, target_room_id, target_material, is_addition)``; ``seq`` counts from 1.
    """
    quantity = positive_quantity(F.coalesce(F.col("quantity_after").cast("string"), F.lit("1")))
    number = F.coalesce(F.nullif(text_or_blank("id"), F.lit("")), F.col("seq").cast("string"))
    typed_key = F.nullif(text_or_blank("mapping_key"), F.lit(""))
    return manual_lines.select(
        "job_id", strip("room").alias("source_room"), strip("material").alias("source_material"),
        strip("material").alias("article"), strip("category").alias("categorie"),
        F.lit(0).alias("page"),
        F.coalesce(F.nullif(strip("label"), F.lit("")), F.lit("Saisie manuelle")).alias("label"),
        strip(F.coalesce(typed_key, F.concat(F.lit("manual:"), number))).alias("mapping_key"),
        F.lit(MANUAL).alias("origin"), quantity.alias("quantity"),
        F.struct(F.lit(1).alias("part"), F.col("seq").cast("bigint").alias("at"), F.lit(0).alias("item")).alias("seq"),
        F.struct(
            text_or_blank("target_room_id").alias("target_room_id"),
            text_or_blank("target_material").alias("target_material"),
            F.coalesce("is_addition", F.lit(False)).alias("is_addition"),
        ).alias("inline"),
    ).where((F.col("quantity") > 0) & (F.col("source_material") != ""))


def after_rows(objects: DataFrame, components: DataFrame, manual_lines: DataFrame | None) -> DataFrame:
    """Plan objects that have a room, and manual lines with or without one."""
    rows = expand_components(objects, components).where("source_room <> ''")
    return rows if manual_lines is None else rows.unionByName(manual_rows(manual_lines))


# -- relations ------------------------------------------------------------------------------

def resolved_relations(relations: DataFrame, room_rows: DataFrame, index: DataFrame) -> DataFrame:
    """Relation rows with their room id and catalogue spelling; either is null when unknown.

    Input columns: job_id, target_room_id, target_material, is_addition and any others.
    """
    typed = relations.withColumns({"target": strip("target_room_id"), "raw_target": strip("target_material")})
    known = resolve_rooms(typed.select("job_id", "target"), room_rows).withColumnRenamed("room_id", "rel_room_id")
    names = index.select("job_id", F.col("name_norm").alias("_norm"), F.col("first_name").alias("canonical"))
    return (
        typed.join(known, ["job_id", "target"], "left")
        .withColumn("_norm", F.when(F.col("raw_target") != "", norm_token("raw_target")))
        .join(names, ["job_id", "_norm"], "left")
        .drop("target", "_norm", "target_room_id", "target_material")
    )


def effective_rows(after: DataFrame, relations: DataFrame, room_map: DataFrame, material_map: DataFrame,
                   room_rows: DataFrame, index: DataFrame, fit: bool = False) -> DataFrame:
    """After-rows with the room and material they count for.

    A relation (inline on a manual line, else saved for the object) decides the
    room even when it names no known one. For the material: an addition keeps
    the plan name, a known target is used, anything else leaves the automatic match. ``fit`` as of ``by_job``.
    """
    saved = resolved_relations(relations, room_rows, index).select(
        "job_id", F.col("mapping_key").alias("_plan_key"), F.struct("rel_room_id", "canonical", "raw_target", "is_addition").alias("saved"))
    inline = resolved_relations(
        after.where("inline is not null").select("job_id", "inline.*").distinct().withColumns({
            "_r": F.col("target_room_id"), "_m": F.col("target_material")}), room_rows, index
    ).select("job_id", F.struct(F.col("_r").alias("target_room_id"), F.col("_m").alias("target_material"),
                                F.col("is_addition").alias("is_addition")).alias("inline"),
             F.struct("rel_room_id", "canonical", "raw_target", "is_addition").alias("typed"))
    by_hand = F.col("inline").isNotNull()
    related = (
        by_job(after, fit).withColumn("_plan_key", F.when(~by_hand, F.col("mapping_key")))
        .join(saved, ["job_id", "_plan_key"], "left").join(inline, ["job_id", "inline"], "left")
        .where(~by_hand | F.col("typed").isNotNull()).withColumn("rel", F.when(by_hand, F.col("typed")).otherwise(F.col("saved")))
    )
    rows = related.join(
        room_map.where("room_id is not null").select("job_id", "source_room", F.col("room_id").alias("_auto_room")),
        ["job_id", "source_room"], "left",
    ).join(
        material_map.where("target is not null").select(
            "job_id", "article", F.col("target").alias("_auto"), F.col("method").alias("_how"), F.col("score").alias("_score")),
        ["job_id", "article"], "left",
    )
    explicit = F.col("rel").isNotNull()
    addition = F.coalesce(F.col("rel.is_addition"), F.lit(False))
    known_target = F.col("rel.canonical").isNotNull()
    listed = F.when(explicit, F.col("rel.rel_room_id")).otherwise(F.col("_auto_room"))
    return rows.select(
        "job_id",
        F.coalesce(listed, new_room_id("source_room")).alias("room_id"),
        listed.isNotNull().alias("room_is_listed"),
        F.when(addition, F.col("article")).when(known_target, F.col("rel.canonical"))
         .otherwise(F.coalesce("_auto", "article")).alias("materiel"),
        F.when(addition, "validé sans équivalent Excel (1.0)").when(known_target, "correspondance objet (1.0)")
         .when(F.col("_auto").isNotNull(), F.concat(F.col("_how"), F.lit(" ("), F.col("_score").cast("string"), F.lit(")")))
         .otherwise("article PDF sans équivalent").alias("mapping_method"),
        F.when(~addition & known_target, F.col("rel.canonical")).alias("explicit_material"),
        F.when(~addition & ~known_target & (F.col("rel.raw_target") != ""), F.col("rel.raw_target")).alias("unknown_target"),
        addition.alias("is_addition"), "source_room", "source_material", "article", "categorie", "page", "label",
        "mapping_key", "origin", "quantity", "seq",
    )


def merged_listing(scope_listing: DataFrame) -> DataFrame:
    """Listing rows of a group merged into one with their number ``n`` and quantity."""
    return scope_listing.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("quantite").alias("quantite"))


def category_modes(scope_listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Most frequent category per (room, material) and per material; the smallest name wins a tie. Merged rows count ``n`` times."""
    n = F.col("n") if "n" in scope_listing.columns else F.lit(1)
    counted = scope_listing.where((F.col("materiel") != "") & (F.col("categorie") != "")).groupBy(
        "job_id", "room_id", "materiel", "categorie").agg(F.sum(n).alias("n"))

    def mode(df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "categorie")).alias("m")).select(
            *keys, F.col("m.categorie").alias(out))

    per_material = counted.groupBy("job_id", "materiel", "categorie").agg(F.sum("n").alias("n"))
    return (mode(counted, ["job_id", "room_id", "materiel"], "room_category"),
            mode(per_material, ["job_id", "materiel"], "material_category"))


def with_category(rows: DataFrame, scope_listing: DataFrame) -> DataFrame:
    """Category of the listing for that room, else for that material, else the plan's own."""
    by_room, by_material = category_modes(scope_listing)
    return rows.join(by_room, ["job_id", "room_id", "materiel"], "left").join(by_material, ["job_id", "materiel"], "left").withColumn(
        "categorie", F.coalesce("room_category", "material_category", strip("categorie"))
    ).drop("room_category", "material_category")


# -- aggregation and full outer join ------------------------------------------------------------

def _in_order(field: str, separator: str) -> Column:
    """Distinct non-blank values of the collected rows, in order of first appearance."""
    values = F.transform(F.col("_rows"), lambda r: strip(r[field]))
    kept = F.filter(F.array_distinct(values), lambda v: (v != "") & (F.lower(v) != "nan"))
    return F.array_join(kept, separator)


def after_groups(mapped: DataFrame) -> DataFrame:
    """After side per (room, category, material) with its provenance.

    Rows with equal provenance are merged first, so a group collects only its
    distinct provenances, however many objects it counts.
    """
    shown = ["label", "source_room", "source_material", "origin", "mapping_key", "mapping_method"]
    merged = mapped.groupBy(*GROUP, *shown, "page").agg(
        F.sum("quantity").alias("quantity"), F.min("seq").alias("seq"), F.max("is_addition").alias("is_addition"))
    grouped = merged.groupBy(*GROUP).agg(
        F.sum("quantity").alias("quantite_apres"),
        F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page").cast("int")))).alias("_pages"),
        F.array_sort(F.collect_list(F.struct("seq", *shown))).alias("_rows"),
        F.max("is_addition").alias("is_addition"),
    )
    return grouped.select(
        *GROUP, "quantite_apres", "is_addition",
        F.array_join(F.transform("_pages", lambda p: p.cast("string")), ",").alias("pages"),
        _in_order("label", ", ").alias("labels"),
        _in_order("source_room", " | ").alias("source_room"),
        _in_order("source_material", " | ").alias("source_material"),
        _in_order("origin", " + ").alias("origin"),
        _in_order("mapping_key", " | ").alias("mapping_key"),
        _in_order("mapping_method", " | ").alias("mapping_method"),
    )


def before_rows(scope_listing: DataFrame, mapped: DataFrame, fit: bool = False) -> DataFrame:
    """Listing rows of the rooms something was counted in; broken references never count. ``fit`` as of ``by_job``."""
    targeted = mapped.where("room_is_listed").select("job_id", "room_id").distinct()
    usable = scope_listing.where((F.col("materiel") != "") & ~is_broken_reference("materiel"))
    return semi_join(usable, targeted, ["job_id", "room_id"], fit)


def before_groups(before: DataFrame) -> DataFrame:
    return before.groupBy(*GROUP).agg(F.sum("quantite").alias("quantite_avant"))


def known_materials(mapped: DataFrame, material_map: DataFrame) -> DataFrame:
    """Materials a job has an accepted match for: automatic targets and explicit relations."""
    automatic = material_map.where("target is not null").select("job_id", F.col("target").alias("materiel"))
    explicit = mapped.where("explicit_material is not null").select("job_id", F.col("explicit_material").alias("materiel"))
    return automatic.union(explicit).distinct()


def status(before: Column, after: Column, addition: Column, known: Column) -> Column:
    return (
        F.when((before != 0) & (after == 0), NOT_DETECTED)
        .when((before == 0) & (after != 0), F.when(addition | known, ADDED).otherwise(TO_VALIDATE))
        .when(before == after, UNCHANGED).otherwise(MODIFIED)
    )


def reconcile(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """Full outer join of both sides with difference and status.

    Each side has one row per group, so the join is a union grouped again: unlike a join it leaves rows dealt by job where
    they are. As in a join a null equals nothing.
    """
    zero = F.lit(0).cast("bigint")
    fields = {f.name: f.dataType for side in (before, after) for f in side.schema if f.name not in GROUP}

    def side(df: DataFrame, name: str) -> DataFrame:
        unnamed = F.concat(*[F.col(c).cast("string") for c in GROUP]).isNull()
        return df.select(*GROUP, F.when(unnamed, name).alias("_side"), *[
            F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in fields.items()])

    both = side(before, "before").unionByName(side(after, "after")).groupBy(*GROUP, "_side").agg(*[F.max(c).alias(c) for c in fields])
    merged = both.join(known.withColumn("_known", F.lit(True)), ["job_id", "materiel"], "left")
    counts = merged.withColumns({
        "quantite_avant": F.coalesce("quantite_avant", zero), "quantite_apres": F.coalesce("quantite_apres", zero),
        "is_addition": F.coalesce("is_addition", F.lit(False)), "_known": F.coalesce("_known", F.lit(False)),
        **{c: F.coalesce(c, F.lit("")) for c in (
            "pages", "labels", "source_room", "source_material", "origin", "mapping_key", "mapping_method")},
    })
    return counts.select(
        *GROUP, "quantite_avant", "quantite_apres",
        (F.col("quantite_apres") - F.col("quantite_avant")).alias("ecart"),
        status(F.col("quantite_avant"), F.col("quantite_apres"), F.col("is_addition"), F.col("_known")).alias("statut"),
        "pages", "labels", "source_room", "source_material",
        F.when(F.col("origin") == "", "excel").otherwise(F.col("origin")).alias("origin"),
        "mapping_key", "mapping_method", "is_addition",
        F.when(F.col("mapping_method") == "", "maquette seule").otherwise(F.col("mapping_method")).alias("rapprochement"),
    )


def room_descriptions(room_rows: DataFrame, mapped: DataFrame, levels: DataFrame) -> DataFrame:
    """Level, lot, occupant and names per room id; rooms only the plan knows get made-up ones.

    ``levels(job_id, display_level)``.
    """
    fields = ["niveau", "scope_id", "occupation", "piece", "numero", "room_label"]
    listed = room_rows.groupBy("job_id", "room_id").agg(F.max_by(F.struct(*fields), "first_seen").alias("d")).select(
        "job_id", "room_id", "d.*")
    fresh = mapped.where("not room_is_listed").groupBy("job_id", "room_id").agg(F.min_by("source_room", "seq").alias("_room"))
    name = F.when(F.col("_room") != "", F.concat(F.col("_room"), F.lit(" [nouvelle pièce]"))).otherwise("")
    blank = F.lit("")
    made_up = fresh.join(levels, "job_id", "left").select(
        "job_id", "room_id", F.coalesce("display_level", blank).alias("niveau"), blank.alias("scope_id"),
        blank.alias("occupation"), name.alias("piece"), blank.alias("numero"), name.alias("room_label"))
    return listed.unionByName(made_up)


def describe(comparison: DataFrame, descriptions: DataFrame) -> DataFrame:
    fields = ["niveau", "scope_id", "occupation", "piece", "numero", "room_label"]
    return comparison.join(descriptions, ["job_id", "room_id"], "left").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in fields})


# -- traceability and reports -----------------------------------------------------------------------

def object_targets(symbols: DataFrame, exclusions: DataFrame, relations: DataFrame, room_map: DataFrame,
                   material_map: DataFrame, room_rows: DataFrame, index: DataFrame) -> DataFrame:
    """Effective room and material per relation key; of several spellings the last counts.

    Merged symbols have their last place in ``last``.
    """
    at = F.max("last" if "last" in symbols.columns else "seq")
    last = without_excluded(
        symbols.groupBy("job_id", text_or_blank("room").alias("room"), "article").agg(at.alias("seq")), exclusions
    ).groupBy("job_id", "mapping_key").agg(F.max_by(F.struct("room", "article"), "seq").alias("o"))
    plain = last.select(
        "job_id", "mapping_key", strip("o.room").alias("source_room"), F.col("o.article").alias("article"),
        F.col("o.article").alias("source_material"), F.lit("").alias("categorie"), F.lit(0).alias("page"),
        F.lit("").alias("label"), F.lit(PLAN).alias("origin"), F.lit(1).cast("bigint").alias("quantity"),
        F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("item")).alias("seq"),
        F.lit(None).cast("struct<target_room_id:string,target_material:string,is_addition:boolean>").alias("inline"))
    return effective_rows(plain, relations, room_map, material_map, room_rows, index).select(
        "job_id", "mapping_key", "room_id", "room_is_listed", "materiel", "is_addition")


def trace(symbols: DataFrame, exclusions: DataFrame, targets: DataFrame, comparison: DataFrame,
          references: DataFrame, material_map: DataFrame, room_rows: DataFrame, merged: DataFrame | None = None,
          fit: bool = False) -> DataFrame:
    """One row per symbol: what it was counted as, and the status of that line.

    ``merged`` is ``merged_symbols(symbols)`` where at hand; ``fit`` as of ``by_job``.
    """
    statuses = comparison.groupBy("job_id", "room_id", "materiel").agg(F.max_by("statut", "categorie").alias("_statut"))
    scope_of = room_rows.select("job_id", "room_id", "scope_id").distinct()
    per_target = targets.join(statuses, ["job_id", "room_id", "materiel"], "left").join(scope_of, ["job_id", "room_id"], "left").select(
        "job_id", "mapping_key", F.struct("room_id", "materiel", "_statut", "scope_id").alias("t"))
    ignored = exclusions.select("job_id", strip("mapping_key").alias("mapping_key")).distinct().withColumn("_ignored", F.lit(True))
    fallback = material_map.where("target is not null").select("job_id", "article", F.col("target").alias("_auto"))
    # Look everything up once per distinct object, then join the symbols a single time.
    objects = (
        by_job((symbols if merged is None else merged).select("job_id", text_or_blank("room").alias("room"), "article"), fit).distinct()
        .withColumn("mapping_key", relation_key("room", "article"))
        .join(per_target, ["job_id", "mapping_key"], "left")
        .join(ignored, ["job_id", "mapping_key"], "left")
        .join(fallback, ["job_id", "article"], "left")
        .join(references.withColumnRenamed("reference", "_reference"), "article", "left")
    )
    rows = by_job(symbols.withColumn("room", text_or_blank("room")), fit).join(objects, ["job_id", "room", "article"])
    is_ignored = F.coalesce("_ignored", F.lit(False))
    statut = F.when(is_ignored, TRACE_EXCLUDED).otherwise(F.coalesce(F.col("t._statut"), F.lit(TRACE_COUNTED)))
    reference = F.coalesce("_reference", F.lit("?"))
    return rows.select(
        "job_id", "seq", reference.alias("reference"), "detection_id", "mapping_key",
        F.coalesce(F.col("t.room_id"), F.lit("")).alias("room_id"), F.coalesce(F.col("t.scope_id"), F.lit("")).alias("scope_id"),
        F.col("page").cast("int").alias("page"), "page_type", "source", "label", "article", "categorie",
        F.coalesce(F.nullif("original_article", F.lit("")), "article").alias("original_article"),
        F.coalesce(F.nullif("original_reference", F.lit("")), reference).alias("original_reference"),
        py_round(confidence("confidence", "source", "label"), 2).alias("confidence"),
        text_or_blank("room").alias("room"), py_round("room_dist", 1).alias("room_dist"),
        py_round("x", 1).alias("x"), py_round("y", 1).alias("y"),
        F.coalesce(F.col("t.materiel"), F.col("_auto"), F.col("article")).alias("materiel_compare"),
        is_ignored.alias("ignored"), (~is_ignored & needs_review(statut)).alias("needs_review"), statut.alias("statut"),
    )


REPORT_ORDER = ["job_id", "niveau", "occupation", "piece", "categorie", "materiel", "room_id"]


def report_table(comparison: DataFrame) -> DataFrame:
    """The comparison sheet: seventeen named columns, per job."""
    return comparison.select("job_id", *[F.col(c).alias(title) for c, title in REPORT_COLUMNS])


def report_ranks(comparison: DataFrame) -> DataFrame:
    """The described comparison with ``rang``, the row's place in its job's sheet."""
    filled = comparison.withColumns({c: F.coalesce(c, F.lit("")) for c in REPORT_ORDER if c != "job_id"})
    return rank_by_range(filled, ["job_id"], REPORT_ORDER[1:], "rang")


def status_counts(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("job_id", "statut").agg(F.count(F.lit(1)).alias("lignes"))


def report_summary(comparison: DataFrame, room_map: DataFrame, material_map: DataFrame) -> DataFrame:
    """(job_id, ord, label, value): the summary sheet; statuses that do not occur show 0."""
    rooms = room_map.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("room_id").isNotNull()).alias("matched"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("room_id").isNull(), F.col("source_room")))), ", ").alias("missing"))
    suggested = material_map.groupBy("job_id").agg(
        F.max(F.coalesce(F.col("method") == "llm", F.lit(False))).alias("suggested"))
    counts = comparison.groupBy("job_id").agg(*[
        F.count_if(F.col("statut") == s).alias(f"s{i}") for i, s in enumerate(REPORT_STATUS_ORDER)])
    wide = counts.join(rooms, "job_id", "left").join(suggested, "job_id", "left")
    lines = [
        ("Pièces reconnues sur le plan", F.coalesce("seen", F.lit(0)).cast("string")),
        ("Pièces rapprochées avec la maquette", F.coalesce("matched", F.lit(0)).cast("string")),
        ("Pièces non rapprochées", F.coalesce(F.nullif("missing", F.lit("")), F.lit("—"))),
        ("Rapprochement des noms par LLM", F.when(F.col("suggested"), "oui").otherwise("non (fuzzy local)")),
        *[(f"Lignes « {s} »", F.col(f"s{i}").cast("string")) for i, s in enumerate(REPORT_STATUS_ORDER)],
    ]
    return wide.select("job_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(lines)
    ])).alias("l")).select("job_id", "l.*")


def symbol_totals(symbols: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Symbols kept per job, in all and by vision."""
    kept = without_excluded(symbols.groupBy("job_id", text_or_blank("room").alias("room"), "article", "source").agg(
        F.count(F.lit(1)).alias("n")), exclusions)
    return kept.groupBy("job_id").agg(
        F.sum("n").alias("symboles_detectes"),
        F.sum(F.when(F.col("source") == "vision", F.col("n")).otherwise(0)).alias("symboles_vision"))


def catalog_entries(catalog: DataFrame, rank: Column) -> DataFrame:
    """(page_type, article, categorie, reference): the first entry of each catalogue article."""
    first = catalog.groupBy("page_type", "article").agg(F.min_by(F.struct("categorie", "reference"), rank).alias("e"))
    return first.select("page_type", "article", F.col("e.categorie").alias("categorie"), F.coalesce("e.reference", F.lit("?")).alias("reference"))


def catalog_coverage(symbols: DataFrame, exclusions: DataFrame, catalog: DataFrame, rank: Column) -> DataFrame:
    """Count per catalogue article of a page type in every job that has any; the other entries of ``catalog_entries`` count 0.

    Zeros aren't written out: a table of jobs times catalogue entries would say nothing more.
    """
    kept = without_excluded(symbols.groupBy("job_id", "page_type", text_or_blank("room").alias("room"), "article").agg(
        F.count(F.lit(1)).alias("n")), exclusions)
    counts = kept.groupBy("job_id", "page_type", "article").agg(F.sum("n").alias("n"))
    return counts.join(catalog_entries(catalog, rank), ["page_type", "article"]).select(
        "job_id", "page_type", "article", "categorie", "reference", "n")


def components_present(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """Component rules whose composite article occurs in the plan, one row per item."""
    seen = symbols.select("job_id", norm_token("article").alias("article_norm")).distinct()
    return seen.join(components.where(strip("item_article") != ""), "article_norm").select(
        "job_id", strip("article").alias("article"), "item_rank", strip("item_article").alias("item_article"),
        strip("item_categorie").alias("item_categorie"),
        F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1)).cast("bigint").alias("quantity"))


def output_checks(jobs: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """(job_id, verdict): the first required output a job lacks or leaves empty, else OK."""
    checked, verdict = jobs.select("job_id").distinct(), None
    for name, table in outputs.items():
        rows = table.groupBy("job_id").agg(F.count(F.lit(1)).alias(f"_{name}"))
        checked = checked.join(rows, "job_id", "left")
        missing = F.col(f"_{name}").isNull()
        verdict = F.when(missing, f"vide : {name}") if verdict is None else verdict.when(missing, f"vide : {name}")
    return checked.select("job_id", verdict.otherwise("OK").alias("verdict"))
