"""Lots ("scopes") and rooms of a listing, and the choice of the lot a plan covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HINT_MIN_LENGTH, HINT_STOP_WORDS
from ..functions.identity import (
    is_broken_reference, is_usable_material, room_id, room_label, scope_id, scope_label,
)
from ..functions.text import norm_token, not_blank, strip


#: What a comparison reads of listing rows with their identities.
LISTING_COLUMNS = ["job_id", "sheet_idx", "row_idx", "niveau", "occupation", "piece", "numero", "categorie", "materiel", "quantite",
                   "room_id", "scope_id"]


def listing_order() -> Column:
    return F.struct("sheet_idx", "row_idx")


def sorted_by_name(names: Column) -> Column:
    """Array of names in the order of their normalised form."""
    keyed = F.array_sort(F.transform(names, lambda v: F.struct(norm_token(v).alias("k"), v.alias("v"))))
    return F.transform(keyed, lambda x: x["v"])


# -- identities ----------------------------------------------------------------

def identities(listing: DataFrame) -> DataFrame:
    """One row per distinct (niveau, occupation, piece, numero), with its first position."""
    parts = ["niveau", "occupation", "piece", "numero"]
    return listing.groupBy("job_id", *[strip(c).alias(c) for c in parts]).agg(
        F.min(listing_order()).alias("first_seen")
    ).withColumns({
        "scope_id": scope_id("niveau", "occupation", "numero"),
        "room_id": room_id(*parts),
        "room_label": room_label(*parts),
        "piece_norm": norm_token("piece"),
    }).withColumn("label_norm", norm_token("room_label"))


def rooms(identity_rows: DataFrame) -> DataFrame:
    return identity_rows.where(F.col("piece") != "")


def scopes(identity_rows: DataFrame) -> DataFrame:
    """One row per lot, labelled by its first spelling."""
    return identity_rows.groupBy("job_id", "scope_id").agg(
        F.min_by(F.struct("niveau", "occupation", "numero"), "first_seen").alias("i"),
    ).select(
        "job_id", "scope_id", "i.*",
        scope_label("i.niveau", "i.occupation", "i.numero").alias("scope_label"),
    )


def scope_options(listing: DataFrame) -> DataFrame:
    """Lots with their sorted rooms and materials."""
    sets = listing.groupBy("job_id", "scope_id").agg(
        F.min_by(F.struct(*[strip(c).alias(c) for c in ("niveau", "occupation", "numero")]), listing_order()).alias("i"),
        F.collect_set(F.when(not_blank("piece"), strip("piece"))).alias("_pieces"),
        F.collect_set(F.when(is_usable_material("materiel"), strip("materiel"))).alias("_materiels"),
    )
    return sets.select(
        "job_id", "scope_id", "i.*",
        scope_label("i.niveau", "i.occupation", "i.numero").alias("scope_label"),
        sorted_by_name(F.col("_pieces")).alias("pieces"),
        F.size("_pieces").alias("piece_count"),
        sorted_by_name(F.col("_materiels")).alias("materiels"),
    )


def room_inventory(listing: DataFrame) -> DataFrame:
    """Quantity per (room, material, category); broken references left out."""
    parts = ["niveau", "occupation", "piece", "numero"]
    usable = listing.where(not_blank("piece") & is_usable_material("materiel"))
    return usable.groupBy(
        "job_id", *[strip(c).alias(c) for c in (*parts, "materiel", "categorie")]
    ).agg(F.sum("quantite").alias("quantite")).withColumns({
        "room_id": room_id(*parts), "scope_id": scope_id("niveau", "occupation", "numero"),
    })


def room_options(listing: DataFrame) -> DataFrame:
    """Rooms with their sorted inventory; rooms without usable material keep an empty one."""
    parts = ["niveau", "occupation", "piece", "numero"]
    entry = F.struct(
        norm_token("materiel").alias("k1"), norm_token("categorie").alias("k2"),
        F.col("materiel").alias("name"), F.col("categorie").alias("category"), F.col("quantite").alias("quantity"),
    )
    stock = room_inventory(listing).groupBy("job_id", *parts).agg(F.array_sort(F.collect_list(entry)).alias("_stock"))
    entries = F.coalesce("_stock", F.array().cast(
        "array<struct<k1:string,k2:string,name:string,category:string,quantity:bigint>>"))
    return rooms(identities(listing)).join(stock, ["job_id", *parts], "left").select(
        "job_id", "room_id", "scope_id", "room_label", *parts, "first_seen",
        sorted_by_name(F.array_distinct(F.transform(entries, lambda e: e["name"]))).alias("materiels"),
        F.transform(entries, lambda e: F.struct(e["name"].alias("name"), e["category"].alias("category"),
                                                e["quantity"].alias("quantity"))).alias("materials"),
    )


# -- resolving what users typed ----------------------------------------------------

def _unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value where exactly one row holds the key."""
    return df.groupBy("job_id", F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)
    ).where(F.col("_n") == 1).drop("_n")


def _resolve(targets: DataFrame, options: DataFrame, value: str, fields: tuple[str, str]) -> DataFrame:
    wanted = targets.select("job_id", strip("target").alias("target")).where(F.col("target") != "").distinct().withColumn(
        "_norm", norm_token("target"))
    by_id = options.select("job_id", F.col(value).alias("target"), F.col(value).alias("_v0")).distinct()
    found = wanted.join(by_id, ["job_id", "target"], "left")
    for n, field in enumerate(fields, start=1):
        table = _unique(options, field, value).select("job_id", F.col("_key").alias("_norm"), F.col(value).alias(f"_v{n}"))
        found = found.join(table, ["job_id", "_norm"], "left")
    return found.select("job_id", "target", F.coalesce("_v0", "_v1", "_v2").alias(value)).where(F.col(value).isNotNull())


def resolve_rooms(targets: DataFrame, room_rows: DataFrame) -> DataFrame:
    """(job_id, target) -> room_id by id, else unique label, else unique room name.

    An ambiguous name resolves to nothing; unresolved targets are absent.
    """
    return _resolve(targets, room_rows, "room_id", ("label_norm", "piece_norm"))


def resolve_scopes(targets: DataFrame, scope_rows: DataFrame) -> DataFrame:
    """(job_id, target) -> scope_id by id, else unique label, else unique occupant."""
    keyed = scope_rows.withColumns({
        "label_norm": norm_token("scope_label"), "occupation_norm": norm_token("occupation")})
    return _resolve(targets, keyed, "scope_id", ("label_norm", "occupation_norm"))


# -- choosing the lot -----------------------------------------------------------------

def filter_level(listing: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of the level asked for; a level hint only filters jobs it matches something in.

    ``params(job_id, niveau_excel, niveau_hint)``; a job without params keeps every row.
    """
    wanted = params.select("job_id", F.lower(strip("niveau_excel")).alias("_level"),
                           F.lower(strip("niveau_hint")).alias("_hint"))
    rows = listing.join(wanted, "job_id", "left").withColumns({
        "_level": F.coalesce("_level", F.lit("")), "_hint": F.coalesce("_hint", F.lit(""))})
    asked = F.col("_level") != ""
    level_ok = F.lower("niveau") == F.col("_level")
    hint_ok = (F.col("_hint") != "") & F.contains(F.lower("niveau"), F.col("_hint"))
    hits = rows.where(~asked & hint_ok).select("job_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, "job_id", "left").where(
        F.when(asked, level_ok).when(F.col("_hit"), hint_ok).otherwise(True)
    ).drop("_level", "_hint", "_hit")


def level_errors(listing: DataFrame, params: DataFrame) -> DataFrame:
    """Jobs whose requested level does not exist."""
    asked = params.where(strip("niveau_excel") != "").select("job_id", F.lower(strip("niveau_excel")).alias("_level"), "niveau_excel")
    known = listing.select("job_id", F.lower("niveau").alias("_level")).distinct()
    return asked.join(known, ["job_id", "_level"], "left_anti").select("job_id", "niveau_excel")


def _words(c) -> Column:
    return F.filter(F.array_distinct(F.split(norm_token(c), " ")),
                    lambda w: (F.length(w) >= HINT_MIN_LENGTH) & ~w.isin(HINT_STOP_WORDS))


def infer_scope(scope_rows: DataFrame, room_rows: DataFrame, targets: DataFrame, hints: DataFrame) -> DataFrame:
    """(job_id, scope_id, method) for the jobs where exactly one lot can be shown to be meant.

    In order: the only lot of the level; the one lot all saved room targets lie
    in; the lot whose occupant shares most distinctive words with a hint (a tie
    decides nothing).
    """
    only = scope_rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("scope_id").alias("s")).where("n = 1").select(
        "job_id", F.col("s").alias("_only"))
    scope_of_room = room_rows.select("job_id", "room_id", "scope_id").distinct()
    targeted = (
        resolve_rooms(targets, room_rows).join(scope_of_room, ["job_id", "room_id"])
        .groupBy("job_id").agg(F.min("scope_id").alias("_saved"), F.max("scope_id").alias("_other"))
        .where(F.col("_saved") == F.col("_other")).drop("_other")
    )
    hint_words = hints.select("job_id", F.explode(F.filter(_words("hint"), lambda w: ~w.rlike("^[0-9]+$"))).alias("w")).distinct()
    scope_words = scope_rows.select("job_id", "scope_id", _words("occupation").alias("_all")).select(
        "job_id", "scope_id", F.size("_all").alias("_size"), F.explode("_all").alias("w"))
    shares = scope_words.join(hint_words, ["job_id", "w"]).groupBy("job_id", "scope_id", "_size").agg(
        F.count(F.lit(1)).alias("shared"))
    strength = F.struct("shared", F.rint(F.lit(1000.0) * F.col("shared") / F.greatest(F.col("_size"), F.lit(1))).alias("share"))
    hinted = (
        shares.withColumn("strength", strength).groupBy("job_id", "strength")
        .agg(F.count(F.lit(1)).alias("n"), F.min("scope_id").alias("scope_id"))
        .groupBy("job_id").agg(F.max_by(F.struct("n", "scope_id"), "strength").alias("best"))
        .where("best.n = 1").select("job_id", F.col("best.scope_id").alias("_hinted"))
    )
    jobs = scope_rows.select("job_id").distinct()
    return (
        jobs.join(only, "job_id", "left").join(targeted, "job_id", "left").join(hinted, "job_id", "left")
        .select(
            "job_id",
            F.coalesce("_only", "_saved", "_hinted").alias("scope_id"),
            F.when(F.col("_only").isNotNull(), "seul pôle du niveau")
             .when(F.col("_saved").isNotNull(), "relations sauvegardées")
             .when(F.col("_hinted").isNotNull(), "nom du PDF").alias("method"),
        ).where(F.col("scope_id").isNotNull())
    )


def choose_scope(scope_rows: DataFrame, room_rows: DataFrame, params: DataFrame, targets: DataFrame) -> DataFrame:
    """(job_id, scope_id, method, n_scopes): the user's choice, else the inferred one, else null."""
    asked = params.select("job_id", strip("excel_scope_id").alias("target")).where(F.col("target") != "")
    explicit = resolve_scopes(asked, scope_rows).select("job_id", F.col("scope_id").alias("_explicit"))
    inferred = infer_scope(scope_rows, room_rows, targets, params.select("job_id", F.col("scope_hint").alias("hint")))
    counts = scope_rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_scopes"))
    return (
        counts.join(asked, "job_id", "left").join(explicit, "job_id", "left").join(inferred, "job_id", "left")
        .select(
            "job_id", "n_scopes",
            F.when(F.col("target").isNotNull(), F.col("_explicit")).otherwise(F.col("scope_id")).alias("scope_id"),
            F.when(F.col("_explicit").isNotNull(), "sélection utilisateur")
             .when(F.col("target").isNull(), F.col("method")).alias("method"),
            (F.col("target").isNotNull() & F.col("_explicit").isNull()).alias("unknown_scope"),
        )
    )


def filter_scope(listing: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen lot. Several lots and no choice leave nothing: better empty than mixed."""
    choice = chosen.select("job_id", F.col("scope_id").alias("_chosen"), "n_scopes")
    return listing.join(choice, "job_id").where(
        F.when(F.col("_chosen").isNotNull(), F.col("scope_id") == F.col("_chosen")).otherwise(F.col("n_scopes") <= 1)
    ).drop("_chosen", "n_scopes")


# -- audits -----------------------------------------------------------------------------

def level_summary(listing: DataFrame) -> DataFrame:
    return listing.groupBy("job_id", "niveau").agg(
        F.countDistinct("piece").alias("pieces"),
        F.count(F.lit(1)).alias("lignes"),
        F.sum("quantite").alias("quantite"),
        F.countDistinct("scope_id").alias("n_scopes"),
    )


def broken_references(scope_listing: DataFrame) -> DataFrame:
    """Rows and quantity per job that hold a broken spreadsheet reference."""
    return scope_listing.where(is_broken_reference("materiel")).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantite").alias("quantite"))


def listing_audit(listing: DataFrame, scope_listing: DataFrame, chosen: DataFrame, correspondences: DataFrame) -> DataFrame:
    """The fourteen control figures of a listing, one row per job."""
    raw_room = F.struct(*[strip(c) for c in ("niveau", "occupation", "piece", "numero")])
    whole = listing.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("lignes_materiel"),
        F.countDistinct("piece").alias("pieces_uniques"),
        F.countDistinct(F.when(not_blank("piece"), raw_room)).alias("pieces_physiques"),
        F.countDistinct("scope_id").alias("scopes_physiques"),
        F.sum("quantite").alias("quantite_totale"),
        F.array_join(F.array_sort(F.collect_set("niveau")), "|").alias("niveaux"),
        F.count_if(F.col("code_article") != "").alias("codes_articles_renseignes"),
    )
    broken = is_broken_reference("materiel")
    part = scope_listing.groupBy("job_id").agg(
        F.countDistinct(F.when(not_blank("piece"), raw_room)).alias("pieces_scope_selectionne"),
        F.sum("quantite").alias("quantite_scope_selectionne"),
        F.count_if(broken).alias("references_formule_invalides"),
        F.sum(F.when(broken, F.col("quantite")).otherwise(0)).alias("quantite_references_invalides"),
    )
    given = correspondences.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "room").alias("correspondances_pieces"),
        F.count_if(F.col("kind") == "material").alias("correspondances_articles"),
    )
    picked = chosen.select("job_id", F.coalesce("scope_id", F.lit("")).alias("scope_selectionne"))
    joined = whole.join(picked, "job_id", "left").join(part, "job_id", "left").join(given, "job_id", "left")
    zero = [c for c in joined.columns if c not in ("job_id", "niveaux", "scope_selectionne")]
    return joined.na.fill(0, zero).na.fill("", ["scope_selectionne"])


def reference_lists(scope_listing: DataFrame) -> DataFrame:
    """(job_id, kind, value): distinct rooms and materials users may pick from."""
    entries = scope_listing.select("job_id", F.explode(F.array(
        F.struct(F.lit("piece").alias("kind"), F.when(not_blank("piece"), F.col("piece")).alias("value")),
        F.struct(F.lit("materiel").alias("kind"), F.when(is_usable_material("materiel"), F.col("materiel")).alias("value")),
    )).alias("e")).select("job_id", "e.*")
    return entries.where(F.col("value").isNotNull()).distinct()
