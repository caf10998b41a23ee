"""Lines of the priced document: groups of counted objects, saved choices, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import format_euro, legacy_quantity_after, line_total, vat
from ..functions.identity import is_broken_reference, relation_key
from ..session import cut_lineage
from ..functions.text import norm_token, strip, text_or_blank, tidy
from .options import resolve_rooms
from .ordered import rank_by_range
from .overlay import _or
from .reconcile import REPORT_ORDER

NEW_ROOM = " [nouvelle pièce]"
TABLE_ORDER = [c for c in REPORT_ORDER if c != "job_id"]


# -- lines as typed ------------------------------------------------------------------------------

def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines in today's columns, without NUL characters and outer spaces; empty ones are dropped.

    ``lines(job_id, seq, id, mapping_key, origin, room, lot, sous_lot, material, category,
    comparison_room, comparison_material, is_addition, quantity_before, market_quantity,
    quantity_after, additional_quantity, unit_price)``; a null is a field that was not sent.
    """
    before = tidy(F.coalesce("quantity_before", "market_quantity"))
    after = F.when(F.col("quantity_after").isNotNull(), tidy("quantity_after")).otherwise(
        legacy_quantity_after(before, tidy("additional_quantity")))
    texts = ["id", "mapping_key", "room", "lot", "sous_lot", "material", "category", "comparison_room", "comparison_material", "unit_price"]
    return lines.select(
        "job_id", "seq", F.when(F.lower(text_or_blank("origin")) == "manual", "manual").otherwise("pdf").alias("origin"),
        *[tidy(c).alias(c) for c in texts],
        F.coalesce("is_addition", F.lit(False)).alias("is_addition"), before.alias("quantity_before"), after.alias("quantity_after"),
    ).where("room <> '' or material <> ''")


def lot_pricing(lines: DataFrame) -> DataFrame:
    """Per lot: subtotal, 10 % tax rounded half up, total; ``lot_order`` is the first line's position."""
    sums = lines.groupBy("job_id", text_or_blank("lot").alias("lot")).agg(
        F.min("seq").alias("lot_order"),
        F.coalesce(F.sum(line_total("quantity_after", "unit_price")), F.lit(0)).cast("decimal(38,8)").alias("subtotal"))
    taxed = sums.withColumn("tax", vat("subtotal"))
    return taxed.select(
        "job_id", "lot", "lot_order", format_euro("subtotal").alias("subtotal"), format_euro("tax").alias("tax"),
        format_euro(F.col("subtotal") + F.col("tax")).alias("total"))


# -- groups of counted objects ----------------------------------------------------------------------

def plan_groups(trace: DataFrame, include_ignored: bool = False) -> DataFrame:
    """Traced objects per relation key, compared material and category, shown as first spelled."""
    seen = trace if include_ignored else trace.where(~F.coalesce("ignored", F.lit(False)))
    alike = seen.groupBy("job_id", "room", "article", "original_article", "materiel_compare", "categorie").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    named = alike.select(
        "job_id", "n", "seq", tidy("room").alias("room"),
        tidy(_or("article", "original_article", "materiel_compare")).alias("material"),
        tidy(_or("materiel_compare", "article", "original_article")).alias("comparison_material"),
        tidy("categorie").alias("category"),
    ).where("material <> ''").withColumns({
        "mapping_key": relation_key("room", "material"), "_k1": norm_token("comparison_material"), "_k2": norm_token("category")})
    grouped = named.groupBy("job_id", "mapping_key", "_k1", "_k2").agg(
        F.sum("n").alias("quantity_after"), F.min(F.struct("seq", "room", "material", "comparison_material", "category")).alias("f"))
    return grouped.select("job_id", "mapping_key", F.col("f.room").alias("room"), F.col("f.material").alias("material"),
                          F.col("f.comparison_material").alias("comparison_material"), F.col("f.category").alias("category"),
                          "quantity_after", F.col("f.seq").alias("first_seq"))


def numbered_groups(groups: DataFrame) -> DataFrame:
    """Groups with their position ``n`` by room, material, category, then first appearance."""
    keyed = groups.withColumns({"_r": norm_token("room"), "_m": norm_token("material"), "_c": norm_token("category")})
    return rank_by_range(keyed, ["job_id"], ["_r", "_m", "_c", "first_seq"], "n").drop("_r", "_m", "_c")


def _room_material_keys(room, *materials) -> Column:
    room = norm_token(room)
    keys = [F.when((room != "") | (norm_token(m) != ""), F.concat(room, F.lit("|"), norm_token(m))) for m in materials]
    return F.array_compact(F.array_distinct(F.array(*keys)))


def _answered(asked: DataFrame, answers: DataFrame, ask: list[str]) -> DataFrame:
    """Each line with the answer to what it asks; a null among the last key's values is a value like others."""
    *keys, last = ask
    answers = answers.withColumnRenamed(last, "_last")
    same = F.col(last).eqNullSafe(F.col("_last"))
    return asked.join(answers.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k) == F.col(f"_{k}") for k in keys] + [same]).drop("_last", *(f"_{k}" for k in keys))


def _first_match(wanted: DataFrame, comparison: DataFrame, prefer_category: bool) -> DataFrame:
    """Before-quantity per ``line`` from the comparison row its rooms and materials point to.

    ``wanted(job_id, line, rooms ARRAY, pieces ARRAY, materials ARRAY, category_norm)`` is read twice. Rooms match by id
    or by name: both become one kind of key, so the join is an equality. Lines that ask the same are answered once: a line
    meets one row per key, not all comparison rows of its material.
    """
    room_keys = F.concat(F.transform("rooms", lambda r: F.concat(F.lit("id:"), r)), F.transform("pieces", lambda p: F.concat(F.lit("nom:"), p)))
    asked = wanted.select("job_id", "line", "category_norm", F.explode(F.array_distinct(room_keys)).alias("room_key"), "materials").withColumn(
        "material_norm", F.explode(F.array_distinct("materials"))).drop("materials")
    offered = comparison.select(
        "job_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("id:"), "room_id"), F.concat(F.lit("nom:"), norm_token("piece"))))).alias("room_key"),
        norm_token("materiel").alias("material_norm"), norm_token("categorie").alias("_cat"), "quantite_avant",
        F.struct(*TABLE_ORDER).alias("_order"))
    other = (F.col("_cat") != F.col("category_norm")).cast("int") if prefer_category else F.lit(0)
    ask, by = ["job_id", "room_key", "material_norm", "category_norm"], F.struct(other.alias("o"), "_order")
    answers = asked.select(*ask).distinct().join(offered, ask[:3]).groupBy(*ask).agg(F.min_by("quantite_avant", by).alias("_found"), F.min(by).alias("_by"))
    return _answered(asked, answers, ask).groupBy("job_id", "line").agg(F.min_by("_found", "_by").alias("found"))


def document_lines(trace: DataFrame, submitted: DataFrame, comparison: DataFrame, room_map: DataFrame,
                   preserve_selection: bool = True) -> DataFrame:
    """Rebuilt document: one line per group of counted objects, then the typed lines.

    Choices of submitted lines are taken over by relation key, else by room and
    material. With ``preserve_selection`` groups without a submitted line stay
    hidden. In ``submitted`` a null ``comparison_room`` is a field not sent.
    """
    plan_lines = submitted.where(F.lower(_or("origin", F.lit("pdf"))) != "manual")
    choice = F.struct("id", "lot", "sous_lot", "comparison_room", "comparison_material", "is_addition", "unit_price")
    by_relation = plan_lines.groupBy("job_id", _or("mapping_key", relation_key("room", "material")).alias("mapping_key")).agg(
        F.max_by(choice, "seq").alias("_p0"))
    by_name = plan_lines.withColumn("_key", F.explode(_room_material_keys("room", "material", "comparison_material"))).groupBy(
        "job_id", "_key").agg(F.max_by(choice, "seq").alias("_p"))
    keys = _room_material_keys("room", "material", "comparison_material")
    groups = numbered_groups(plan_groups(trace, include_ignored=preserve_selection)).withColumns({"_k1": F.get(keys, F.lit(0)), "_k2": F.get(keys, F.lit(1))})
    joined = (
        groups.join(by_relation, ["job_id", "mapping_key"], "left")
        .join(by_name.select("job_id", F.col("_key").alias("_k1"), F.col("_p").alias("_p1")), ["job_id", "_k1"], "left")
        .join(by_name.select("job_id", F.col("_key").alias("_k2"), F.col("_p").alias("_p2")), ["job_id", "_k2"], "left")
        .withColumn("p", F.coalesce("_p0", "_p1", "_p2")).drop("_p0", "_p1", "_p2", "_k1", "_k2")
    )
    if preserve_selection:
        joined = joined.where("p is not null")
    mapped = room_map.where("room_id is not null").groupBy("job_id", norm_token("source_room").alias("_room_norm")).agg(
        F.max("room_id").alias("_mapped"))
    has_room = F.col("p.comparison_room").isNotNull()
    addition = F.coalesce(F.col("p.is_addition"), F.lit(False))
    typed_material = tidy("p.comparison_material")
    lines = joined.withColumn("_room_norm", norm_token("room")).join(mapped, ["job_id", "_room_norm"], "left").select(
        "job_id", F.concat(F.lit("g"), F.col("n").cast("string")).alias("line"), "n", "mapping_key", "room", "material", "category", "quantity_after",
        "p", addition.alias("is_addition"), has_room.alias("_has_room"), ((typed_material != "") | addition).alias("_has_material"),
        F.when(has_room, tidy("p.comparison_room")).otherwise(F.coalesce("_mapped", F.lit(""))).alias("comparison_room"),
        F.when(addition, "").when(typed_material != "", typed_material).otherwise(F.col("comparison_material")).alias("comparison_material"))

    def filled(*columns: Column) -> Column:
        return F.filter(F.array(*columns), lambda v: v.isNotNull() & (v != ""))

    wanted = lines.select(
        "job_id", "line", norm_token("category").alias("category_norm"), filled(F.col("comparison_room")).alias("rooms"),
        filled(norm_token("comparison_room"), F.when(~F.col("_has_room"), norm_token("room")),
               F.when(~F.col("_has_room"), norm_token(F.concat("room", F.lit(NEW_ROOM))))).alias("pieces"),
        filled(norm_token("comparison_material"), F.when(~F.col("_has_material"), norm_token("material"))).alias("materials"))
    nothing = F.when(F.col("_has_room") | F.col("_has_material"), "0").otherwise("")
    plan = lines.join(_first_match(cut_lineage(wanted), comparison, prefer_category=True), ["job_id", "line"], "left").select(
        "job_id", _or(tidy("p.id"), F.concat(F.lit("pdf-"), F.col("n").cast("string"))).alias("id"), "mapping_key", F.lit("pdf").alias("origin"),
        "room", tidy("p.lot").alias("lot"), tidy("p.sous_lot").alias("sous_lot"), "material", "category", "comparison_room",
        "comparison_material", "is_addition", F.coalesce(F.col("found").cast("string"), nothing).alias("quantity_before"),
        F.col("quantity_after").cast("string").alias("quantity_after"), tidy("p.unit_price").alias("unit_price"))

    return plan.unionByName(_typed_lines(submitted, comparison))


def _typed_lines(submitted: DataFrame, comparison: DataFrame) -> DataFrame:
    """Manual lines; without a chosen material they are additions unless the user said otherwise."""
    number = F.concat(F.lit("manual-"), F.col("seq").cast("string"))
    addition = F.coalesce("is_addition", tidy("comparison_material") == "")
    lines = submitted.where(F.lower(_or("origin", F.lit("pdf"))) == "manual").select(
        "job_id", number.alias("line"), "seq", tidy("id").alias("id"), tidy("mapping_key").alias("mapping_key"),
        tidy("room").alias("room"), tidy("material").alias("material"), tidy("category").alias("category"),
        tidy("lot").alias("lot"), tidy("sous_lot").alias("sous_lot"), tidy("comparison_room").alias("comparison_room"),
        F.when(addition, "").otherwise(tidy("comparison_material")).alias("comparison_material"), addition.alias("is_addition"),
        tidy("quantity_after").alias("quantity_after"), tidy("unit_price").alias("unit_price"),
    ).where("room <> '' or material <> ''")
    wanted = lines.select(
        "job_id", "line", norm_token("category").alias("category_norm"), F.array("comparison_room").alias("rooms"),
        F.array(norm_token("comparison_room")).alias("pieces"), F.array(norm_token("comparison_material")).alias("materials"))
    return lines.join(_first_match(cut_lineage(wanted), comparison, prefer_category=False), ["job_id", "line"], "left").select(
        "job_id", _or("id", "line").alias("id"), _or("mapping_key", "line").alias("mapping_key"), F.lit("manual").alias("origin"), "room", "lot",
        "sous_lot", "material", "category", "comparison_room", "comparison_material", "is_addition",
        F.coalesce(F.col("found").cast("string"), F.lit("0")).alias("quantity_before"), _or("quantity_after", F.lit("1")).alias("quantity_after"),
        "unit_price")


# -- suggestions of the editor --------------------------------------------------------------------------

def room_catalogue(inventory: DataFrame) -> DataFrame:
    """(job_id, room_id, material_norm): what may be chosen in a room."""
    return inventory.select("job_id", "room_id", norm_token("materiel").alias("material_norm")).distinct()


def suggested_lines(trace: DataFrame, relations: DataFrame, exclusions: DataFrame, room_map: DataFrame, articles: DataFrame,
                    rooms: DataFrame, inventory: DataFrame, scope_materials: DataFrame) -> DataFrame:
    """Lines the editor proposes: groups by room, material and category with a room and material suggestion.

    A material is only suggested if the room's stock holds it; without a room,
    if the lot does. ``articles(job_id, article, target)``, ``scope_materials(job_id, materiel)``.
    """
    kept = trace.where(~F.coalesce("ignored", F.lit(False))).groupBy("job_id", "room", "article", "original_article", "materiel_compare", "categorie").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    named = kept.select(
        "job_id", "n", "seq", strip("room").alias("room"), strip(_or("article", "original_article", "materiel_compare")).alias("material"),
        strip(_or("materiel_compare", "article", "original_article")).alias("compared"), strip("categorie").alias("category"),
    ).where("material <> ''")
    groups = named.groupBy("job_id", norm_token("room").alias("room_norm"), norm_token("material").alias("material_norm"),
                           norm_token("category").alias("category_norm")).agg(
        F.sum("n").alias("quantity_after"), F.min(F.struct("seq", "room", "material", "compared", "category")).alias("f")).select(
        "job_id", "room_norm", "material_norm", "quantity_after", "f.*").withColumn("mapping_key", relation_key("room", "material"))
    shown = groups.join(exclusions.select("job_id", "mapping_key").distinct(), ["job_id", "mapping_key"], "left_anti")
    targets = relations.select("job_id", F.col("target_room_id").alias("target")).union(shown.select("job_id", F.col("room").alias("target")))
    resolved = resolve_rooms(targets, rooms)
    related = relations.withColumn("target", strip("target_room_id")).join(resolved, ["job_id", "target"], "left").select(
        "job_id", "mapping_key", F.col("room_id").alias("_by_relation"), text_or_blank("target_material").alias("_relation_material"),
        F.coalesce("is_addition", F.lit(False)).alias("_addition"))
    matched = room_map.where("room_id is not null").groupBy("job_id", norm_token("source_room").alias("room_norm")).agg(
        F.max("room_id").alias("_by_map"))
    by_name = resolved.select("job_id", F.col("target").alias("room"), F.col("room_id").alias("_by_name"))
    mapped_article = articles.where("target is not null").groupBy("job_id", norm_token("article").alias("material_norm")).agg(
        F.max("target").alias("_suggestion"))
    rows = (
        shown.join(related, ["job_id", "mapping_key"], "left").join(matched, ["job_id", "room_norm"], "left")
        .join(by_name, ["job_id", "room"], "left").join(mapped_article, ["job_id", "material_norm"], "left")
        .withColumn("comparison_room", F.coalesce("_by_relation", "_by_map", "_by_name", F.lit("")))
    )
    allowed = room_catalogue(inventory).unionByName(scope_materials.select(
        "job_id", F.lit("").alias("room_id"), norm_token("materiel").alias("material_norm")).distinct())

    def check(df: DataFrame, column: str, out: str) -> DataFrame:
        flag = allowed.select("job_id", F.col("room_id").alias("comparison_room"), F.col("material_norm").alias("_c"), F.lit(True).alias(out))
        return df.withColumn("_c", F.nullif(norm_token(column), F.lit(""))).join(flag, ["job_id", "comparison_room", "_c"], "left").drop("_c")

    checked = check(check(check(rows, "_relation_material", "_ok0"), "_suggestion", "_ok1"), "compared", "_ok2")
    material = F.when(F.col("_addition"), "").when(F.col("_ok0") & (F.col("comparison_room") != ""), F.col("_relation_material")).when(
        F.col("_ok1"), F.col("_suggestion")).when(F.col("_ok2"), F.col("compared")).otherwise("")
    return checked.select("job_id", "mapping_key", "room", "material", "category", "comparison_room", material.alias("comparison_material"),
                          F.coalesce("_addition", F.lit(False)).alias("is_addition"), F.col("quantity_after").cast("string").alias("quantity_after"))


def quantity_before(lines: DataFrame, inventory: DataFrame, comparison: DataFrame) -> DataFrame:
    """Before-quantity shown next to a line: the room's stock of its category, else of the material,
    else the comparison, else 0. ``lines(job_id, line, room_id, material, category)``."""
    lines = cut_lineage(lines.select("job_id", "line", text_or_blank("room_id").alias("room_id"), norm_token("material").alias("_m"), norm_token("category").alias("_c")))
    stock = inventory.select("job_id", "room_id", norm_token("materiel").alias("_m"), norm_token("categorie").alias("_sc"), "quantite")
    same = (F.col("_c") != "") & (F.col("_sc") == F.col("_c"))
    asked, ask = lines.where("room_id <> '' and _m <> ''"), ["job_id", "room_id", "_m", "_c"]
    stocks = asked.select(*ask).distinct().join(stock, ask[:3]).groupBy(*ask).agg(F.sum(F.when(same, F.col("quantite"))).alias("_same"), F.sum("quantite").alias("_all"))
    stocked = _answered(asked.select("line", *ask), stocks, ask).groupBy("job_id", "line").agg(F.coalesce(F.sum("_same"), F.sum("_all")).alias("_stock"))
    wanted = asked.select(
        "job_id", "line", F.col("_c").alias("category_norm"), F.array("room_id").alias("rooms"), F.array(norm_token("room_id")).alias("pieces"),
        F.array("_m").alias("materials"))
    compared = _first_match(wanted, comparison, prefer_category=True)
    return lines.join(stocked, ["job_id", "line"], "left").join(compared, ["job_id", "line"], "left").select(
        "job_id", "line", F.coalesce("_stock", "found", F.lit(0)).cast("bigint").alias("quantity_before"))


def unresolved_counts(lines: DataFrame, rooms: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lines of a document still without a valid room, or without a valid material of that room."""
    valid_room = rooms.select("job_id", F.col("room_id").alias("comparison_room"), F.lit(True).alias("_room")).distinct()
    valid_material = room_catalogue(inventory).select(
        "job_id", F.col("room_id").alias("comparison_room"), F.col("material_norm").alias("_m"), F.lit(True).alias("_material"))
    checked = lines.where("origin <> 'manual'").withColumn("_m", norm_token("comparison_material")).join(
        valid_room, ["job_id", "comparison_room"], "left").join(valid_material, ["job_id", "comparison_room", "_m"], "left")
    return checked.groupBy("job_id").agg(
        F.count_if(F.col("_room").isNull()).alias("unresolved_rooms"),
        F.count_if(~F.coalesce("is_addition", F.lit(False)) & F.col("_material").isNull()).alias("unresolved_materials"))


def scope_choices(scopes: DataFrame, rooms: DataFrame, scope_listing: DataFrame, comparison: DataFrame) -> DataFrame:
    """(job_id, scope_id, n_rooms, n_materials, source): rooms of a lot and its catalogue, else compared materials."""
    counted = rooms.groupBy("job_id", "scope_id").agg(F.countDistinct("room_id").alias("n_rooms"))
    own = scope_listing.where((strip("materiel") != "") & ~is_broken_reference("materiel")).groupBy("job_id", "scope_id").agg(
        F.countDistinct(strip("materiel")).alias("_own"))
    compared = comparison.where(strip("materiel") != "").select("job_id", "room_id", strip("materiel").alias("m")).distinct().join(
        rooms.select("job_id", "room_id", "scope_id").distinct(), ["job_id", "room_id"]).groupBy("job_id", "scope_id").agg(
        F.countDistinct("m").alias("_compared"))
    keys = ["job_id", "scope_id"]
    return scopes.select(*keys).join(counted, keys, "left").join(own, keys, "left").join(compared, keys, "left").select(
        *keys, F.coalesce("n_rooms", F.lit(0)).alias("n_rooms"), F.coalesce("_own", "_compared", F.lit(0)).alias("n_materials"),
        F.when(F.col("_own").isNotNull(), "catalogue").otherwise("comparatif").alias("source"))


def option_search(options: DataFrame, query: str, suggested: str = "") -> DataFrame:
    """Options of each job whose label holds the query, with their rank; the suggestion leads with rank 0.

    ``options(job_id, ord, value, label)``; the first row of a value counts.
    """
    distinct = options.where("value <> ''").groupBy("job_id", "value").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    is_suggested = (F.col("value") == suggested) | (norm_token("label") == norm_token(F.lit(suggested))) if suggested else F.lit(False)
    wanted = norm_token(F.lit(query.strip()))
    found = rank_by_range(distinct.where(F.contains(norm_token("label"), wanted)), ["job_id"], ["ord", "value"], "rank")
    lead = distinct.where(is_suggested).groupBy("job_id").agg(F.min(F.struct("ord", "value", "label")).alias("s")).select(
        "job_id", F.lit(0).alias("rank"), "s.value", "s.label")
    rest = found.select("job_id", "rank", "value", "label").join(lead.select("job_id", "value"), ["job_id", "value"], "left_anti")
    return lead.unionByName(rest.select("job_id", "rank", "value", "label"))
