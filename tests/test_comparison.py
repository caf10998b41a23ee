"""Whole comparisons on small literal frames. All cases run as jobs of one comparison."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from frames import compare, listing, manual, rows_of, symbols, table
from sitetally.fixed_values import ADDED, MODIFIED, NOT_DETECTED, TO_VALIDATE, UNCHANGED
from sitetally.functions.identity import relation_key, room_id, scope_id
from sitetally.operators import options

PRISE = "Prise de courant"
POSTE = "Poste de travail (4 PC + 1 RJ)"
TWO_LOTS = [("IRM", "Salle", "12", PRISE, 99), ("VASCULAIRE ANGIO", "Vasculaire 1", "28", PRISE, 2),
            ("VASCULAIRE ANGIO", "Vasculaire 2", "28", "Prise RJ45", 4)]
LISTINGS = {
    1: [("A", "Secrétariat", "12", PRISE, 63), ("B", "Secrétariat", "28", PRISE, 22)],
    2: [("A", "Secrétariat", "12", PRISE, 63), ("B", "Secrétariat", "28", PRISE, 22)],
    3: [("A", "Consultation", "1", PRISE, 1), ("A", "consultation", "1", PRISE, 2)],
    4: [("A", "Bureau", "1", "Prise courant", 4)],
    5: [("A", "Bureau", "1", PRISE, 4)],
    6: [("A", "Source", "1", PRISE, 7), ("A", "Destination", "1", PRISE, 3)],
    7: [("A", "Bureau", "1", PRISE, 7)],
    8: [("A", "Bureau", "1", "#REF!", 10), ("A", "Bureau", "1", PRISE, 2)],
    9: TWO_LOTS, 10: TWO_LOTS, 11: TWO_LOTS, 12: TWO_LOTS, 13: TWO_LOTS, 14: TWO_LOTS,
    15: [("A", "Bureau", "1", PRISE, 1), ("A", "Bureau", "1", "Lampe", 2), ("A", "Bureau", "1", "Store", 3),
         ("A", "Couloir", "1", "Horloge", 5)],
    16: [("A", "Bureau", "1", "Prise de courant 16A 2P+T (Encastrée)", 8), ("A", "Bureau", "1", "Prise RJ45 (Encastrée)", 1)],
    17: [("A", "Bureau", "1", PRISE, 1)],
    18: [("A", "Salle de soins", "1", PRISE, 1), ("A", "Salle de soin", "1", PRISE, 2), ("A", "Attente", "1", "Lampes LED", 3)],
}
SYMBOLS = {
    1: [("Secrétariat", PRISE)], 2: [("Secrétariat", PRISE)], 3: [("CONSULTATION", PRISE)],
    4: [("Bureau", "Prise courant nouvelle")], 6: [("Source", PRISE)], 7: [("Bureau", PRISE)],
    8: [("Bureau", PRISE), ("Bureau", PRISE)],
    9: [("Vasculaire 1", PRISE)], 10: [("Vasculaire 1", PRISE)], 11: [("Salle", PRISE)], 12: [("Salle", PRISE)],
    13: [("Salle", PRISE)], 14: [("Vasculaire 1", PRISE)],
    15: [("bureau", PRISE), ("bureau", "Lampe"), ("Bureau", "xyzw 99"), ("Bureau", "Horloge")],
    16: [("Bureau", POSTE, "g2"), ("Bureau", POSTE, "g1")],
    17: [("bureau", PRISE), ("Bureau", "xyzw 99"), ("", PRISE)],
    18: [("Salle de soinx", PRISE), ("Grande attente nord", "Lampe LED")],
}


@pytest.fixture(scope="module")
def ids(spark):
    """Keys the cases need, computed once."""
    def keyed(*columns):
        return spark.range(1).select(*columns).first()

    def room(*parts):
        return room_id(*map(F.lit, parts))

    def relation(place, material):
        return relation_key(F.lit(place), F.lit(material))

    row = keyed(
        room("R+2", "B", "Secrétariat", "28"), room("R+2", "A", "Bureau", "1"), room("R+2", "A", "Destination", "1"),
        room("R+2", "VASCULAIRE ANGIO", "Vasculaire 1", "28"), scope_id(*map(F.lit, ("R+2", "VASCULAIRE ANGIO", "28"))),
        relation("Secrétariat", PRISE), relation("Bureau", "Prise courant nouvelle"), relation("Source", PRISE),
        relation("Bureau", PRISE), relation("Bureau", "xyzw 99"))
    names = ["secretariat_b", "bureau", "destination", "vasculaire", "lot28", "k_secretariat", "k_nouvelle", "k_source",
             "k_bureau", "k_excluded"]
    return dict(zip(names, row))


@pytest.fixture(scope="module")
def run(spark, ids):
    def params(job, scope="", hint="", level=""):
        return (job, level, "", "", scope, hint)

    return compare(
        reduce(lambda a, b: a.unionByName(b), [listing(spark, *rows, job=j) for j, rows in LISTINGS.items()]),
        reduce(lambda a, b: a.unionByName(b), [symbols(spark, *rows, job=j) for j, rows in SYMBOLS.items()]),
        relations=table(
            spark, "relations",
            (2, ids["k_secretariat"], ids["secretariat_b"], PRISE, False),
            (4, ids["k_nouvelle"], ids["bureau"], "", True),
            (6, ids["k_source"], ids["destination"], PRISE, False),
            (7, ids["k_bureau"], "nulle part", "", False),
            (14, "v1:autre::objet", ids["vasculaire"], "", False)),
        params=table(
            spark, "params", params(9, hint="24-031 plan CABINET VASCULAIRE ind B"), params(10), params(11, scope=ids["lot28"]),
            params(12, scope="vasculaire angio lot n 28 (r 2)"), params(13, scope="rien"), params(14), params(5)),
        exclusions=table(spark, "exclusions", (17, ids["k_excluded"])),
        manual_lines=manual(spark, (5, 1, "m1", None, "", "Lampe neuve", "", None, "3", "", "", False),
                            (5, 2, "m2", None, "Bureau", "Lampe", "", None, "0", "", "", False)),
    )


def of(df, job, *columns):
    return rows_of(df.where(F.col("job_id") == job), *columns)


def test_homonym_rooms_stay_unmatched_until_a_relation_names_one(run, ids):
    assert of(run.room_map, 1, "source_room", "room_id") == [("Secrétariat", None)]
    assert of(run.table, 1, "quantite_avant") == [(0,)]
    assert of(run.table, 2, "quantite_avant", "quantite_apres", "room_id", "statut") == [(22, 1, ids["secretariat_b"], MODIFIED)]
    assert of(run.chosen_scope, 2, "method") == [("relations sauvegardées",)]


def test_two_homonyms_in_one_scope_are_ambiguous(run):
    assert of(run.room_map, 3, "room_id") == [(None,)]


def test_addition_keeps_plan_name(run):
    added = run.table.where("quantite_apres > 0")
    assert of(added, 4, "materiel", "statut", "is_addition") == [("Prise courant nouvelle", ADDED, True)]


def test_manual_line_without_room(run):
    assert of(run.table, 5, "quantite_apres", "piece", "origin", "mapping_key") == [(3, "", "manual", "manual:m1")]


def test_relation_moves_objects_to_another_room(run):
    assert of(run.table, 6, "piece", "quantite_avant", "quantite_apres") == [("Destination", 3, 1)]


def test_relation_to_an_unknown_room_makes_a_new_room(run):
    assert of(run.table, 7, "piece", "materiel", "quantite_avant", "statut") == [("Bureau [nouvelle pièce]", PRISE, 0, ADDED)]


def test_broken_references_never_count(run):
    assert of(run.table, 8, "materiel", "quantite_avant", "statut") == [(PRISE, 2, UNCHANGED)]


def test_scope_hint_selects_the_lot(run, ids):
    assert of(run.chosen_scope, 9, "scope_id", "method") == [(ids["lot28"], "nom du PDF")]
    assert of(run.table, 9, "piece", "quantite_avant", "quantite_apres") == [("Vasculaire 1", 2, 1)]


def test_undetermined_scope_fails_closed(run):
    assert of(run.chosen_scope, 10, "scope_id") == [(None,)]
    assert of(run.table, 10, "quantite_avant", "statut") == [(0, TO_VALIDATE)]
    assert of(run.material_map, 10, "target") == [(None,)]


def test_user_selects_the_scope(run, ids):
    for job in (11, 12):
        assert of(run.chosen_scope, job, "scope_id", "method") == [(ids["lot28"], "sélection utilisateur")]


def test_unknown_scope_and_level_are_reported(spark, run):
    assert of(run.chosen_scope, 13, "unknown_scope", "scope_id") == [(True, None)]
    asked = table(spark, "params", (9, "R+9", "", "", "", ""), (10, " r+2 ", "", "", "", ""))
    assert rows_of(options.level_errors(run.listing, asked), "job_id", "niveau_excel") == [(9, "R+9")]


def test_stale_relation_does_not_choose_a_scope(run):
    assert of(run.chosen_scope, 14, "scope_id") == [(None,)]


def test_all_statuses_and_rapprochement(run):
    assert of(run.table, 15, "materiel", "statut", "rapprochement") == [
        ("Horloge", ADDED, "exact (1.0)"), ("Lampe", MODIFIED, "exact (1.0)"), (PRISE, UNCHANGED, "exact (1.0)"),
        ("Store", NOT_DETECTED, "maquette seule"), ("xyzw 99", TO_VALIDATE, "article PDF sans équivalent")]


def test_components_expand_and_group_keeps_order(run):
    labels = f"g2 · {POSTE}, g1 · {POSTE}"
    assert of(run.table, 16, "materiel", "quantite_apres", "labels", "source_material", "pages") == [
        ("Prise RJ45 (Encastrée)", 2, labels, POSTE, "5"),
        ("Prise de courant 16A 2P+T (Encastrée)", 8, labels, POSTE, "5")]


def test_trace_follows_each_symbol(spark, run):
    refs = spark.createDataFrame([(PRISE, "2")], "article STRING, reference STRING")
    assert of(run.trace(refs), 17, "seq", "reference", "statut", "ignored", "needs_review", "confidence") == [
        (0, "2", UNCHANGED, False, False, 1.0),
        (1, "?", "EXCLU PAR L'UTILISATEUR", True, False, 1.0),
        (2, "2", "COMPTÉ SUR LE PLAN", False, False, 1.0)]


def test_similarity_and_containment_tiers(run):
    got = of(run.room_map.join(run.scope_rooms.select("job_id", "room_id", "piece"), ["job_id", "room_id"]), 18,
             "source_room", "piece", "method", "score")
    assert got == [("Grande attente nord", "Attente", "contenance", 0.75), ("Salle de soinx", "Salle de soin", "fuzzy", 0.96)]
    assert of(run.material_map, 18, "article", "target", "method", "score") == [
        ("Lampe LED", "Lampes LED", "fuzzy", 0.95), (PRISE, PRISE, "exact", 1.0)]
