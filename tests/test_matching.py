"""Room and material tiers against a plain cascade on random names."""

import random
from collections import Counter
from difflib import SequenceMatcher

from sitetally.operators import matching, options, overlay

WORDS = ["salle", "bureau", "soin", "attente", "nord", "accueil", "1", "2", "local", "technique"]
OVERRIDES = "job_id int, source string, target string, seq int"


def misspelt(rng, words):
    base = " ".join(words)
    return "".join(c for c in base if c == " " or rng.random() > 0.12).strip() or "x"


def inside(needle, hay):
    return f" {needle} " in f" {hay} "


def room_answers(room, pieces):
    """The answer of each tier as a set of (piece, method): what the tier names, if it names one piece that exists once."""
    count, ratio = Counter(pieces), {p: SequenceMatcher(None, room, p).ratio() for p in pieces}
    top = {p for p, r in ratio.items() if abs(r - max(ratio.values())) < 1e-9 and r >= 0.62}
    held = {p for p in count if len(p) >= 4 and (inside(p, room) or (room and inside(room, p)))}
    longest = {p for p in held if len(p) == max(map(len, held))}
    tiers = [("exact", {room} & count.keys()), ("fuzzy", top if len(top) == 1 else set()), ("contenance", set([p for p in pieces if p in longest][:1]))]
    return [(name, {p for p in named if count[p] == 1}, bool(named)) for name, named in tiers]


def expected_room(room, pieces):
    """The first tier in order with an answer; an exact name that exists twice ends the search."""
    (_, exact, met), *others = room_answers(room, pieces)
    if met:
        return (*exact, "exact") if exact else None
    return next(((*found, name) for name, found, _ in others if found), None)


def test_room_tiers(spark):
    rng, listed, seen, want = random.Random(8), [], set(), {}
    for job in range(6):
        pieces = [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(14)]
        listed += [(job, 0, i, "R", f"occ {i}", p, str(i), "m", 1) for i, p in enumerate(pieces)]
        for _ in range(40):
            room = misspelt(rng, rng.choices(WORDS, k=rng.randint(1, 4)))
            room = " ".join(room.split())
            seen.add((job, room))
            want[job, room] = expected_room(room, [pieces[i] for i in sorted(range(14), key=lambda i: f"occ {i}")])
    listing = spark.createDataFrame(listed, "job_id int, sheet_idx int, row_idx int, niveau string, occupation string, piece string, numero string, materiel string, quantite int")
    room_rows = options.rooms(options.identities(listing))
    plan = spark.createDataFrame(sorted(seen), "job_id int, source_room string")
    found = matching.match_rooms(plan, room_rows, spark.createDataFrame([], OVERRIDES)).join(
        room_rows.select("job_id", "room_id", "piece"), ["job_id", "room_id"], "left").collect()
    got = {(r.job_id, r.source_room): (r.piece, r.method) if r.room_id else None for r in found}
    assert got == want


def test_material_similarity_prefers_the_first_in_order(spark):
    rng, articles, listed, aliases, want = random.Random(9), set(), [], [], {}
    names = sorted({" ".join(rng.choices(WORDS, k=2)) for _ in range(25)})
    for rank, target in enumerate(["bureau nord", "salle absente"]):
        aliases.append(("etrange", rank, target))
    for job in range(4):
        catalogue = sorted(rng.sample(names, 12))
        listed += [(job, m) for m in catalogue]
        for article in sorted({misspelt(rng, rng.choices(WORDS, k=2)) for _ in range(25)} | {"etrange"}):
            article = " ".join(article.split())
            articles.add((job, article))
            asked = [article] + (["bureau nord", "salle absente"] if article == "etrange" else [])
            ratios = [(-SequenceMatcher(None, c, m).ratio(), i, k, m) for i, c in enumerate(asked) for k, m in enumerate(catalogue)]
            least, *_, material = min(ratios)
            if -least >= 0.65:
                want[job, article] = material, round(-least, 2)
    index = matching.catalogue_index(spark.createDataFrame(listed, "job_id int, materiel string"))
    from sitetally.sources.rules import normalised_aliases
    found = matching.match_materials(
        spark.createDataFrame(sorted(articles), "job_id int, article string"), index, spark.createDataFrame([], OVERRIDES),
        spark.createDataFrame([], "job_id int, article string"), normalised_aliases(spark.createDataFrame(aliases, "article string, alias_rank int, material string")),
        spark.createDataFrame([], "cache_key string, material string"), ("similarity",)).where("target is not null")
    assert {(r.job_id, r.article): (r.target, r.score) for r in found.collect()} == want


def test_overrides_decide_even_when_they_fail(spark):
    listing = spark.createDataFrame([(1, 0, 0, "R", "o", "Salle 1", "1", "m", 1), (1, 0, 1, "R", "o", "Salle 2", "1", "m", 1)],
                                    "job_id int, sheet_idx int, row_idx int, niveau string, occupation string, piece string, numero string, materiel string, quantite int")
    room_rows = options.rooms(options.identities(listing))
    plan = spark.createDataFrame([(1, "Salle 1"), (1, "SALLE-2"), (1, "Annexe")], "job_id int, source_room string")
    given = spark.createDataFrame([(1, "Salle 1", "nulle part", 1), (1, "salle 2", "Salle 1", 2), (1, "Annexe", "", 3)], OVERRIDES)
    got = {r.source_room: (r.method, r.room_id is not None) for r in matching.match_rooms(plan, room_rows, given).collect()}
    assert got == {"Salle 1": (None, False), "SALLE-2": ("correspondance utilisateur", True), "Annexe": (None, False)}


def test_rooms_after_corrections_and_marker_modes(spark):
    zones = spark.createDataFrame([(1, 1, "a", "Ancien", "Neuf", 0.0, 0.0, 10.0, 10.0), (1, 1, "b", "", "Cour", 0.0, 20.0, 10.0, 10.0)],
                                  "job_id int, page int, id string, name_original string, name string, x double, y double, w double, h double")
    rooms = spark.createDataFrame([(1, 1, 1, "Ancien", "12 m²", 1.0, 1.0), (1, 1, 2, "Hall", "9 m²", 2.0, 2.0)],
                                  "job_id int, page int, idx int, name string, surface string, x double, y double")
    got = [(r.name, r.surface, r.y) for r in overlay.corrected_rooms(rooms, zones).orderBy("o").collect()]
    assert got == [("Neuf", "12 m²", 1.0), ("Hall", "9 m²", 2.0), ("Cour", "", 25.0)]
    markers = spark.createDataFrame([(1, "counted", True), (2, "counted", False), (3, "manual", False)], "id int, kind string, review boolean")
    assert [overlay.visible_markers(markers, m).count() for m in ("all", "review", "counted", "manual")] == [3, 1, 2, 1]
