"""Spatial operators against plain scans, many random cases as jobs of one run."""

import math
import random

from pyspark.sql import functions as F

from sitetally.functions import symbols as sym
from sitetally.operators import spatial


def test_duplicate_removal_equals_the_greedy_scan(spark):
    rng, rows = random.Random(1), []
    for job in range(60):
        for seq in range(40):
            page_type = rng.choice(["LUMINAIRE", "PLOMBERIE"])
            label = rng.choice(["glyphe (0.87)", "glyphe (0.5)", "x"])
            rows.append((job, seq, 1, page_type, rng.choice("ab"), float(rng.randrange(40)), float(rng.randrange(40)), rng.choice(["texte", "vision", "autre"]), label))
    df = spark.createDataFrame(rows, "job_id int, seq int, page int, page_type string, article string, x double, y double, source string, label string")
    got = {(r.job_id, r.seq) for r in spatial.remove_duplicate_symbols(df, sym.duplicate_quality("source", "label")).collect()}

    def quality(r):
        return 2.0 if r[7] == "texte" else float(r[8][8:-1]) if "(" in r[8] else 1.0 if r[7] == "vision" else 0.8

    want, kept = set(), []
    for r in sorted(rows, key=lambda r: (r[0], -quality(r), r[1])):
        radius = 8.0 if r[3] == "LUMINAIRE" else 5.0
        if not any(k[0] == r[0] and k[3] == r[3] and k[4] == r[4] and (k[5] - r[5]) ** 2 + (k[6] - r[6]) ** 2 <= radius ** 2 for k in kept):
            kept.append(r)
            want.add((r[0], r[1]))
    assert got == want


def test_overlap_suppression_equals_the_greedy_scan(spark):
    rng, rows = random.Random(2), []
    for job in range(60):
        for seq in range(40):
            rows.append((job, 1, seq, float(rng.randrange(60)), float(rng.randrange(60)), rng.choice("ab"), "c", rng.randrange(5) / 4, float(rng.choice([3, 8, 12, 30]))))
    df = spark.createDataFrame(rows, "job_id int, page int, seq int, x double, y double, article string, categorie string, score double, size double")
    got = {(r.job_id, r.seq) for r in spatial.suppress_overlaps(df).collect()}
    want, kept = set(), []
    for r in sorted(rows, key=lambda r: (r[7], r[3], r[4], r[5], r[6], r[8], r[2]), reverse=True):
        if not any(k[0] == r[0] and (k[3] - r[3]) ** 2 + (k[4] - r[4]) ** 2 < min(0.7 * r[8], 0.7 * k[8]) ** 2 for k in kept):
            kept.append(r)
            want.add((r[0], r[2]))
    assert got == want


def _waves(free, start):
    """Steps from a cell to every free cell, by growing sets."""
    steps, wave = {}, {start}
    for n in range(len(free) + 1):
        steps |= dict.fromkeys(wave, n)
        wave = {c for x, y in wave for c in ((x - 1, y), (x, y - 1), (x + 1, y), (x, y + 1)) if c in free and c not in steps}
    return steps


def _nearest_labels(free, rooms):
    """Least (steps, idx) of each reachable cell; seeds are the first free cells by (ring, dy, dx) that no earlier room has."""
    seeds = {}
    for idx, x, y in rooms:
        ring = sorted((max(abs(cx - x), abs(cy - y)), cy - y, cx - x, (cx, cy)) for cx, cy in free - set(seeds.values()))
        if ring and ring[0][0] < 15:
            seeds[idx] = ring[0][3]
    offers = [(cell, (n, idx)) for idx, seed in seeds.items() for cell, n in _waves(free, seed).items()]
    return {cell: min(o for c, o in offers if c == cell)[1] for cell in {c for c, _ in offers}}


def test_flood_equals_distances_from_the_definition(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", 8)
    rng, cells, rooms, want = random.Random(3), [], [], {}
    big = 1 << 40  # room numbers have no bound
    for job in range(6):
        side = 20
        free = {(x, y) for x in range(side) for y in range(side) if rng.random() < 0.7}
        seeds = [(big + i, rng.randrange(side // 2), rng.randrange(side // 2)) for i in range(5)] + [(big + 5, 3, 3), (big + 6, 3, 3)]
        cells += [(job, 1, x, y) for x, y in free]
        rooms += [(job, 1, i, x, y) for i, x, y in seeds]
        want.update({(job, x, y): i for (x, y), i in _nearest_labels(free, seeds).items()})
    cell_df = spark.createDataFrame(cells, "job_id bigint, page int, x bigint, y bigint")
    room_df = spark.createDataFrame(rooms, "job_id bigint, page int, idx bigint, x bigint, y bigint")
    got = {(r.job_id, r.x, r.y): r.idx for r in spatial.flood(cell_df, spatial.place_seeds(room_df, cell_df)).collect()}
    assert got == want


def test_size_zero_has_no_neighbours(spark):
    schema = "job_id int, page int, seq int, x double, y double, article string, categorie string, score double, size double"
    rows = [(1, 1, i, 5.0, 5.0, "a", "c", i / 10, 0.0) for i in range(3)]
    mixed = [(2, 1, 0, 0.0, 0.0, "a", "c", 0.9, 10.0), (2, 1, 1, 1.0, 0.0, "a", "c", 0.8, 10.0), (2, 1, 2, 0.0, 0.0, "a", "c", 0.7, 0.0), (2, 1, 3, 0.0, 0.0, "a", "c", 0.6, None)]
    got = {(r.job_id, r.seq) for r in spatial.suppress_overlaps(spark.createDataFrame(rows + mixed, schema)).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 2), (2, 3)}
    points = spark.createDataFrame([(1, 0.0, 1), (1, 0.0, 2), (1, 3.0, 3)], "k int, x double, rank int").withColumn("y", F.lit(0.0))
    kept = spatial.keep_strongest(points, ["k"], F.col("rank"), F.lit(0.0), inclusive=True)
    assert {r["rank"] for r in kept.collect()} == {2, 3}


def test_nearest_room_looks_as_far_as_needed(spark):
    rng = random.Random(4)
    points = [(1, 1, float(rng.randrange(5000)), float(rng.randrange(50))) for _ in range(200)] + [(2, 1, 0.0, 0.0)]
    rooms = [(1, 1, i, f"r{i}", float(rng.randrange(300)), float(rng.randrange(300))) for i in range(30)]
    got = {(r.job_id, r.x, r.y): r.room for r in spatial.nearest_room(
        spark.createDataFrame(points, "job_id int, page int, x double, y double"),
        spark.createDataFrame(rooms, "job_id int, page int, idx int, name string, x double, y double"), finest=16.0).collect()}
    want = {(j, x, y): min(((rx - x) ** 2 + (ry - y) ** 2, i, n) for _, _, i, n, rx, ry in rooms)[2] for j, _, x, y in points if j == 1}
    assert got == {**want, (2, 0.0, 0.0): ""}


def test_nearest_room_equals_the_definition_without_a_row_per_point_and_cell(spark, monkeypatch):
    rng = random.Random(11)
    # page 1: a dense cluster, a few labels far away, and equal places; page 2: one spot; page 3: no label
    rooms = [(1, 1, i, f"r{i}", float(rng.randrange(40)), float(rng.randrange(40))) for i in range(900)]
    rooms += [(1, 1, 900 + i, f"far{i}", rng.uniform(0, 90000), rng.uniform(-500, 500)) for i in range(5)] + [(2, 1, 7, None, 3.0, 4.0), (1, None, 1, "x", 0.0, 0.0), (1, 1, 0, "y", None, 0.0)]
    points = [(1, 1, rng.uniform(-9, 60), rng.uniform(-9, 60)) for _ in range(700)] + [(1, 1, rng.uniform(-900, 99000), rng.uniform(-900, 900)) for _ in range(60)]
    points += [(1, 1, 5.0, 5.0)] * 2 + [(2, 1, 0.0, 0.0), (2, 1, None, 0.0), (3, 1, 1.0, 1.0), (None, 1, 1.0, 1.0)]
    monkeypatch.setattr(spatial, "ANCHORS", 300)
    near = spatial.nearest_room(spark.createDataFrame(points, "job_id int, page int, x double, y double"),
                                spark.createDataFrame(rooms, "job_id int, page int, idx int, name string, x double, y double"), near=50)
    got = {(r.job_id, r.page, r.x, r.y): (r.room, r.room_dist) for r in near.collect()}

    def definition(job, page, x, y):
        there = [(math.dist((x, y), (rx, ry)), i, n) for j, p, i, n, rx, ry in rooms if j == job and p == page and None not in (x, rx)]
        return (min(there)[2] or "", round(min(there)[0], 1)) if there else ("", None)

    assert got == {p: definition(*p) for p in set(points)}
    assert "Window" not in near._jdf.queryExecution().executedPlan().toString()


def test_polygons_count_crossings(spark):
    shape = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    zones = spark.createDataFrame([(1, 1, "a", "Zone", 0.0, 0.0, shape, True)],
                                  "job_id int, page int, id string, name string, x double, y double, points array<struct<x:double,y:double>>, locked boolean")
    points = spark.createDataFrame([(1, 1, 5.0, 8.0), (1, 1, 1.0, 8.0), (1, 1, 5.0, 4.0), (1, 1, 11.0, 1.0)], "job_id int, page int, x double, y double")
    got = {(r.x, r.y) for r in spatial.zone_assign(points, zones).collect()}
    assert got == {(1.0, 8.0), (5.0, 4.0)}


def _greedy(points, inclusive):
    """points: (rank, x, y, r), all of one page; ranks kept by the plain scan."""
    kept = []
    for rank, x, y, r in sorted(points, reverse=True):
        near = lambda k: (k[1] - x) ** 2 + (k[2] - y) ** 2
        if not any(near(k) < min(r, k[3]) ** 2 or (inclusive and near(k) == min(r, k[3]) ** 2) for k in kept):
            kept.append((rank, x, y, r))
    return {k[0] for k in kept}


def test_a_long_run_takes_no_rounds_and_large_clusters_equal_the_scan(spark, monkeypatch):
    schema = "k int, rank int, x double, y double, r double"
    run = [(1, 5000 - i, i * 3.0, 0.0, 4.0) for i in range(5000)]  # each one is outranked by the one before it
    rng = random.Random(8)
    mixed = [(2, i, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.3, 1.0, 5.0, 17.0, 64.0])) for i in range(700)]
    df = spark.createDataFrame(run + mixed, schema)
    rounds = []
    plain = spatial._in_rounds
    monkeypatch.setattr(spatial, "_in_rounds", lambda *a: (rounds.append(1), plain(*a))[1])
    for inclusive, scanned in ((True, 20_000), (False, 20_000), (False, 50)):
        got = {(r.k, r["rank"]) for r in spatial.keep_strongest(df if scanned > 50 else df.where("k = 2"), ["k"], F.col("rank"), F.col("r"), inclusive, scanned).collect()}
        want = {(2, x) for x in _greedy([p[1:] for p in mixed], inclusive)} | ({(1, x) for x in range(5000, 0, -2)} if scanned > 50 else set())
        assert got == want and len(rounds) == (scanned == 50)


def test_flood_of_a_labyrinth_with_few_rounds_a_tile(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", 16)
    side = 48  # one long way, winding through all tiles
    free = {(x, y) for y in range(side) for x in range(side) if y % 2 == 0 or x == (side - 1 if y % 4 == 1 else 0)}
    rng = random.Random(2)
    loose = {(x, y) for x in range(100, 100 + side) for y in range(-20, 20) if rng.random() < 0.6}
    seeds = {7: (0, 0), 3: (side - 1, 24), 5: (101, -20), 9: (130, 3), 4: (131, 3)}
    loose |= set(seeds.values()) - free
    want = {}
    for idx, seed in seeds.items():
        for cell, n in _waves(free | loose, seed).items():
            want[cell] = min(want.get(cell, (1 << 60, 0)), (n, idx))
    cells = spark.createDataFrame([(1, 1, x, y) for x, y in free | loose], "job_id bigint, page int, x bigint, y bigint")
    starts = spark.createDataFrame([(1, 1, i, x, y) for i, (x, y) in seeds.items()], "job_id bigint, page int, idx bigint, x bigint, y bigint")
    assert {(r.x, r.y): (r.steps, r.idx) for r in spatial.flood(cells, starts).collect()} == want


def test_seeds_and_ring_lookup_equal_the_definition(spark):
    """Crowded rooms go through all their cells, negative cells and tile edges included."""
    rng = random.Random(6)
    free = {(x, y) for x in range(-70, 70) for y in range(-12, 12) if rng.random() < 0.02}
    rooms = [(i, *rng.choice([(-64, 0), (-1, -2), (0, 0), (3, 1), (63, 2)])) for i in range(80)]
    order = spatial._ring_order(15)
    assert order[:4] == [(0, 0), (-1, -1), (-1, 0), (-1, 1)] and len(order) == 29 * 29
    taken, want = set(), {}
    for idx, x, y in rooms:
        cell = next(((x + dx, y + dy) for dy, dx in order if (x + dx, y + dy) in free - taken), None)
        if cell:
            want[idx] = cell
            taken.add(cell)
    cells = spark.createDataFrame([(1, 1, x, y) for x, y in free], "job_id bigint, page int, x bigint, y bigint")
    asked = spark.createDataFrame([(1, 1, *r) for r in rooms] + [(2, 1, 0, 0, 0)], "job_id bigint, page int, idx bigint, x bigint, y bigint")
    assert {r.idx: (r.x, r.y) for r in spatial.place_seeds(asked, cells).collect()} == want and len(want) < 80
    labels = {c: i for i, c in enumerate(sorted(free))}
    labelled = spark.createDataFrame([(1, 1, x, y, i) for (x, y), i in labels.items()], "job_id bigint, page int, x bigint, y bigint, idx int")
    spots = [(rng.randrange(-90, 90), rng.randrange(-30, 30)) for _ in range(300)]
    found = {(r.x, r.y): r.idx for r in spatial.ring_lookup(spark.createDataFrame([(1, 1, *s) for s in spots], "job_id bigint, page int, x bigint, y bigint"), labelled).collect()}
    expected = {s: next((labels[s[0] + dx, s[1] + dy] for dy, dx in spatial._ring_order(12) if (s[0] + dx, s[1] + dy) in labels), None) for s in spots}
    assert found == {s: i for s, i in expected.items() if i is not None}


def _inside(x, y, shape):
    odd = False
    for (px, py), (qx, qy) in zip(shape, [shape[-1], *shape[:-1]]):
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / ((qy - py) or 1e-9) + px:
            odd = not odd
    return odd


def test_zones_with_many_edges_equal_the_plain_test_with_few_edges_a_point(spark):
    import math
    rng = random.Random(12)
    turns = [2 * math.pi * i / 10_000 for i in range(10_000)]
    wide = [(4000 * math.cos(a) * (1 + 0.05 * math.sin(90 * a)) + 5000, 300 * math.sin(a) * (1 + 0.2 * math.sin(63 * a)) + 400) for a in turns]
    comb = [(0.0, 0.0), *(p for i in range(60) for p in ((i * 5.0, 90.0 - i), (i * 5.0 + 2, 3.0))), (310.0, 0.0)]
    star = [(50 + 40 * math.cos(2.4 * i), 50 + 40 * math.sin(2.4 * i)) for i in range(25)]
    shapes = {"wide": (1, wide), "comb": (2, comb), "star": (3, star), "flat": (3, [(0.0, 5.0), (9.0, 5.0)]), "none": (3, [])}
    zones = spark.createDataFrame([(j, 1, n, n, 0.0, 0.0, s, True) for n, (j, s) in shapes.items()],
                                  "job_id int, page int, id string, name string, x double, y double, points array<struct<x:double,y:double>>, locked boolean")
    spots = [(1, rng.uniform(800, 9200), rng.uniform(0, 800)) for _ in range(300)] + [(2, rng.uniform(-5, 315), rng.choice([0.0, 3.0, 45.0, rng.uniform(0, 90)])) for _ in range(300)]
    spots += [(3, float(rng.randrange(0, 100)), float(rng.randrange(0, 100))) for _ in range(300)] + [(1, *p) for p in wide[::500]] + [(2, *p) for p in comb[::9]]
    got = {(r.job_id, r.x, r.y): r.zone for r in spatial.zone_assign(spark.createDataFrame([(j, 1, x, y) for j, x, y in spots], "job_id int, page int, x double, y double"), zones).collect()}
    want = {(j, x, y): n for j, x, y in spots for n, (k, s) in shapes.items() if j == k and s and _inside(x, y, s)}
    assert got == want and 300 < len(want) < 850
    cover = spatial.zone_cover(zones).agg(F.max(F.size("edges")), F.max(F.size("heights")), F.count("*")).first()
    assert cover[0] <= 40 and cover[1] <= 80 and cover[2] < 12_000


def test_companions_equal_the_definition_without_a_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ANCHORS", 7)
    rng = random.Random(11)
    anchors = [(1, 1 + i % 2, i // 2 if i % 5 else 0, rng.choice([0.0, 33.5, 250.0, rng.uniform(-300, 700)]), rng.uniform(0, 500)) for i in range(120)]
    spots = [(1, 1 + i % 2, rng.choice(["a", "b", None]), float(rng.randrange(500)), float(rng.randrange(500)), rng.choice([0.3, 0.62, 0.7, 0.9])) for i in range(300)]
    found = spatial.anchor_companions(spark.createDataFrame(anchors, "job_id int, page int, anchor_id int, x double, y double"),
                                      spark.createDataFrame(spots, "job_id int, page int, template string, x double, y double, score double"))
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().toString()).split("FlatMapCoGroups")[0] and "FlatMapCoGroupsInArrow" in plan
    want = {}
    for job, page, who, x, y in anchors:
        x0, x1, y0, y1 = max(0, int(x - 100)), int(x + 100), max(0, int(y - 100)), int(y + 100)
        for _, p, template, cx, cy, score in spots:
            if p == page and score >= 0.62 and x0 <= cx < x1 and y0 <= cy < y1:
                best = want.get((page, who, template))
                want[page, who, template] = max((score, -cy, -cx), best) if best else (score, -cy, -cx)
    rows = found.collect()
    assert len(rows) == len(want) and {(r.page, r.anchor_id, r.template): (r.score, -r.y, -r.x) for r in rows} == want


def test_large_groups_are_settled_by_tiles_in_few_rounds(spark, monkeypatch):
    rng = random.Random(12)
    points = [(k, i, rng.uniform(0, 900), rng.uniform(0, 700), rng.choice([0.7, 4.0, 9.0, 20.0])) for k, n in ((1, 3000), (2, 100), (3, 20)) for i in range(n)]
    rounds, plain = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: (rounds.append(1), plain(df))[1])
    df = spark.createDataFrame(points + [(None, 1, 0.0, 0.0, 1.0)], "k int, rank int, x double, y double, r double")
    got = {(r.k, r["rank"]) for r in spatial.keep_strongest(df, ["k"], F.col("rank"), F.col("r"), False, 400).collect()}
    assert got == {(k, x) for k in (1, 2, 3) for x in _greedy([p[1:] for p in points if p[0] == k], False)} and len(rounds) < 25


def test_small_groups_meet_in_one_array_with_copies_and_missing_places(spark):
    rows = [(1, 1, 5, 0.0, 0.0), (1, 1, 5, 0.0, 0.0), (1, 1, 4, 1.0, 0.0), (1, 1, 3, None, 0.0), (1, 1, 2, None, 0.0), (2, None, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, l int, rank int, x double, y double")
    kept = spatial.keep_strongest(df, ["k", "l"], F.col("rank"), F.lit(2.0), inclusive=True)
    assert "Generate explode(sequence" not in kept._jdf.queryExecution().toString() and "collect_list" in kept._jdf.queryExecution().toString()
    assert sorted(r["rank"] for r in kept.collect()) == [3, 5, 5]
