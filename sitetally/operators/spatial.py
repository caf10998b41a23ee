"""Points, zones and cells: nearest label, zones, duplicate removal, flooding.

Joins go over grid cells; no step compares all points of a page with each other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..fixed_values import LEGEND_MARGIN_PT, RENDER_ZOOM
from ..functions.text import py_round
from ..session import cut_lineage, ship_package
from .ordered import rank_by_range

PAGE = ["job_id", "page"]
# edges that cross one cell of a zone's cover, and the least side of a cell (a power of two)
EDGES = 16
FINEST = -6
NEAR_CELL = 16.0
# labels of an even block, and points that look for their nearest label together
NEAR = 4096
TOGETHER = 64
# cells of a tile's side: for flooding, and for searches around a cell
TILE = 128
CELLS = 128
# boxes around anchors (points or labels of a block) that one group holds, and pairs of a box and a candidate that are looked at together
ANCHORS = 100_000
LOOKED = 1 << 22
# points whose surroundings are looked at together
CHUNK = 1024
# cells that a room names at a time
WISHES = 8
# rows of a group that SQL scans, and spots that one scan in Python decides at most
FEW = 64
SCANNED = 20_000
# stands for radius 0 where equal points are neighbours
POINT = 1e-9


def _cell(c: str, side) -> Column:
    return F.floor(F.col(c) / F.lit(side)).cast("bigint")


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by keys in as many partitions as shuffles have: Python's work on few bytes isn't left to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# -- nearest label -------------------------------------------------------------------------

def _nearest(points: pa.Table, labels: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Distance and row of each point's nearest label; the first (idx, name) wins a tie.

    Points close together look at the labels that can be nearest to one of them.
    """
    labels = labels.take(pc.sort_indices(labels, sort_keys=[("idx", "ascending"), ("name", "ascending")], null_placement="at_start"))
    x, y, rx, ry = (t.column(c).to_numpy().astype(float) for t, c in ((points, "x"), (points, "y"), (labels, "rx"), (labels, "ry")))
    strip = max(float(np.ptp(y)) / math.sqrt(len(y) / TOGETHER + 1), POINT)
    order = np.lexsort((x, np.floor((y - y.min()) / strip)))
    at, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    for some in np.split(order, range(TOGETHER, len(order), TOGETHER)):
        px, py = x[some], y[some]
        gaps, spans = zip(*((np.maximum(0.0, np.maximum(p.min() - r, r - p.max())), np.maximum(np.abs(r - p.min()), np.abs(r - p.max()))) for p, r in ((px, rx), (py, ry))))
        reach = (spans[0] * spans[0] + spans[1] * spans[1]).min()
        near = np.flatnonzero(gaps[0] * gaps[0] + gaps[1] * gaps[1] <= reach * (1 + 1e-9) + 1e-9)
        dx, dy = rx[near] - px[:, None], ry[near] - py[:, None]
        d = np.sqrt(dx * dx + dy * dy)
        first = d.argmin(1)
        at[some], distance[some] = near[first], d[np.arange(len(some)), first]
    return distance, labels.take(at)


def nearest_room(points: DataFrame, rooms: DataFrame, finest: float = NEAR_CELL, near: int = NEAR) -> DataFrame:
    """Nearest room label per distinct point: (job_id, page, x, y, room, room_dist).

    Each page is cut into blocks that would hold about ``near`` labels each if even, at least ``finest`` wide. A point meets the
    labels of its block and of a quarter of its side around it, all at once. If its nearest one may lie farther away, it goes into the
    next round, with blocks four times as wide. Blocks that hold very many labels or points are dealt to several groups. The first
    label (``idx``) wins a tie; a page without labels gives ''.
    """
    ship_package(points.sparkSession)
    spots = points.select(*PAGE, "x", "y").distinct()
    finite = [F.abs(c) < math.inf for c in ("x", "y")]
    labels = rooms.where(finite[0] & finite[1]).dropna(subset=PAGE).groupBy(*PAGE, F.col("x").alias("rx"), F.col("y").alias("ry")).agg(
        F.min(F.struct("idx", "name")).alias("label")).select(*PAGE, "rx", "ry", "label.idx", "label.name")
    labels = cut_lineage(labels)
    w, h, n = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("n") / near
    pages = cut_lineage(labels.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n"), F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.min(F.struct("idx", "name", "rx", "ry")).alias("first")).withColumn(
        "side", F.greatest(F.lit(float(finest)), F.sqrt(w * h / n), F.greatest(w, h) / n)).drop("n"))
    at = spots.join(pages, PAGE, "left").withColumn("_in", F.coalesce(finite[0] & finite[1], F.lit(False)) & F.col("side").isNotNull())
    dx, dy = F.col("first.rx") - F.col("x"), F.col("first.ry") - F.col("y")
    lost = at.where(~F.col("_in")).select(*PAGE, "x", "y", F.sqrt(dx * dx + dy * dy).alias("d"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("first.name")).alias("name"))
    block = [*PAGE, "bx", "by"]

    def met_in(todo: DataFrame, side: Column) -> DataFrame:
        """Each point of todo (with its page's box and side) to its nearest label around its block, and how far those reach."""
        halo, margin, placed = side / 4, F.lit(math.inf), todo
        for c in ("x", "y"):
            low, high = F.col(f"{c}0"), F.col(f"{c}1")
            home = F.floor((F.greatest(low, F.least(F.col(c), high)) - low) / side).cast("bigint")
            left, right = low + home * side - halo, low + (home + 1) * side + halo
            margin = F.least(margin, F.when(left > low, F.col(c) - left), F.when(right < high, right - F.col(c)))
            placed = placed.withColumn(f"b{c}", home)
        placed = cut_lineage(placed.withColumn("margin", margin).select(*block, "x", "y", "margin"))

        def reached(c: str) -> Column:
            return F.explode(F.sequence(*(F.floor((F.col(f"r{c}") - F.col(f"{c}0") + by) / side).cast("bigint") for by in (-halo, halo))))

        offered = labels.join(pages.select(*PAGE, "x0", "y0", "side"), PAGE).withColumn("bx", reached("x")).withColumn("by", reached("y")).select(
            *block, "rx", "ry", "idx", "name")
        asked = placed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("_points"))
        offered = offered.join(asked.select(*block), block, "left_semi")
        parts = asked.join(offered.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("_labels")), block)
        crowded = cut_lineage(parts.where("_points > 1 or _labels > 1"))

        def dealt(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
            """df's rows once in each group that needs them: dealt by their own part, repeated for the other side's."""
            numbered = df.join(crowded, block, "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(*by), own), F.lit(0)))
            return numbered.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1)))

        ours, theirs = dealt(placed, "_points", "_labels", "x", "y"), dealt(offered, "_labels", "_points", "rx", "ry")
        theirs = theirs.toDF(*theirs.columns)  # columns of its own beside those of placed

        def meet(points: pa.Table, labels: pa.Table) -> pa.Table:
            if not len(points):
                return pa.table([*(points.column(c) for c in (*PAGE, "x", "y", "margin")), pa.array([], pa.float64()), *(labels.column(c).slice(0, 0) for c in ("idx", "name"))], schema.names)
            # a block that reaches no label leaves its points to the next round
            distance, found = _nearest(points, labels) if len(labels) else (np.full(len(points), math.inf), {c: pa.nulls(len(points), labels.schema.field(c).type) for c in ("idx", "name")})
            return pa.table([*(points.column(c) for c in (*PAGE, "x", "y", "margin")), pa.array(distance), found["idx"], found["name"]], schema.names)

        kinds = [*(placed.schema[c] for c in (*PAGE, "x", "y", "margin")), StructField("d", DoubleType()), *(labels.schema[c] for c in ("idx", "name"))]
        schema = StructType([StructField(f.name, f.dataType) for f in kinds])
        group = [*block, "_points", "_labels"]
        met = _dealt(ours, group).groupBy(*group).cogroup(_dealt(theirs, group).groupBy(*group)).applyInArrow(meet, schema)
        best = F.min(F.struct("d", "idx", "name")).alias("hit")
        if crowded.isEmpty():
            return cut_lineage(met)
        return cut_lineage(met.groupBy(*PAGE, "x", "y", "margin").agg(best).select(*PAGE, "x", "y", "margin", "hit.*"))

    found, wide, todo = lost, 1.0, at.where("_in")
    while True:
        met = met_in(todo, F.col("side") * wide)
        # all that a block reaches is nearer than its margin
        settled = F.col("d") <= F.col("margin") * (1 - 1e-6)
        found = found.unionByName(met.where(settled).select(*PAGE, "x", "y", "d", "name"))
        far = met.where(~settled).select(*PAGE, "x", "y")
        if far.isEmpty():
            break
        todo, wide = far.join(pages, PAGE), wide * 4
    return found.select(*PAGE, "x", "y", F.coalesce("name", F.lit("")).alias("room"), py_round("d", 1).alias("room_dist"))


# -- zones ------------------------------------------------------------------------------------

def rectangle(x, y, w, h) -> Column:
    """Corner points of a box, rounded to one decimal."""
    def point(px, py):
        return F.struct(py_round(px, 1).alias("x"), py_round(py, 1).alias("y"))

    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)}


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule; each edge joins a point to the one before it."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))
    crossings = F.zip_with(points, before, lambda p, q: F.when(
        ((p["y"] > y) != (q["y"] > y))
        & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1e-9)).otherwise(q["y"] - p["y"]) + p["x"]), 1
    ).otherwise(0))
    return F.aggregate(crossings, F.lit(0), lambda n, c: n + c) % 2 == 1


def _cover_cell(level: int, cx: int, cy: int, p: np.ndarray, q: np.ndarray, edges: np.ndarray) -> tuple[bool, list[float], np.ndarray, np.ndarray]:
    """What decides inside one cell of side 2**level: whether a ray from it to the right crosses an odd number of the edges that count
    for every point of the cell; heights, each of which counts for the points below it; the edges to be tested; the edges
    that matter to parts of the cell. Edge i leads from point i - 1 to point i; ``edges`` are those that may matter.

    Edges wholly right of the cell count by their ends alone. An end that two of them share counts twice, hence not at all, so
    in the cell's range of y just the ends beside tested edges are left.
    """
    side = 2.0 ** level
    x0, y0, x1, y1 = cx * side, cy * side, (cx + 1) * side, (cy + 1) * side
    margin = 1e-9 * max(1.0, abs(x0), abs(x1))
    a, b = p[edges], q[edges]
    near = (np.maximum(a[:, 1], b[:, 1]) >= y0) & (np.minimum(a[:, 1], b[:, 1]) <= y1) & (np.maximum(a[:, 0], b[:, 0]) >= x0 - margin)
    edges, right = edges[near], np.minimum(a[near, 0], b[near, 0]) > x1 + margin
    ends, times = np.unique(np.concatenate([edges[right], (edges[right] - 1) % len(p)]), return_counts=True)
    heights = p[ends[times % 2 == 1], 1]
    return bool((heights >= y1).sum() % 2), heights[(heights > y0) & (heights < y1)].tolist(), edges[~right], edges


def _covers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of a quadtree that hold a part of each zone. Cells that most edges cross are split first, as long as there are about
    as few cells as edges."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            p = np.array([row.xs, row.ys], float).T.reshape(-1, 2)
            if not len(p) or not np.isfinite(p).all():
                continue
            q, whole = np.roll(p, 1, axis=0), np.arange(len(p))
            level = max(FINEST, math.ceil(math.log2(max(float(np.ptp(p[:, 0])), float(np.ptp(p[:, 1])), 2.0 ** FINEST))))
            low, high = np.floor(p.min(0) / 2.0 ** level).astype(int), np.floor(p.max(0) / 2.0 ** level).astype(int)
            heap = []

            def add(level: int, cx: int, cy: int, edges: np.ndarray) -> None:
                odd, heights, tested, inner = _cover_cell(level, cx, cy, p, q, edges)
                if odd or len(tested) or heights:
                    heapq.heappush(heap, (-len(tested), level, cx, cy, odd, heights, tested, inner))

            for cx in range(low[0], high[0] + 1):
                for cy in range(low[1], high[1] + 1):
                    add(level, cx, cy, whole)
            final, budget = [], 2 * len(p) + 64
            while heap and -heap[0][0] > EDGES and len(heap) + len(final) < budget:
                _, level, cx, cy, *cell = heapq.heappop(heap)
                if level == FINEST:
                    final.append((level, cx, cy, *cell))
                    continue
                for i in (0, 1):
                    for j in (0, 1):
                        add(level - 1, 2 * cx + i, 2 * cy + j, cell[-1])
            for level, cx, cy, odd, heights, tested, _ in final + [c[1:] for c in heap]:
                out.append((*row[:9], level, cx, cy, odd, heights, np.hstack([p[tested], q[tested]]).tolist()))
        yield pd.DataFrame(out, columns=[*pdf.columns[:9], "level", "cx", "cy", "odd", "heights", "edges"])


def _part(name: str):
    return lambda point: point[name].cast("double")


def zone_cover(zones: DataFrame) -> DataFrame:
    """(job_id, page, zy, zx, zid, name, bx, by, ...) to cells: level, cx, cy and what decides inside each of them."""
    ship_package(zones.sparkSession)
    box = bounds(F.col("points"))
    flat = zones.select(
        *PAGE, F.col("y").alias("zy"), F.col("x").alias("zx"), F.col("id").alias("zid"), "name", box["x"].alias("bx"), box["y"].alias("by"),
        F.array(box["x"] + box["w"], box["y"] + box["h"]).alias("far"),
        *(F.transform("points", _part(c)).alias(f"{c}s") for c in ("x", "y"))).where("size(xs) > 0")
    head = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in flat.columns[:9])
    return flat.mapInPandas(_covers, f"{head}, level int, cx bigint, cy bigint, odd boolean, heights array<double>, edges array<array<double>>")


def zone_assign(points: DataFrame, zones: DataFrame, locked_only: bool = True) -> DataFrame:
    """Name of the first zone, in (y, x) order of its page, around each distinct point.

    ``zones(job_id, page, id, name, x, y, points, locked)``. Points outside all zones are absent. A zone is covered by cells of a
    quadtree; a point meets the cells around it, one a level, and tests the few edges that cross them (as ``in_polygon`` does all).
    """
    cover = cut_lineage(zone_cover(zones.where("locked") if locked_only else zones))
    levels = F.array(*(F.lit(r["level"]) for r in cover.select("level").distinct().collect())).cast("array<int>")  # powers of two: a few dozen at most
    spots = points.select(*PAGE, F.col("x").alias("px"), F.col("y").alias("py")).distinct().withColumn("level", F.explode(levels))
    spots = spots.withColumns({c: F.floor(F.col(p) / F.pow(F.lit(2.0), "level")).cast("bigint") for c, p in (("cx", "px"), ("cy", "py"))})
    x, y = F.col("px"), F.col("py")

    def crossed(e: Column) -> Column:
        return ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / F.when(e[3] == e[1], F.lit(1e-9)).otherwise(e[3] - e[1]) + e[0])

    passed = F.size(F.filter("edges", crossed)) + F.size(F.filter("heights", lambda h: h > y)) + F.col("odd").cast("int")
    inside = (
        spots.join(cover, [*PAGE, "level", "cx", "cy"])
        .where(x.between(F.col("bx"), F.col("far")[0]) & y.between(F.col("by"), F.col("far")[1]) & (passed % 2 == 1))
    )
    return inside.groupBy(*PAGE, "px", "py").agg(F.min_by("name", F.struct("zy", "zx", "zid")).alias("zone")).select(
        *PAGE, F.col("px").alias("x"), F.col("py").alias("y"), F.coalesce("zone", F.lit("")).alias("zone"))


def legend_exclusion(detections: DataFrame, legends: DataFrame, min_x: float = LEGEND_MARGIN_PT * RENDER_ZOOM) -> DataFrame:
    """Drop detections in the left margin or inside the legend box of their page (pixels)."""
    boxes = legends.select(*PAGE, "x0", "y0", "x1", "y1")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return detections.where(F.col("x") >= min_x).join(boxes, PAGE, "left").where(
        ~F.coalesce(inside, F.lit(False))).drop("x0", "y0", "x1", "y1")


def anchor_companions(anchors: DataFrame, candidates: DataFrame, reach: float = 100.0, threshold: float = 0.62) -> DataFrame:
    """Best-scoring candidate of each template around each anchor, if good enough.

    ``anchors(job_id, page, anchor_id, x, y)``, ``candidates(job_id, page, template, x, y, score)`` in pixels.
    A box and the candidates it may hold meet once, in the box's home cell: a candidate goes to the up to four homes whose boxes can
    reach it. There the candidates of a template are looked at from the best one down, until each box has one.
    """
    ship_package(anchors.sparkSession)
    low = {c: F.greatest(F.lit(0), (F.col(c) - reach).cast("int")) for c in ("x", "y")}
    high = {c: (F.col(c) + reach).cast("int") for c in ("x", "y")}
    boxes = anchors.select(*PAGE, "anchor_id", low["x"].alias("x0"), high["x"].alias("x1"), low["y"].alias("y0"), high["y"].alias("y1"))
    side, home = 2 * reach + 1, [*PAGE, "hx", "hy"]
    boxes = boxes.where("x1 > x0 and y1 > y0 and job_id is not null and page is not null").withColumns({"hx": _cell("x0", side), "hy": _cell("y0", side)})
    spots = candidates.where(F.col("score") >= threshold).groupBy(*PAGE, "template", "x", "y").agg(F.max("score").alias("score"))
    for c in ("x", "y"):
        spots = spots.withColumn(f"h{c}", F.explode(F.array(_cell(c, side) - 1, _cell(c, side))))
    # a home with very many boxes is dealt to several groups, each with all of its candidates
    crowded = cut_lineage(boxes.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("_parts")).where("_parts > 1"))
    boxes = boxes.join(crowded, home, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("anchor_id", "x0", "y0"), "_parts"), F.lit(0))).drop("_parts")
    spots = spots.where("job_id is not null and page is not null").join(crowded, home, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    def best(boxes: pa.Table, spots: pa.Table) -> pa.Table:
        x0, x1, y0, y1 = (boxes.column(c).to_numpy() for c in ("x0", "x1", "y0", "y1"))
        x, y, score = (spots.column(c).to_numpy().astype(float) for c in ("x", "y", "score"))
        kinds = pd.factorize(spots.column("template").to_pandas(), use_na_sentinel=False)[0]
        order = np.lexsort((x, y, -score, ~np.isnan(score), kinds))
        whose, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for places in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
            open_, at, step = np.arange(len(x0)), 0, 32
            while len(open_) and at < len(places):
                look = places[at:at + step]
                inside = (x[look] >= x0[open_, None]) & (x[look] < x1[open_, None]) & (y[look] >= y0[open_, None]) & (y[look] < y1[open_, None])
                hit, first = inside.any(1), inside.argmax(1)
                whose.append(open_[hit])
                found.append(look[first[hit]])
                open_, at = open_[~hit], at + step
                step = min(2 * step, max(32, LOOKED // max(1, len(open_))))
        who, what = np.concatenate(whose), np.concatenate(found)
        return pa.table([*(boxes.column(c).take(who) for c in (*PAGE, "anchor_id")), *(spots.column(c).take(what) for c in ("template", "x", "y", "score"))], schema.names)

    kinds = {**{c: boxes.schema[c].dataType for c in (*PAGE, "anchor_id")}, **{c: spots.schema[c].dataType for c in ("template", "x", "y", "score")}}
    schema = StructType([StructField(c, kind) for c, kind in kinds.items()])
    group = [*home, "part"]
    met = _dealt(boxes, group).groupBy(*group).cogroup(_dealt(spots, group).groupBy(*group)).applyInArrow(best, schema)
    hit = F.struct("score", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))
    return met.groupBy(*PAGE, "anchor_id", "template").agg(F.max(hit).alias("h")).select(
        *PAGE, "anchor_id", "template", (-F.col("h.nx")).alias("x"), (-F.col("h.ny")).alias("y"), F.col("h.score").alias("score"))


# -- greedy removal of neighbours -------------------------------------------------------------

def _clash(a, b, inclusive: bool) -> Column:
    """Whether two rows with _x, _y and _r are neighbours: their distance is below the smaller radius, or equal to it if ``inclusive``.
    Rows with equal places and radii are, even without a number there."""
    dx, dy, reach = a["_x"] - b["_x"], a["_y"] - b["_y"], F.least(a["_r"], b["_r"])
    d2, r2 = dx * dx + dy * dy, reach * reach
    near = F.coalesce((d2 <= r2) if inclusive else (d2 < r2), F.lit(False))
    return near | (a["_x"].eqNullSafe(b["_x"]) & a["_y"].eqNullSafe(b["_y"]) & (a["_r"] == b["_r"]))


def _few(rows: DataFrame, keys: list[str], columns: list[str], inclusive: bool) -> DataFrame:
    """The rows that scans of small groups keep. Each group's rows are collected."""
    item = F.struct("_strength", "_x", "_y", "_r", F.struct(*columns).alias("row"))
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("rows"))
    none = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", none, lambda done, r: F.when(F.exists(done, lambda k: _clash(k, r, inclusive)), done).otherwise(F.concat(done, F.array(r))))
    alone = groups.where("size(rows) = 1").select(F.col("rows")[0]["row"].alias("row"))
    # every copy of a row that stays does
    several = groups.where("size(rows) > 1").withColumn("kept", F.transform(kept, lambda k: k["_strength"]))
    staying = F.filter("rows", lambda r: F.exists("kept", lambda k: k.eqNullSafe(r["_strength"])))
    return alone.unionByName(several.select(F.explode(F.transform(staying, lambda r: r["row"])).alias("row"))).select("row.*")


def _scan(pdf: pd.DataFrame, inclusive: bool) -> np.ndarray:
    """State after the greedy scan of a piece of a group: 1 kept, -1 removed, 0 open.

    ``safe`` rows have all their neighbours in the piece. A row with a better kept neighbour goes, one with a better open neighbour
    stays open, and any other safe one is kept. Kept and open rows are looked up in a grid per level of radii.
    """
    grids: dict[int, dict[tuple[int, int], list[tuple[float, float, float, bool]]]] = {}
    order = np.argsort(pdf["_order"].to_numpy(), kind="stable")
    states = pdf["state"].to_numpy().copy()

    def met(x: float, y: float, r: float) -> int:
        found = 1
        for other, cells in grids.items():
            side = 2.0 ** (other + 1)
            cx, cy = math.floor(x / side), math.floor(y / side)
            for i in (cx - 1, cx, cx + 1):
                for j in (cy - 1, cy, cy + 1):
                    for px, py, pr, kept in cells.get((i, j), ()):
                        d2, reach = (px - x) * (px - x) + (py - y) * (py - y), min(r, pr)
                        if d2 < reach * reach or (inclusive and d2 == reach * reach):
                            if kept:
                                return -1
                            found = 0
        return found

    for at, x, y, r, safe in zip(order.tolist(), *(pdf[c].to_numpy()[order].tolist() for c in ("_x", "_y", "_r", "safe"))):
        if not states[at]:
            found = met(x, y, r)
            states[at] = found if safe or found < 0 else 0
        if states[at] >= 0:
            level = math.frexp(r)[1] - 1
            side = 2.0 ** (level + 1)
            grids.setdefault(level, {}).setdefault((math.floor(x / side), math.floor(y / side)), []).append((x, y, r, bool(states[at])))
    return states


def _whole(inclusive: bool):
    """The scan of several whole groups, packed into one."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [part[_scan(part.assign(state=0, safe=True), inclusive) == 1] for _, part in pdf.groupby("_gid")]
        return pd.concat(parts)[["_gid", "_order"]]

    return scan


def _in_rounds(todo: DataFrame, inclusive: bool, scanned: int) -> DataFrame:
    """(_gid, _order) of the rows that scans of large groups keep, of (_gid, _order, _x, _y, _r).

    A group is cut into tiles at least eight of its largest radius wide, and so wide that an even one would hold about ``scanned`` rows. A tile is scanned with the rows up to two of
    these radii around it; what depends on rows farther away stays open, and goes into the next round with the kept rows around.
    So a round settles all but chains of neighbours that lead from tile to tile.
    """
    extent = todo.groupBy("_gid").agg(
        F.max("_r").alias("_reach"), (F.max("_x") - F.min("_x")).alias("w"), (F.max("_y") - F.min("_y")).alias("h"), F.greatest(F.lit(1.0), F.count(F.lit(1)) / scanned).alias("n"))
    sides = extent.select("_gid", "_reach", F.greatest(8 * F.col("_reach"), F.sqrt(F.col("w") * F.col("h") / F.col("n")), F.greatest("w", "h") / F.col("n")).alias("_side"))
    row = ["_gid", "_order", "_x", "_y", "_r", "_reach", "_side"]
    todo = cut_lineage(todo.join(sides, "_gid").select(*row).withColumn("state", F.lit(0)))
    tile = ["_gid", "_tx", "_ty"]

    def at(c: str, by) -> Column:
        return F.floor((F.col(c) + by) / F.col("_side"))

    def gap(c: str, t: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(t) * F.col("_side") - F.col(c), F.col(c) - (F.col(t) + 1) * F.col("_side"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        now = _scan(pdf, inclusive)
        return pdf.assign(state=now)[(now != 0) & (pdf["state"] == 0) & pdf["home"]][["_gid", "_order", "state"]]

    halo, kept_parts = 2 * F.col("_reach"), []
    while True:
        placed = todo.withColumn("_tx", F.explode(F.sequence(at("_x", -halo), at("_x", halo)))).withColumn("_ty", F.explode(F.sequence(at("_y", -halo), at("_y", halo))))
        home = (F.col("_tx") == at("_x", F.lit(0.0))) & (F.col("_ty") == at("_y", F.lit(0.0)))
        away = F.sqrt(gap("_x", "_tx") * gap("_x", "_tx") + gap("_y", "_ty") * gap("_y", "_ty"))
        placed = placed.withColumns({"home": home, "safe": home | (away <= 0.99 * F.col("_reach"))})
        open_tiles = cut_lineage(placed.where("home and state = 0").select(*tile).distinct())
        if open_tiles.isEmpty():
            break
        placed = placed.join(open_tiles, tile, "left_semi")
        settled = cut_lineage(_dealt(placed.select(*tile, "_order", "_x", "_y", "_r", "state", "home", "safe"), tile).groupBy(*tile).applyInPandas(
            settle, "_gid bigint, _order bigint, state int"))
        kept_parts.append(settled.where("state = 1").select("_gid", "_order"))
        around = placed.select(*row, "state").distinct()
        now = settled.withColumnRenamed("state", "_now")
        todo = cut_lineage(around.join(now, ["_gid", "_order"], "left").withColumn("state", F.coalesce("_now", "state")).where("state >= 0").drop("_now"))
    survivors = kept_parts[0]
    for part in kept_parts[1:]:
        survivors = survivors.unionByName(part)
    return survivors


def keep_strongest(points: DataFrame, keys: list[str], rank: Column, radius: Column, inclusive: bool, scanned: int = SCANNED) -> DataFrame:
    """Rows a greedy scan keeps: by falling ``rank``, unless a kept row lies within the smaller radius.

    ``rank`` must differ between rows. Without a positive radius a row has no neighbours, unless ``inclusive`` makes those of its
    very point count. Groups of up to FEW rows are scanned in SQL, those of up to ``scanned`` spots each by itself in Python, larger
    ones tile by tile in rounds. A null key groups nothing: such rows go.
    """
    ship_package(points.sparkSession)
    marks = {"_strength": rank, "_r": F.coalesce(radius.cast("double"), F.lit(0.0)), "_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")}
    whole = points.withColumns(marks)
    alone = F.lit(False) if inclusive else F.col("_r") <= 0
    marked = whole.where(~alone).withColumn("_r", F.greatest("_r", F.lit(POINT))).dropna(subset=keys)
    crowded = cut_lineage(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min(FEW, scanned)).withColumn(
        "_gid", F.monotonically_increasing_id()))
    kept = _few(marked.join(crowded, keys, "left_anti"), keys, points.columns, inclusive)
    if not crowded.isEmpty():
        kept = kept.unionByName(_many(marked, crowded, keys, inclusive, scanned).select(*points.columns))
    return kept if inclusive else whole.where(alone).select(*points.columns).unionByName(kept)


def _many(marked: DataFrame, crowded: DataFrame, keys: list[str], inclusive: bool, scanned: int) -> DataFrame:
    """The rows of the ``crowded`` groups that scans keep."""
    several = marked.join(crowded.drop("_n"), keys)
    top = cut_lineage(several.groupBy("_gid", "_x", "_y", "_r").agg(F.max("_strength").alias("_strength")))
    ordered = rank_by_range(top, ["_gid"], [F.desc("_strength")], "_order")
    placed = F.coalesce(F.abs("_x") < F.lit(math.inf), F.lit(False)) & F.coalesce(F.abs("_y") < F.lit(math.inf), F.lit(False))
    spots = ordered.where(placed).select("_gid", "_order", "_x", "_y", "_r")
    sizes = cut_lineage(spots.groupBy("_gid").agg(F.count(F.lit(1)).alias("_n")))
    n, most = sizes.agg(F.coalesce(F.sum(F.when(F.col("_n") <= scanned, F.col("_n"))), F.lit(0)), F.max("_n")).first()
    # groups go into Python packed, so that small ones don't cost a call each
    bucket = F.pmod(F.xxhash64("_gid"), F.lit(-(-n // scanned) or 1)).alias("_bucket")
    small = spots.join(sizes.where(F.col("_n") <= scanned).select("_gid"), "_gid", "left_semi").select(bucket, "*")
    survivors = ordered.where(~placed).select("_gid", "_order").unionByName(
        _dealt(small, ["_bucket"]).groupBy("_bucket").applyInPandas(_whole(inclusive), "_gid bigint, _order bigint"))
    if most is not None and most > scanned:
        survivors = survivors.unionByName(_in_rounds(spots.join(sizes.where(F.col("_n") > scanned).select("_gid"), "_gid", "left_semi"), inclusive, scanned))
    ranks = cut_lineage(ordered.join(survivors, ["_gid", "_order"], "left_semi").select("_gid", "_strength"))
    return several.join(ranks, ["_gid", "_strength"], "left_semi")


def remove_duplicate_symbols(symbols: DataFrame, quality: Column) -> DataFrame:
    """One symbol per article and spot of a page: the best source wins, then the first seen."""
    rank = F.struct(quality.alias("q"), (-F.col("seq")).alias("s"))
    radius = F.when(F.col("page_type") == "LUMINAIRE", F.lit(8.0)).otherwise(F.lit(5.0))
    return keep_strongest(symbols, ["job_id", "page", "page_type", "article"], rank, radius, inclusive=True)


def suppress_overlaps(detections: DataFrame) -> DataFrame:
    """Of overlapping detections of any article keep the highest score; boxes overlap by 0.7 of the smaller size."""
    rank = F.struct("score", "x", "y", "article", "categorie", "size", "seq")
    return keep_strongest(detections, PAGE, rank, F.lit(0.7) * F.col("size"), inclusive=False)


# -- tiles of cells ------------------------------------------------------------------------------

def _packed_tiles(cells: DataFrame, side: int) -> DataFrame:
    """(job_id, page, tx, ty, mask): the cells of each tile as bits of a side x side square, row by row."""
    place = F.pmod("y", F.lit(side)) * side + F.pmod("x", F.lit(side))
    return cells.select(*PAGE, _cell("x", side).alias("tx"), _cell("y", side).alias("ty"), place.cast("bigint").alias("place")).groupBy(
        *PAGE, "tx", "ty").agg(F.bitmap_construct_agg("place").alias("mask"))


def _unpacked(mask: bytes, side: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")
    return bits[: side * side].reshape(side, side).astype(bool)


def _ring_order(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) less than radius away, ring by ring, row by row inside a ring."""
    span = range(1 - radius, radius)
    return sorted(((dy, dx) for dy in span for dx in span), key=lambda o: (max(map(abs, o)), *o))


def _first_cells(asked: DataFrame, tiles: DataFrame, radius: int, count: int) -> DataFrame:
    """For each row of asked (job_id, page, x, y, skip): the next ``count`` cells of the tiles around it in ring order, after ``skip`` of
    them, as rows with ``rank`` (from skip + 1) and the cell (cx, cy).

    A row meets the tiles that its search reaches, at most four, and looks at their bits; a cell it finds is the only other row made.
    """
    def search(points: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        columns = {c: [] for c in ("job_id", "page", "x", "y", "skip", "rank", "cx", "cy")}
        if len(points) and len(masks):
            tx, ty = int(points["tx"].iloc[0]), int(points["ty"].iloc[0])
            area = np.zeros((3 * CELLS, 3 * CELLS), bool)
            for other_x, other_y, mask in zip(masks["ox"], masks["oy"], masks["mask"]):
                j, i = (other_x - tx + 1) * CELLS, (other_y - ty + 1) * CELLS
                area[i:i + CELLS, j:j + CELLS] = _unpacked(mask, CELLS)
            xs, ys = points["x"].to_numpy(), points["y"].to_numpy()
            px, py = xs - (tx - 1) * CELLS, ys - (ty - 1) * CELLS
            skip, (dy, dx) = points["skip"].to_numpy(), np.array(_ring_order(radius)).T
            for at in range(0, len(points), CHUNK):
                part = slice(at, at + CHUNK)
                there = area[py[part, None] + dy, px[part, None] + dx]
                found = np.cumsum(there, axis=1)
                i, k = np.nonzero(there & (found > skip[part, None]) & (found <= skip[part, None] + count))
                for c, v in (("x", xs[part][i]), ("y", ys[part][i]), ("skip", skip[part][i]), ("rank", found[i, k]), ("cx", xs[part][i] + dx[k]), ("cy", ys[part][i] + dy[k])):
                    columns[c].append(v)
        out = pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in columns.items() if c not in PAGE})
        return out.assign(**{c: points[c].iloc[0] if len(points) else 0 for c in PAGE})[list(columns)]

    ship_package(asked.sparkSession)
    if 2 * (radius - 1) > CELLS:
        raise ValueError("a search reaches two tiles a side at most")
    home = ["tx", "ty"]

    def reached(c: str) -> Column:
        return F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / CELLS).cast("bigint") for d in (1 - radius, radius - 1)))))

    placed = asked.withColumns({"tx": _cell("x", CELLS), "ty": _cell("y", CELLS)})
    near = placed.select(*PAGE, *home, reached("x").alias("ox"), "y").select(*PAGE, *home, "ox", reached("y").alias("oy")).distinct()
    masks = near.join(tiles.withColumnsRenamed({"tx": "ox", "ty": "oy"}), [*PAGE, "ox", "oy"])
    masks = masks.toDF(*masks.columns)  # columns of its own beside those of placed
    kinds = {c: placed.schema[c].dataType.simpleString() for c in PAGE}
    group = [*PAGE, *home]
    return _dealt(placed, group).groupBy(*group).cogroup(_dealt(masks, group).groupBy(*group)).applyInPandas(
        search, f"job_id {kinds['job_id']}, page {kinds['page']}, x bigint, y bigint, skip bigint, rank bigint, cx bigint, cy bigint")


# -- flooding room labels over free cells ----------------------------------------------------------

def place_seeds(rooms: DataFrame, cells: DataFrame, radius: int = 15) -> DataFrame:
    """Starting cell of each room: the nearest free cell no earlier room took.

    Every room asks for its first free cell in ring order; a cell goes to the lowest ``idx`` asking; the others ask for their
    next one until nobody has to. Rooms name their cells WISHES at a time, further ones only when all of those went to others.
    ``rooms(job_id, page, idx, x, y)`` in cells, ``cells(job_id, page, x, y)`` the free ones.
    """
    tiles = cut_lineage(_packed_tiles(cells.distinct(), CELLS))
    room = [*PAGE, "idx"]
    # rooms on one spot name the same cells, and each earlier one takes a cell that the later ones would have named before
    same_spot = Window.partitionBy(*PAGE, "x", "y").orderBy("idx")
    asking = rooms.select(*room, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).withColumn(
        "skip", (F.row_number().over(same_spot) - 1).cast("bigint"))

    def wishes_of(asked: DataFrame) -> DataFrame:
        found = _first_cells(asked.select(*PAGE, "x", "y", "skip").distinct(), tiles, radius, WISHES)
        return asked.join(found, [*PAGE, "x", "y", "skip"]).select(*room, "rank", "skip", F.col("cx").alias("x"), F.col("cy").alias("y"))

    wishes = cut_lineage(wishes_of(asking))
    lost = None
    while True:
        open_wishes = wishes if lost is None else wishes.join(lost, [*room, "rank"], "left_anti")
        asks = open_wishes.groupBy(*room).agg(F.min(F.struct("rank", "x", "y", "skip")).alias("a")).select(*room, "a.*")
        winners = asks.groupBy(*PAGE, "x", "y").agg(F.min("idx").alias("winner"))
        refused = cut_lineage(asks.join(winners, [*PAGE, "x", "y"]).where("idx <> winner").select(*room, "rank", "skip"))
        if refused.isEmpty():
            return asks.select(*room, "x", "y")
        lost = refused if lost is None else cut_lineage(lost.unionByName(refused))
        # whose last named cell is gone names more; a room that has fewer than WISHES left has named all
        spent = refused.where(F.col("rank") == F.col("skip") + WISHES).select(*room, F.col("rank").alias("skip"))
        if not spent.isEmpty():
            further = wishes_of(asking.drop("skip").join(spent, room))
            wishes = cut_lineage(wishes.unionByName(further))


def _spread(free: np.ndarray, cells: np.ndarray, steps: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least (steps, idx) of every free cell of a square from cells (flat places) that have some, going up, down, left and right.

    Wave by wave: each wave writes the cells it reaches first, so the work grows with the cells.
    """
    side = free.shape[1] + 2
    open_ = np.zeros((free.shape[0] + 2, side), bool)
    open_[1:-1, 1:-1] = free
    open_ = open_.ravel()
    none = np.iinfo(np.int64).max
    at_step, label = np.full(len(open_), -1), np.full(len(open_), none)
    order = np.argsort(steps, kind="stable")
    cells, steps, idx = (cells // free.shape[1] + 1) * side + cells % free.shape[1] + 1, steps[order], idx[order]
    cells = cells[order]
    begins = np.flatnonzero(np.diff(steps, prepend=steps[0] - 1)) if len(steps) else np.zeros(0, np.int64)
    groups = [(int(steps[b]), cells[b:e], idx[b:e]) for b, e in zip(begins, [*begins[1:], len(steps)])][::-1]
    wave, now = np.zeros(0, np.int64), 0
    while len(wave) or groups:
        if not len(wave):
            now = groups[-1][0]
        reached, offered = wave, label[wave] if len(wave) else np.zeros(0, np.int64)
        if len(wave):
            reached = np.concatenate([wave - 1, wave + 1, wave - side, wave + side])
            offered = np.tile(offered, 4)
        if groups and groups[-1][0] == now:
            _, more, labels = groups.pop()
            reached, offered = np.append(reached, more), np.append(offered, labels)
        new = open_[reached] & (at_step[reached] < 0)
        reached, offered = reached[new], offered[new]
        np.minimum.at(label, reached, offered)
        wave = np.unique(reached)
        at_step[wave] = now
        now += 1
    inside = np.s_[1:-1, 1:-1]
    return at_step.reshape(-1, side)[inside], label.reshape(-1, side)[inside]


def flood(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Label of the room nearest on foot for every reachable free cell; the lowest ``idx`` wins a tie.

    Cells are packed into tiles, a row each. Rounds carry only the cells along tile edges: a tile that a label enters on a
    shorter way is solved from its seeds and edges, and offers its edges to its neighbours. The number of rounds is that of tiles on
    the longest shortest way. The insides of tiles are made once, when no edge changes any more.
    """
    ship_package(cells.sparkSession)
    tile, place = [*PAGE, "tx", "ty"], F.pmod("y", F.lit(TILE)) * TILE + F.pmod("x", F.lit(TILE))
    kinds = {c: cells.schema[c].dataType.simpleString() for c in PAGE}
    head = f"job_id {kinds['job_id']}, page {kinds['page']}, tx bigint, ty bigint"
    start = seeds.select(*PAGE, _cell("x", TILE).alias("tx"), _cell("y", TILE).alias("ty"), place.cast("bigint").alias("place"),
                         F.lit(0).cast("bigint").alias("steps"), F.col("idx").cast("bigint").alias("idx"))
    # a blocked cell spreads nothing: tiles drop it
    tiles = cut_lineage(_packed_tiles(cells.select(*PAGE, "x", "y").distinct(), TILE))

    def solve(known: pd.DataFrame, masks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not len(known) or not len(masks):
            return None
        free = _unpacked(masks["mask"].iloc[0], TILE)
        best = known.sort_values(["place", "steps", "idx"]).drop_duplicates("place")
        best = best[free.ravel()[best["place"].to_numpy()]]
        return free, *_spread(free, *(best[c].to_numpy() for c in ("place", "steps", "idx")))

    def edges(known: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        """What the tile offers its neighbours: their cell beside each edge cell, one step on."""
        columns = {c: [np.zeros(0, np.int64)] for c in ("tx", "ty", "place", "steps", "idx")}
        solved = solve(known, masks)
        if solved is not None:
            _, steps, label = solved
            tx, ty = (int(masks[c].iloc[0]) for c in ("tx", "ty"))
            along = np.arange(TILE)
            for dx, dy, own, there in ((-1, 0, np.s_[:, 0], along * TILE + TILE - 1), (1, 0, np.s_[:, -1], along * TILE),
                                       (0, -1, np.s_[0, :], (TILE - 1) * TILE + along), (0, 1, np.s_[-1, :], along)):
                reached = steps[own] >= 0
                n = int(reached.sum())
                for c, v in (("tx", np.full(n, tx + dx)), ("ty", np.full(n, ty + dy)), ("place", there[reached]), ("steps", steps[own][reached] + 1), ("idx", label[own][reached])):
                    columns[c].append(v)
        out = pd.DataFrame({c: np.concatenate(v) for c, v in columns.items()})
        return out.assign(**{c: masks[c].iloc[0] if len(masks) else 0 for c in PAGE})[[*tile, "place", "steps", "idx"]]

    def fill(known: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        solved = solve(known, masks)
        if solved is None:
            return pd.DataFrame({c: [] for c in (*PAGE, "x", "y", "idx", "steps")})
        _, steps, label = solved
        y, x = np.nonzero(steps >= 0)
        return pd.DataFrame({**{c: masks[c].iloc[0] for c in PAGE}, "x": x + int(masks["tx"].iloc[0]) * TILE, "y": y + int(masks["ty"].iloc[0]) * TILE,
                             "idx": label[y, x], "steps": steps[y, x]})

    known = cut_lineage(start.groupBy(*tile, "place").agg(F.min(F.struct("steps", "idx")).alias("best")))
    touched = known.select(*tile).distinct()
    while True:
        sources = known.join(touched, tile, "left_semi").select(*tile, "place", "best.steps", "best.idx")
        offers = _dealt(sources, tile).groupBy(*tile).cogroup(_dealt(tiles.join(touched, tile, "left_semi"), tile).groupBy(*tile)).applyInPandas(
            edges, f"{head}, place bigint, steps bigint, idx bigint")
        offered = offers.join(tiles.select(*tile), tile, "left_semi").groupBy(*tile, "place").agg(F.min(F.struct("steps", "idx")).alias("offer"))
        better = cut_lineage(offered.join(known, [*tile, "place"], "left").where("best is null or offer < best").select(*tile, "place", F.col("offer").alias("best")))
        if better.isEmpty():
            break
        known = cut_lineage(known.join(better, [*tile, "place"], "left_anti").unionByName(better))
        touched = better.select(*tile).distinct()
    sources = known.select(*tile, "place", "best.steps", "best.idx")
    return _dealt(sources, tile).groupBy(*tile).cogroup(_dealt(tiles, tile).groupBy(*tile)).applyInPandas(
        fill, f"job_id {kinds['job_id']}, page {kinds['page']}, x bigint, y bigint, idx bigint, steps bigint")


def ring_lookup(points: DataFrame, labelled: DataFrame, radius: int = 12) -> DataFrame:
    """Label of the first labelled cell around a cell, ring by ring, row by row inside a ring.

    Distinct cells only. A cell finds its labelled cell in the bits of the tiles around it, then looks its label up.
    ``points(job_id, page, x, y)`` and ``labelled(job_id, page, x, y, idx)`` in cells.
    """
    spots = points.select(*PAGE, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).distinct().withColumn("skip", F.lit(0).cast("bigint"))
    found = _first_cells(spots, _packed_tiles(labelled.select(*PAGE, "x", "y").distinct(), CELLS), radius, 1)
    at = labelled.select(*PAGE, F.col("x").alias("cx"), F.col("y").alias("cy"), "idx")
    return found.join(at, [*PAGE, "cx", "cy"]).select(*PAGE, "x", "y", "idx")
