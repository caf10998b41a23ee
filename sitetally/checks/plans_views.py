"""Queries over plan pages, points, zones and cells."""

from pyspark.sql import functions as F

from ..functions import symbols as sym
from ..operators import spans, spatial
from ..plans.plan_symbols import CELL_SCALE, PlanSymbols
from ..session import cut_lineage
from .registry import greedy, norm_k2, query

_PT = f"""pt as (select job_id, page, case when max(case when size >= 17 and contains({norm_k2('text')}, 'electricite') then 1 else 0 end) = 1 then 'ELECTRICITE'
    when max(case when size >= 17 and contains({norm_k2('text')}, 'luminaire') then 1 else 0 end) = 1 then 'LUMINAIRE'
    when max(case when size >= 17 and contains({norm_k2('text')}, 'plomberie') then 1 else 0 end) = 1 then 'PLOMBERIE'
    when max(case when size >= 17 and contains({norm_k2('text')}, 'cloisonnement') then 1 else 0 end) = 1 then 'CLOISONNEMENT'
    when max(case when size >= 17 and contains({norm_k2('text')}, 'amenagement') then 1 else 0 end) = 1 then 'AMENAGEMENT' else 'AUTRE' end as page_type
    from {{b_spans}} group by 1, 2)"""


@query("page_types", f"with {_PT} select * from pt")
def page_types(d):
    return spans.page_types(d.b_spans)


@query("span_level_hint", "select job_id, regexp_extract(arg_min(text, row(page, seq)), '\\bR(\\d)\\b', 1) as niveau_hint from {b_spans} where regexp_matches(text, '\\bR\\d\\b') group by 1")
def span_level_hint(d):
    return spans.level_hint(d.b_spans)


_ISM2 = "regexp_full_match(text, '[\\d\\s.,]+m²')"
_RL = f"""sp as (select job_id, page, seq, text, size, x, y, {_ISM2} as m2 from {{b_spans}}),
    nm as (select * from sp where not m2 and not regexp_matches({norm_k2('text')}, 'sol souple|carrelage|terrazzo|faience|faux plafond|demontable|peinture|lasure|stylobate|partage|privatifs|communs|prive|hsfxp|plafond|mur|sol|lot ')),
    pa as (select s.job_id, s.page, s.seq, s.text as surface, s.x, s.y, n.text as name, n.seq as nseq, n.x - s.x as dx, n.y - s.y as dy from sp s join nm n on n.job_id = s.job_id and n.page = s.page
           where s.m2 and abs(n.size - s.size) <= 0.3),
    be as (select *, row_number() over (partition by job_id, page, seq order by case when dx > 0 and dx <= 40 and abs(dy) <= 3 then 0 else 1 end, case when dx > 0 and dx <= 40 and abs(dy) <= 3 then dx else 35 + dy end, nseq) as k
           from pa where (dx > 0 and dx <= 40 and abs(dy) <= 3) or (abs(dx) <= 6 and dy between -35 and -5)),
    rl as (select job_id, page, min(seq) as idx, arg_min(name, seq) as name, arg_min(surface, seq) as surface, arg_min(x, seq) as x, arg_min(y, seq) as y from be where k = 1 group by job_id, page, {norm_k2('name')})"""


@query("room_labels", f"with {_RL} select * from rl")
def room_labels(d):
    return spans.room_labels(d.b_spans)


@query("reference_page", f"""with {_RL}, c as (select p.job_id, p.page, count(rl.idx) as n_rooms from (select distinct job_id, page from {{b_spans}}) p left join rl on rl.job_id = p.job_id and rl.page = p.page group by 1, 2),
       r as (select job_id, arg_max(page, row(n_rooms, -page)) as reference_page from c group by 1)
       select c.job_id, page, n_rooms, reference_page, case when n_rooms >= 3 then page else reference_page end as rooms_page from c join r using (job_id)""")
def reference_page(d):
    return spans.room_pages(d.b_spans, cut_lineage(spans.room_labels(d.b_spans)))


# one catalogue entry per kind and size of part: a mark, a word with a captured number, or a plain text
_ENTRIES = """select case p_size % 3 when 0 then 'ELECTRICITE' when 1 then 'LUMINAIRE' else 'AUTRE' end as page_type, 'text' as kind, cast(pk as int) as ord,
              case when pk % 3 = 0 then concat('^', cast(p_size % 9 as string), '$') when pk % 3 = 1 then concat('CLICK (', cast(p_size % 10 as string), '[0-9]*)$')
                   else concat('view ', cast(p_size % 17 as string)) end as pattern,
              case when pk % 3 = 1 then concat(nm, ' n {{0}}') else nm end as article, br as categorie, cast(pk as string) as reference,
              case when pk % 7 = 0 then 10.5e0 end as min_font_size, cast(null as double) as max_font_size, cast(null as double) as min_x,
              case when pk % 5 = 0 then 150.0e0 end as max_x, 20.0e0 as min_y, cast(null as double) as max_y, p_size as sz
              from (select p_size, p_type, min(p_partkey) as pk, min(p_name) as nm, min(p_brand) as br from {part} group by 1, 2)"""


def _entries(d):
    return d.sql(_ENTRIES.replace("{{0}}", "@")).withColumns({
        "article": F.replace("article", F.lit("@"), F.lit("{0}")),
        "expands": F.when(F.col("ord") % 4 == 0, F.create_map(F.lit("PC"), F.lit(4), F.lit("RJ"), F.lit(1), F.lit("rien"), F.lit(0)))})


_CM = f"""{_PT}, en as ({_ENTRIES.replace("{{0}}", "@")}), hm as (select s.job_id, s.page, s.seq, s.text, s.x, s.y, en.*, row_number() over (partition by s.seq order by en.ord) as k
    from {{b_spans}} s join pt on pt.job_id = s.job_id and pt.page = s.page join en on en.page_type = pt.page_type and s.size >= coalesce(min_font_size, 0) and s.x <= coalesce(max_x, 1e9) and s.y >= min_y
         and regexp_matches(s.text, concat('^(?:', pattern, ')'), 'i')),
    cm as (select job_id, page, seq, page_type, text as label, replace(article, '@', case when pattern like '%(%' then regexp_extract(lower(text), lower(pattern), 1) else '' end) as article, categorie, x, y, ord % 4 = 0 as multi from hm where k = 1)"""


@query("catalog_match", f"with {_CM} select job_id, page, seq, page_type, label, article, categorie, x, y from cm")
def catalog_match(d):
    return spans.catalog_match(d.b_spans, spans.page_types(d.b_spans), _entries(d)).select(
        "job_id", "page", "seq", "page_type", "label", "article", "categorie", "x", "y")


@query("catalog_expand", f"""with {_CM} select job_id, seq, label, article, 0 as copy, 'texte' as source from cm where not multi
       union all select job_id, seq, concat(label, ' (déployé)'), 'PC', n, 'expansion' from cm, range(1, 5) r(n) where multi
       union all select job_id, seq, concat(label, ' (déployé)'), 'RJ', 1, 'expansion' from cm where multi""")
def catalog_expand(d):
    return spans.expand_catalog(spans.catalog_match(d.b_spans, spans.page_types(d.b_spans), _entries(d))).select(
        "job_id", "seq", "label", "article", "copy", "source")


@query("uncatalogued", f"""with {_CM} select s.job_id, pt.page_type, s.text as label, count(*) as occurrences from {{b_spans}} s join pt on pt.job_id = s.job_id and pt.page = s.page
       where s.size < 13 and length(s.text) >= 2 and not regexp_full_match(s.text, '[0-9.,:x× %°/m²-]+', 'i') and pt.page_type in (select page_type from en)
       and (s.job_id, s.page, s.text) not in (select (job_id, page, label) from cm) group by 1, 2, 3""")
def uncatalogued(d):
    types = cut_lineage(spans.page_types(d.b_spans))
    return spans.uncatalogued(d.b_spans, types, _entries(d), spans.catalog_match(d.b_spans, types, _entries(d)))


@query("remarks", f"with {_PT} select job_id, page, min(seq) as seq, concat('p.', page, ' (', page_type, ') : ', text) as remark from {{b_spans}} join pt using (job_id, page) where size between 14.5 and 21 and length(text) > 20 group by job_id, page, page_type, text")
def remarks(d):
    return spans.remarks(d.b_spans, spans.page_types(d.b_spans))


# -- the whole plan page ----
_PAGE_DETECTIONS = """select job_id, page, 1000000000 + seq as seq, name as article, 'cat' as categorie, x, y, cast(concat('0.', cast(61 + seq % 9 * 4 as string)) as double) as score from {b_points}"""
# corridors around the labels of a page, with gaps
_ROOMS_FOR = f"""{_RL}, pc as (select p.job_id, p.page, count(rl.idx) as n_rooms from (select distinct job_id, page from {{b_spans}}) p left join rl on rl.job_id = p.job_id and rl.page = p.page group by 1, 2),
       pr as (select job_id, arg_max(page, row(n_rooms, -page)) as reference_page from pc group by 1),
       pg as (select pc.job_id, pc.page, case when n_rooms >= 3 then pc.page else reference_page end as rooms_page from pc join pr using (job_id)),
       rf as (select pg.job_id, pg.page, idx, name, x, y from pg join rl on rl.job_id = pg.job_id and rl.page = pg.rooms_page)"""


@query("plan_symbols", f"""with recursive {_CM}, {_ROOMS_FOR},
       fd as (select job_id, page, seq, page_type, label, article, categorie, x, y, 'texte' as source, multi, 2.0::double as q from cm
              union all select d.job_id, d.page, seq, page_type, concat('glyphe (', score, ')'), article, categorie, x, y, 'vision', false, score from ({_PAGE_DETECTIONS}) d join pt using (job_id, page)),
       po as (select distinct job_id, page, x, y from fd),
       ne as (select po.*, rf.name, sqrt((rf.x - po.x) * (rf.x - po.x) + (rf.y - po.y) * (rf.y - po.y)) as dist, row_number() over (partition by po.job_id, po.page, po.x, po.y order by dist, rf.idx) as k
              from po left join rf on rf.job_id = po.job_id and rf.page = po.page),
       rc as (select job_id, page, idx, cast(floor(x * 0.75) as bigint) as x, cast(floor(y * 0.75) as bigint) as y, row_number() over (partition by job_id, page order by idx) as n from rf),
       gr as (select distinct job_id, page, x, y from (select job_id, page, x + d as x, y from rc, range(-9, 10) r(d) union all select job_id, page, x, y + d from rc, range(-9, 10) r(d)) where (x * 7 + y * 13) % 11 <> 0),
       ca as (select rc.job_id, rc.page, n, idx, list(struct_pack(x := gr.x, y := gr.y) order by greatest(abs(gr.x - rc.x), abs(gr.y - rc.y)), gr.y - rc.y, gr.x - rc.x) as wishes
              from rc left join gr on gr.job_id = rc.job_id and gr.page = rc.page and abs(gr.x - rc.x) < 15 and abs(gr.y - rc.y) < 15 group by 1, 2, 3, 4),
       tk as (select job_id, page, n, [struct_pack(idx := idx, c := wishes[1])] as taken from ca where n = 1
         union all select ca.job_id, ca.page, ca.n, list_append(tk.taken, struct_pack(idx := ca.idx, c := list_filter(ca.wishes, lambda w: not list_contains(list_transform(tk.taken, lambda t: t.c), w))[1]))
         from tk join ca on ca.job_id = tk.job_id and ca.page = tk.page and ca.n = tk.n + 1),
       se as (select job_id, page, t.c.x as x, t.c.y as y, 0 as steps, t.idx as idx from (select job_id, page, unnest(taken) as t from (select * from tk qualify row_number() over (partition by job_id, page order by n desc) = 1)) where t.c.x is not null),
       fl(job_id, page, x, y, steps, idx) using key (job_id, page, x, y) as (select * from se
         union select n.job_id, n.page, n.x, n.y, min(n.steps), arg_min(n.idx, row(n.steps, n.idx))
         from (select fl.job_id, fl.page, fl.x + dx as x, fl.y + dy as y, fl.steps + 1 as steps, fl.idx from fl, (values (1, 0), (-1, 0), (0, 1), (0, -1)) r(dx, dy)) n
           join gr on gr.job_id = n.job_id and gr.page = n.page and gr.x = n.x and gr.y = n.y
           left join recurring.fl k on k.job_id = n.job_id and k.page = n.page and k.x = n.x and k.y = n.y
         where k.steps is null or row(n.steps, n.idx) < row(k.steps, k.idx) group by 1, 2, 3, 4),
       ce as (select job_id, page, x as cx, y as cy, idx from fl),
       wa as (select po.*, ce.idx, row_number() over (partition by po.job_id, po.page, po.x, po.y order by greatest(abs(cx - floor(po.x * 0.75)), abs(cy - floor(po.y * 0.75))), cy, cx) as k
              from po join ce on ce.job_id = po.job_id and ce.page = po.page and abs(cx - floor(po.x * 0.75)) < 12 and abs(cy - floor(po.y * 0.75)) < 12),
       pl as (select fd.*, coalesce(rf.name, ne.name, '') as room, round_even(case when rf.name is not null then sqrt((rf.x - fd.x) * (rf.x - fd.x) + (rf.y - fd.y) * (rf.y - fd.y)) else ne.dist end, 1) as room_dist
              from fd join ne on ne.job_id = fd.job_id and ne.page = fd.page and ne.x = fd.x and ne.y = fd.y and ne.k = 1
              left join wa on wa.job_id = fd.job_id and wa.page = fd.page and wa.x = fd.x and wa.y = fd.y and wa.k = 1
              left join rf on rf.job_id = wa.job_id and rf.page = wa.page and rf.idx = wa.idx),
       {greedy("select *, case when page_type = 'LUMINAIRE' then 64.0 else 25.0 end as reach from pl", "job_id, page, page_type, article", "q desc, seq", "seq x y",
               "(e.x - r.x) * (e.x - r.x) + (e.y - r.y) * (e.y - r.y) <= r.reach")},
       de as (select pl.* from pl join (select job_id, page, page_type, article, e.seq as seq from kept) using (job_id, page, page_type, article, seq))
       select job_id, page, seq, 0 as copy, article, label, room, room_dist, source from de where not multi
       union all select job_id, page, seq, n, 'PC', concat(label, ' (déployé)'), room, room_dist, 'expansion' from de, range(1, 5) r(n) where multi
       union all select job_id, page, seq, 1, 'RJ', concat(label, ' (déployé)'), room, room_dist, 'expansion' from de where multi""")
def plan_symbols(d):
    plan = PlanSymbols(d.b_spans, _entries(d), d.sql(_PAGE_DETECTIONS))
    arms = F.explode(F.sequence(F.lit(-9), F.lit(9)))
    spots = plan.rooms.select("job_id", "page", *(F.floor(F.col(c) * CELL_SCALE).cast("bigint").alias(c) for c in ("x", "y")), arms.alias("d"))
    cells = spots.select("job_id", "page", F.col("x") + F.col("d"), "y").union(spots.select("job_id", "page", "x", F.col("y") + F.col("d"))).toDF("job_id", "page", "x", "y")
    plan.grid = cells.where("(x * 7 + y * 13) % 11 <> 0").distinct()
    return plan.symbols.select("job_id", "page", "seq", "copy", "article", "label", "room", "room_dist", "source")


# -- points -------------------------------------------------------------------------------------
@query("nearest_room", """with q as (select distinct job_id, page, x, y from {b_points}), n as (select q.*, r.name, row_number() over (partition by q.job_id, q.page, q.x, q.y
       order by sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)), r.idx) as k, sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) as d
       from q join {b_rooms} r on r.job_id = q.job_id and r.page = q.page)
       select q.job_id, q.page, q.x, q.y, coalesce(n.name, '') as room, round(d, 1) as room_dist from q left join n on n.job_id = q.job_id and n.page = q.page and n.x = q.x and n.y = q.y and n.k = 1""")
def nearest_room(d):
    return spatial.nearest_room(d.b_points, d.b_rooms)


def _zones(d):
    box = spatial.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return d.b_zones.withColumn("points", F.when(F.col("triangle"), F.slice(box, 1, 3)).otherwise(box)).withColumn("source", F.lit("murs"))


_IN = "z.y <= q.y and q.y < z.y + z.h and q.x < z.x + z.w and case when triangle then q.x >= z.x + z.w * (q.y - z.y) / z.h else q.x >= z.x end"


def _zoned(points: str, locked: str) -> str:
    return f"""zn as (select q.job_id, q.page, q.x, q.y, z.name, row_number() over (partition by q.job_id, q.page, q.x, q.y order by z.y, z.x, z.id) as k
        from (select distinct job_id, page, x, y from {points}) q join {{b_zones}} z on z.job_id = q.job_id and z.page = q.page and {locked} and {_IN})"""


@query("zone_assign", f"with {_zoned('{b_points}', 'locked')} select job_id, page, x, y, name as zone from zn where k = 1")
def zone_assign(d):
    return spatial.zone_assign(d.b_points, _zones(d))


_LEGEND = "select c_custkey % 40 as job_id, cast(c_custkey % 7 + 1 as int) as page, min(c_custkey % 500) * 1.0e0 as x0, 200.0e0 as y0, min(c_custkey % 500) + 300.0e0 as x1, 500.0e0 as y1 from {customer} group by 1, 2"


@query("legend_exclusion", f"""select p.job_id, p.page, p.seq from {{b_points}} p left join ({_LEGEND}) l on l.job_id = p.job_id and l.page = p.page
       where p.x >= 100 and not coalesce(p.x between x0 and x1 and p.y between y0 and y1, false)""")
def legend_exclusion(d):
    return spatial.legend_exclusion(d.b_points, d.sql(_LEGEND), min_x=100.0).select("job_id", "page", "seq")


_ANCHORS = "select job_id, page, idx as anchor_id, x, y from {b_rooms}"
_CANDIDATES = "select job_id, page, name as template, x, y, cast(seq % 101 as double) / 100 as score from {b_points}"


@query("anchor_companion", f"""with a as ({_ANCHORS}), c as ({_CANDIDATES}), h as (select a.job_id, a.page, anchor_id, template, c.x, c.y, score, row_number() over (partition by a.job_id, a.page, anchor_id, template order by score desc, c.y, c.x) as k
       from a join c on c.job_id = a.job_id and c.page = a.page and c.x >= greatest(0, a.x - 100) and c.x < a.x + 100 and c.y >= greatest(0, a.y - 100) and c.y < a.y + 100 where score >= 0.62)
       select job_id, page, anchor_id, template, x, y, score from h where k = 1""")
def anchor_companion(d):
    return spatial.anchor_companions(d.sql(_ANCHORS), d.sql(_CANDIDATES))


_QUALITY = "case when source = 'texte' then 2.0 when label like '%(%' then cast(regexp_extract(label, '\\((.*)\\)', 1) as double) else 1.0 end"


@query("spatial_dedup", f"""with recursive {greedy(f"select *, {_QUALITY} as q, case when page_type = 'LUMINAIRE' then 64.0 else 25.0 end as reach from {{b_symbols}}",
       "job_id, page, page_type, article", "q desc, seq", "seq x y", "(e.x - r.x) * (e.x - r.x) + (e.y - r.y) * (e.y - r.y) <= r.reach")}
       select job_id, e.seq as seq, page, article, e.x as x, e.y as y from kept""")
def spatial_dedup(d):
    return spatial.remove_duplicate_symbols(d.b_symbols, sym.duplicate_quality("source", "label")).select("job_id", "seq", "page", "article", "x", "y")


_DETECTIONS = """select job_id, page, seq, x, y, name as article, '' as categorie, cast(seq % 89 as double) / 100 as score, cast(seq % 60 as double) as size from {b_points}"""


@query("score_suppression", f"""with recursive {greedy(_DETECTIONS, "job_id, page", "score desc, x desc, y desc, article desc, size desc, seq desc", "seq x y score size",
       "(e.x - r.x) * (e.x - r.x) + (e.y - r.y) * (e.y - r.y) < 0.49 * least(e.size, r.size) * least(e.size, r.size)")}
       select job_id, page, e.seq as seq, e.x as x, e.y as y, e.score as score from kept""")
def score_suppression(d):
    return spatial.suppress_overlaps(d.sql(_DETECTIONS)).select("job_id", "page", "seq", "x", "y", "score")


def _grid(d):
    cells = d.b_grid.where("p_size % 5 <> 0").select("job_id", "page", "x", "y")
    rooms = d.sql("select floor(p_partkey / 1600) as job_id, 1 as page, p_partkey as idx, p_partkey % 40 as x, cast(floor(p_partkey / 40) as bigint) % 40 as y from {part} where p_size > 48")
    return cells, rooms.withColumns({"job_id": F.col("job_id").cast("bigint")})


# a room in turn takes its first free cell; then each job's grid is a list of steps * 10^9 + idx, spread a step at a time
@query("flood_rooms", """with recursive ce as (select job_id, x, y from {b_grid} where p_size % 5 <> 0),
       ro as (select job_id, p_partkey as idx, x, y, row_number() over (partition by job_id order by p_partkey) as n from {b_grid} where p_size > 48),
       ca as (select ro.job_id, n, idx, list(struct_pack(x := ce.x, y := ce.y) order by greatest(abs(ce.x - ro.x), abs(ce.y - ro.y)), ce.y - ro.y, ce.x - ro.x) as wishes
              from ro left join ce on ce.job_id = ro.job_id and abs(ce.x - ro.x) < 15 and abs(ce.y - ro.y) < 15 group by 1, 2, 3),
       tk as (select job_id, n, [struct_pack(idx := idx, c := wishes[1])] as taken from ca where n = 1
         union all select ca.job_id, ca.n, list_append(tk.taken, struct_pack(idx := ca.idx, c := list_filter(ca.wishes, lambda w: not list_contains(list_transform(tk.taken, lambda t: t.c), w))[1]))
         from tk join ca on ca.job_id = tk.job_id and ca.n = tk.n + 1),
       se as (select job_id, t.idx as idx, t.c.x as x, t.c.y as y from (select job_id, unnest(taken) as t from (select * from tk qualify row_number() over (partition by job_id order by n desc) = 1)) where t.c.x is not null),
       g0 as (select ce.job_id, list(y * 40 + x) as free, max(y * 40 + x) as top from ce group by 1),
       v0 as (select g0.job_id, list_transform(range(0, 1600), lambda p: list_contains(free, p)) as open, list_transform(range(0, 1600), lambda p: list_filter(s, lambda e: e.p = p)[1].idx) as v
              from g0 join (select job_id, list(struct_pack(p := y * 40 + x, idx := idx)) as s from se group by 1) using (job_id)),
       fl as (select job_id, open, v, true as moved from v0
         union all select job_id, open, w, w is distinct from v from (select job_id, open, v, list_transform(range(0, 1600), lambda p: case when open[p + 1] then
           list_min([v[p + 1], case when p % 40 > 0 then v[p] + 1000000000 end, case when p % 40 < 39 then v[p + 2] + 1000000000 end,
                     case when p > 39 then v[p - 39] + 1000000000 end, case when p < 1560 then v[p + 41] + 1000000000 end]) end) as w from fl where moved))
       select job_id, 1 as page, p % 40 as x, p // 40 as y, v[p + 1] % 1000000000 as idx, v[p + 1] // 1000000000 as steps from fl, range(0, 1600) r(p) where not moved and v[p + 1] is not null""")
def flood_rooms(d):
    cells, rooms = _grid(d)
    return spatial.flood(cells, spatial.place_seeds(rooms, cells))


_LABELLED = "select job_id, page, x, y, p_partkey as idx from {b_grid} where p_size > 44"


@query("ring_lookup", f"""with l as ({_LABELLED}), h as (select g.job_id, g.page, g.x, g.y, l.idx, row_number() over (partition by g.job_id, g.page, g.x, g.y order by greatest(abs(l.x - g.x), abs(l.y - g.y)), l.y - g.y, l.x - g.x) as k
       from {{b_grid}} g join l on l.job_id = g.job_id and l.page = g.page and abs(l.x - g.x) < 12 and abs(l.y - g.y) < 12) select job_id, page, x, y, idx from h where k = 1""")
def ring_lookup(d):
    return spatial.ring_lookup(d.b_grid, d.sql(_LABELLED))
