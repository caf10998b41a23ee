"""Queries over corrections, zones, documents and saved analyses."""

from pyspark.sql import functions as F

from ..functions.identity import relation_key, with_room_identity
from ..functions.text import norm_token
from ..operators import document, history, options, overlay, spatial
from ..session import cut_lineage
from .plans_views import _zoned, _zones
from .registry import broken, key, norm, query, room

# -- zones ------------------------------------------------------------------------------------
_PTS = "select user_id % 40 as job_id, cast(user_id % 3 + 1 as int) as page from {events} group by 1, 2"
_LABELS = "select job_id, min(idx) as idx, name, min(x) as x, max(y) as y from {b_rooms} group by job_id, name"
_MARKS = "select job_id, concat('Pièce ', cast(seq % 90 as string)) as room, x, y from {b_points}"


@query("zone_proposals", f"""with l as ({_LABELS}), s as (select job_id, room as name, min(x) as a, max(x) as b, min(y) as c, max(y) as d from ({_MARKS}) group by 1, 2),
       b as (select l.job_id, idx, l.name, greatest(0, least(x, coalesce(a, x)) - 38) as x0, greatest(x, coalesce(b, x)) + 38 as x1, greatest(0, least(y, coalesce(c, y)) - 30) as y0, greatest(y, coalesce(d, y)) + 30 as y1
       from l left join s on s.job_id = l.job_id and s.name = l.name),
       w as (select job_id, idx, name, case when x1 - x0 < 80 then greatest(0, (x0 + x1) / 2 - 40) else x0 end as x0, case when x1 - x0 < 80 then (x0 + x1) / 2 + 40 else x1 end as x1,
       case when y1 - y0 < 55 then greatest(0, (y0 + y1) / 2 - 28) else y0 end as y0, case when y1 - y0 < 55 then (y0 + y1) / 2 + 28 else y1 end as y1 from b)
       select w.job_id, concat('r', page, '-', idx) as id, page, name, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h from w join ({_PTS}) p on p.job_id = w.job_id""")
def zone_proposals(d):
    return overlay.zone_proposals(d.sql(_LABELS), d.sql(_MARKS), d.sql(_PTS)).select("job_id", "id", "page", "name", "x", "y", "w", "h")


_SUBMITTED = """select s_suppkey % 40 as job_id, s_suppkey as seq, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then concat('z', cast(s_suppkey as string)) else concat('n', cast(s_suppkey as string)) end as id,
                cast(null as int) as page, '' as name_original, case when s_suppkey % 4 = 0 then 'Renommée' else '' end as name, case when s_suppkey % 2 = 0 then 12.0e0 end as x, cast(null as double) as y,
                case when s_suppkey % 5 = 0 then 3.0e0 end as w, cast(null as double) as h, true as locked from {supplier}"""


@query("zone_merge", f"""with s as ({_SUBMITTED}), nz as (select job_id, count(*) as c from {{b_zones}} group by 1), f as (select job_id, seq, row_number() over (partition by job_id order by seq) as n from s where seq % 3 <> 1),
       m as (select s.*, z.id as zid, z.page as zp, z.name_original as zo, z.name as zn, z.x as zx, z.y as zy, z.w as zw, z.h as zh, z.triangle, f.n, coalesce(c, 0) as c from s left join {{b_zones}} z on z.job_id = s.job_id and z.id = s.id
       left join f on f.job_id = s.job_id and f.seq = s.seq left join nz on nz.job_id = s.job_id),
       e as (select job_id, case when id = '' then concat('r', coalesce(zp, 1), '-', c + n) else id end as id, coalesce(zp, 1) as page, case when zo is not null then zo else name end as name_original,
       case when name <> '' then name when zo is not null then zo else 'Pièce sans nom' end as name, case when zid is not null then zx else coalesce(x, 0) end as x, coalesce(zy, 0) as y,
       case when zid is not null then zw else greatest(8, coalesce(w, 80)) end as w, coalesce(zh, 55) as h, locked, 'utilisateur' as source from m)
       select * from e union all select job_id, id, page, name_original, name, x, y, w, h, locked, 'murs' from {{b_zones}} where sk % 3 <> 1""")
def zone_merge(d):
    points = F.lit(None).cast("array<struct<x:double,y:double>>")
    return overlay.merge_zones(_zones(d).drop("triangle", "sk"), d.sql(_SUBMITTED).withColumn("points", points)).drop("points")


_EV = """select user_id % 40 as job_id, event_id as seq, cast(user_id % 7 + 1 as int) as page, event_type as page_type, concat('Article ', cast(event_id % 5 as string)) as article, 'cat' as categorie,
         cast(event_id * 43 % 983 as double) as x, cast(event_id * 59 % 709 as double) as y, concat('Pièce ', cast(event_id % 70 as string)) as room, 4.5e0 as room_dist, 'texte' as source, 'lab' as label,
         concat('d', cast(event_id as string)) as detection_id from {events}"""
_REN = "rn as (select job_id, name_original as original, arg_max(name, row(page, y, x, id)) as new_name from {b_zones} group by 1, 2)"


@query("room_rename", f"""with e as ({_EV}), {_REN}, {_zoned('e', 'locked')} select e.job_id, e.seq, coalesce(zn.name, rn.new_name, e.room) as room, case when zn.name is not null then 0 else 4.5 end::double as room_dist
       from e left join rn on rn.job_id = e.job_id and rn.original = e.room left join zn on zn.job_id = e.job_id and zn.page = e.page and zn.x = e.x and zn.y = e.y and zn.k = 1""")
def room_rename(d):
    return overlay.rename_rooms(d.sql(_EV), _zones(d)).select("job_id", "seq", "room", "room_dist")


_EDITS = """select user_id % 40 as job_id, case when event_id % 11 < 6 then concat('d', cast(event_id as string)) else concat('p', cast(user_id % 7 + 1 as string), '-d', cast(event_id % 40 as string), 'x') end as object_id,
            event_id % 13 = 0 as ignored, case when event_id % 3 = 0 then 'R2' else '' end as reference, case when event_id % 3 = 1 then 'Article 3' else '' end as article,
            case when event_id % 4 = 0 then 'Choisie' else '' end as room from {events}"""
_META = """select distinct event_type as page_type, lookup, case lookup when 'R2' then 'Article 2' else 'Article 3' end as article, 'nouvelle' as categorie, 'R' as reference from (select event_type, {lookups} as lookup from {{events}}) k"""


@query("edit_overlay", f"""with e as ({_EV}), ed as ({_EDITS}), {_REN}, {_zoned('e', 'locked')}, j as (select e.*, ed.reference as er, ed.article as ea, ed.room as eroom, coalesce(ed.ignored, false) as ig from e left join ed on ed.job_id = e.job_id and ed.object_id = e.detection_id)
       select j.job_id, j.seq, case when er = 'R2' then 'Article 2' when ea <> '' then 'Article 3' else j.article end as article, case when er <> '' or ea <> '' then 'nouvelle' else categorie end as categorie,
       case when er <> '' or ea <> '' then 'lab (corrigé)' else label end as label, case when er <> '' or ea <> '' then 'corrigé' else source end as source,
       case when eroom <> '' then eroom else coalesce(zn.name, rn.new_name, j.room) end as room, case when eroom <> '' or zn.name is not null then 0 else 4.5 end::double as room_dist
       from j left join rn on rn.job_id = j.job_id and rn.original = j.room left join zn on zn.job_id = j.job_id and zn.page = j.page and zn.x = j.x and zn.y = j.y and zn.k = 1 where not ig""")
def edit_overlay(d):
    meta = d.sql(_META.format(lookups="explode(array('R2', 'Article 3'))"))
    return overlay.apply_edits(d.sql(_EV), d.sql(_EDITS), meta, _zones(d)).select(
        "job_id", "seq", "article", "categorie", "label", "source", "room", "room_dist")


_HAND = """select user_id % 40 as job_id, event_id as seq, concat('h', cast(event_id as string)) as id, cast(user_id % 7 + 1 as int) as page, case when event_id % 6 = 0 then '' else event_type end as page_type,
           case when event_id % 2 = 0 then 'R2' else 'R9' end as reference, case when event_id % 3 = 0 then 'Article 3' else 'inconnu' end as article, cast(event_id * 43 % 983 as double) as x,
           cast(event_id * 59 % 709 as double) as y, case when event_id % 5 = 0 then 'Donnée' else '' end as room, '' as label, event_id % 10 = 1 as ignored from {events}"""


@query("manual_objects", f"""with h as ({_HAND}), zl as (with {_zoned('h', 'locked')} select * from zn where k = 1), za as (with {_zoned('h', 'true')} select * from zn where k = 1)
       select h.job_id, h.seq, 'Ajout manuel' as label, case when reference = 'R2' then 'Article 2' else 'Article 3' end as article, case when room <> '' then room else coalesce(zl.name, za.name, '') end as room,
       case when page_type = '' then 'view' else page_type end as page_type from h left join zl on zl.job_id = h.job_id and zl.page = h.page and zl.x = h.x and zl.y = h.y
       left join za on za.job_id = h.job_id and za.page = h.page and za.x = h.x and za.y = h.y where not ignored and (reference = 'R2' or article = 'Article 3')""")
def manual_objects(d):
    types = d.sql("select distinct user_id % 40 as job_id, cast(user_id % 7 + 1 as int) as page, 'view' as page_type from {events}")
    return overlay.manual_symbols(d.sql(_HAND), types, d.sql(_META.format(lookups="explode(array('R2', 'Article 3'))")), _zones(d)).select(
        "job_id", "seq", "label", "article", "room", "page_type")


_PAGES = "select user_id % 40 as job_id, cast(user_id % 7 + 1 as int) as page, 1000.0e0 as width, 800.0e0 as height, 0.0e0 as a, 1.0e0 as b, -1.0e0 as c, 0.0e0 as d, 1000.0e0 as e, 0.0e0 as f from {events} group by 1, 2"
_TR = "select *, 'R0' as reference, seq % 9 = 0 as needs_review, case when seq % 8 = 0 then 'À VALIDER' else 'AJOUT' end as statut from "


@query("marker_overlay", f"""with e as ({_EV}), t as ({_TR} e), ed as ({_EDITS}), h as ({_HAND}),
       c as (select t.job_id, t.page, t.detection_id, case when ed.reference = 'R2' then 'R' else coalesce(ed.reference, t.reference) end as reference, case when ed.reference = 'R2' then 'Article 2' else coalesce(ed.article, t.article) end as article,
       coalesce(ed.room, t.room) as room, coalesce(ed.ignored, false) as ignored, 'counted' as kind, needs_review or statut like 'À%' as review, round((1000 - y) / 10, 4) as left, round(x / 8, 4) as top
       from t left join ed on ed.job_id = t.job_id and ed.object_id = t.detection_id)
       select * from c union all select job_id, page, event_type, '', '', '', false, 'uncatalogued', false, round((1000 - y) / 10, 4), round(x / 8, 4) from (select job_id, page, name as event_type, x, y from {{b_points}})
       union all select job_id, page, id, reference, article, room, ignored, 'manual', false, round(x / 10, 4), round(y / 8, 4) from h""")
def marker_overlay(d):
    trace = d.sql(_TR + f"({_EV})")
    texts = d.b_points.select("job_id", "page", F.col("name").alias("label"), "x", "y", F.lit("").alias("room"))
    return overlay.marker_overlay(trace, d.sql(_EDITS), d.sql(_META.format(lookups="explode(array('R2', 'Article 3'))")), texts, d.sql(_HAND), d.sql(_PAGES))


_MARKERS = """select event_id as id, case event_id % 4 when 0 then 'manual' when 1 then 'uncatalogued' else 'counted' end as kind, event_id % 5 = 0 as review from {events}"""


@query("visible_markers", f"""with m as ({_MARKERS}) select 'all' as mode, id from m union all select 'review', id from m where review union all select 'counted', id from m where kind = 'counted'
       union all select 'manual', id from m where kind = 'manual'""")
def visible_markers(d):
    markers, shown = d.sql(_MARKERS), None
    for mode in ("all", "review", "counted", "manual"):
        part = overlay.visible_markers(markers, mode).select(F.lit(mode).alias("mode"), "id")
        shown = part if shown is None else shown.unionByName(part)
    return shown


@query("corrected_rooms", f"""with {_REN}, b as (select r.job_id, coalesce(new_name, r.name) as name, concat(cast(idx % 9 as varchar), ' m²') as surface, x, y, page, 0 as part, page::double as o1, idx::double as o2, 0.0::double as o3
         from {{b_rooms}} r left join rn on rn.job_id = r.job_id and rn.original = r.name
         union all select job_id, name, '', x + w / 2, y + h / 2, page, 1, page::double, y, x from {{b_zones}} where name <> '')
       select job_id, name, surface, x, y, page from b qualify row_number() over (partition by job_id, name order by part, o1, o2, o3) = 1""")
def corrected_rooms(d):
    rooms = d.b_rooms.withColumn("surface", F.concat((F.col("idx") % 9).cast("string"), F.lit(" m²")))
    return overlay.corrected_rooms(rooms, _zones(d)).drop("o")


# -- saved corrections ----------------------------------------------------------------------------
@query("corrections_fold", "select job_id, key, arg_max(value, version) as value from {b_versions} where present group by 1, 2")
def corrections_fold(d):
    return overlay.fold_corrections(d.b_versions)


_REL = f"""rl as (select job_id, {key('room', 'material')} as mapping_key, max(seq) as seq from {{b_doc_lines}} where lower(origin) <> 'manual' group by 1, 2)"""


@query("relations_from_lines", f"""with {_REL} select rl.job_id, rl.mapping_key, coalesce(comparison_room, '') as target_room_id, comparison_material as target_material, is_addition from rl join {{b_doc_lines}} l on l.seq = rl.seq""")
def relations_from_lines(d):
    return overlay.relations_from_lines(d.b_doc_lines)


@query("exclusion_diff", f"""with {_REL}, a as (select distinct job_id % 50 as job_id, {key('piece', "concat('art ', cast(pk % 23 as varchar))")} as mapping_key from {{b_src}}) select * from a where (job_id, mapping_key) not in (select (job_id, mapping_key) from rl)""")
def exclusion_diff(d):
    every = d.b_src.select((F.col("job_id") % 50).alias("job_id"), relation_key("piece", F.concat(F.lit("art "), (F.col("pk") % 23).cast("string"))).alias("mapping_key"))
    return overlay.excluded_keys(every, d.b_doc_lines)


_REQ = """select c_custkey as job_id, case c_custkey % 4 when 0 then '' when 1 then c_mktsegment else 'BUILDING' end as computed, case c_custkey % 3 when 0 then '' when 1 then 'MACHINERY' else 'X' end as requested,
          case when c_custkey % 7 = 0 then 'A' else '' end as corrections_scope, case when c_custkey % 5 = 0 then 'B' else '' end as document_scope from {customer}"""
_IDS = "select o_custkey as job_id, case when o_orderkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as scope_id from {orders}"


@query("scope_guards", f"""with i as ({_IDS}) select r.job_id, case when corrections_scope <> '' and document_scope <> '' and corrections_scope <> document_scope then '409 corrections et document' when computed = '' then '409 sans scope calculé'
       when (job_id, computed) not in (select (job_id, scope_id) from i) then '422 scope calculé inconnu' when requested <> '' and (job_id, requested) not in (select (job_id, scope_id) from i) then '422 scope demandé inconnu'
       when requested <> '' and requested <> computed then '409 scope divergent' else 'OK' end as verdict from ({_REQ}) r""")
def scope_guards(d):
    return overlay.scope_guards(d.sql(_REQ), d.sql(_IDS))


# -- document ------------------------------------------------------------------------------------------
_CL = """cl as (select job_id, seq, case when lower(origin) = 'manual' then 'manual' else 'pdf' end as origin, id, mapping_key, room, lot, sous_lot, material, category, coalesce(comparison_room, '') as comparison_room, comparison_material, unit_price,
    is_addition, b as quantity_before, case when quantity_after is not null then quantity_after when additional_quantity = '' then b else coalesce(regexp_replace(regexp_replace(cast(
    try_cast(replace(b, ',', '.') as decimal(18,6)) + try_cast(replace(additional_quantity, ',', '.') as decimal(18,6)) as varchar), '0+$', ''), '\\.$', ''), '') end as quantity_after
    from (select *, coalesce(quantity_before, market_quantity) as b from {b_doc_lines}))"""


@query("doc_lines_clean", f"with {_CL} select * from cl where room <> '' or material <> ''")
def doc_lines_clean(d):
    return document.clean_lines(d.b_doc_lines)


def _euro(x: str) -> str:
    return f"concat(replace(format('{{:,}}', cast(trunc({x}) as bigint)), ',', chr(160)), ',', right(cast({x} as varchar), 2), chr(160), '€')"


@query("lot_pricing", f"""with s as (select job_id, lot, min(seq) as lot_order, coalesce(sum(try_cast(replace(quantity_after, ',', '.') as decimal(18,4)) * try_cast(replace(unit_price, ',', '.') as decimal(18,4))), 0) as t from {{b_doc_lines}} group by 1, 2),
       v as (select *, cast(round(t * 0.10, 2) as decimal(30,2)) as tax from s), w as (select *, cast(round(t, 2) as decimal(30,2)) as st, cast(round(t + tax, 2) as decimal(30,2)) as tt from v)
       select job_id, lot, lot_order, {_euro('st')} as subtotal, {_euro('tax')} as tax, {_euro('tt')} as total from w""")
def lot_pricing(d):
    return document.lot_pricing(d.b_doc_lines)


_TRACE = """select job_id % 50 as job_id, seq, piece as room, case when pk % 2 = 0 then materiel else upper(materiel) end as article, materiel as original_article, case when pk % 3 = 0 then concat(materiel, ' comparé') else materiel end as materiel_compare,
            categorie, pk % 10 = 0 as ignored from {b_src}"""


def _groups(where: str) -> str:
    return f"""gr as (select job_id, {key('room', 'article')} as mapping_key, {norm('materiel_compare')} as k1, {norm('categorie')} as k2, count(*) as quantity_after, min(seq) as first_seq,
        arg_min(room, row(seq, room, article, materiel_compare, categorie)) as room, arg_min(article, row(seq, room, article, materiel_compare, categorie)) as material,
        arg_min(materiel_compare, row(seq, room, article, materiel_compare, categorie)) as comparison_material, arg_min(categorie, row(seq, room, article, materiel_compare, categorie)) as category from ({_TRACE}) where {where} group by 1, 2, 3, 4)"""


@query("plan_groups", f"with {_groups('not ignored')} select job_id, mapping_key, room, material, comparison_material, category, quantity_after, first_seq from gr")
def plan_groups(d):
    return document.plan_groups(d.sql(_TRACE))


# a submitted line for the objects of some rooms; the comparison is the stock of the same items
_LINES = """select job_id % 50 as job_id, min(seq) as seq, case when min(pk) % 3 = 0 then '' else concat('s', cast(min(seq) as string)) end as id, '' as mapping_key, case when min(pk) % 7 = 0 then 'manual' else 'pdf' end as origin,
            piece as room, brand as lot, '' as sous_lot, materiel as material, min(categorie) as category, case when min(pk) % 2 = 0 then 'Salle 2' end as comparison_room,
            case when min(pk) % 5 = 0 then 'red bolt' else '' end as comparison_material, min(pk) % 4 = 0 as is_addition, '7' as quantity_after, '12' as unit_price from {b_src} group by job_id % 50, piece, brand, materiel"""
_STOCK = """select job_id % 50 as job_id, concat('id ', piece) as room_id, 'N' as niveau, 'O' as occupation, piece, categorie, materiel, sum(lq) as quantite_avant from {b_src} group by job_id % 50, piece, categorie, materiel"""
_RMAP = "select distinct job_id % 50 as job_id, piece as source_room, concat('id ', piece) as room_id from {b_src}"


@query("doc_lines", f"""with {_groups('true')}, nu as (select *, row_number() over (partition by job_id order by {norm('room')}, {norm('material')}, {norm('category')}, first_seq) as n from gr), sb as ({_LINES}), st as ({_STOCK}), mp as ({_RMAP}),
       pl as (select *, {norm('room')} as rr, {norm('material')} as m1, {norm('comparison_material')} as m2 from sb where origin = 'pdf'),
       br as (select job_id, {key('room', 'material')} as k, max(seq) as seq from pl group by 1, 2),
       bn as (select job_id, k, max(seq) as seq from (select job_id, concat(rr, '|', m1) as k, seq from pl union all select job_id, concat(rr, '|', m2), seq from pl) group by 1, 2),
       pk as (select nu.*, coalesce(br.seq, b1.seq, b2.seq) as line_seq from nu left join br on br.job_id = nu.job_id and br.k = nu.mapping_key
              left join bn b1 on b1.job_id = nu.job_id and b1.k = concat({norm('nu.room')}, '|', {norm('nu.material')}) left join bn b2 on b2.job_id = nu.job_id and b2.k = concat({norm('nu.room')}, '|', {norm('nu.comparison_material')})),
       pr as (select pk.*, sb.id as pid, sb.lot, sb.comparison_room as cr, sb.comparison_material as cmat, sb.is_addition as ad, sb.unit_price as up, mp.room_id as mapped from pk join sb on sb.job_id = pk.job_id and sb.seq = pk.line_seq
              left join mp on mp.job_id = pk.job_id and mp.source_room = pk.room),
       ch as (select *, coalesce(cr, mapped, '') as sel_room, case when ad then '' when cmat <> '' then cmat else comparison_material end as sel_mat from pr),
       mt as (select ch.job_id, ch.n, st.quantite_avant, row_number() over (partition by ch.job_id, ch.n order by case when {norm('st.categorie')} = {norm('ch.category')} then 0 else 1 end, st.piece, st.categorie, st.materiel) as k from ch join st on st.job_id = ch.job_id
              and (st.room_id = sel_room or {norm('st.piece')} = {norm('sel_room')} or (cr is null and {norm('st.piece')} = {norm('ch.room')})) and {norm('st.materiel')} <> ''
              and ({norm('st.materiel')} = {norm('sel_mat')} or (not ad and cmat = '' and {norm('st.materiel')} = {norm('ch.material')}))),
       mn as (select sb.*, coalesce(is_addition, comparison_material = '') as ad from sb where origin = 'manual'),
       mm as (select mn.job_id, mn.seq, st.quantite_avant, row_number() over (partition by mn.job_id, mn.seq order by st.piece, st.categorie, st.materiel) as k from mn join st on st.job_id = mn.job_id
              and (st.room_id = coalesce(comparison_room, '') or {norm('st.piece')} = {norm("coalesce(comparison_room, '')")}) and {norm('st.materiel')} = case when ad then '' else {norm('comparison_material')} end)
       select ch.job_id, case when pid = '' then concat('pdf-', ch.n) else pid end as id, mapping_key, 'pdf' as origin, room, lot, material, category, sel_room as comparison_room, sel_mat as comparison_material, ad as is_addition,
       coalesce(cast(mt.quantite_avant as varchar), case when cr is not null or cmat <> '' or ad then '0' else '' end) as quantity_before, cast(quantity_after as varchar) as quantity_after, up as unit_price
       from ch left join mt on mt.job_id = ch.job_id and mt.n = ch.n and mt.k = 1
       union all select mn.job_id, case when id = '' then concat('manual-', mn.seq) else id end, concat('manual-', mn.seq), 'manual', room, lot, material, category, coalesce(comparison_room, ''), case when ad then '' else comparison_material end, ad,
       coalesce(cast(mm.quantite_avant as varchar), '0'), quantity_after, unit_price from mn left join mm on mm.job_id = mn.job_id and mm.seq = mn.seq and mm.k = 1""")
def doc_lines(d):
    trace = d.sql(_TRACE)
    return document.document_lines(trace, cut_lineage(d.sql(_LINES)), d.sql(_STOCK), d.sql(_RMAP)).drop("sous_lot")


def _stock(d):
    return d.sql("select job_id % 50 as job_id, concat('id ', piece) as room_id, materiel, categorie, sum(lq) as quantite from {b_src} where st = 'O' group by 1, 2, 3, 4")


_ASK = """select o_custkey % 50 as job_id, o_orderkey as line, case when o_orderkey % 9 = 0 then '' else concat('id Salle ', cast(o_orderkey % 7 + 1 as string)) end as room_id, upper(p_name) as material,
          case when o_orderkey % 2 = 0 then p_type else 'autre' end as category
          from {orders} join (select l_orderkey, min(l_partkey) as pk from {lineitem} group by 1) l on l_orderkey = o_orderkey join {part} on pk = p_partkey"""


@query("qty_before", f"""with a as ({_ASK}), i as (select job_id % 50 as job_id, concat('id ', piece) as room_id, materiel, categorie, sum(lq) as q, sum(case when st = 'O' then lq end) as qo from {{b_src}} group by 1, 2, 3, 4),
       s as (select a.job_id, line, coalesce(sum(qo) filter ({norm('categorie')} = {norm('category')}), sum(qo)) as q from a join i on i.job_id = a.job_id and i.room_id = a.room_id and qo is not null and {norm('i.materiel')} = {norm('a.material')} group by 1, 2),
       c as (select a.job_id, line, arg_min(q, row(case when {norm('categorie')} = {norm('category')} then 0 else 1 end, categorie)) as q from a join i on i.job_id = a.job_id and i.room_id = a.room_id and {norm('i.materiel')} = {norm('a.material')} group by 1, 2)
       select a.job_id, a.line, cast(coalesce(s.q, c.q, 0) as bigint) as quantity_before from a left join s on s.job_id = a.job_id and s.line = a.line left join c on c.job_id = a.job_id and c.line = a.line""")
def qty_before(d):
    return document.quantity_before(d.sql(_ASK), _stock(d), d.sql(_STOCK))


_INV = "select distinct job_id % 50 as job_id, concat('Salle ', cast(ln as string)) as room_id, concat('art ', cast(pk % 9 as string)) as materiel from {b_src}"


@query("unresolved_counts", f"""with {_CL}, v as ({_INV}) select job_id, count(*) filter ((job_id, comparison_room) not in (select (job_id, room_id) from v)) as unresolved_rooms,
       count(*) filter (not is_addition and (job_id, comparison_room, {norm('comparison_material')}) not in (select (job_id, room_id, {norm('materiel')}) from v)) as unresolved_materials from cl where origin <> 'manual' and (room <> '' or material <> '') group by 1""")
def unresolved_counts(d):
    inventory = d.sql(_INV)
    return document.unresolved_counts(document.clean_lines(d.b_doc_lines), inventory.select("job_id", "room_id").distinct(), inventory)


_SUG_ROOMS = "select distinct job_id % 50 as job_id, concat('id ', piece) as room_id, piece from {b_src}"
_SUG_INV = "select distinct job_id % 50 as job_id, concat('id ', piece) as room_id, materiel from {b_src} where st = 'O'"
_SUG_REL = "select job_id % 50 as job_id, piece as room, case when pk % 2 = 0 then materiel else concat(materiel, ' bis') end as article, max(case when pk % 2 = 0 then 'Salle 3' else 'nulle part' end) as target_room_id, min(case when pk % 3 = 0 then 'red bolt' else '' end) as target_material, bool_or(pk % 50 = 0) as is_addition from {b_src} group by 1, 2, 3"


@query("doc_suggestions", f"""with g as (select job_id, room, {key('room', 'article')} as mapping_key, {norm('categorie')} as k2, count(*) as q, arg_min(article, row(seq, room, article, materiel_compare, categorie)) as material,
         arg_min(materiel_compare, row(seq, room, article, materiel_compare, categorie)) as compared, arg_min(categorie, row(seq, room, article, materiel_compare, categorie)) as category from ({_TRACE}) where not ignored group by 1, 2, 3, 4),
       rl as (select *, {key('room', 'article')} as mapping_key from ({_SUG_REL})), v as (select distinct job_id, room_id, {norm('materiel')} as m from ({_SUG_INV}) union select distinct job_id % 50, '', {norm('materiel')} from {{b_src}}),
       am as (select distinct job_id % 50 as job_id, {norm('materiel')} as m, concat(materiel, '') as sug from {{b_src}} where length(materiel) % 2 = 0),
       rs as ({_SUG_ROOMS}), w as (select g.*, rl.target_material as rm, coalesce(rl.is_addition, false) as ad, coalesce(t.room_id, b.room_id, '') as cr, am.sug from g left join rl on rl.job_id = g.job_id and rl.mapping_key = g.mapping_key
         left join rs t on t.job_id = g.job_id and t.piece = rl.target_room_id left join rs b on b.job_id = g.job_id and b.piece = g.room left join am on am.job_id = g.job_id and am.m = {norm('g.material')})
       select job_id, mapping_key, room, material, category, cr as comparison_room, case when ad then '' when cr <> '' and rm <> '' and (job_id, cr, {norm('rm')}) in (select (job_id, room_id, m) from v) then rm
         when sug is not null and (job_id, cr, {norm('sug')}) in (select (job_id, room_id, m) from v) then sug when (job_id, cr, {norm('compared')}) in (select (job_id, room_id, m) from v) then compared else '' end as comparison_material,
       ad as is_addition, cast(q as varchar) as quantity_after from w""")
def doc_suggestions(d):
    rooms = d.sql(_SUG_ROOMS).withColumns({"label_norm": F.concat(norm_token("piece"), F.lit(" label")), "piece_norm": norm_token("piece")})
    relations = cut_lineage(d.sql(_SUG_REL).withColumn("mapping_key", relation_key("room", "article")).drop("room", "article"))
    none = d.spark.createDataFrame([], "job_id BIGINT, mapping_key STRING")
    no_map = d.spark.createDataFrame([], "job_id BIGINT, source_room STRING, room_id STRING")
    articles = d.sql("select distinct job_id % 50 as job_id, materiel as article, materiel as target from {b_src} where length(materiel) % 2 = 0")
    return document.suggested_lines(d.sql(_TRACE), relations, none, no_map, articles, rooms, d.sql(_SUG_INV), d.sql("select job_id % 50 as job_id, materiel from {b_src}"))


# -- history ---------------------------------------------------------------------------------------------
@query("history_list", """select row_number() over (order by modified_at desc, job_id) as rank, job_id, created_at, updated_at, case when excel_name = '' then 'Excel non renseigné' else excel_name end as excel_name, 'PDF non renseigné' as pdf_name, 'done' as job_status,
       symboles_detectes, lignes, owner_sub, modified_at from {b_analyses} where owner_sub in ('BUILDING', '')""")
def history_list(d):
    return history.history_list(d.b_analyses, "BUILDING", allow_legacy=True)


@query("output_owner", """with f as (select job_id, split_part(output, '/', -1) as name from {b_analyses} where owner_sub = 'BUILDING' union select job_id, split_part(word_output, '/', -1) from {b_analyses} where owner_sub = 'BUILDING')
       select name, job_id from f where name in (select concat(c_name, '.docx') from {customer}) and name <> ''""")
def output_owner(d):
    names = d.customer.select(F.explode(F.array(F.concat("c_name", F.lit(".docx")), F.concat(F.lit("out/"), "c_name"))).alias("name"))
    return history.output_owner(d.b_analyses, names, "BUILDING")


@query("history_delete", """with t as (select distinct o_custkey as job_id from {orders} where o_orderpriority = '1-URGENT'), g as (select * from {b_analyses} where job_id in (select job_id from t))
       select job_id, concat('analysis_', job_id, '.json') as name, 'removed' as state from g union all select job_id, split_part(output, '/', -1), 'removed' from g
       union all select job_id, split_part(word_output, '/', -1), 'removed' from g where word_output <> '' union all select job_id, excel_name, 'kept' from {b_analyses} where job_id not in (select job_id from t)""")
def history_delete(d):
    gone = d.sql("select o_custkey as job_id from {orders} where o_orderpriority = '1-URGENT'")
    removed = history.artefacts(d.b_analyses, gone).withColumn("state", F.lit("removed"))
    return removed.unionByName(history.without_deleted(d.b_analyses, gone).select("job_id", F.col("excel_name").alias("name"), F.lit("kept").alias("state")))


@query("owner_preserved", "select job_id, arg_min(owner_sub, version) filter (owner_sub <> '') as owner_sub from {b_versions} group by 1")
def owner_preserved(d):
    return history.preserved_owners(d.b_versions)
