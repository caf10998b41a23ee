"""Queries over matching tiers, relations, aggregation, the comparison and its reports."""

from pyspark.sql import functions as F

from ..functions.identity import relation_key, with_room_identity
from ..functions.text import norm_token, strip
from ..operators import matching, options, reconcile
from ..plans.comparison import Comparison
from ..session import by_job, cut_lineage, jobs_fit, written
from ..sources import rules, sinks
from .listings import _CHOSEN
from .registry import broken, key, new_room, norm, query, ratios, room, sha

EXACT = {"room_tiers": ("exact", "containment"), "material_tiers": ("exact", "alias")}


def _listing(d):
    return with_room_identity(d.b_listing)


def _plan_rooms(d):
    return d.b_symbols.select("job_id", strip("room").alias("source_room")).where("source_room <> ''").distinct()


def _level_rooms(d):
    return cut_lineage(options.rooms(options.identities(_listing(d))))


def _articles(d):
    return d.b_symbols.select("job_id", "article").distinct()


def _aliases(d):
    return rules.normalised_aliases(d.b_aliases)


def _components(d):
    return d.b_components.withColumn("article_norm", norm_token("article"))


def _none(d, columns):
    return d.spark.createDataFrame([], columns)


# -- names ----------------------------------------------------------------------------
_NAMES = f"""pr as (select distinct job_id, trim(room) as source_room, {norm('room')} as room_norm from {{b_symbols}} where trim(room) <> ''),
    nm as (select job_id, piece_norm, count(*) as n, min(room_id) as room_id, min(row({norm('niveau')}, {norm('occupation')}, piece_norm, {norm('numero')})) as pos
           from {{b_ident}} group by 1, 2)"""


@query("room_match_exact", f"""with {_NAMES} select pr.job_id, source_room, case when n = 1 then room_id end as room_id, case when n = 1 then 'exact' end as method
       from pr left join nm on nm.job_id = pr.job_id and piece_norm = room_norm""")
def room_match_exact(d):
    return matching.match_rooms(_plan_rooms(d), _level_rooms(d), _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), ("exact",)).drop("score")


_CONTAINED = f"""ct as (select pr.job_id, source_room, n, room_id, row_number() over (partition by pr.job_id, source_room order by length(piece_norm) desc, pos) as k
    from pr join nm on nm.job_id = pr.job_id and length(piece_norm) >= 4 and (contains(concat(' ', room_norm, ' '), concat(' ', piece_norm, ' '))
         or (room_norm <> '' and contains(concat(' ', piece_norm, ' '), concat(' ', room_norm, ' '))))),
    rm as (select pr.job_id, pr.source_room, case when e.n is not null then case when e.n = 1 then e.room_id end when c.n = 1 then c.room_id end as room_id,
           case when e.n is not null then case when e.n = 1 then 'exact' end when c.n = 1 then 'contenance' end as method
           from pr left join nm e on e.job_id = pr.job_id and e.piece_norm = pr.room_norm left join ct c on c.job_id = pr.job_id and c.source_room = pr.source_room and c.k = 1)"""


@query("room_match_contains", f"with {_NAMES}, {_CONTAINED} select *, case method when 'exact' then 1.0::double when 'contenance' then 0.75::double end as score from rm")
def room_match_contains(d):
    return matching.match_rooms(_plan_rooms(d), _level_rooms(d), _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), ("exact", "containment"))


_ROOM_OV = """select s_suppkey as job_id, case s_suppkey % 3 when 0 then 'Annexe' when 1 then 'salle 6' else 'SALLE-5' end as source,
              case s_suppkey % 4 when 0 then 'Salle 1' when 1 then 'salle inconnue' when 2 then '' else 'Salle-3' end as target, s_suppkey as seq from {supplier}"""


def _room_overrides(d):
    return d.sql(_ROOM_OV)


@query("room_match", f"""with recursive {_NAMES}, {_CONTAINED}, ov as (select o.job_id, {norm('source')} as room_norm, t.room_id from ({_ROOM_OV}) o left join nm t on t.job_id = o.job_id and t.piece_norm = {norm('target')} and t.n = 1),
       {ratios('select room_norm as a, piece_norm as b from pr join nm using (job_id)')},
       rk as (select pr.job_id, source_room, nm.room_id, n, ratio, row_number() over w as k, lead(ratio) over w as follower from pr join nm using (job_id) join rt on a = room_norm and b = piece_norm
              window w as (partition by pr.job_id, source_room order by ratio desc, piece_norm)),
       fz as (select * from rk where k = 1 and ratio >= 0.62 and n = 1 and coalesce(ratio - follower >= 1e-9, true)),
       fi as (select pr.job_id, pr.source_room, case when ov.job_id is not null then ov.room_id when e.n is not null or fz.room_id is null then rm.room_id else fz.room_id end as room_id,
              case when ov.job_id is not null then 'correspondance utilisateur' when e.n is not null or fz.room_id is null then rm.method else 'fuzzy' end as method, ratio
              from pr left join ov on ov.job_id = pr.job_id and ov.room_norm = pr.room_norm left join nm e on e.job_id = pr.job_id and e.piece_norm = pr.room_norm
              left join rm on rm.job_id = pr.job_id and rm.source_room = pr.source_room left join fz on fz.job_id = pr.job_id and fz.source_room = pr.source_room)
       select job_id, source_room, room_id, case when room_id is not null then method end as method,
       case when room_id is not null then case method when 'fuzzy' then round_even(ratio, 2) when 'contenance' then 0.75::double else 1.0::double end end as score from fi""")
def room_match(d):
    return matching.match_rooms(_plan_rooms(d), _level_rooms(d), _room_overrides(d))


_INDEX = f"""ix as (select job_id, {norm('materiel')} as nn, min(materiel) as first_name, max(materiel) as last_name from {{b_lst}}
    where trim(materiel) <> '' and not {broken('materiel')} group by 1, 2), ar as (select distinct job_id, article, {norm('article')} as an from {{b_symbols}})"""
_OV_MATERIAL = """select distinct job_id, article as source, case length(article) % 3 when 0 then '' when 1 then upper(replace(article, 'inconnu ', '')) else 'rien de tel' end as target,
                  cast(1 as bigint) as seq from {b_symbols} where article like 'inconnu%'"""
_VALIDATED = "select distinct job_id, upper(article) as article from {b_symbols} where article like '%bolt%'"


@query("material_exact", f"""with {_INDEX}, o as ({_OV_MATERIAL}), v as (select distinct job_id, {norm('article')} as an from ({_VALIDATED}))
       select ar.job_id, ar.article, case when o.source is not null and o.target = '' then null when ou.nn is not null then ou.last_name when v.an is not null then ar.article else e.last_name end as target,
       case when o.source is not null and o.target = '' then null when ou.nn is not null then 'correspondance utilisateur' when v.an is not null then 'validé sans équivalent Excel'
            when e.nn is not null then 'exact' end as method,
       case when o.source is not null and o.target = '' then 'refused' when ou.nn is not null or v.an is not null or e.nn is not null then 'matched' else 'open' end as outcome
       from ar left join o on o.job_id = ar.job_id and o.source = ar.article left join ix ou on ou.job_id = ar.job_id and ou.nn = {norm('o.target')}
       left join v on v.job_id = ar.job_id and v.an = ar.an left join ix e on e.job_id = ar.job_id and e.nn = ar.an""")
def material_exact(d):
    return matching.match_materials(
        _articles(d), cut_lineage(matching.catalogue_index(_listing(d))), d.sql(_OV_MATERIAL), d.sql(_VALIDATED), _aliases(d),
        _none(d, "cache_key STRING, material STRING"), ("override", "validated", "exact")).select("job_id", "article", "target", "method", "outcome")


_ALIAS = f"""al as (select {norm('article')} as an, {norm('material')} as mn, min(alias_rank) as alias_rank from {{b_aliases}} group by 1, 2),
    am as (select ar.job_id, ar.article, arg_min(last_name, alias_rank) as target from ar join al on al.an = ar.an join ix on ix.job_id = ar.job_id and ix.nn = al.mn group by 1, 2),
    mm as (select ar.job_id, ar.article, coalesce(e.last_name, am.target) as target, case when e.nn is not null then 'exact' when am.target is not null then 'règle' end as method
           from ar left join ix e on e.job_id = ar.job_id and e.nn = ar.an left join am on am.job_id = ar.job_id and am.article = ar.article)"""


@query("material_alias", f"with {_INDEX}, {_ALIAS} select *, case when target is null then 'open' else 'matched' end as outcome from mm")
def material_alias(d):
    return matching.match_materials(
        _articles(d), cut_lineage(matching.catalogue_index(_listing(d))), _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"),
        _none(d, "job_id BIGINT, article STRING"), _aliases(d), _none(d, "cache_key STRING, material STRING"), ("exact", "alias")
    ).select("job_id", "article", "target", "method", "outcome")


_HASH = f"ch0 as (select job_id, {sha(chr(39) + chr(39) + ' || string_agg(distinct nn, chr(124) order by nn)')} as h from ix where nn <> '' group by 1)"


_CACHE = "select p_name as cache_key, min(p_brand) as material from {part} group by 1"
_ANSWERS = "select p_name as cache_key, case when length(p_name) % 3 = 0 then null else max(p_type) end as material from {part} group by 1 having length(p_name) % 2 = 0"


@query("merge_cache", f"with n as ({_ANSWERS}) select * from n union all select * from ({_CACHE}) where cache_key not in (select cache_key from n)")
def merge_cache(d):
    return rules.merge_cache(d.sql(_CACHE), d.sql(_ANSWERS))


@query("map_cache", f"""with {_INDEX}, {_HASH}, k as (select ar.*, concat('v2:', h, ':', {sha('an')}) as cache_key from ar join ch0 using (job_id)),
       c as (select k.job_id, article, cache_key, length(article) % 4 as v, last_name, k.an from k left join ix on ix.job_id = k.job_id and ix.nn = replace(k.an, 'inconnu ', ''))
       select job_id, article, cache_key, case when v = 0 then null else last_name end as cached,
       case when v = 0 then 'refused' when last_name is null then null when v = 1 then 'scope' else 'legacy' end as state
       from (select c.job_id, article, cache_key, v, case when v = 3 then null else last_name end as last_name from c)""")
def map_cache(d):
    index = cut_lineage(matching.catalogue_index(_listing(d)))
    articles = cut_lineage(_articles(d).withColumn("article_norm", norm_token("article")))
    v = F.length("article") % 4
    hashes = matching.catalogue_hash(articles.select("job_id").distinct(), index)
    scoped = articles.join(hashes, "job_id").where(v < 2).select(
        matching.scoped_cache_key(F.col("catalogue_hash"), F.col("article_norm")).alias("cache_key"),
        F.when(v == 1, F.replace("article_norm", F.lit("inconnu "), F.lit(""))).alias("material")).distinct()
    legacy = articles.where(v >= 2).select(F.col("article").alias("cache_key"), F.when(
        v == 2, F.replace("article_norm", F.lit("inconnu "), F.lit(""))).alias("material")).distinct()
    cache = cut_lineage(scoped.union(legacy).groupBy("cache_key").agg(F.max("material").alias("material")))
    return matching.cached_mappings(articles, index, cache)


@query("material_fuzzy", f"""with recursive {_INDEX}, {_ALIAS}, cd as (select job_id, article, an as a, -1 as rank from ar union all select ar.job_id, ar.article, al.mn, al.alias_rank from ar join al on al.an = ar.an),
       {ratios('select a, nn as b from cd join ix using (job_id)')},
       sm as (select cd.job_id, cd.article, first_name, ratio, row_number() over (partition by cd.job_id, cd.article order by ratio desc, rank, first_name) as k
              from cd join ix using (job_id) join rt on rt.a = cd.a and rt.b = ix.nn where ratio >= 0.65)
       select mm.job_id, mm.article, coalesce(mm.target, first_name) as target, coalesce(mm.method, case when first_name is not null then 'fuzzy' end) as method,
       case when mm.target is not null then 1.0::double else round_even(ratio, 2) end as score, case when coalesce(mm.target, first_name) is null then 'open' else 'matched' end as outcome
       from mm left join sm on sm.job_id = mm.job_id and sm.article = mm.article and k = 1""")
def material_fuzzy(d):
    return matching.match_materials(
        _articles(d), cut_lineage(matching.catalogue_index(_listing(d))), _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"),
        _none(d, "job_id BIGINT, article STRING"), _aliases(d), _none(d, "cache_key STRING, material STRING"))


_SUGGESTED = "select job_id, article, min(label) as material from {b_symbols} where label not like 'glyphe%' and job_id % 3 <> 0 group by 1, 2"


@query("suggestion_filter", f"""with {_INDEX}, {_HASH}, s as ({_SUGGESTED}), op as (select ar.* from ar left join ix on ix.job_id = ar.job_id and ix.nn = ar.an where ix.nn is null),
       ok as (select op.job_id, op.article, x.last_name from op join s on s.job_id = op.job_id and s.article = op.article
              join (select distinct job_id, materiel, {norm('materiel')} as nn from {{b_lst}}) l on l.job_id = op.job_id and l.materiel = s.material
              join ix x on x.job_id = op.job_id and x.nn = l.nn)
       select op.job_id, op.article, ok.last_name as target, case when ok.last_name is not null then 'llm' end as method, concat('v2:', h, ':', {sha('an')}) as cache_key
       from op join ch0 on ch0.job_id = op.job_id left join ok on ok.job_id = op.job_id and ok.article = op.article where op.job_id in (select job_id from s)""")
def suggestion_filter(d):
    index = cut_lineage(matching.catalogue_index(_listing(d)))
    matched = cut_lineage(matching.match_materials(
        _articles(d), index, _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), _none(d, "job_id BIGINT, article STRING"), _aliases(d),
        _none(d, "cache_key STRING, material STRING"), ("exact",)))
    accepted, remembered = matching.apply_suggestions(matched, index, d.sql(_SUGGESTED))
    answered = d.sql(_SUGGESTED).select("job_id").distinct()
    opened = matched.where("outcome = 'open'").select("job_id", "article").join(answered, "job_id", "left_semi")
    hashes = matching.catalogue_hash(opened.select("job_id").distinct(), index)
    keyed = opened.join(hashes, "job_id").withColumn("cache_key", matching.scoped_cache_key(F.col("catalogue_hash"), norm_token("article")))
    kept = keyed.join(remembered.select("cache_key").distinct(), "cache_key", "left_semi")
    return kept.join(accepted.select("job_id", "article", "target", "method"), ["job_id", "article"]).select("job_id", "article", "target", "method", "cache_key")


# -- after side ---------------------------------------------------------------------------
_EXCLUDED = "select distinct job_id, room, article from {b_symbols} where seq % 7 = 2"


def _exclusions(d):
    return d.sql(_EXCLUDED).select("job_id", relation_key("room", "article").alias("mapping_key")).distinct()


@query("exclusions", f"""select job_id, {key('room', 'article')} as mapping_key, count(*) as n from {{b_symbols}} where (job_id, {key('room', 'article')}) not in
       (select (job_id, {key('room', 'article')}) from ({_EXCLUDED})) group by 1, 2""")
def exclusions(d):
    return reconcile.count_objects(d.b_symbols, _exclusions(d)).groupBy("job_id", "mapping_key").agg(F.sum("quantity").alias("n"))


@query("symbol_totals", f"""select job_id, count(*) as symboles_detectes, count(*) filter (source = 'vision') as symboles_vision from {{b_symbols}}
       where (job_id, {key('room', 'article')}) not in (select (job_id, {key('room', 'article')}) from ({_EXCLUDED})) group by 1""")
def symbol_totals(d):
    return reconcile.symbol_totals(d.b_symbols, _exclusions(d))


_EXPANDED = f"""ob as (select job_id, room, article, categorie, page, label, count(*) as q, min(seq) as seq from {{b_symbols}} group by all),
    cp as (select {norm('article')} as an, item_rank, nullif(item_article, '') as ia, nullif(item_categorie, '') as ic, greatest(1, quantity) as iq from {{b_components}}),
    ex as (select job_id, trim(room) as source_room, article as source_material, coalesce(ia, article) as article, coalesce(ic, categorie) as categorie, page,
           case when iq is not null then concat(label, ' · ', article) else label end as label, {key('room', 'article')} as mapping_key, 'pdf' as origin, q * coalesce(iq, 1) as quantity,
           seq, coalesce(item_rank, 0) as item from ob left join cp on cp.an = {norm('ob.article')})"""


@query("component_expand", f"""with {_EXPANDED} select job_id, source_room, source_material, article, categorie, label, cast(sum(quantity) as bigint) as quantity from ex group by all""")
def component_expand(d):
    objects = reconcile.count_objects(d.b_symbols, _none(d, "job_id BIGINT, mapping_key STRING"))
    return reconcile.expand_components(objects, _components(d)).groupBy("job_id", "source_room", "source_material", "article", "categorie", "label").agg(
        F.sum("quantity").alias("quantity"))


_MANUAL = """mn as (select job_id, trim(room) as source_room, trim(material) as material, trim(category) as categorie, concat('manual:', id) as mapping_key, seq,
    cast(trunc(coalesce(try_cast(replace(quantity_after, ',', '.') as double), 0)) as bigint) as quantity, target_room_id, is_addition from {b_manual} where trim(material) <> '')"""


@query("after_union", f"""with {_EXPANDED}, {_MANUAL} select job_id, origin, source_room, article, mapping_key, cast(sum(quantity) as bigint) as quantity from (
       select job_id, origin, source_room, article, mapping_key, quantity from ex where source_room <> ''
       union all select job_id, 'manual', source_room, material, mapping_key, quantity from mn where quantity > 0) group by 1, 2, 3, 4, 5""")
def after_union(d):
    objects = reconcile.count_objects(d.b_symbols, _none(d, "job_id BIGINT, mapping_key STRING"))
    return reconcile.after_rows(objects, _components(d), d.b_manual).groupBy("job_id", "origin", "source_room", "article", "mapping_key").agg(
        F.sum("quantity").alias("quantity"))


_RELBASE = """select job_id, room, case when seq % 10 < 4 then article else concat('autre ', article) end as article, concat('Salle ', cast(seq % 9 as string)) as target_room_id,
              case seq % 3 when 0 then label when 1 then 'rien de tel' else '' end as target_material, seq % 8 = 0 as is_addition from {b_symbols}"""


def _relations(d):
    rows = d.sql(_RELBASE).withColumn("mapping_key", relation_key("room", "article"))
    return rows.groupBy("job_id", "mapping_key").agg(F.max(F.struct("target_room_id", "target_material", "is_addition")).alias("r")).select(
        "job_id", "mapping_key", "r.*")


@query("effective_relation", f"""with {_EXPANDED}, {_MANUAL}, {_INDEX}, {_NAMES},
       up as (select job_id, piece_norm, min(room_id) as room_id from {{b_ident}} group by 1, 2 having count(*) = 1),
       rl as (select job_id, {key('room', 'article')} as mapping_key, max(row(target_room_id, target_material, is_addition)) as r from ({_RELBASE}) group by 1, 2),
       aft as (select ex.job_id, source_room, source_material, article, ex.mapping_key, quantity, r is not null as explicit, r[1] as tr, r[2] as tm, coalesce(r[3], false) as addition
              from ex left join rl on rl.job_id = ex.job_id and rl.mapping_key = ex.mapping_key where source_room <> ''
              union all select job_id, source_room, material, material, mapping_key, quantity, true, target_room_id, '', is_addition from mn where quantity > 0),
       rows as (select a.*, case when explicit then t.room_id else e.room_id end as listed, case when tm <> '' then c.first_name end as canonical, x.last_name as auto
              from aft a left join up t on t.job_id = a.job_id and t.piece_norm = {norm('a.tr')} left join up e on e.job_id = a.job_id and e.piece_norm = {norm('a.source_room')}
              left join ix c on c.job_id = a.job_id and c.nn = {norm('a.tm')} left join ix x on x.job_id = a.job_id and x.nn = {norm('a.article')})
       select job_id, mapping_key, coalesce(listed, {new_room('source_room')}) as room_id, case when addition then article when canonical is not null then canonical else coalesce(auto, article) end as materiel,
       case when addition then 'validé sans équivalent Excel (1.0)' when canonical is not null then 'correspondance objet (1.0)' when auto is not null then 'exact (1.0)' else 'article PDF sans équivalent' end as mapping_method,
       case when not addition and canonical is null and tm <> '' then tm end as unknown_target, addition as is_addition, cast(sum(quantity) as bigint) as quantity from rows group by all""")
def effective_relation(d):
    rooms, index = _level_rooms(d), cut_lineage(matching.catalogue_index(_listing(d)))
    objects = reconcile.count_objects(d.b_symbols, _none(d, "job_id BIGINT, mapping_key STRING"))
    after = cut_lineage(reconcile.after_rows(objects, _components(d), d.b_manual))
    room_map = cut_lineage(matching.match_rooms(_plan_rooms(d), rooms, _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), ("exact",)))
    materials = cut_lineage(matching.match_materials(
        after.select("job_id", "article").distinct(), index, _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), _none(d, "job_id BIGINT, article STRING"),
        _aliases(d), _none(d, "cache_key STRING, material STRING"), ("exact",)))
    rows = reconcile.effective_rows(after, cut_lineage(_relations(d)), room_map, materials, rooms, index)
    return rows.groupBy("job_id", "mapping_key", "room_id", "materiel", "mapping_method", "unknown_target", "is_addition").agg(F.sum("quantity").alias("quantity"))


# -- both sides straight from the identities (no name matching) ---------------------------------
_COUNTED = f"""select job_id, niveau, occupation, piece, numero, categorie, materiel, pk, ln, seq, cast(ln % 3 + 1 as int) as page, lq, st,
              case when pk % 4 = 0 then 'nan' when pk % 5 = 1 then ' ' else brand end as label from {{b_src}} where st = 'F'"""


def _counted(d):
    rows = with_room_identity(d.sql(_COUNTED))
    return rows.select(
        "job_id", "room_id", F.lit(True).alias("room_is_listed"), "categorie", "materiel", "label", F.upper("piece").alias("source_room"),
        F.concat("materiel", F.lit("/"), (F.col("pk") % 3).cast("string")).alias("source_material"), F.when(F.col("pk") % 2 == 0, "pdf").otherwise("manual").alias("origin"),
        relation_key("piece", "materiel").alias("mapping_key"), F.concat(F.lit("m"), (F.col("pk") % 3).cast("string")).alias("mapping_method"),
        F.when(F.col("pk") % 9 == 0, F.col("materiel")).alias("explicit_material"), (F.col("pk") % 11 == 0).alias("is_addition"), "page",
        F.lit(1).cast("bigint").alias("quantity"), "seq")


def _first_seen(name: str, col: str, separator: str) -> str:
    return (f"{name} as (select job_id, room_id, categorie, materiel, string_agg(v, '{separator}' order by s, v) as {name} from (select job_id, room_id, categorie, materiel, trim({col}) as v, "
            f"min(seq) as s from cn where trim({col}) <> '' and lower(trim({col})) <> 'nan' group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4)")


_CN = f"""cn as (select job_id, {room()} as room_id, categorie, materiel, label, upper(piece) as source_room, concat(materiel, '/', pk % 3) as source_material,
    case when pk % 2 = 0 then 'pdf' else 'manual' end as origin, {key('piece', 'materiel')} as mapping_key, concat('m', pk % 3) as mapping_method,
    case when pk % 9 = 0 then materiel end as explicit_material, pk % 11 = 0 as is_addition, page, seq from ({_COUNTED}))"""
_AG = f"""{_CN}, {_first_seen('labels', 'label', ', ')}, {_first_seen('source_rooms', 'source_room', ' | ')}, {_first_seen('source_materials', 'source_material', ' | ')},
    {_first_seen('origins', 'origin', ' + ')}, {_first_seen('mapping_keys', 'mapping_key', ' | ')}, {_first_seen('mapping_methods', 'mapping_method', ' | ')},
    ag as (select c.*, coalesce(labels, '') as labels, source_rooms as source_room, source_materials as source_material, origins as origin, mapping_keys as mapping_key, mapping_methods as mapping_method
       from (select job_id, room_id, categorie, materiel, count(*) as quantite_apres, bool_or(is_addition) as is_addition, string_agg(distinct cast(page as varchar), ',' order by cast(page as varchar)) as pages from cn group by 1, 2, 3, 4) c
       left join labels using (job_id, room_id, categorie, materiel) left join source_rooms using (job_id, room_id, categorie, materiel) left join source_materials using (job_id, room_id, categorie, materiel)
       left join origins using (job_id, room_id, categorie, materiel) left join mapping_keys using (job_id, room_id, categorie, materiel) left join mapping_methods using (job_id, room_id, categorie, materiel))"""


@query("after_group", f"with {_AG} select * from ag")
def after_group(d):
    return reconcile.after_groups(_counted(d))


@query("before_group", "select job_id, room_id, categorie, materiel, cast(sum(quantite) as bigint) as quantite_avant from {b_lst} group by 1, 2, 3, 4")
def before_group(d):
    return reconcile.before_groups(_listing(d))


_BEFORE = f"bf as (select job_id, room_id, categorie, materiel, quantite from {{b_lst}} where materiel <> '' and not {broken('materiel')} and (job_id, room_id) in (select (job_id, room_id) from cn))"


@query("before_scope", f"with {_CN}, {_BEFORE} select job_id, room_id, count(*) as n, cast(sum(quantite) as bigint) as quantite from bf group by 1, 2")
def before_scope(d):
    return reconcile.before_rows(_listing(d), _counted(d)).groupBy("job_id", "room_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantite").alias("quantite"))


_LN = f"""{_AG}, {_BEFORE}, bg as (select job_id, room_id, categorie, materiel, cast(sum(quantite) as bigint) as quantite_avant from bf group by 1, 2, 3, 4),
    kn as (select distinct job_id, explicit_material as materiel from cn where explicit_material is not null),
    ln0 as (select job_id, room_id, categorie, materiel, coalesce(quantite_avant, 0) as quantite_avant, coalesce(quantite_apres, 0) as quantite_apres, coalesce(is_addition, false) as is_addition,
            coalesce(pages, '') as pages, coalesce(labels, '') as labels, coalesce(source_room, '') as source_room, coalesce(source_material, '') as source_material,
            coalesce(origin, 'excel') as origin, coalesce(mapping_key, '') as mapping_key, coalesce(mapping_method, '') as mapping_method, coalesce(mapping_method, 'maquette seule') as rapprochement from bg full join ag using (job_id, room_id, categorie, materiel)),
    cl as (select ln0.*, quantite_apres - quantite_avant as ecart, case when quantite_avant <> 0 and quantite_apres = 0 then 'NON DÉTECTÉ SUR PLAN (à vérifier)'
            when quantite_avant = 0 and quantite_apres <> 0 then case when is_addition or kn.materiel is not null then 'AJOUT' else 'À VALIDER (article inconnu de la maquette)' end
            when quantite_avant = quantite_apres then 'INCHANGÉ' else 'MODIFIÉ' end as statut from ln0 left join kn using (job_id, materiel))"""


def _lines(d):
    """The listing and the counted rows, both written, and the lines from them, for one ``written`` with ``all_keys`` false."""
    listing, counted = written(_listing(d).select(*options.LISTING_COLUMNS), "listing"), written(_counted(d), "counted")
    fit = jobs_fit(listing, counted)
    no_map = _none(d, "job_id BIGINT, article STRING, target STRING")
    return listing, counted, reconcile.reconcile(
        reconcile.before_groups(reconcile.before_rows(listing, counted, fit)), reconcile.after_groups(by_job(counted, fit)),
        reconcile.known_materials(counted, no_map))


def _described(d):
    listing, counted, lines = _lines(d)
    rooms = written(options.rooms(options.identities(listing)), "rooms")
    return reconcile.describe(lines, reconcile.room_descriptions(rooms, counted, _none(d, "job_id BIGINT, display_level STRING")))


@query("status_counts", f"with {_LN} select job_id, statut, count(*) as lignes from cl group by 1, 2")
def status_counts(d):
    return written(reconcile.status_counts(_lines(d)[2]), "counts", all_keys=False)


_DESCRIBED = "rd as (select distinct job_id, room_id, niveau, occupation, piece, numero from {b_ident})"


@query("report_comparison", f"""with {_LN}, {_DESCRIBED} select cl.job_id, coalesce(niveau, '') as "Niveau", coalesce(occupation, '') as "Occupation", coalesce(piece, '') as "Pièce Excel", coalesce(numero, '') as "N°",
       cl.room_id as "ID pièce Excel", source_room as "Pièce source PDF", source_material as "Objet source PDF", origin as "Origine", categorie as "Catégorie", materiel as "Matériel comparé",
       quantite_avant as "Quantité marché", quantite_apres as "Quantité après FTM", ecart as "Écart", statut as "Statut", pages as "Pages PDF", labels as "Libellés plan", rapprochement as "Rapprochement"
       from cl left join rd using (job_id, room_id)""")
def report_comparison(d):
    return written(reconcile.report_table(_described(d)), "report", all_keys=False)


@query("report_order", f"""with {_LN}, {_DESCRIBED} select cl.job_id, cl.room_id, categorie, materiel, row_number() over (partition by cl.job_id order by coalesce(niveau, ''), coalesce(occupation, ''),
       coalesce(piece, ''), categorie, materiel, cl.room_id) as rang from cl left join rd using (job_id, room_id)""")
def report_order(d):
    placed = written(_described(d).select(*reconcile.REPORT_ORDER), "placed", all_keys=False)
    return written(reconcile.report_ranks(placed).select("job_id", "room_id", "categorie", "materiel", "rang"), "ranks")


@query("report_summary", f"""with {_LN}, {_NAMES}, e as (select pr.job_id, source_room, case when n = 1 then room_id end as room_id from pr left join nm on nm.job_id = pr.job_id and piece_norm = room_norm),
       w as (select job_id, count(*) as seen, count(room_id) as matched, string_agg(source_room, ', ' order by source_room) filter (room_id is null) as missing from e group by 1),
       s as (select job_id, count(*) filter (statut = 'AJOUT') as a, count(*) filter (statut = 'MODIFIÉ') as b, count(*) filter (statut = 'INCHANGÉ') as c, count(*) filter (statut like 'NON%') as d, count(*) filter (statut like 'À%') as f from cl group by 1),
       j as (select s.*, seen, matched, missing from s left join w using (job_id))
       select job_id, u.ord, u.label, u.value from j, lateral (values (0, 'Pièces reconnues sur le plan', cast(coalesce(seen, 0) as varchar)), (1, 'Pièces rapprochées avec la maquette', cast(coalesce(matched, 0) as varchar)),
         (2, 'Pièces non rapprochées', coalesce(missing, '—')), (3, 'Rapprochement des noms par LLM', 'non (fuzzy local)'), (4, 'Lignes « AJOUT »', cast(a as varchar)), (5, 'Lignes « MODIFIÉ »', cast(b as varchar)),
         (6, 'Lignes « INCHANGÉ »', cast(c as varchar)), (7, 'Lignes « NON DÉTECTÉ SUR PLAN (à vérifier) »', cast(d as varchar)), (8, 'Lignes « À VALIDER (article inconnu de la maquette) »', cast(f as varchar))) u(ord, label, value)""")
def report_summary(d):
    room_map = matching.match_rooms(_plan_rooms(d), _level_rooms(d), _none(d, "job_id BIGINT, source STRING, target STRING, seq BIGINT"), ("exact",))
    lines = written(_lines(d)[2].select("job_id", "statut"), "lines", all_keys=False)
    return reconcile.report_summary(lines, room_map, _none(d, "job_id BIGINT, method STRING"))


def _payload(*columns: str) -> str:
    """JSON object of some columns without its nulls."""
    return "json_merge_patch('{' || '}', to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in columns) + ")))::varchar"


@query("analysis_record", f"""with {_LN}, lm as (select job_id, niveau, count(distinct piece) as pieces, count(*) as lignes, cast(sum(quantite) as bigint) as quantite from {{b_lst}} group by 1, 2)
       select job_id, 'comparatif' as section, {_payload(*'room_id categorie materiel quantite_avant quantite_apres ecart statut pages labels source_room source_material origin mapping_key mapping_method is_addition rapprochement'.split())} as payload from cl
       union all select job_id, 'scopes', {_payload('scope_id', 'niveau', 'occupation', 'numero', 'scope_label')} from {{b_sc}}
       union all select job_id, 'statuts', {_payload('statut', 'lignes')} from (select job_id, statut, count(*) as lignes from cl group by 1, 2)
       union all select job_id, 'niveaux', {_payload('niveau', 'pieces', 'lignes', 'quantite')} from lm""")
def analysis_record(d):
    listing, _, lines = _lines(d)
    lines = written(lines, "lines", all_keys=False)
    return sinks.record_rows({"comparatif": lines, "scopes": options.scopes(options.identities(listing)), "statuts": reconcile.status_counts(lines),
                              "niveaux": options.level_summary(listing).select("job_id", "niveau", "pieces", "lignes", "quantite")})


@query("output_checks", f"""with {_CN}, {_BEFORE} select s_suppkey as job_id, case when s_suppkey not in (select job_id from bf) then 'vide : avant' when s_suppkey not in (select job_id from cn where page = 2) then 'vide : apres'
       else 'OK' end as verdict from {{supplier}}""")
def output_checks(d):
    counted = _counted(d)
    jobs = d.supplier.select(F.col("s_suppkey").alias("job_id"))
    return reconcile.output_checks(jobs, {"avant": reconcile.before_rows(_listing(d), counted), "apres": counted.where("page = 2")})


@query("category_lookup", """with c as (select job_id, room_id, materiel, categorie, count(*) as n from {b_lst} where materiel <> '' group by all),
       r as (select job_id, room_id, materiel, categorie, row_number() over (partition by job_id, room_id, materiel order by n desc, categorie) as k from c),
       m as (select job_id, materiel, categorie, row_number() over (partition by job_id, materiel order by sum(n) desc, categorie) as k from c group by job_id, materiel, categorie),
       """ + _CN + """ select cn.job_id, cn.room_id, cn.materiel, coalesce(r.categorie, m.categorie, cn.categorie) as categorie, count(*) as n from cn
       left join r on r.job_id = cn.job_id and r.room_id = cn.room_id and r.materiel = cn.materiel and r.k = 1 left join m on m.job_id = cn.job_id and m.materiel = cn.materiel and m.k = 1 group by 1, 2, 3, 4""")
def category_lookup(d):
    return reconcile.with_category(_counted(d).select("job_id", "room_id", "materiel", "categorie"), _listing(d)).groupBy("job_id", "room_id", "materiel", "categorie").agg(
        F.count(F.lit(1)).alias("n"))


_CATALOG = """select p_type as page_type, 'text' as kind, cast(p_partkey as int) as ord, p_name as article, p_brand as categorie, cast(p_partkey as string) as reference from {part}"""
_PAGE_TYPED = "select l_suppkey as job_id, p_type as page_type, p_name as article, concat('Salle ', cast(l_linenumber as string)) as room from {lineitem} join {part} on l_partkey = p_partkey"


@query("catalog_coverage", f"""with c as (select page_type, article, arg_min(categorie, ord) as categorie, arg_min(reference, ord) as reference from ({_CATALOG}) group by 1, 2),
       s as ({_PAGE_TYPED}), n as (select job_id, page_type, article, count(*) as n from s where room <> 'Salle 3' group by 1, 2, 3)
       select job_id, page_type, article, categorie, reference, n.n from c join n using (page_type, article)""")
def catalog_coverage(d):
    symbols = d.sql(_PAGE_TYPED)
    excluded = symbols.where("room = 'Salle 3'").select("job_id", relation_key("room", "article").alias("mapping_key")).distinct()
    return reconcile.catalog_coverage(symbols, excluded, d.sql(_CATALOG), rules.entry_rank())


@query("components_present", f"""select distinct s.job_id, c.article, item_rank, item_article, trim(item_categorie) as item_categorie, case when quantity = 0 then 1 else quantity end as quantity
       from (select distinct job_id, {norm('article')} as an from {{b_symbols}}) s join {{b_components}} c on {norm('c.article')} = s.an""")
def components_present(d):
    return reconcile.components_present(d.b_symbols, _components(d))


# -- the whole comparison ------------------------------------------------------------------------
_SCOPED = _CHOSEN + """, sl as (select l.* from {b_lst} l join ch using (job_id) where case when ch.scope_id is not null then l.scope_id = ch.scope_id else n_scopes <= 1 end),
    sid as (select distinct job_id, niveau, occupation, piece, numero, scope_id, room_id, room_label from sl)"""
_FLAG = f"""{_SCOPED}, pr as (select distinct job_id, trim(room) as source_room, {norm('room')} as room_norm from {{b_symbols}} where trim(room) <> ''),
    nm as (select job_id, {norm('piece')} as piece_norm, count(*) as n, min(room_id) as room_id, min(row({norm('niveau')}, {norm('occupation')}, {norm('piece')}, {norm('numero')})) as pos from sid group by 1, 2),
    {_CONTAINED}, {_EXPANDED},
    ix as (select job_id, {norm('materiel')} as nn, min(materiel) as first_name, max(materiel) as last_name from sl where trim(materiel) <> '' and not {broken('materiel')} group by 1, 2),
    ar as (select distinct job_id, article, {norm('article')} as an from ex where source_room <> ''), {_ALIAS},
    mp as (select ex.job_id, ex.source_room, ex.article, ex.mapping_key, coalesce(rm.room_id, {new_room('ex.source_room')}) as room_id, rm.room_id is not null as listed, coalesce(mm.target, ex.article) as materiel,
           case when mm.target is null then 'article PDF sans équivalent' else concat(mm.method, ' (1.0)') end as how, categorie as own, page, quantity from ex
           left join rm on rm.job_id = ex.job_id and rm.source_room = ex.source_room left join mm on mm.job_id = ex.job_id and mm.article = ex.article where ex.source_room <> ''),
    c0 as (select job_id, room_id, materiel, categorie, count(*) as n from sl where materiel <> '' group by all),
    cr as (select job_id, room_id, materiel, categorie, row_number() over (partition by job_id, room_id, materiel order by n desc, categorie) as k from c0),
    cm as (select job_id, materiel, categorie, row_number() over (partition by job_id, materiel order by sum(n) desc, categorie) as k from c0 group by job_id, materiel, categorie),
    mc as (select mp.*, coalesce(cr.categorie, cm.categorie, own) as categorie from mp left join cr on cr.job_id = mp.job_id and cr.room_id = mp.room_id and cr.materiel = mp.materiel and cr.k = 1
           left join cm on cm.job_id = mp.job_id and cm.materiel = mp.materiel and cm.k = 1),
    ga as (select job_id, room_id, categorie, materiel, sum(quantity) as qa, string_agg(distinct cast(page as varchar), ',' order by cast(page as varchar)) as pages from mc group by 1, 2, 3, 4),
    gb as (select job_id, room_id, categorie, materiel, sum(quantite) as qb from sl where materiel <> '' and not {broken('materiel')} and (job_id, room_id) in (select (job_id, room_id) from mc where listed) group by 1, 2, 3, 4),
    kn as (select distinct job_id, target as materiel from mm where target is not null),
    fl as (select job_id, room_id, categorie, materiel, cast(coalesce(qb, 0) as bigint) as quantite_avant, cast(coalesce(qa, 0) as bigint) as quantite_apres, coalesce(pages, '') as pages,
           kn.materiel is not null as known from gb full join ga using (job_id, room_id, categorie, materiel) left join kn using (job_id, materiel)),
    fs as (select job_id, room_id, categorie, materiel, quantite_avant, quantite_apres, quantite_apres - quantite_avant as ecart, pages,
           case when quantite_avant <> 0 and quantite_apres = 0 then 'NON DÉTECTÉ SUR PLAN (à vérifier)'
           when quantite_avant = 0 and quantite_apres <> 0 then case when known then 'AJOUT' else 'À VALIDER (article inconnu de la maquette)' end
           when quantite_avant = quantite_apres then 'INCHANGÉ' else 'MODIFIÉ' end as statut from fl)"""


def _comparison(d, **extra):
    return Comparison(_listing(d), d.b_symbols, params=d.b_params, aliases=_aliases(d), components=_components(d), **EXACT, **extra)


@query("reconcile", f"""with {_FLAG}, fr as (select job_id, room_id, min(source_room) as sr from mc where not listed group by 1, 2)
       select fs.*, coalesce(sid.niveau, case when p.niveau_excel <> '' then p.niveau_excel else concat('R', p.niveau_hint) end) as niveau,
       coalesce(sid.occupation, '') as occupation, coalesce(sid.piece, concat(sr, ' [nouvelle pièce]')) as piece, coalesce(sid.scope_id, '') as scope_id
       from fs left join sid on sid.job_id = fs.job_id and sid.room_id = fs.room_id left join fr on fr.job_id = fs.job_id and fr.room_id = fs.room_id left join {{b_params}} p on p.job_id = fs.job_id""")
def reconcile_jobs(d):
    return _comparison(d).table.select("job_id", "room_id", "categorie", "materiel", "quantite_avant", "quantite_apres", "ecart", "pages", "statut",
                                       "niveau", "occupation", "piece", "scope_id")


_KEPT_FLAG = _FLAG.replace("from {b_symbols} group by all)", f"from {{b_symbols}} where (job_id, {key('room', 'article')}) not in (select (job_id, {key('room', 'article')}) from ({_EXCLUDED})) group by all)")


@query("trace", f"""with {_KEPT_FLAG}, xk as (select distinct job_id, {key('room', 'article')} as mapping_key from ({_EXCLUDED})),
       st as (select job_id, room_id, materiel, arg_max(statut, categorie) as statut from fs group by 1, 2, 3),
       s0 as (select *, {key('room', 'article')} as mapping_key from {{b_symbols}}),
       sy as (select s0.*, xk.mapping_key is not null as ignored from s0 left join xk on xk.job_id = s0.job_id and xk.mapping_key = s0.mapping_key),
       lo as (select job_id, mapping_key, arg_max(room, seq) as room, arg_max(article, seq) as article from sy where not ignored group by 1, 2),
       tg as (select lo.job_id, lo.mapping_key, coalesce(rm.room_id, {new_room('lo.room')}) as room_id, coalesce(mm.target, lo.article) as mat from lo
              left join rm on rm.job_id = lo.job_id and rm.source_room = trim(lo.room) left join mm on mm.job_id = lo.job_id and mm.article = lo.article)
       select sy.job_id, sy.mapping_key, ignored, coalesce(tg.room_id, '') as room_id, coalesce(tg.mat, mm.target, sy.article) as materiel_compare,
       case when ignored then 'EXCLU PAR L''UTILISATEUR' else coalesce(st.statut, 'COMPTÉ SUR LE PLAN') end as statut, count(*) as n, cast(sum(seq % 1000003) as bigint) as check_seq
       from sy left join tg on tg.job_id = sy.job_id and tg.mapping_key = sy.mapping_key left join mm on mm.job_id = sy.job_id and mm.article = sy.article
       left join st on st.job_id = tg.job_id and st.room_id = tg.room_id and st.materiel = tg.mat group by 1, 2, 3, 4, 5, 6""")
def trace_jobs(d):
    run = _comparison(d, exclusions=_exclusions(d))
    references = d.sql("select distinct p_name as article, 'x' as reference from {part}")
    counted = run.trace(references).groupBy("job_id", "mapping_key", "ignored", "room_id", "materiel_compare", "statut").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("seq") % 1000003).alias("check_seq"))
    return written(counted, "trace", all_keys=False)
