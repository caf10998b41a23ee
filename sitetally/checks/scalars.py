"""Queries over keys, labels, amounts, scores."""

from pyspark.sql import functions as F

from ..functions import amounts, identity, symbols as sym, text
from ..functions.similarity import similar_pairs
from ..operators import options, overlay
from ..sources import rules
from .registry import broken, ident, key, new_room, norm, norm_k2, query, ratios, room, room_label, scope, scope_label, sha


@query("norm_token", f"select doc_id, sha1({norm('text')}) as token_hash, length({norm('text')}) as n from {{documents}}")
def norm_token(d):
    token = text.norm_token("text")
    return d.documents.select("doc_id", F.sha1(token).alias("token_hash"), F.length(token).alias("n"))


@query("norm_span", f"select doc_id, sha1({norm_k2('text')}) as span_hash, length({norm_k2('text')}) as n from {{documents}}")
def norm_span(d):
    span = text.norm_span("text")
    return d.documents.select("doc_id", F.sha1(span).alias("span_hash"), F.length(span).alias("n"))


@query("relation_key", f"select job_id, {key('room', 'article')} as mapping_key, count(*) as n from {{b_symbols}} group by 1, 2")
def relation_key(d):
    return d.b_symbols.groupBy("job_id", identity.relation_key("room", "article").alias("mapping_key")).agg(F.count(F.lit(1)).alias("n"))


@query("identity_keys", f"""select distinct niveau, occupation, piece, numero, {scope()} as scope_id, {room()} as room_id,
       {new_room('piece')} as new_room_id from {{b_src}}""")
def identity_keys(d):
    return identity.with_room_identity(d.b_src.select("niveau", "occupation", "piece", "numero").distinct()).select(
        "niveau", "occupation", "piece", "numero", "scope_id", "room_id", identity.new_room_id("piece").alias("new_room_id"))


@query("identity_labels", f"""select distinct niveau, occupation, piece, numero, {room_label()} as room_label, {scope_label()} as scope_label,
       concat(piece, ' (', niveau, ')') as bare_room, 'Pôle non renseigné' as bare_scope from {{b_src}}""")
def identity_labels(d):
    blank = F.lit("")
    return d.b_src.select("niveau", "occupation", "piece", "numero").distinct().withColumns({
        "room_label": identity.room_label("niveau", "occupation", "piece", "numero"),
        "scope_label": identity.scope_label("niveau", "occupation", "numero"),
        "bare_room": identity.room_label("niveau", blank, "piece", blank),
        "bare_scope": identity.scope_label(blank, blank, blank)})


@query("invalid_refs", f"""select job_id, count(*) as rows, cast(sum(quantite) as bigint) as quantite from {{b_listing}}
       where {broken('materiel')} group by job_id""")
def invalid_refs(d):
    return options.broken_references(d.b_listing)


_QTY = """select o_orderkey, case o_orderkey % 6 when 0 then replace(cast(cast(o_totalprice as decimal(18,2)) as string), '.', ',')
          when 1 then cast(cast(o_totalprice as decimal(18,2)) as string) when 2 then 'abc' when 3 then concat('-', cast(o_custkey as string), '.5')
          when 4 then concat(' ', cast(o_custkey as string), ' ') else '' end as t from {orders}"""


@query("qty_parse", f"""select o_orderkey, cast(greatest(0, trunc(coalesce(try_cast(replace(trim(t), ',', '.') as double), 0))) as bigint) as typed,
       cast(trunc(coalesce(try_cast(trim(t) as double), 0)) as bigint) as sheet from ({_QTY})""")
def qty_parse(d):
    return d.sql(_QTY).select("o_orderkey", amounts.positive_quantity("t").alias("typed"), amounts.sheet_quantity("t").alias("sheet"))


_LEGACY = """select o_orderkey, case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then 'x' else cast(o_custkey % 90 as string) end as b,
             case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then concat('-', cast(o_custkey % 9 as string), ',50')
                  else concat(cast(o_custkey % 12 as string), '.', cast(o_orderkey % 4 as string), '0') end as c from {orders}"""


@query("legacy_qty", f"""select o_orderkey, case when c = '' then b else coalesce(regexp_replace(regexp_replace(cast(
         try_cast(case when b = '' then '0' else b end as decimal(18,6)) + try_cast(replace(c, ',', '.') as decimal(18,6)) as varchar),
         '0+$', ''), '\\.$', ''), '') end as after from ({_LEGACY})""")
def legacy_qty(d):
    return d.sql(_LEGACY).select("o_orderkey", amounts.legacy_quantity_after("b", "c").alias("after"))


_MONEY = "select o_orderkey, cast(o_totalprice as decimal(18,4)) * (case when o_orderkey % 3 = 0 then -7.125 else 11.005 end) as m from {orders}"


@query("euro_format", f"""select o_orderkey, concat(case when r < 0 then '-' else '' end, replace(format('{{:,}}', cast(trunc(abs(r)) as bigint)), ',', chr(160)), ',',
       right(cast(abs(r) as varchar), 2), chr(160), '€') as euro from (select o_orderkey, cast(round(m, 2) as decimal(30,2)) as r from ({_MONEY}))""")
def euro_format(d):
    return d.sql(_MONEY).select("o_orderkey", amounts.format_euro("m").alias("euro"))


_SCORES = """select event_id, case event_id % 4 when 0 then 'texte' when 1 then 'vision' when 2 then 'expansion' else 'Corrigé' end as source,
             case when event_id % 3 = 0 then concat('glyphe (0.', cast(10 + event_id % 90 as string), ')') when event_id % 11 = 0 then 'glyphe (1.0)'
             else event_type end as label, case when event_id % 5 = 0 then 0.5e0 else 0.0e0 end as stored from {events}"""
_EMB = "try_cast(nullif(regexp_extract(label, '\\((0(?:\\.\\d+)?|1(?:\\.0+)?)\\)', 1), '') as double)"


@query("symbol_scores", f"""select event_id, case when stored <> 0 then stored when source in ('texte', 'Corrigé') then 1.0 else
       coalesce({_EMB}, case when source = 'vision' then 0.75 else 0.6 end)::double end as confidence,
       case when source = 'texte' then 2.0 else coalesce({_EMB}, case when source = 'vision' then 1.0 else 0.8 end)::double end as quality
       from ({_SCORES})""")
def symbol_scores(d):
    return d.sql(_SCORES).select("event_id", sym.confidence("stored", "source", "label").alias("confidence"),
                                 sym.duplicate_quality("source", "label").alias("quality"))


_DETECTED = """select user_id % 16 as job_id, event_id as seq, cast(user_id % 5 + 1 as int) as page, event_type as page_type,
               concat('Article ', cast(event_id % 3 as string)) as article, cast(event_id % 24 as double) / 2 as x, cast(event_id % 30 as double) as y,
               case when event_id % 101 = 0 then 'given' else '' end as detection_id, 0.0e0 as confidence, 'texte' as source, 'a' as label,
               '' as original_article, '' as original_reference from {events}"""


@query("detection_ids", f"""with s as ({_DETECTED}), b as (select *, case when detection_id <> '' then detection_id else
       concat('p', page, '-', {sha("concat_ws(chr(124), page, page_type, case when article = 'Article 1' then 'R1' else '' end, " + norm('article')
       + ", cast(round_even(x / 2, 0) as bigint) * 2, cast(round_even(y / 2, 0) as bigint) * 2)", 10)}) end as base from s),
       n as (select *, row_number() over (partition by job_id, base order by seq) as k, row_number() over (partition by job_id, page order by seq) as l from b)
       select job_id, seq, concat(base, case when k > 1 then concat('-', k) else '' end) as detection_id, concat('p', page, '-d', l) as legacy_id,
       case when article = 'Article 1' then 'R1' else '' end as original_reference from n""".replace("with s as", "with s as", 1))
def detection_ids(d):
    references = d.sql("select distinct concat('Article ', cast(event_id % 3 as string)) as article, 'R1' as reference from {events} where event_id % 3 = 1")
    done = overlay.with_detection_metadata(d.sql(_DETECTED), references)
    return overlay.with_legacy_id(done).select("job_id", "seq", "detection_id", "legacy_id", "original_reference")


@query("fuzzy_pairs", f"""with recursive l as (select distinct job_id, {norm('article')} as a from {{b_symbols}}), r as (select distinct job_id, {norm('materiel')} as b from {{b_listing}}),
       {ratios('select l.a, r.b from l join r using (job_id)')}
       select l.job_id, l.a, r.b, round_even(ratio, 4) as score from l join r using (job_id) join rt on rt.a = l.a and rt.b = r.b where ratio >= 0.65 - 1e-9""")
def fuzzy_pairs(d):
    left = d.b_symbols.select("job_id", text.norm_token("article").alias("a"))
    right = d.b_listing.select("job_id", text.norm_token("materiel").alias("b"))
    return similar_pairs(left, right, ["job_id"], 0.65).withColumn("score", text.py_round("score", 4))


@query("catalog_flat", """select p_size, p_type as page_type, 'text' as kind, cast(row_number() over (partition by p_size, p_type order by cast(p_partkey as varchar)) - 1 as int) as ord,
       cast(p_partkey as varchar) as reference, p_name as article, p_brand as categorie, 14.0::double as min_font_size from {part}""")
def catalog_flat(d):
    """Catalogue documents written from the parts of each size, then flattened."""
    entry = F.struct(F.col("p_partkey").cast("string").alias("reference"), F.concat(F.lit("^"), "p_name").alias("pattern"),
                     F.col("p_name").alias("article"), F.col("p_brand").alias("categorie"), F.lit(14).alias("min_font_size"))
    written = d.part.groupBy("p_size", "p_type").agg(F.array_sort(F.collect_list(entry)).alias("text")).select(
        "p_size", F.to_json(F.create_map("p_type", F.struct("text"))).alias("document"))
    return rules.flatten_catalog(written).select("p_size", "page_type", "kind", "ord", "reference", "article", "categorie", "min_font_size")
