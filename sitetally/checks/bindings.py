"""Views that let every operator run over the driver tables.

Each view is one SQL text that Spark and DuckDB both read; ``{name}`` stands
for a driver table or another view. Order lines with status O are
the listing, those with status F the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

VIEWS = {
    # every order line as an item of a building site; a supplier is a job
    "b_src": """
        select l_suppkey as job_id, l_linestatus as st, l_partkey as pk, l_orderkey as ok, l_linenumber as ln,
               cast(floor(l_quantity) as bigint) as lq, l_extendedprice as price,
               (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 1000000 as seq,
               r_name as niveau, n_name as occupation,
               case when l_suppkey % 5 = 0 then concat(cast(n_nationkey as string), '-', cast(l_linenumber % 2 as string))
                    else cast(n_nationkey as string) end as numero,
               case when l_linenumber = 7 then 'Local technique' else concat('Salle ', cast(l_linenumber as string)) end as piece,
               p_type as categorie, p_name as materiel, p_brand as brand
        from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey
             join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "b_listing": """
        select job_id, 0 as sheet_idx, 'Maquette' as sheet, seq as row_idx, niveau, occupation, piece, numero, categorie,
               case when pk % 4 = 0 then '' else brand end as code_article,
               case when pk % 97 = 3 then '#REF!' when pk % 89 = 5 then '' else materiel end as materiel,
               lq % 3 as quantite
        from {b_src} where st = 'O'""",
    "b_symbols": """
        select job_id, seq, cast(ln % 3 + 1 as int) as page,
               case ln % 3 when 0 then 'ELECTRICITE' when 1 then 'LUMINAIRE' else 'PLOMBERIE' end as page_type,
               case when pk % 3 = 0 then concat('glyphe (0.', cast(10 + pk % 90 as string), ')') else materiel end as label,
               case when pk % 6 = 0 then upper(materiel) when pk % 6 = 1 then replace(materiel, 'e', 'é')
                    when pk % 12 = 2 then concat('inconnu ', materiel) else materiel end as article,
               categorie, cast(ok * 7 % 800 as double) as x, cast(cast(floor(price) as bigint) % 600 as double) as y,
               case when pk % 13 = 0 then '' when pk % 11 = 0 then 'Annexe'
                    when ln = 1 then 'SALLE 1' when ln = 2 then 'Salle-2' when ln = 3 then 'Sallé 3'
                    when ln = 4 then 'Grande salle 4 nord' when ln = 7 then 'Local technique'
                    else concat('Salle ', cast(ln as string)) end as room,
               cast(ok % 40 as double) as room_dist, case when pk % 3 = 0 then 'vision' else 'texte' end as source,
               '' as detection_id, cast(0 as double) as confidence, '' as original_article, '' as original_reference
        from {b_src} where st = 'F'""",
    "b_params": """
        select s_suppkey as job_id, case when s_suppkey % 3 = 0 then lower(r_name) else '' end as niveau_excel,
               '' as nom_niveau, case when s_suppkey % 3 = 1 then substr(r_name, 1, 2) else 'zz' end as niveau_hint,
               case when s_suppkey % 10 = 0 then concat(n_name, ' lot n ', cast(n_nationkey as string), '-1 ', r_name) else '' end
                   as excel_scope_id,
               concat('plan cabinet ', n_name) as scope_hint
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "b_aliases": """
        select distinct concat('inconnu ', p_name) as article, 1 as alias_rank, p_name as material from {part} where length(p_name) % 2 = 0
        union all
        select distinct concat('inconnu ', p_name), 0, concat(p_name, ' absent') from {part} where length(p_name) % 2 = 0""",
    "b_components": """
        select distinct p_name as article, 0 as item_rank, concat(p_name, ' socle') as item_article, '' as item_categorie,
               cast(length(p_name) % 3 as bigint) as quantity from {part} where p_name like '%bolt%'
        union all
        select distinct p_name, 1, p_name, 'Courant faible', cast(2 as bigint) from {part} where p_name like '%bolt%'""",
    "b_manual": """
        select o_custkey % 100 as job_id, o_orderkey as seq, cast(o_orderkey as string) as id, '' as mapping_key,
               case when o_orderkey % 3 = 0 then '' else concat('Salle ', cast(o_orderkey % 9 as string)) end as room,
               case when o_orderkey % 11 = 0 then ' ' else o_orderpriority end as material, o_orderstatus as category, '' as label,
               case o_orderkey % 4 when 0 then '0' when 1 then '2,7' when 2 then 'x' else '3' end as quantity_after,
               concat('Salle ', cast(o_orderkey % 9 as string)) as target_room_id, '' as target_material,
               o_orderkey % 5 = 0 as is_addition
        from {orders}""",
    # sheets of a workbook: merged cells are filled on every fifth row only
    "b_cells": """
        select c_nationkey as job_id, 0 as sheet_idx, c_mktsegment as sheet, o_orderkey + 6 as row_idx,
               case when o_orderkey % 5 = 0 then c_name end as occ,
               case when o_orderkey % 5 = 0 then concat('Pièce ', cast(o_custkey % 9 as string)) end as pce,
               case when o_orderkey % 5 = 0 then cast(o_custkey % 30 as string) end as num,
               o_orderstatus as cat, case when o_orderkey % 17 = 0 then null else concat('A', cast(o_orderkey % 50 as string)) end as code,
               case o_orderkey % 7 when 0 then null when 1 then '(vide)' when 2 then concat(' ', o_orderpriority, ' ') else o_orderpriority end as mat,
               case o_orderkey % 4 when 0 then '1,5' when 1 then '2.9' when 2 then '-3' else cast(o_orderkey % 10 as string) end as qty
        from {orders} join {customer} on o_custkey = c_custkey""",
    "b_sheets": """
        select distinct c_nationkey as job_id, c_mktsegment as sheet from {customer}""",
    # text spans of plan pages
    "b_spans": """
        select user_id % 40 as job_id, cast(user_id % 7 + 1 as int) as page, event_id as seq,
               case when event_id % 3 = 0 then concat(cast(event_id % 90 as string), ',5 m²')
                    when event_id % 97 = 1 then concat('PLAN D''', case user_id % 3 when 0 then 'ÉLECTRICITÉ' when 1 then 'Aménagement' else 'Luminaire' end)
                    when event_id % 89 = 2 then concat('Circulation ', event_type, ' - R', cast(event_id % 4 as string))
                    when event_id % 31 = 4 then 'Sol souple'
                    when event_id % 29 = 5 then cast(event_id % 9 as string)
                    else concat(event_type, ' ', cast(event_id % 17 as string)) end as text,
               case when event_id % 97 = 1 then 18.0e0 when event_id % 89 = 2 then 15.0e0 else cast(10 + event_id % 2 as double) end as size,
               cast(event_id * 37 % 211 as double) as x, cast(event_id * 53 % 307 as double) as y
        from {events}""",
    "b_rooms": """
        select user_id % 40 as job_id, cast(user_id % 7 + 1 as int) as page, event_id as idx,
               concat('Pièce ', cast(event_id % 61 as string)) as name, cast(event_id * 91 % 977 as double) as x,
               cast(event_id * 67 % 701 as double) as y
        from {events}""",
    "b_points": """
        select user_id % 40 as job_id, cast(user_id % 7 + 1 as int) as page, event_id as seq, event_type as name,
               cast(event_id * 43 % 983 as double) as x, cast(event_id * 59 % 709 as double) as y
        from {events}""",
    # one box per label, cut to a triangle for every third
    "b_zones": """
        select s_suppkey % 40 as job_id, cast(s_suppkey % 7 + 1 as int) as page, concat('z', cast(s_suppkey as string)) as id,
               concat('Pièce ', cast(s_suppkey % 61 as string)) as name_original,
               concat('Zone ', cast(s_suppkey % 13 as string)) as name,
               cast(s_suppkey * 131 % 900 as double) as x, cast(s_suppkey * 77 % 600 as double) as y,
               cast(90 + s_suppkey % 7 * 30 as double) as w, cast(70 + s_suppkey % 5 * 40 as double) as h,
               s_suppkey % 4 <> 3 as locked, s_suppkey % 3 = 0 as triangle, s_suppkey as sk
        from {supplier}""",
    "b_grid": """
        select cast(floor(p_partkey / 1600) as bigint) as job_id, 1 as page, p_partkey % 40 as x,
               cast(floor(p_partkey / 40) as bigint) % 40 as y, p_size, p_partkey
        from {part}""",
    "b_doc_lines": """
        select o_custkey % 50 as job_id, o_orderkey as seq, case when o_orderkey % 13 = 0 then '' else concat('L', cast(o_orderkey as string)) end as id,
               '' as mapping_key, case when o_orderkey % 9 = 0 then 'Manual' else 'pdf' end as origin,
               concat('Salle ', cast(o_orderkey % 7 + 1 as string)) as room, o_orderpriority as lot, o_orderstatus as sous_lot,
               case when o_orderkey % 19 = 0 then '' else concat('art ', cast(o_orderkey % 23 as string)) end as material,
               o_orderstatus as category, case when o_orderkey % 4 = 0 then concat('Salle ', cast(o_orderkey % 7 + 1 as string)) end as comparison_room,
               case when o_orderkey % 6 = 0 then concat('art ', cast(o_orderkey % 23 as string)) else '' end as comparison_material,
               o_orderkey % 10 = 0 as is_addition, case when o_orderkey % 8 = 0 then null else cast(o_orderkey % 12 as string) end as quantity_before,
               cast(o_orderkey % 15 as string) as market_quantity,
               case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then '2,5' else cast(o_orderkey % 6 as string) end as quantity_after,
               case when o_orderkey % 10 = 0 then '' else concat(cast(o_orderkey % 3 as string), ',50') end as additional_quantity,
               case when o_orderkey % 16 = 0 then 'n.c.' else replace(cast(cast(o_totalprice as decimal(18,2)) as string), '.', ',') end as unit_price
        from {orders}""",
    "b_analyses": """
        select c_custkey as job_id, case when c_custkey % 7 = 0 then '' else c_mktsegment end as owner_sub,
               concat('2026-01-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0')) as created_at,
               concat('2026-02-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0')) as modified_at, '' as updated_at,
               case when c_custkey % 5 = 0 then '' else c_name end as excel_name, '' as pdf_name, '' as job_status,
               concat('out/', c_name, '.xlsx') as output, case when c_custkey % 3 = 0 then concat('out/', c_name, '.docx') else '' end as word_output,
               c_nationkey as symboles_detectes, c_custkey % 9 as lignes
        from {customer}""",
    "b_versions": """
        select o_custkey as job_id, o_orderkey as version, o_orderpriority as key, o_orderstatus as value, o_orderkey % 3 <> 0 as present,
               case when o_orderkey % 4 = 0 then '' else o_orderstatus end as owner_sub
        from {orders}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, VIEWS[name])


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: spark_view(spark, sf_dir, n) for n in names})


def duckdb_sql(text: str, extra: dict[str, str]) -> str:
    """The query with every view it uses, directly or not, as a CTE."""
    views, order = {**VIEWS, **extra}, []

    def visit(body: str) -> None:
        for name in re.findall(r"\{(\w+)\}", body):
            if name in views and name not in order:
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(text)
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", views[n]) for n in order}
    body = re.sub(r"\{(\w+)\}", r"\1", text)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({plain[n]})" for n in order)
    own = re.match(r"\s*with\s+(recursive\s+)?", body)
    recursive = "recursive " if own and own[1] else ""
    return f"with {recursive}{ctes},\n{body[own.end():]}" if own else f"with {ctes}\n{body}"
