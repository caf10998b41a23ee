"""Queries over sheets, listings, lots and rooms."""

from pyspark.sql import functions as F

from ..operators import options, reconcile
from ..operators.document import option_search as search_options
from ..operators.document import scope_choices as list_scope_choices
from ..operators.overlay import safe_rooms
from ..operators.search import OptionIndex
from ..session import cut_lineage, shared_folder
from ..sources import sheets
from ..sources.job_store import JobStore
from .registry import broken, norm, query, room, scope, scope_label


def _sheet_rows(d):
    """Workbook rows of every customer segment: title, header in row 5, cells from row 6."""
    data = d.b_cells.select("job_id", "sheet_idx", "sheet", "row_idx", F.array(
        "num", "occ", "pce", "cat", "code", "mat", "qty", F.when((F.col("sheet") == "FURNITURE") & (F.col("row_idx") % 10 == 6), "R+1")).alias("cells"))
    names = F.array(*map(F.lit, ["N° LOT", "Occupation", "Nom de la pièce", "Catégorie", "Code article", "Matériel", "Quantité", "Niveau"]))
    header = F.when(F.col("sheet") == "HOUSEHOLD", F.array(F.lit("rien"))).when(
        F.col("sheet") == "MACHINERY", F.slice(names, 1, 6)).when(F.col("sheet") == "FURNITURE", names).otherwise(F.slice(names, 1, 7))
    heads = d.b_sheets.select("job_id", F.lit(0).alias("sheet_idx"), "sheet", F.lit(5).cast("bigint").alias("row_idx"), header.alias("cells"))
    titles = d.b_sheets.select("job_id", F.lit(0).alias("sheet_idx"), "sheet", F.lit(0).cast("bigint").alias("row_idx"), F.array("sheet").alias("cells"))
    notes = d.b_sheets.select("job_id", F.lit(1).alias("sheet_idx"), F.lit("Mode d'emploi").alias("sheet"), F.lit(0).cast("bigint").alias("row_idx"),
                              F.array(F.lit("Occupation")).alias("cells"))
    return data.unionByName(heads).unionByName(titles).unionByName(notes)


_RAW = """r as (select *, case when sheet = 'FURNITURE' and row_idx % 10 = 6 then 'R+1' end as niv from {b_cells} where sheet not in ('HOUSEHOLD', 'MACHINERY')),
  f as (select job_id, sheet, row_idx, cat, code, mat, qty,
        last_value(occ ignore nulls) over w as occupation, last_value(pce ignore nulls) over w as piece, last_value(num ignore nulls) over w as numero,
        last_value(niv ignore nulls) over w as niv, max(niv) over (partition by job_id, sheet) is not null as has_level
        from r window w as (partition by job_id, sheet order by row_idx rows between unbounded preceding and current row))"""
_CLEAN = _RAW + f""", c as (select job_id, sheet, row_idx, coalesce(niv, sheet) as niveau, coalesce(trim(occupation), '') as occupation,
        coalesce(trim(piece), '') as piece, coalesce(trim(numero), '') as numero, coalesce(trim(cat), '') as categorie, coalesce(trim(code), '') as code_article,
        case when trim(mat) like '(%)' then '' else trim(mat) end as materiel,
        case when trim(mat) like '(%)' then 0 else cast(trunc(coalesce(try_cast(qty as double), 0)) as bigint) end as quantite
        from f where mat is not null)"""


@query("header_detect", """select distinct job_id, sheet, case when sheet <> 'HOUSEHOLD' then 5::bigint end as header_row,
       case when sheet = 'HOUSEHOLD' then null else 2 end as pos_occupation, case when sheet in ('HOUSEHOLD', 'MACHINERY') then null else 7 end as pos_quantite,
       case when sheet = 'FURNITURE' then 8 end as pos_niveau from {b_sheets}""")
def header_detect(d):
    return sheets.sheet_headers(_sheet_rows(d)).select("job_id", "sheet", "header_row", "pos_occupation", "pos_quantite", "pos_niveau")


@query("sheet_quality", """select distinct job_id, sheet, case when sheet = 'MACHINERY' then 5::bigint end as header_row, case when sheet = 'MACHINERY'
       then 'colonnes obligatoires absentes : quantite' else 'aucune ligne d''en-tete contenant ''Occupation''' end as error
       from {b_sheets} where sheet in ('HOUSEHOLD', 'MACHINERY')""")
def sheet_quality(d):
    return sheets.sheet_errors(_sheet_rows(d))


@query("ffill_merged", f"with {_RAW} select job_id, sheet, row_idx, occupation, piece, numero from f")
def ffill_merged(d):
    rows = _sheet_rows(d)
    return sheets.fill_merged_cells(sheets.raw_listing(rows, sheets.sheet_headers(rows))).select(
        "job_id", "sheet", "row_idx", "occupation", "piece", "numero")


@query("listing_clean", f"""with {_CLEAN} select job_id, sheet, row_idx, niveau, occupation, piece, numero, categorie, code_article, materiel, quantite,
       {room()} as room_id, {scope()} as scope_id from c""")
def listing_clean(d):
    return sheets.read_listing(_sheet_rows(d)).select(
        "job_id", "sheet", "row_idx", "niveau", "occupation", "piece", "numero", "categorie", "code_article", "materiel", "quantite", "room_id", "scope_id")


@query("listing_placeholders", f"with {_CLEAN} select job_id, sheet, piece, count(*) as n, cast(sum(quantite) as bigint) as quantite from c where materiel = '' group by 1, 2, 3")
def listing_placeholders(d):
    return sheets.read_listing(_sheet_rows(d)).where("materiel = ''").groupBy("job_id", "sheet", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantite").alias("quantite"))


_CORR = """select c_nationkey as job_id, o_orderkey as row_idx, case when o_orderkey % 9 = 0 then '' else concat(' Plan ', cast(o_custkey % 40 as string)) end as l,
           case when o_orderkey % 8 = 0 then null else o_orderpriority end as r from {orders} join {customer} on o_custkey = c_custkey"""


@query("correspondences", f"""select job_id, kind, trim(l) as source, arg_max(trim(r), row_idx) as target from ({_CORR}) cross join (values ('room'), ('material')) k(kind)
       where l <> '' and r <> '' and row_idx > 0 group by 1, 2, 3""")
def correspondences(d):
    data = d.sql(_CORR)
    parts = []
    for sheet, left, right in (("Correspondance pièces", "Pièce plan (PDF)", "Pièce existante (Excel)"),
                               ("Correspondance articles", "Article plan (PDF)", "Matériel existant (Excel)")):
        jobs = d.customer.select(F.col("c_nationkey").alias("job_id")).distinct()
        parts.append(jobs.select("job_id", F.lit(2).alias("sheet_idx"), F.lit(sheet).alias("sheet"), F.lit(0).cast("bigint").alias("row_idx"),
                                 F.array(F.lit("n"), F.lit(left), F.lit(right)).alias("cells")))
        parts.append(data.where("row_idx > 0").select("job_id", F.lit(2).alias("sheet_idx"), F.lit(sheet).alias("sheet"), "row_idx",
                                                      F.array(F.lit("x"), "l", "r").alias("cells")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return sheets.read_correspondences(rows)


# -- lots and rooms ------------------------------------------------------------------

def _listing(d):
    from ..functions.identity import with_room_identity
    return with_room_identity(d.b_listing)


def _valid(m="materiel"):
    return f"(trim({m}) <> '' and not {broken(m)})"


@query("scope_options", f"""with s as (select job_id, scope_id, niveau, occupation, numero, list(distinct piece) as ps, list(distinct materiel) filter ({_valid()}) as ms
       from {{b_lst}} group by all) select job_id, scope_id, {scope_label()} as scope_label, cast(len(ps) as int) as piece_count,
       array_to_string(list_sort(ps), ';') as pieces, array_to_string(list_sort(ms), ';') as materiels from s""")
def scope_options(d):
    return options.scope_options(_listing(d)).select("job_id", "scope_id", "scope_label", "piece_count", F.array_join("pieces", ";").alias("pieces"),
                                                     F.array_join("materiels", ";").alias("materiels"))


@query("room_options", f"""with i as (select job_id, room_id, room_label, materiel, categorie, sum(quantite) as q from {{b_lst}} where {_valid()} group by all),
       g as (select job_id, room_id, room_label, string_agg(concat(materiel, '/', categorie, '=', q), ';' order by {norm('materiel')}, {norm('categorie')}) as materials,
       count(distinct materiel) as n from i group by all)
       select distinct l.job_id, l.room_id, l.room_label, coalesce(g.materials, '') as materials, coalesce(cast(n as int), 0) as n from {{b_lst}} l left join g using (job_id, room_id)""")
def room_options(d):
    return options.room_options(_listing(d)).select("job_id", "room_id", "room_label", F.array_join(F.transform(
        "materials", lambda e: F.concat(e["name"], F.lit("/"), e["category"], F.lit("="), e["quantity"].cast("string"))), ";").alias("materials"),
        F.size("materiels").alias("n"))


@query("category_mode", """with c as (select job_id, room_id, materiel, categorie, count(*) as n from {b_lst} where materiel <> '' group by all),
       r as (select job_id, room_id, materiel, categorie as room_category, row_number() over (partition by job_id, room_id, materiel order by n desc, categorie) as k from c),
       m as (select job_id, materiel, categorie as material_category, row_number() over (partition by job_id, materiel order by sum(n) desc, categorie) as k from c group by job_id, materiel, categorie)
       select r.job_id, room_id, r.materiel, room_category, material_category from r join m on r.job_id = m.job_id and r.materiel = m.materiel and m.k = 1 where r.k = 1""")
def category_mode(d):
    by_room, by_material = reconcile.category_modes(_listing(d))
    return by_room.join(by_material, ["job_id", "materiel"])


@query("level_inspect", """select job_id, niveau, count(distinct piece) as pieces, count(*) as lignes, cast(sum(quantite) as bigint) as quantite,
       count(distinct scope_id) as n_scopes from {b_lst} group by 1, 2""")
def level_inspect(d):
    return options.level_summary(_listing(d))


_LEVEL = """lv as (select l.* from {b_lst} l join {b_params} p using (job_id) where case when p.niveau_excel <> '' then lower(l.niveau) = p.niveau_excel
        when exists (select 1 from {b_lst} x where x.job_id = l.job_id and contains(lower(x.niveau), lower(p.niveau_hint))) then contains(lower(l.niveau), lower(p.niveau_hint))
        else true end)"""


@query("level_filter", f"with {_LEVEL} select job_id, niveau, count(*) as n from lv group by 1, 2")
def level_filter(d):
    return options.filter_level(_listing(d), d.b_params).groupBy("job_id", "niveau").agg(F.count(F.lit(1)).alias("n"))


_ASKED = """select s_suppkey as job_id, case s_suppkey % 3 when 0 then 'sous-sol' when 1 then upper(r_name) else '' end as niveau_excel
             from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"""


@query("level_errors", f"""select job_id, niveau_excel from ({_ASKED}) where niveau_excel <> '' and (job_id, lower(niveau_excel)) not in (select (job_id, lower(niveau)) from {{b_lst}})""")
def level_errors(d):
    return options.level_errors(_listing(d), d.sql(_ASKED))


@query("level_hint", """select l.job_id, l.niveau, contains(lower(l.niveau), 'a') as hinted, count(*) as n from {b_lst} l
       where not exists (select 1 from {b_lst} x where x.job_id = l.job_id and contains(lower(x.niveau), 'a')) or contains(lower(l.niveau), 'a') group by 1, 2, 3""")
def level_hint(d):
    hints = d.b_params.select("job_id", F.lit("").alias("niveau_excel"), F.lit("A").alias("niveau_hint"))
    return options.filter_level(_listing(d), hints).groupBy("job_id", "niveau", F.contains(F.lower("niveau"), F.lit("a")).alias("hinted")).agg(
        F.count(F.lit(1)).alias("n"))


# plan files name the occupant, two-lot sites share it: only explicit choices and single lots are certain
_CHOSEN = f"""n as (select job_id, count(*) as n_scopes, min(scope_id) as only_one from {{b_sc}} group by 1),
       ask as (select p.job_id, min(s.scope_id) as picked from {{b_params}} p join {{b_sc}} s on s.job_id = p.job_id and {norm('s.scope_label')} = {norm('p.excel_scope_id')}
               where p.excel_scope_id <> '' group by 1 having count(*) = 1),
       ch as (select n.job_id, n_scopes, case when p.excel_scope_id <> '' then ask.picked when n_scopes = 1 then only_one end as scope_id,
              case when ask.picked is not null then 'sélection utilisateur' when p.excel_scope_id = '' and n_scopes = 1 then 'seul pôle du niveau' end as method
              from n join {{b_params}} p using (job_id) left join ask using (job_id))"""


def _chosen(d):
    ids = cut_lineage(options.identities(_listing(d)))
    return options.choose_scope(options.scopes(ids), options.rooms(ids), d.b_params, d.sql("select 0L as job_id, 'x' as target from {region}"))


@query("scope_filter", f"with {_CHOSEN} select l.job_id, l.scope_id, method, count(*) as n from {{b_lst}} l join ch using (job_id, scope_id) group by 1, 2, 3")
def scope_filter(d):
    chosen = cut_lineage(_chosen(d).where("scope_id is not null"))
    return options.filter_scope(_listing(d), chosen).groupBy("job_id", "scope_id").agg(F.count(F.lit(1)).alias("n")).join(
        chosen.select("job_id", "method"), "job_id")


@query("scope_fail_closed", f"""with {_CHOSEN} select ch.job_id, n_scopes, ch.scope_id, method, (select count(*) from {{b_lst}} l where l.job_id = ch.job_id and
       case when ch.scope_id is not null then l.scope_id = ch.scope_id else n_scopes <= 1 end) as kept from ch""")
def scope_fail_closed(d):
    chosen = cut_lineage(_chosen(d))
    kept = options.filter_scope(_listing(d), chosen).groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))
    return chosen.join(kept, "job_id", "left").select("job_id", "n_scopes", "scope_id", "method", F.coalesce("kept", F.lit(0)).alias("kept"))


_TARGETS = """select job_id, case ok % 4 when 0 then piece when 1 then concat('  ', upper(piece), '-') when 2 then concat(occupation, ' ', piece, ' N ', numero, ' ', niveau)
              else 'nulle part' end as target, niveau, occupation, piece, numero, ok % 9 as v from {b_src}"""


@query("resolve_room", f"""with t as (select distinct job_id, case when v = 3 then {room()} else trim(target) end as target from ({_TARGETS})),
       u as (select job_id, label_norm as k, min(room_id) as r from {{b_ident}} group by 1, 2 having count(*) = 1),
       p as (select job_id, piece_norm as k, min(room_id) as r from {{b_ident}} group by 1, 2 having count(*) = 1),
       i as (select distinct job_id, room_id as k from {{b_ident}})
       select t.job_id, t.target, coalesce(i.k, u.r, p.r) as room_id from t left join i on i.job_id = t.job_id and i.k = t.target
       left join u on u.job_id = t.job_id and u.k = {norm('t.target')} left join p on p.job_id = t.job_id and p.k = {norm('t.target')}
       where coalesce(i.k, u.r, p.r) is not null""")
def resolve_room(d):
    from ..functions.identity import room_id
    targets = d.sql(_TARGETS).select("job_id", F.when(F.col("v") == 3, room_id("niveau", "occupation", "piece", "numero")).otherwise(F.col("target")).alias("target"))
    return options.resolve_rooms(targets, options.rooms(options.identities(_listing(d))))


_STARGETS = """select job_id, case ok % 3 when 0 then occupation when 1 then concat(occupation, ' lot n ', numero, ' ', niveau) else 'nulle part' end as target from {b_src}"""


@query("resolve_scope", f"""with t as (select distinct job_id, target from ({_STARGETS})),
       u as (select job_id, {norm('scope_label')} as k, min(scope_id) as r from {{b_sc}} group by 1, 2 having count(*) = 1),
       p as (select job_id, {norm('occupation')} as k, min(scope_id) as r from {{b_sc}} group by 1, 2 having count(*) = 1)
       select t.job_id, t.target, coalesce(u.r, p.r) as scope_id from t
       left join u on u.job_id = t.job_id and u.k = {norm('t.target')} left join p on p.job_id = t.job_id and p.k = {norm('t.target')} where coalesce(u.r, p.r) is not null""")
def resolve_scope(d):
    return options.resolve_scopes(d.sql(_STARGETS), options.scopes(options.identities(_listing(d))))


# lots of a region: one job per region, one lot per nation; hints name words of the occupant
_SC = """select r_regionkey as job_id, n_nationkey as nk, n_name, r_name, s_suppkey from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"""


@query("infer_scope", f"""with o as (select s_suppkey % 50 as job_id, {scope("'N'", "concat(o, ' lot')", 'nk')} as scope_id, o from (select s_suppkey, cast(nk as varchar) as nk,
         case when s_suppkey % 50 % 2 = 0 then concat('Angio ', lower(n_name)) else concat('vasculaire ', case when s_suppkey % 3 = 0 then 'nord' else 'sud' end) end as o from ({_SC}))),
       sc as (select distinct job_id, scope_id, o from o), n as (select job_id, count(distinct scope_id) as n, min(scope_id) as only_one from sc group by 1),
       w as (select distinct job_id, scope_id, unnest(string_split({norm("concat(o, ' lot')")}, ' ')) as w from sc),
       ws as (select job_id, scope_id, w, count(*) over (partition by job_id, scope_id) as size from w where length(w) >= 4),
       h as (select job_id, scope_id, count(*) as shared, round_even(1000.0 * count(*) / any_value(size), 0) as share from ws where w in ('vasculaire', 'nord', 'angio') group by 1, 2),
       b as (select *, rank() over (partition by job_id order by shared desc, share desc) as k from h),
       u as (select job_id, min(scope_id) as s from b where k = 1 group by 1 having count(*) = 1)
       select n.job_id, case when n.n = 1 then only_one else u.s end as scope_id, case when n.n = 1 then 'seul pôle du niveau' else 'nom du PDF' end as method
       from n left join u using (job_id) where n.n = 1 or u.s is not null""")
def infer_scope(d):
    base = d.sql(_SC).select((F.col("s_suppkey") % 50).alias("job_id"), F.lit("N").alias("niveau"), F.col("nk").cast("string").alias("numero"), F.lit("Salle").alias("piece"),
                             F.concat(F.when(F.col("s_suppkey") % 50 % 2 == 0, F.concat(F.lit("Angio "), F.lower("n_name"))).otherwise(F.concat(
                                 F.lit("vasculaire "), F.when(F.col("s_suppkey") % 3 == 0, "nord").otherwise("sud"))), F.lit(" lot")).alias("occupation"),
                             F.lit(0).alias("sheet_idx"), F.col("s_suppkey").alias("row_idx"))
    ids = options.identities(base)
    jobs = base.select("job_id").distinct()
    hints = jobs.select("job_id", F.lit("24-031 Cabinet VASCULAIRE Nord, niveau 2").alias("hint")).union(jobs.select("job_id", F.lit("plan angio 2024")))
    return options.infer_scope(options.scopes(ids), options.rooms(ids), jobs.select("job_id", F.lit("nulle part").alias("target")), hints)


@query("listing_audit", f"""with {_CHOSEN}, sl as (select l.* from {{b_lst}} l join ch using (job_id) where case when ch.scope_id is not null then l.scope_id = ch.scope_id else n_scopes <= 1 end),
       w as (select job_id, count(*) as lignes_materiel, count(distinct piece) as pieces_uniques, count(distinct room_id) as pieces_physiques, count(distinct scope_id) as scopes_physiques,
             cast(sum(quantite) as bigint) as quantite_totale, string_agg(distinct niveau, '|' order by niveau) as niveaux, count(*) filter (code_article <> '') as codes_articles_renseignes from {{b_lst}} group by 1),
       p as (select job_id, count(distinct room_id) as pieces_scope_selectionne, cast(sum(quantite) as bigint) as quantite_scope_selectionne,
             count(*) filter ({broken('materiel')}) as references_formule_invalides, cast(coalesce(sum(quantite) filter ({broken('materiel')}), 0) as bigint) as quantite_references_invalides from sl group by 1),
       g as (select s_suppkey as job_id, count(*) filter (s_suppkey % 2 = 0) as correspondances_pieces, count(*) filter (s_suppkey % 2 = 1) as correspondances_articles from {{supplier}} group by 1)
       select w.*, coalesce(ch.scope_id, '') as scope_selectionne, coalesce(pieces_scope_selectionne, 0) as pieces_scope_selectionne, coalesce(quantite_scope_selectionne, 0) as quantite_scope_selectionne,
       coalesce(references_formule_invalides, 0) as references_formule_invalides, coalesce(quantite_references_invalides, 0) as quantite_references_invalides,
       correspondances_pieces, correspondances_articles from w join ch using (job_id) left join p using (job_id) join g using (job_id)""")
def listing_audit(d):
    listing, chosen = _listing(d), cut_lineage(_chosen(d))
    given = d.sql("select s_suppkey as job_id, case when s_suppkey % 2 = 0 then 'room' else 'material' end as kind from {supplier}")
    return options.listing_audit(listing, options.filter_scope(listing, chosen), chosen, given)


@query("reference_lists", f"""select distinct job_id, 'piece' as kind, piece as value from {{b_lst}} union select distinct job_id, 'materiel', materiel from {{b_lst}} where {_valid()}""")
def reference_lists(d):
    return options.reference_lists(_listing(d))


@query("option_search", f"""with o as (select job_id, room_id as value, min(room_label) as label, min(first_seen) as ord from {{b_ident}} group by 1, 2),
       lead as (select job_id, arg_min(value, ord) as value, arg_min(label, ord) as label from o where {norm('label')} like '%salle 3%' and {norm('label')} = {norm("'nation_3 salle 3 n 3 europe'")} group by 1),
       f as (select job_id, value, label, row_number() over (partition by job_id order by ord, value) as rank from o where contains({norm('label')}, 'salle'))
       select job_id, 0 as rank, value, label from lead union all select job_id, rank, value, label from f where (job_id, value) not in (select (job_id, value) from lead)""")
def option_search(d):
    rows = options.rooms(options.identities(_listing(d))).select("job_id", F.col("first_seen.row_idx").alias("ord"), F.col("room_id").alias("value"), F.col("room_label").alias("label"))
    return search_options(rows, " SALLÉ ", suggested="NATION_3 Salle 3 n 3 Europe")


_SEARCHED = (" SALLÉ ", "n 3", "e", "nation 1 salle")


@query("option_index", f"""with o as (select job_id, room_id as value, arg_min(room_label, first_seen) as label, min(first_seen) as ord from {{b_ident}} group by 1, 2)
       select q, job_id, value, label from o, (values {', '.join(f"('{q}')" for q in _SEARCHED)}) as t(q) where contains({norm('label')}, {norm('q')})""")
def option_index(d):
    rows = options.rooms(options.identities(_listing(d))).select("job_id", F.col("first_seen.row_idx").alias("ord"), F.col("room_id").alias("value"), F.col("room_label").alias("label"))
    index = OptionIndex.build(rows, shared_folder(d.spark, "option-index"))
    found = [index.search(q).select(F.lit(q).alias("q"), "job_id", "value", "label") for q in _SEARCHED]
    return found[0].union(found[1]).union(found[2]).union(found[3])


# stored, then jobs with broken references stored again without them, then those of one level deleted
@query("job_store", """select job_id, row_idx, materiel, quantite from {b_listing} where niveau <> 'ASIA' and materiel <> '#REF!'""")
def job_store(d):
    listing = d.b_listing.select("job_id", "niveau", "row_idx", "materiel", "quantite")
    store = JobStore(d.spark, shared_folder(d.spark, "job-store"))
    store.write(listing, ("row_idx",))
    broken_jobs = listing.where("materiel = '#REF!'").select("job_id").distinct()
    store.write(listing.join(broken_jobs, "job_id", "left_semi").where("materiel <> '#REF!'"), ("row_idx",), replaced=broken_jobs)
    store.delete(listing.where("niveau = 'ASIA'").select("job_id"))
    return store.read().select("job_id", "row_idx", "materiel", "quantite")


@query("scope_choices", f"""with r as (select job_id, scope_id, count(distinct room_id) as n_rooms from {{b_ident}} group by 1, 2),
       o as (select job_id, scope_id, count(distinct materiel) as own from {{b_lst}} where {_valid()} and niveau < 'B' group by 1, 2),
       c as (select job_id, scope_id, count(distinct materiel) as cmp from {{b_lst}} where materiel <> '' and categorie = 'ECONOMY' group by 1, 2)
       select s.job_id, s.scope_id, n_rooms, coalesce(own, cmp, 0) as n_materials, case when own is not null then 'catalogue' else 'comparatif' end as source
       from {{b_sc}} s join r using (job_id, scope_id) left join o using (job_id, scope_id) left join c using (job_id, scope_id)""")
def scope_choices(d):
    listing = _listing(d)
    ids = options.identities(listing)
    return list_scope_choices(options.scopes(ids), options.rooms(ids), listing.where("niveau < 'B'"), listing.where("categorie = 'ECONOMY'"))


_SAVED = """select s_suppkey as job_id, case when s_suppkey % 4 = 0 then n_name else '' end as audit, case when s_suppkey % 4 = 1 then 'inconnu' else '' end as selected,
            case when s_suppkey % 3 = 0 then n_name else '' end as corrections, n_name as document, n_name from {supplier} join {nation} on s_nationkey = n_nationkey"""


_KNOWN = "select s_suppkey as job_id, concat('excel-scope-', cast(s_suppkey as string)) as scope_id from {supplier}"
_OFFERED = """select o_custkey % 100 as job_id, o_orderkey as room_id, case o_orderkey % 3 when 0 then '' when 1 then concat('excel-scope-', cast(o_custkey % 100 as string)) else 'ancien' end as scope_id from {orders}"""


@query("refresh_rooms", f"select * from ({_OFFERED}) where scope_id <> '' and (job_id, scope_id) in (select (job_id, scope_id) from ({_KNOWN}))")
def refresh_rooms(d):
    return safe_rooms(d.sql(_OFFERED), d.sql(_KNOWN))


@query("refresh_scope", f"""with a as (select job_id, coalesce(nullif(audit, ''), nullif(selected, ''), nullif(corrections, ''), document) as target from ({_SAVED})),
       u as (select job_id, {norm('occupation')} as k, min(scope_id) as r from {{b_sc}} group by 1, 2 having count(*) = 1),
       n as (select job_id, case when count(*) = 1 then min(scope_id) end as one from {{b_sc}} group by 1)
       select a.job_id, coalesce(u.r, n.one, '') as scope_id from a left join u on u.job_id = a.job_id and u.k = {norm('a.target')} left join n on n.job_id = a.job_id""")
def refresh_scope(d):
    from ..operators.overlay import refreshed_scope
    ids = options.identities(_listing(d))
    saved = d.sql(_SAVED)
    return refreshed_scope(saved, options.scopes(ids), options.rooms(ids), saved.select("job_id", F.lit("nulle part").alias("target")),
                           saved.select("job_id", F.lit("plan 2024").alias("hint")))
