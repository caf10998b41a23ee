"""Sheets, prices, corrections and sinks on literal frames."""

from pyspark.sql import functions as F

from frames import rows_of
from sitetally.functions import amounts
from sitetally.operators import document, history, overlay
from sitetally.sources import rules, sheets, sinks

SHEETS = "job_id bigint, sheet_idx int, sheet string, row_idx bigint, cells array<string>"
HEADER = ["N° LOT", "Occupation", "Nom de la pièce", "Catégorie", "Code article", "Matériel", "Quantité"]


def test_listing_is_read_from_merged_cells(spark):
    rows = [
        (1, 0, "R+1", 0, ["R+1"]), (1, 0, "R+1", 5, HEADER),
        (1, 0, "R+1", 6, ["28", "ANGIO", "Salle", "Élec", "c", "Prise", "2.9"]),
        (1, 0, "R+1", 7, [None, None, None, "Élec", None, "Store", "1,5"]),
        (1, 0, "R+1", 8, [None] * 7),
        (1, 0, "R+1", 9, [None, None, "Accueil", "Élec", None, "(vide)", "4"]),
        (1, 1, "Mode d'emploi", 0, ["Occupation"]), (1, 2, "R+2", 0, ["rien"]),
    ]
    df = spark.createDataFrame(rows, SHEETS)
    got = rows_of(sheets.read_listing(df), "row_idx", "niveau", "occupation", "piece", "numero", "materiel", "quantite")
    assert got == [(6, "R+1", "ANGIO", "Salle", "28", "Prise", 2), (7, "R+1", "ANGIO", "Salle", "28", "Store", 0), (9, "R+1", "ANGIO", "Accueil", "28", "", 0)]
    assert rows_of(sheets.sheet_errors(df), "sheet", "error") == [("R+2", "aucune ligne d'en-tete contenant 'Occupation'")]


def test_price_of_a_line_and_its_lot(spark):
    lines = spark.createDataFrame([(1, 1, "CFO", "6", "10"), (1, 2, "CFO", "x", "10"), (1, 3, "", "1 000", "1,005")],
                                  "job_id int, seq int, lot string, quantity_after string, unit_price string")
    priced = lines.select("seq", amounts.format_euro(amounts.line_total("quantity_after", "unit_price")).alias("total"))
    assert rows_of(priced, "seq", "total") == [(1, "60,00 €"), (2, ""), (3, "1 005,00 €")]
    assert rows_of(document.lot_pricing(lines), "lot", "subtotal", "tax", "total") == [
        ("", "1 005,00 €", "100,50 €", "1 105,50 €"), ("CFO", "60,00 €", "6,00 €", "66,00 €")]


def test_ignored_objects_stay_in_the_document_only_if_resubmitted(spark):
    trace = spark.createDataFrame([(1, 1, "Salle", "Prise", "Prise", "Prise", "c", True), (1, 2, "Salle", "Lampe", "Lampe", "Lampe", "c", False)],
                                  "job_id int, seq int, room string, article string, original_article string, materiel_compare string, categorie string, ignored boolean")
    assert rows_of(document.plan_groups(trace), "material") == [("Lampe",)]
    assert rows_of(document.plan_groups(trace, include_ignored=True), "material") == [("Lampe",), ("Prise",)]


def test_owners_are_kept_and_isolated(spark):
    df = spark.createDataFrame([(1, "user-a"), (2, "user-b"), (3, None)], "job_id int, owner_sub string")
    assert rows_of(df.where(history.may_read("user-a")), "job_id") == [(1,)]
    assert rows_of(df.where(history.may_read("local", True)), "job_id") == [(3,)]
    assert df.where(history.may_read(None)).count() == 3
    versions = spark.createDataFrame([(1, 1, "user-a"), (1, 2, "attacker"), (2, 1, ""), (2, 2, "user-b")], "job_id int, version int, owner_sub string")
    assert rows_of(history.preserved_owners(versions), "job_id", "owner_sub") == [(1, "user-a"), (2, "user-b")]


def test_scope_guards(spark):
    requests = spark.createDataFrame([(1, "s1", "s2", "", ""), (2, "", "", "", ""), (3, "s1", "s1", "", ""), (4, "s1", "", "a", "b"), (5, "zz", "", "", "")],
                                     "job_id int, computed string, requested string, corrections_scope string, document_scope string")
    ids = spark.createDataFrame([(j, s) for j in range(1, 6) for s in ("s1", "s2")], "job_id int, scope_id string")
    assert [v for _, v in rows_of(overlay.scope_guards(requests, ids), "job_id", "verdict")] == [
        "409 scope divergent", "409 sans scope calculé", "OK", "409 corrections et document", "422 scope calculé inconnu"]


def test_shipped_rules(spark):
    catalog = rules.shipped_catalog(spark)
    assert catalog.count() == 32
    assert rows_of(rules.article_references(catalog).where("article = 'Vidéophone'"), "reference") == [("12",)]
    cache = rules.merge_cache(spark.createDataFrame([("a", "x"), ("b", None)], "cache_key string, material string"),
                              spark.createDataFrame([("b", "y")], "cache_key string, material string"))
    assert rows_of(cache, "cache_key", "material") == [("a", "x"), ("b", "y")]


def test_sink_writes_one_folder_per_job(spark, tmp_path):
    sinks.write_by_job(spark.range(10).select((F.col("id") % 2).alias("job_id"), "id"), str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("job_id=*")) == ["job_id=0", "job_id=1"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_documents_and_searches_are_whole(spark):
    from sitetally.operators import document

    columns = ("id mapping_key origin room lot sous_lot material category comparison_room comparison_material quantity_before market_quantity "
               "quantity_after additional_quantity unit_price").split()
    schema = "job_id int, seq int, is_addition boolean, " + ", ".join(f"{c} string" for c in columns)
    same = "n" * 600
    rows = [(1, i, False, *[f"{same} {i}" if c in ("room", "material") else "" for c in columns]) for i in range(300)]
    found = document.clean_lines(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 300 and len({r.room for r in found}) == 300
    trace = spark.createDataFrame([(1, i, f"{same} {i}", "art", "art", "art", "cat", False) for i in range(3)],
                                  "job_id int, seq int, room string, article string, original_article string, materiel_compare string, categorie string, ignored boolean")
    assert document.plan_groups(trace).count() == 3
    options = spark.createDataFrame([(1, i, f"v{i}", f"salle {i}") for i in range(100)], "job_id int, ord int, value string, label string")
    ranks = sorted(r["rank"] for r in document.option_search(options, "salle", "v7").collect())
    assert ranks == [0] + [r for r in range(1, 101) if r != 8]


def test_level_is_the_first_text_above_the_header(spark):
    from sitetally.fixed_values import HEADER_MARK
    from sitetally.sources.sheets import sheet_headers

    rows = [(1, 0, "", i, [None]) for i in range(9)] + [(1, 0, "", 9, [None, "R+3"]), (1, 0, "", 10, ["note"]), (1, 0, "", 11, [HEADER_MARK]), (1, 0, "", 12, ["x"])]
    frame = spark.createDataFrame(rows, "job_id int, sheet_idx int, sheet string, row_idx bigint, cells array<string>")
    found = sheet_headers(frame).first()
    assert (found.header_row, found.sheet_level) == (11, "R+3")


def test_a_job_store_touches_the_files_of_a_job_only(spark, tmp_path, monkeypatch):
    from sitetally.sources import job_store

    monkeypatch.setattr(job_store, "FILE_ROWS", 2000)
    store = job_store.JobStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.read_job(1) is None
    jobs = spark.range(20_000).select(F.when(F.col("id") < 9000, 7).otherwise(F.col("id") % 5000).alias("job_id"), "id", F.lit("a").alias("v"))
    store.write(jobs, ("id",))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/data").rglob("*.parquet")}
    assert len(before) == 10 and sorted(r["id"] for r in store.read_job(7).collect()) == [*range(9000), 10007, 15007]
    assert len(store.read_job(4321).inputFiles()) <= 2 and len(store.read_job(7).inputFiles()) < 7
    again = spark.createDataFrame([(7, 1, "b"), (4321, 2, "b")], "job_id int, id long, v string")
    store.write(again.select(F.col("job_id"), "id", "v"), replaced=spark.createDataFrame([(7,), (12,)], "job_id int"))
    store.delete(spark.createDataFrame([(13,)], "job_id int"))
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert rows_of(store.read_job(7), "id", "v") == [(1, "b")] and rows_of(store.read_job(4321), "id", "v") == [(2, "b")]
    assert store.read_job(12).count() == store.read_job(13).count() == store.read_job(99_999).count() == 0
    want = sorted([(r["job_id"], r["id"], "a") for r in jobs.collect() if r["job_id"] not in (7, 12, 13, 4321)] + [(7, 1, "b"), (4321, 2, "b")])
    assert rows_of(store.read(), "job_id", "id", "v") == want
    fresh = store.compact()
    assert rows_of(fresh.read(), "job_id", "id", "v") == want and rows_of(fresh.read_job(7), "v") == [("b",)]


def test_posting_lists_find_what_a_scan_finds(spark, tmp_path):
    from sitetally.functions.text import norm_token
    from sitetally.operators.search import OptionIndex

    labels = ["Salle 1", "SALLÉ 12", "salle à manger", "Grande  salle", "lassé", "s a l l e", "", None, "ab", "a", "aaaa", "12-3"]
    rows = [(j, i, "" if i == 4 and j == 1 else f"v{i}", label) for j in (1, 2) for i, label in enumerate(labels)] + [(1, 99, "v0", "later label of v0")]
    options = spark.createDataFrame(rows, "job_id int, ord int, value string, label string")
    index = OptionIndex.build(options, str(tmp_path / "index"))
    plain = {(r.job_id, r.value): r.plain for r in index.options().select("job_id", "value", norm_token("label").alias("plain")).collect()}
    assert len(plain) == 23
    for query in ("salle", " SALLÉ ", "a", "ll", "12", "2 3", "salle 1", "aaa", "zzz", "", "é", "salle salle"):
        wanted = spark.range(1).select(norm_token(F.lit(query.strip())).alias("q")).first()["q"]
        assert rows_of(index.search(query), "job_id", "value") == sorted(k for k, v in plain.items() if wanted == "" or wanted in (v or ""))


def test_lines_that_ask_the_same_meet_the_comparison_once(spark):
    """Before-quantities of repeated, blank and null lines; the comparison's rows meet a question, not a line."""
    lines = [(1, n, "r", "Bolt", "cat b") for n in range(40)] + [(1, 40, "r", "bolt", "none"), (1, 41, "", "Bolt", "cat b"), (1, 42, None, "Bolt", "cat b"),
                                                               (1, 43, "r", None, "x"), (2, 1, "r", "Bolt", "cat b"), (1, 44, "s", "Nut", "cat a")]
    lines += [(1, 44, "s", "Nut", "cat b"), (1, 45, "s", "Nut", None)]  # a line given twice, and one without a category
    stock = [(1, "r", "bolt", "cat a", 2), (1, "r", "Bolt", "cat b", 3), (1, "r", "Bolt", "cat b", 4)]
    compared = [(1, "s", "N", "O", "S", c, "nut", q) for c, q in (("cat a", 5), ("cat b", 6), ("cat c", 7))] + [(1, "r", "N", "O", "R", "cat b", "bolt", 9)]
    got = document.quantity_before(spark.createDataFrame(lines, "job_id bigint, line bigint, room_id string, material string, category string"),
                                   spark.createDataFrame(stock, "job_id bigint, room_id string, materiel string, categorie string, quantite bigint"),
                                   spark.createDataFrame(compared, "job_id bigint, room_id string, niveau string, occupation string, piece string, categorie string, materiel string, quantite_avant bigint"))
    want = [(1, n, 7) for n in range(40)] + [(1, 40, 9), (1, 41, 0), (1, 42, 0), (1, 43, 0), (1, 44, 5), (1, 44, 5), (1, 45, 5), (2, 1, 0)]
    assert rows_of(got, "job_id", "line", "quantity_before") == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_same" in plan and "_by" in plan  # sums and best rows per question, before lines come in
