"""Rows dealt by job once: wide rows cross a step's joins and groups where they are, and large jobs get the same answers without it."""

import pytest
from pyspark.sql import functions as F

from frames import compare, listing, symbols
from sitetally import session
from sitetally.operators import reconcile
from sitetally.plans import comparison
from sitetally.session import by_job, jobs_fit, semi_join

MAPPED = ("job_id long, room_id string, categorie string, materiel string, label string, source_room string, source_material string, origin string, "
          "mapping_key string, mapping_method string, page int, quantity long, seq long, is_addition boolean, room_is_listed boolean, explicit_material string")
LISTED = "job_id long, room_id string, categorie string, materiel string, quantite long"


def _sides(spark, fit):
    mapped = spark.createDataFrame([(j, f"r{i % 3}", None if i == 4 else "c", f"m{i}", "l", "s", "a", "pdf", f"k{i}", "exact", 1, 2, i, False, True,
                                     "m1" if i == 1 else None) for j in (1, 2, None) for i in range(6)], MAPPED)
    rows = spark.createDataFrame([(j, f"r{i % 4}", None if i == 4 else "c", f"m{i}", 1) for j in (1, 2, None) for i in range(8)], LISTED)
    before = reconcile.before_groups(reconcile.before_rows(rows, mapped, fit))
    known = mapped.where("explicit_material is not null").select("job_id", F.col("explicit_material").alias("materiel")).distinct()
    return before, reconcile.after_groups(by_job(mapped, fit)), known


def test_lines_cross_their_joins_without_being_dealt_again(spark):
    names = {session.ALL_KEYS: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        lines = reconcile.reconcile(*_sides(spark, True))
        described = lines.join(spark.createDataFrame([(1, "r0", "n")], "job_id long, room_id string, niveau string"), ["job_id", "room_id"], "left")
        plan = described._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in dealt if "categorie" in x]
    # listing rows, rooms before and after they are told apart, counted rows, known materials twice, descriptions
    assert len(dealt) <= 7


@pytest.mark.parametrize("fit", [True, False])
def test_a_null_name_equals_nothing(spark, fit):
    """As in a full join: each side keeps its row of a group without a category, and rows without a job."""
    before, after, known = _sides(spark, fit)
    found = reconcile.reconcile(before, after, known)
    plain = before.join(after, reconcile.GROUP, "full")
    assert found.count() == plain.count()
    assert found.where("categorie is null and job_id = 1").count() == 2
    key = lambda r: tuple(map(str, r))
    counted = plain.select(*reconcile.GROUP, *[F.coalesce(c, F.lit(0)) for c in ("quantite_avant", "quantite_apres")])
    assert sorted(map(key, counted.collect())) == sorted(map(key, found.select(*reconcile.GROUP, "quantite_avant", "quantite_apres").collect()))


def test_semi_join_by_job(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (None, "a", 5)], "job_id long, k string, v int")
    keys = spark.createDataFrame([(1, "a"), (None, "a")], "job_id long, k string")
    for fit in (True, False):
        kept = semi_join(rows, keys, ["job_id", "k"], fit)
        assert kept.columns == rows.columns and sorted(r["v"] for r in kept.collect()) == [1, 2]


def test_a_job_fits_by_its_rows_or_quantity(spark, monkeypatch):
    monkeypatch.setattr(session, "JOB_ROWS", 3)
    rows = lambda *n: spark.createDataFrame([(i,) for i, k in enumerate(n) for _ in range(k)], "job_id long")
    assert jobs_fit(rows(3, 3), rows()) and not jobs_fit(rows(1), rows(4))
    assert not jobs_fit(spark.createDataFrame([(1, 4)], "job_id long, quantity long"))


def test_a_comparison_is_the_same_with_large_jobs(spark, monkeypatch):
    def results():
        run = compare(listing(spark, ("A", "Bureau", "1", "Prise", 3), ("A", "Salle", "1", "Lampe", 2)),
                      symbols(spark, ("bureau", "Prise"), ("bureau", "PRISE"), ("Salle", "autre")), room_tiers=("exact",), material_tiers=("exact",))
        refs = spark.createDataFrame([("Prise", "x")], "article string, reference string")
        return run.fit, *[sorted(map(str, t.collect())) for t in (run.table, run.trace(refs))]

    fit, table, trace = results()
    monkeypatch.setattr(comparison, "jobs_fit", lambda *tables: False)
    large = results()
    assert fit and not large[0] and (table, trace) == large[1:] and len(trace) == 3
