"""Normalisers and similarity against plain Python, generated cases."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitetally.functions import text
from sitetally.functions.similarity import similar_pairs
from sitetally.operators.matching import rooms_by_containment
from sitetally.operators.ordered import RANGE, carry_forward, in_ranges, rank_by_range, running_count

LATIN = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=30)


def token(value):
    bare = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^a-z0-9]+", " ", bare.lower()).strip()


@settings(max_examples=3, deadline=None)
@given(st.lists(LATIN, min_size=50, max_size=200))
def test_norm_token(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.norm_token("v").alias("n")).collect()
    assert all(r.n == token(r.v) for r in rows)


def test_plain_text_skips_the_accents_and_folds_alike(spark):
    """Only text with a longer character looks for accents; nulls, numbers and mixed columns give the same keys as before."""
    rows = [("SALLE-2  nord",), ("Sall\u00e9 3",), ("Salle\u0301 3",), ("",), (None,), ("\u00c9",), ("\u4e2d 7",), ("a\tb\x00c",)]
    names = spark.createDataFrame(rows, "v string")
    found = [tuple(r) for r in names.select(text.norm_token("v"), text.norm_span("v")).collect()]
    assert found == [("salle 2 nord", "salle-2 nord"), ("salle 3", "salle 3"), ("salle 3", "salle 3"), ("", ""), ("", ""), ("e", "e"), ("7", "\u4e2d 7"), ("a b c", "a b\x00c")]
    assert [r.n for r in spark.createDataFrame([(12,), (None,)], "v int").select(text.norm_token("v").alias("n")).collect()] == ["12", ""]
    plan = names.select(text.norm_token("v").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan.lower()


def test_similarity_pruning_loses_nothing(spark):
    rng = random.Random(5)
    words = ["prise", "rj45", "lampe", "led", "16a", "murale", "store", "tableau", "salle", "eau", "zz"]

    def name():
        base = " ".join(rng.choices(words, k=rng.randint(1, 4)))
        return "".join(c for c in base if rng.random() > 0.15).strip() or "x"

    left = [(j, name()) for j in (1, 2) for _ in range(80)]
    right = [(j, name()) for j in (1, 2) for _ in range(80)]
    for threshold in (0.62, 0.65):
        got = {tuple(r) for r in similar_pairs(spark.createDataFrame(left, "j int, a string"), spark.createDataFrame(right, "j int, b string"), ["j"], threshold).collect()}
        want = {(j, a, b, SequenceMatcher(None, a, b).ratio()) for j, a in left for k, b in right if j == k and SequenceMatcher(None, a, b).ratio() >= threshold - 1e-9}
        assert got == want


def test_containment_equals_the_scan(spark):
    rng = random.Random(6)
    words = ["salle", "nord", "eau", "b", "accueil", "12"]
    rooms = sorted({(1, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for _ in range(60)})
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(30)})
    plan = spark.createDataFrame([(j, r, r) for j, r in rooms], "job_id int, source_room string, room_norm string")
    table = spark.createDataFrame([(1, n, 1, f"id {n}", ("", "", n, "")) for n in names],
                                  "job_id int, piece_norm string, n int, room_id string, position struct<a:string,b:string,c:string,d:string>")
    got = {r.source_room: r.room_id for r in rooms_by_containment(plan, table).collect()}

    def inside(needle, hay):
        return f" {needle} " in f" {hay} "

    want = {}
    for _, r in rooms:
        held = [n for n in names if len(n) >= 4 and (inside(n, r) or inside(r, n))]
        if held:
            want[r] = f"id {max(held, key=len)}"
    assert got == want


def test_block_scans_equal_plain_scans(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.choice([None, None, "a", "b"]), rng.choice("xyz")) for g in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i bigint, v string, w string")
    got = {(r.g, r.i): (r.v, r.n) for r in running_count(carry_forward(df, ["g"], "i", ["v"]), ["g"], "i", "n").collect()}
    for g in (1, 2):
        last = None
        for n, (_, i, v, _w) in enumerate([r for r in rows if r[0] == g], start=1):
            last = v or last
            assert got[(g, i)] == (last, n)
    ranked = {(r.g, r.i): r.n for r in rank_by_range(df, ["g"], ["w", "i"], "n").collect()}
    for g in (1, 2):
        for n, (_, i, _v, _w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1])), start=1):
            assert ranked[(g, i)] == n


def test_ranges_hold_counted_rows_of_a_sparse_hot_key(spark):
    rng = random.Random(5)
    values = rng.sample(range(10**15), 4000)
    df = spark.createDataFrame([(0 if n % 100 else 1, v) for n, v in enumerate(values)], "g int, i bigint").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_ranges(df, ["g"], ["i"]).groupBy(RANGE).count().collect()]
        found = {(r.g, r.i): r.n for r in running_count(df, ["g"], "i", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8
    for g in (0, 1):
        own = sorted(v for n, v in enumerate(values) if (0 if n % 100 else 1) == g)
        assert [found[g, v] for v in own] == list(range(1, len(own) + 1))


def test_partitioning_does_not_change_order(spark):
    from sitetally.operators.reconcile import after_groups

    rows = [(1, "r", "c", "m", f"l{9 - i}", "s", "sm", "pdf", "k", "how", i, i % 3, 1, False) for i in range(9)]
    df = spark.createDataFrame(rows, "job_id int, room_id string, categorie string, materiel string, label string, source_room string, source_material string, origin string, "
                                     "mapping_key string, mapping_method string, seq int, page int, quantity bigint, is_addition boolean")
    expected = ", ".join(f"l{9 - i}" for i in range(9))
    for parts in (1, 5):
        row = after_groups(df.repartition(parts, F.rand(parts))).first()
        assert (row.labels, row.pages, row.quantite_apres) == (expected, "1,2", 9)
