"""Passages, whitening and phrases against plain versions, over awkward rows and crowded keys."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import AWKWARD, COLUMNS, words
from pyspark.sql import functions as F

from sitetally.llm import phrases, repeats, skew, whitening
from sitetally.llm.automata import CountAutomaton
from sitetally.llm.queries import LLM_ORACLES, LLM_QUERIES

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def from_sql(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"create view {t} as select * from '{path}'")
    found = con.sql(LLM_ORACLES[name])
    return found.columns, found.fetchall()


@pytest.mark.parametrize("name", ["op11_repeats", "op13_phrases"])
def test_query_equals_sql(spark, name):
    columns, expected = from_sql(name, documents=f"{SMALL}/documents.parquet")
    assert Counter(rows_of(LLM_QUERIES[name](spark, SMALL).select(*columns))) == Counter(expected)


# 11 passages


def without_repeats(rows, window):
    """Plain walk in order of doc_id (null last), then of the texts as given; equal rows are one document."""
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, kept = set(), {}
    for doc_id, text in order:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        kept[doc_id, text] = (doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return Counter(kept[r[0], r[1] or ""] for r in rows)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 20])
def test_cover_gives_each_pair_of_starts_a_shared_anchor(window):
    period, cover, length = repeats.plan_of(window)
    assert period + length - 1 == window
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


@pytest.mark.parametrize(("window", "held", "hot"), [(20, 1 << 20, 1024), (20, 50, 2), (3, 40, 2), (1, 30, 1)])
def test_passages_equal_a_plain_walk(spark, monkeypatch, window, held, hot):
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rng = np.random.default_rng(window)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(80):
        own = [f"w{x}" for x in rng.integers(0, 40 if d % 3 else 4000, int(rng.integers(0, 90)))]
        cut = int(rng.integers(0, 40))
        rows.append((200 - d, " ".join([*own, *passage[cut : cut + int(rng.integers(0, 40))], *own[: d % 7]])))
    rows += [(300 + i, rows[4][1]) for i in range(12)] + [rows[5], rows[5], (301, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = without_repeats(rows[:-1], window) if window else None
    found = Counter(rows_of(repeats.without_repeats(df.filter(~((df.doc_id == 301) & (df.text == rows[6][1]))), window)))
    assert found == expected
    # two texts under one doc_id: each is a document of its own
    both = rows_of(repeats.without_repeats(df, window))
    assert len(both) == len(rows) and {r[1] for r in both if r[0] == 301} == {len(words(rows[4][1])), len(words(rows[6][1]))}


def test_passages_of_awkward_rows(spark):
    rows = [*AWKWARD, (None, "a b " * 30, "de", "c", 5, "z"), (None, "a b " * 30, "de", "c", 5, "z"), (12, "a b " * 30, "de", "c", 5, "z")]
    found = Counter(rows_of(repeats.without_repeats(spark.createDataFrame(rows, COLUMNS))))
    assert found == without_repeats([r[:2] for r in rows], 20)
    assert rows_of(repeats.without_repeats(spark.createDataFrame([], COLUMNS))) == []


def test_marks_hold_all_keys_and_lookup_all_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    keys = spark.range(-500, 500, 7).selectExpr("xxhash64(id) as key")
    asked = skew.with_mark(spark.range(-1000, 1000).selectExpr("id", "xxhash64(id) as key"), F.col("key"), skew.marks(keys, F.col("key")), "held")
    held = {r["id"] for r in asked.filter("held").collect()}
    assert set(range(-500, 500, 7)) <= held and len(held) < 160
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 9), ("b", 2), ("c", 1)) for i in range(n)], "k string, i int")
    counted = spark.createDataFrame([("a", 9, 1.5), ("b", 2, 2.5), ("z", 7, 3.5)], "k string, n long, v double")
    assert Counter((r["k"], r["v"]) for r in skew.lookup(rows, counted, ["k"]).collect()) == Counter({("a", 1.5): 9, ("b", 2.5): 2})


# 12 whitening


def whitened(vectors, weights="one", limit=16):
    """n, deviations, whitened values, shares: by numpy over all vectors at once."""
    grid = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    counts = Counter(grid)
    x = np.array(sorted(counts), object)
    w = np.array([counts[tuple(v)] if weights == "counts" else 1 for v in x.tolist()], object)
    n, sums = int(w.sum()), (w[:, None] * x).sum(0)
    c = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh((c * w[:, None].astype(float)).T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(limit, len(values))
    at = {tuple(v): i for i, v in enumerate(x.tolist())}
    places = [at[g] for g in grid]
    exact = ((n * x - sums) ** 2).sum(1)
    return n, [int(exact[i]) for i in places], (c @ axes[:, :k] / np.sqrt(values[:k]))[places], (values / values.sum())[:k]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_numpy(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)).astype(np.float32) * np.linspace(4, 0.3, 20, dtype=np.float32) + 3
    data = [*base.tolist(), *([base[0].tolist()] * 150), *base[:9].tolist()]
    rows = [*enumerate(data), (9001, None), (9002, [None] * 20), (9003, [float("nan")] * 20), (9004, [float("inf")] + [0.0] * 19), (9005, []), (9006, [1.0] * 7)]
    rows.append((9007, [3e38] * 20))
    df = spark.createDataFrame([(i, v, "n") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(3)
    n, deviations, values, shares = whitened(data, weights)
    found = whitening.whiten(df, weights=weights).collect()
    assert len(found) == 16 * len(data)
    got = np.full((len(data), 16), np.nan)
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert (r["n"], int(r["deviation"])) == (n, deviations[r["vec_id"]])
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = np.sign((got * values).sum(0))
    np.testing.assert_allclose(got * signs, values, atol=1e-7)


def test_whitening_without_spread_and_without_rows(spark):
    kind = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert len(one) == 6 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"], r["n"]) == (None, 0.0, 0, 0.0, 1) for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and len(flat) == 8
    huge = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [5e16, 3.0])]
    n, deviations, *_ = whitened([v for _, v in huge])
    assert {(r["vec_id"], int(r["deviation"])) for r in whitening.whiten(spark.createDataFrame(huge, kind)).collect()} == set(enumerate(deviations))
    assert rows_of(whitening.whiten(spark.createDataFrame([], kind))) == []
    assert rows_of(whitening.whiten(spark.createDataFrame([(1, None)], kind))) == []


# 13 phrases


def test_automata_keep_counts_through_bytes_cuts_and_unions():
    rng = np.random.default_rng(1)
    vocabulary = [b"", *sorted({b"w%d" % i for i in range(30)}), "é".encode()]
    parts, total = [], Counter()
    for _ in range(4):
        grams = rng.integers(1, len(vocabulary), (400, 3))
        grams[rng.random(400) < 0.2, 2] = 0
        grams[rng.random(400) < 0.1, 1:] = 0
        counts = rng.integers(1, 5, 400)
        for g, c in zip(grams.tolist(), counts.tolist(), strict=True):
            total[tuple(vocabulary[i] for i in g)] += c
        part = CountAutomaton.from_bytes(CountAutomaton.of(vocabulary, grams, counts).to_bytes())
        cut = [x for _, x in phrases._cut(part, phrases.prefix_ranges(phrases._word_hashes(part.words), part.grams, 5))]
        parts += [CountAutomaton.from_bytes(x.to_bytes()) for x in cut]
    whole = CountAutomaton.union(parts)
    as_counter = lambda a: Counter({tuple(a.words[i] for i in g): c for g, c in zip(a.grams.tolist(), a.counts.tolist(), strict=True)})
    assert as_counter(whole) == total
    for size in (1, 2, 3):
        expected = Counter()
        for g, c in total.items():
            if all(g[:size]):
                expected[g[:size]] += c
        prefixes, weights = whole.prefixes(size)
        assert Counter({tuple(whole.words[i] for i in p): w for p, w in zip(prefixes.tolist(), weights.tolist(), strict=True)}) == expected
    empty = CountAutomaton.of([b""], np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    assert len(CountAutomaton.from_bytes(empty.to_bytes()).grams) == 0


@pytest.mark.parametrize(("shard", "range_paths", "crowded"), [(1 << 20, 1 << 21, 4), (2000, 8000, 0.1)])
def test_phrases_equal_sql_also_in_crowded_ranges(spark, monkeypatch, tmp_path, shard, range_paths, crowded):
    """Hot pairs of words make ranges with far more paths than wished; awkward rows are added."""
    monkeypatch.setattr(phrases, "CROWDED", crowded)
    rng = np.random.default_rng(7)
    texts = []
    for i in range(120):
        w = [f"W{x}" for x in rng.zipf(1.5, 60) if x < 300]
        for at in rng.integers(0, max(1, len(w)), 12):
            w[at:at] = ["New", "york", f"q{int(rng.integers(0, 90))}"]
        texts.append(" ".join(w).replace("W3 ", "W3. ").replace("W5", "\tW5"))
    rows = [(i, t, [None, "en", "fr", "und"][i % 4], "s", 0, "x") for i, t in enumerate(texts)] + AWKWARD
    df = spark.createDataFrame(rows, COLUMNS)
    path = str(tmp_path / "documents")
    df.write.parquet(path)
    columns, expected = from_sql("op13_phrases", documents=f"{path}/*.parquet")
    found = rows_of(phrases.collocations(df, shard=shard, range_paths=range_paths).select(*columns))
    assert Counter(found) == Counter(expected) and len(expected) > 50
    assert rows_of(phrases.collocations(spark.createDataFrame([], COLUMNS))) == []


def test_digest_of_kept_words(spark):
    first = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").first()
    row = LLM_QUERIES["op11_repeats"](spark, SMALL).filter(f"doc_id = {first['doc_id']}").first()
    if row["n_removed"] == 0:
        assert row["kept_sha256"] == hashlib.sha256(" ".join(words(first["text"])).encode()).hexdigest()
