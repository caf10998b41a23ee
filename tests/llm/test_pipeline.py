"""The five stages over a small folder: each is held against a plain version on its own input, and run() against the chain."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from brute import kept_places, measures, overlap_pairs, words
from pyspark.sql import functions as F

import corpus_pipeline
from sitetally.llm import mixing, quality, toxicity
from sitetally.llm.common import written
from sitetally.llm.tokens import tokenizer_file

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with planted near copies (0.8 to 0.95), rows without an id, a repeated row and columns that the operators use themselves."""
    path = tmp_path_factory.mktemp("sf")
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [r for r in rows if len(words(r[1])) >= 150][:12]
    for i, (doc_id, text, *rest) in enumerate(long):
        w = text.split(" ")
        for at in range(7, len(w), max(8, len(w) // (1 + i // 3))):
            w[at] = "exchanged"
        rows.append((None if i % 4 == 0 else 100_000 + doc_id, " ".join(w), *rest))
    rows += [rows[0], (None, None, None, None, None), (None, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"
    spark.createDataFrame([(*r, 7, "x") for r in rows], kind).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_equal_plain_versions_and_run_chains_them(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(written(stage(spark, outputs[-1], folder), f"test-{len(outputs)}"))
    given, good, clean, single, mixed, packed = ([r.asDict() for r in o.collect()] for o in outputs)
    assert all(o.columns == docs.columns for o in outputs[:5])
    key = lambda r: (r["doc_id"], r["text"])

    # quality rules: what the base rules or the judge reject goes, all else stays
    judged = Counter(r["doc_id"] for r in quality.judge(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in good) == judged and len(good) > 0.5 * len(given)
    for r in good:
        n, _, _, _, repeated = measures(r["text"])
        assert n >= 20 and 100 * repeated <= 30 * n

    # toxicity: documents that score as toxic go
    scored = toxicity.score_documents(outputs[1], spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(r["doc_id"] for r in clean) == Counter(r["doc_id"] for r in scored.filter("predicted = 0").collect())

    # near-duplicates: all pairs, the least id of each component
    ids, texts = [r["doc_id"] for r in clean], [r["text"] for r in clean]
    pairs = [p for p in overlap_pairs(texts) if texts[p[0]] != texts[p[1]]]
    assert len(pairs) >= 6 and Counter(map(key, single)) == Counter(key(clean[i]) for i in kept_places(ids, texts))

    # mixing: whole documents, at most three times, as often as the mix says
    times = Counter(map(key, mixed))
    assert set(times) <= set(map(key, single)) and max(times.values()) <= 3 * max(Counter(map(key, single)).values())
    by_source, largest = defaultdict(int), defaultdict(int)
    for r in mixed:
        by_source[r["source"]] += len(words(r["text"]))
    for r in single:
        largest[r["source"]] = max(largest[r["source"]], len(words(r["text"])))
    targets = {r["source"]: r["target"] for r in mixing.mix(outputs[3]).select("source", "target").distinct().collect()}
    assert all(abs(by_source[s] - t) <= largest[s] for s, t in targets.items())

    # packing: every token once, sequences gapless and within the capacity
    tokenizer = Tokenizer.from_file(tokenizer_file())
    sizes = Counter()
    for r in mixed:
        sizes[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    found, places = Counter(), defaultdict(list)
    for r in packed:
        found[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == sizes
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096

    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, (r.asDict() for r in corpus_pipeline.run(spark, folder).collect()))) == Counter(map(piece, packed))


def test_pipeline_of_no_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.col("doc_id").isNotNull()).count() == 0


def test_crowded_shingles_meet_in_full(spark):
    """Texts that share a long passage, in many components: every near pair is found, whatever its texts share with all others."""
    import numpy as np

    from sitetally.llm import overlap

    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(400):
        own = [f"o{x}" for x in rng.integers(0, 10_000, 30)]
        texts.append(" ".join([*passage, *own]))
        if i % 5 == 0:
            texts.append(" ".join([*passage, *own[:-2], "other", "end"]))
        if i % 9 == 0:
            texts.append(" ".join([*passage[: 50 + i % 8], *own[:6]]))
    rows = list(enumerate(texts))
    kept = overlap.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == kept_places(list(range(len(texts))), texts)


def test_a_large_group_of_near_copies_is_joined_without_all_its_pairs(spark, monkeypatch):
    """Each text is near to a few others of its group and merely alike to the rest: pairs that are held against each other grow with the texts."""
    import numpy as np

    from sitetally.llm import overlap

    rng, asked, plain = np.random.default_rng(11), [], overlap._verified
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(400):
        w = list(base)
        for at in rng.choice(150, 2, replace=False):
            w[at] = f"x{i}.{at}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{i}.{j}" for j in range(40)) for i in range(20)]
    monkeypatch.setattr(overlap, "_verified", lambda pairs, *rest: (asked.append(pairs.count()), plain(pairs, *rest))[1])
    kept = overlap.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == kept_places(list(range(len(texts))), texts)
    assert sum(asked) < 10 * len(texts)


def test_near_copies_are_sought_by_fingerprints_and_verified(spark, monkeypatch):
    """Texts at 2 or fewer differing bits meet as in op1, and stay apart where their shingles do."""
    from sitetally.llm import overlap, simhash

    asked, plain = [], overlap.simhash_links
    monkeypatch.setattr(overlap, "simhash_links", lambda fps: (asked.extend(r["fp"] for r in fps.collect()), plain(fps))[1])
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long), (2, long + " end"), (3, "other words than those of the long text above")]
    kept = overlap.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {1, 3}
    assert {simhash.fingerprint(t.encode()) for _, t in rows[:2]} <= {fp % 2**64 for fp in asked}


def test_places_in_prefixes_keep_every_near_pair_and_drop_others():
    """The first shared shingle of a near pair passes the test of places; late ones, that many pairs of a crowded shingle share, don't."""
    import numpy as np

    from sitetally.llm import overlap

    class Side:
        def __init__(self, found, counts):
            self.size, self.keys = len(found), overlap.prefix(found, counts, overlap.SIMILARITY).tolist()

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    texts = [np.unique(np.concatenate([rng.permutation(base)[: 300 - cut], rng.integers(0, 2**64, cut, dtype=np.uint64)])) for cut in range(0, 90, 3)]
    counts = np.zeros(overlap.COUNTERS, np.uint32)
    for t in texts:
        np.add.at(counts, overlap._counter(t), 1)
    sides, near, met, passed = [Side(t, counts) for t in texts], 0, 0, 0
    for i, a in enumerate(sides):
        for j in range(i):
            b = sides[j]
            shared = [k for k in a.keys if k in set(b.keys)]
            fits = [min(a.size - a.keys.index(k), b.size - b.keys.index(k)) * (1 + overlap.SIMILARITY) >= overlap.SIMILARITY * (a.size + b.size) - 1e-6 for k in shared]
            same = len(np.intersect1d(texts[i], texts[j]))
            if same >= overlap.SIMILARITY * (a.size + b.size - same):
                near += 1
                assert fits and fits[0]
            met, passed = met + len(fits), passed + sum(fits)
    assert near > 30 and passed < 0.8 * met


def test_may_be_first_is_that_rule(spark):
    from sitetally.llm import overlap

    kind = "a struct<left: int, size: int>, b struct<left: int, size: int>"
    rows = [((100, 100), (100, 100)), ((89, 100), (95, 100)), ((88, 100), (95, 100)), ((80, 80), (100, 100)), ((79, 80), (100, 100))]
    found = spark.createDataFrame(rows, kind).select(overlap._may_be_first("a", "b", 0.8).alias("f")).collect()
    assert [r["f"] for r in found] == [True, True, False, True, False]


def test_written_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    root = Path(spark.sparkContext._temp_dir).parent.parent
    files = lambda: {p for top in root.glob("blockmgr-*") for p in top.rglob("shuffle_*.data")}
    counted = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    counted.collect()
    before = files()
    table = written(counted, "test-shuffle")
    for _ in range(50):  # files go a moment after the job
        if files() <= before:
            break
        time.sleep(0.2)
    assert before and files() <= before
    assert table.count() == 100 and len(counted.collect()) == 100


def test_no_near_pair_is_lost_to_an_estimate(spark):
    """Words are exchanged just where most minima of the sketches lie: the pair is near although its sketches hardly agree."""
    import numpy as np

    from sitetally.llm import overlap, simhash

    def values(found):
        mixed = found[:, None] * overlap._FACTORS + overlap._ADDED
        mixed ^= mixed >> np.uint64(32)
        return mixed * np.uint64(0x9E3779B97F4A7C15)

    text = lambda w: " ".join(w).encode()
    base = [f"w{i}" for i in range(500)]
    least, w = overlap.minima(overlap.shingles(text(base))), list(base)
    for _ in range(10):
        free = [i for i in range(5, 495) if w[i - 4 : i + 5] == base[i - 4 : i + 5]]
        held = [int((values(overlap.shingles(text(base[i - 4 : i + 5]))).min(0) == least).sum()) for i in free]
        at = free[int(np.argmax(held))]
        tried = [[*base[at - 4 : at], f"z{at}.{k}", *base[at + 1 : at + 5]] for k in range(100)]
        w[at] = tried[int(np.argmax([int((values(overlap.shingles(text(x))).min(0) < least).sum()) for x in tried]))][4]
    a, b = (overlap.shingles(text(x)) for x in (base, w))
    shared = len(np.intersect1d(a, b))
    assert shared >= overlap.SIMILARITY * (len(a) + len(b) - shared)
    agreeing = int(((overlap.minima(a) >> np.uint64(40) & np.uint64(15)) == (overlap.minima(b) >> np.uint64(40) & np.uint64(15))).sum())
    assert agreeing < overlap._least_agreeing(overlap.SIMILARITY)
    assert (simhash.fingerprint(text(base)) ^ simhash.fingerprint(text(w))).bit_count() > simhash.RADIUS
    rows = [(1, " ".join(base)), (2, " ".join(w)), (3, "other words than those of the long texts above")]
    kept = overlap.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {1, 3}
