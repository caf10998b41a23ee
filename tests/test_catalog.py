"""The catalogue index against a plain walk over all entries."""

import random
import re

import pytest

from sitetally.functions.patterns import heads_of
from sitetally.operators import spans

ENTRY = ("page_type STRING, kind STRING, ord INT, pattern STRING, article STRING, categorie STRING, min_font_size DOUBLE, max_font_size DOUBLE, "
         "min_x DOUBLE, max_x DOUBLE, min_y DOUBLE, max_y DOUBLE, expands MAP<STRING, INT>")
SPAN = "job_id BIGINT, page INT, seq BIGINT, text STRING, size DOUBLE, x DOUBLE, y DOUBLE"


@pytest.mark.parametrize(("pattern", "heads"), [
    ("PC", ["pc"]), ("^PC$", ["pc"]), ("PC|RJ ?45", ["pc", "rj"]), ("(?:A|B)x", ["ax", "bx"]), ("A(?:b|c)?d", ["a"]), ("ab+c", ["ab"]), ("ab*c", ["a"]),
    ("a{2,3}b", ["a"]), ("a{0,3}b", [""]), ("[ab]c", ["ac", "bc"]), ("[a-z]c", [""]), ("\\d+ W", [""]), ("x\\.y\\d", ["x.y"]), ("(?=a)b", [""]),
    ("(?i)abc", [""]), ("CLICK (3[0-9]*)$", ["click 3"]), ("\\bÉc", ["Éc"]), ("ab|abc|a", ["a"]), ("(a|)b", ["ab", "b"]), ("", [""]), ("a(b", [""]), ("a)b", [""]),
    ("x" * 40, ["x" * 12]), ("\\Qa.b\\E", [""]), ("a\\1", [""]), ("((a)|(b))+c", ["a", "b"]), ("a.c", ["a"]), ("a??b", [""]), ("a++b", ["a"]),
])
def test_heads(pattern, heads):
    assert heads_of(pattern) == heads


def test_every_match_begins_with_a_head():
    rng = random.Random(4)
    for _ in range(20_000):
        pattern = "".join(rng.choice(["a", "b", "A", "c?", "b*", "a+", "(a|bc)", "(?:b|c)?", "[ab]", "[^a]", ".", "\\d", "|", "^", "b{2}", "\\."]) for _ in range(rng.randint(0, 5)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        text = "".join(rng.choice("abcAB1.") for _ in range(rng.randint(0, 5)))
        if compiled.match(text):
            assert any(text.lower().startswith(h) for h in heads_of(pattern)), (pattern, text)


def test_five_thousand_patterns_equal_a_walk_and_meet_few_texts(spark):
    rng = random.Random(5)
    words = [a + b + c for a in "BCDFGLMPRST" for b in "aeiou" for c in "lmnrst"]
    kinds = [lambda w: w, lambda w: f"^{w} (\\d+)$", lambda w: f"{w}|{w[::-1]}", lambda w: f"(?:{w}|x{w}) ?n", lambda w: f"{w[:2]}[{w[2]}z]+", lambda w: f"\\d+ {w}"]
    entries = []
    for i in range(5000):
        kind = kinds[-1] if i % 500 == 0 else rng.choice(kinds[:-1])
        low = rng.choice([None, None, 8.0])
        entries.append((rng.choice(["ELECTRICITE", "AUTRE"]), "text", i, kind(rng.choice(words) + rng.choice(words)), f"art{i} {{0}}" if i % 3 == 0 else f"art{i}", "cat",
                        low, None, None, rng.choice([None, 50.0]), None, None, None))
    texts = []
    for e in rng.sample(entries, 300):
        base = re.sub(r"[\\^$()?:\[\]+|]|d\+", "", e[3])[:6]
        texts += [base, base.upper() + " 12", "7 " + base, base[::-1]]
    rows = [(1, 1 + i % 2, i, t, rng.choice([7.0, 9.0]), float(rng.randint(0, 99)), 1.0) for i, t in enumerate(texts * 2)]
    types = {1: "ELECTRICITE", 2: "AUTRE"}
    # an article with a number needs a pattern with a group
    entries = [e for e in entries if "{0}" not in e[4] or e[3].startswith("^")]
    compiled = [re.compile(e[3], re.I) for e in entries]
    matching = {t: [(e, m) for e, c in zip(entries, compiled) if (m := c.match(t))] for t in set(texts)}
    expected = {}
    for _, page, seq, text, size, x, _y in rows:
        for e, hit in matching[text]:
            if e[0] == types[page] and (e[6] is None or size >= e[6]) and (e[9] is None or x <= e[9]):
                expected[seq] = e[4].replace("{0}", hit.group(1)) if "{0}" in e[4] else e[4]
                break
    df, catalog = spark.createDataFrame(rows, SPAN), spark.createDataFrame(entries, ENTRY)
    kind = spark.createDataFrame([(1, p, t) for p, t in types.items()], "job_id BIGINT, page INT, page_type STRING")
    assert {r["seq"]: r["article"] for r in spans.catalog_match(df, kind, catalog).collect()} == expected and len(expected) > 300
    pairs = spans.catalog_candidates(df.join(kind, ["job_id", "page"]).select("page_type", "text").distinct(), catalog.select("page_type", "ord", "pattern")).count()
    distinct = df.join(kind, ["job_id", "page"]).select("page_type", "text").distinct().count()
    assert pairs < distinct * 5000 / 2 / 100


def test_catalogue_without_entries_and_spans_without_text(spark):
    types = spark.createDataFrame([(1, 1, "AUTRE")], "job_id BIGINT, page INT, page_type STRING")
    rows = spark.createDataFrame([(1, 1, 0, None, 9.0, 1.0, 1.0), (1, 1, 1, "", 9.0, 1.0, 1.0), (1, 1, 2, "ab", None, 1.0, 1.0)], SPAN)
    assert spans.catalog_match(rows, types, spark.createDataFrame([], ENTRY)).collect() == []
    every = spark.createDataFrame([("AUTRE", "text", 0, ".*", "any", "c", *[None] * 7)], ENTRY)
    assert sorted(r["seq"] for r in spans.catalog_match(rows, types, every).collect()) == [1, 2]
