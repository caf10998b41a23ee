"""Toxicity by a weighted grammar of clauses.

A lexical transducer turns words into kinds: insults (learned words and stems with weights), threats, targets, negations and
reporting verbs (short fixed lists). It is composed with the machines of negation, reported speech and targets. Each insult
or threat of a clause adds its weight times a factor for the flags it carries; the heaviest clause makes up most of a score.

Learning takes at most TRAINING_ROWS labelled documents, chosen by a hash of doc_id, in three passes: which words and stems
occur in how many toxic documents, in how many clean ones for those that are left, and how well events with each set of
flags tell toxic documents from clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes, written
from .transducers import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, grammar

#: Bound on labelled documents used to learn.
TRAINING_ROWS = 20_000
#: Lengths of the stems tried, in characters from a word's start.
STEMS = (3, 4, 5, 6, 7)
#: Toxic documents that a lexicon entry needs at least, and its share of toxic documents.
MIN_TOXIC, MIN_PRECISION = 4, 0.75
STRONG_PRECISION = 0.95
#: A word that toxic documents have this share as often as the most common entry, which stands in STRONG_ROWS at least.
COMMON_SHARE, STRONG_ROWS = 0.5, 20
#: Added to the bound that a likelihood ratio must pass.
CAUTION = 4.0
#: Weight of a threat before labels speak, and documents that the default factors count for.
THREAT_WEIGHT, PRIOR_ROWS = 2.6, 5.0
#: Share of the other clauses' weight (by logarithm) in a document's score.
FURTHER = 0.5
#: Words of a worker's memory of looked-up words.
MEMORY = 150_000

# fixed lists, in English, French, Spanish and German
THREATS = "kill murder strangle stab tuerai tuerons égorger matarte mataré degollar umbringen abstechen töten".split()
TARGETS = "you your yourself tu toi vous vos ton usted ustedes tú te du dich dir euch ihr".split()
NEGATIONS = "not never no isn aren wasn ne pas jamais nunca jamás nicht kein keine nie".split()
REPORTS = "said says wrote quoted claimed according dit écrit selon dijo escribió según sagte schrieb laut".split()

_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[.!?;:,\n]+")


@dataclass
class Model:
    """weights of words and stems (stems end in *), factor of each set of flags, log-odds without any event."""

    weights: dict[str, float] = field(default_factory=dict)
    factors: dict[frozenset, float] = field(default_factory=dict)
    bias: float = -2.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine, self.memory = model, grammar(), {}
        self.fixed = {w: k for k, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.stems = sorted({len(w) - 1 for w in model.weights if w.endswith("*")})

    def lexical(self, word: str) -> tuple[str, float]:
        """Kind and weight of a lower-case word: the heaviest learned entry that fits, else the fixed lists."""
        found = self.memory.get(word)
        if found is None:
            weights = self.model.weights
            fits = [w for w in (weights.get(word), *(weights.get(word[:n] + "*") for n in self.stems if len(word) >= n)) if w is not None]
            kind = self.fixed.get(word, OTHER)
            found = (INSULT, max(fits)) if fits else (kind, THREAT_WEIGHT if kind == THREAT else 0.0)
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found

    def clauses(self, text: str) -> Iterator[list[tuple[float, frozenset]]]:
        """The events (weight, flags) of each clause that has any."""
        lower = text.lower()
        words = set(_WORD.findall(lower))
        lexical, step = self.lexical, self.machine.step
        loud = {w for w in words if lexical(w)[0] in (INSULT, THREAT)}
        if not loud:
            return
        for clause in _CLAUSE.split(lower):
            inside = _WORD.findall(clause)
            if loud.isdisjoint(inside):
                continue
            state, events, ahead = self.machine.start, [], any(lexical(w)[0] == TARGET for w in inside)
            for word in inside:
                kind, weight = lexical(word)
                state, flags = step[state, kind]
                if kind in (INSULT, THREAT):
                    flags = flags | {"targeted"} if ahead else flags  # a target may also follow: "losers, all of you"
                    events.append((weight, flags | {kind}))
            yield events

    def score(self, text: str) -> float:
        """0 to 1; a text without events has the score of the bias."""
        sums = [sum(w * self.model.factors.get(flags, _default(flags)) for w, flags in events) for events in self.clauses(text)]
        logit = self.model.bias
        if sums:
            most = max(sums)
            logit += most + FURTHER * math.log1p(max(sum(s for s in sums if s > 0) - most, 0.0))
        return 1 / (1 + math.exp(-max(min(logit, 40.0), -40.0)))


def _default(flags: frozenset) -> float:
    """Factor of a set of flags before labels speak."""
    value = 1.0
    for flag, factor in (("negated", 0.4), ("reported", 0.4), ("targeted", 1.2)):
        value *= factor if flag in flags else 1.0
    return value


def features(text: str, stems: tuple[int, ...] = STEMS) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in stems if len(w) >= n}


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most about `rows` labelled documents whose hash doesn't hold them out."""
    id_hash = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null")
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(id_hash % 5 != 0)
    return texts.join(known, texts["doc_id"] == known["_id"]).select("text", "toxic")


def _feature_counts(keep: frozenset | None):
    """Documents of each feature in a partition, of the features to keep; partial counts go out when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                found = features(text.decode())
                counts.update(found if keep is None else keep & found)
            if len(counts) > MEMORY:
                yield out()
                counts.clear()
        yield out()

    return run


def _state_counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(model), Counter()
        for batch in batches:
            for text, toxic in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for flags in {flags for events in scorer.clauses(text.decode()) for _, flags in events}:
                    counts["+".join(sorted(flags)), toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["flags", "toxic", "n"])

    return run


def _tally(rows: DataFrame, keep: frozenset | None) -> DataFrame:
    return rows.select("text").mapInArrow(_feature_counts(keep), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _features_held(keep: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(keep & features(t.decode())) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["features"])

    return run


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Likelihood ratio of a feature in `bad` toxic and `good` clean documents, against the shares of all."""
    share, own = all_bad / (all_bad + all_good), bad / (bad + good)
    return 2 * (bad * math.log(own / share) + (good * math.log((1 - own) / (1 - share)) if good else 0.0))


def cover(toxic: list[set[str]], clean_counts: dict[str, int], clean: int, bound: float) -> list[str]:
    """Entries that explain the toxic documents: the feature with the largest gain first, then the next over the documents
    that none explains yet, until the gain isn't past the bound. Documents still left, however few, then take the feature
    with the largest gain over all documents, if it is past twice the bound. Whole words about as common as the most common
    entry are entries, too. Whole words and longer stems win ties."""
    where: dict[str, set[int]] = {}
    for i, held in enumerate(toxic):
        for f in held:
            where.setdefault(f, set()).add(i)
    everywhere = {f: len(found) for f, found in where.items()}
    left, chosen = len(toxic), []
    while where and left:
        best = max(where, key=lambda f: (_gain(len(where[f]), clean_counts[f], left, clean), not f.endswith("*"), len(f), f))
        found = where.pop(best)
        if len(found) < MIN_TOXIC or len(found) < MIN_PRECISION * (len(found) + clean_counts[best]) or _gain(len(found), clean_counts[best], left, clean) <= bound:
            break
        chosen.append(best)
        left -= len(found)
        for f in {f for i in found for f in toxic[i]} & where.keys():
            where[f] -= found
            if not where[f]:
                del where[f]
    strong = {f: (_gain(everywhere[f], clean_counts[f], len(toxic), clean), not f.endswith("*"), len(f), f) for f in where}
    explained = {i for f in chosen for i, held in enumerate(toxic) if f in held}
    for f in sorted(strong, key=strong.get, reverse=True):
        if strong[f][0] > 2 * bound and everywhere[f] >= STRONG_PRECISION * (everywhere[f] + clean_counts[f]):
            found = {i for i, held in enumerate(toxic) if f in held}
            if not found <= explained:
                chosen.append(f)
                explained |= found
    common = COMMON_SHARE * max([0, *(everywhere[f] for f in chosen)])
    alike = [f for f, n in everywhere.items() if not f.endswith("*") and f not in chosen and n >= max(common, 1) and n >= STRONG_PRECISION * (n + clean_counts[f])]
    return chosen + (sorted(alike) if common >= STRONG_ROWS * COMMON_SHARE else [])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from labelled documents that aren't held out; copies count once. Without labels of both kinds, only the fixed lists score.

    A word or stem enters the lexicon if it stands in MIN_TOXIC toxic documents that no stronger entry explains, MIN_PRECISION
    of its documents are toxic, and that many by chance are unlikely even among all features tried (a likelihood-ratio test
    with a bound that grows with their number). The driver holds the likely features of the toxic training rows, which
    their bound limits."""
    prepare(docs.sparkSession)
    chosen = written(_training_rows(docs, labels, rows).dropDuplicates(["text", "toxic"]), "toxicity-rows")
    totals = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model()
    bad = {r["feature"]: r["n"] for r in _tally(chosen.filter("toxic = 1"), None).filter(F.col("n") >= MIN_TOXIC).collect()}
    good = {r["feature"]: r["n"] for r in _tally(chosen.filter("toxic = 0"), frozenset(bad)).collect()}
    model = Model(bias=math.log(toxic / clean))
    bound = 2 * math.log(max(len(bad), 2)) + CAUTION
    likely = {f: good.get(f, 0) for f, n in bad.items() if n >= MIN_PRECISION * (n + good.get(f, 0)) and _gain(n, good.get(f, 0), toxic, clean) > bound}
    held = chosen.filter("toxic = 1").select("text").mapInArrow(_features_held(frozenset(likely)), "features array<string>").collect()
    for name in cover([set(r["features"]) for r in held], likely, clean, bound):
        model.weights[name] = math.log((bad[name] + 0.5) / (toxic + 1)) - math.log((likely[name] + 0.5) / (clean + 1))
    seen: dict[frozenset, list[int]] = {}
    for r in chosen.mapInArrow(_state_counts(model), "flags string, toxic int, n long").groupBy("flags", "toxic").agg(F.sum("n").alias("n")).collect():
        seen.setdefault(frozenset(r["flags"].split("+")), [0, 0])[r["toxic"] != 0] += r["n"]
    all_bad, all_good = sum(b for _, b in seen.values()), sum(g for g, _ in seen.values())
    whole = math.log((all_bad + 1) / (all_good + 1) * clean / toxic) if seen else 1.0
    for flags, (n_good, n_bad) in seen.items():
        own = math.log((n_bad + 0.5) / (n_good + 0.5) * clean / toxic)
        told = max(0.0, min(1.25, own / whole)) if whole > 0 else 1.0
        weight = (n_good + n_bad) / (n_good + n_bad + PRIOR_ROWS)
        model.factors[flags] = weight * told + (1 - weight) * _default(flags)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t.decode()) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def scores(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """(row, score): row is a struct of the named columns. Only the text is scored; a null one is empty."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model learned from the rows that aren't held out.

    A null doc_id counts as the text "null" for holding out and is never labelled. Repeated rows score alike; labels that
    contradict each other count as toxic. Empty texts have the score of the bias. An empty table gives no rows.
    """
    found = scores(docs, learn(docs, labels), ["doc_id"])
    doc_id = F.col("row.doc_id")
    out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0
    return found.select(doc_id.alias("doc_id"), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with their columns."""
    return scores(docs, learn(docs, labels), docs.columns).filter("score < 0.5").select("row.*")
