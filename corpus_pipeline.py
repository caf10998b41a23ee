"""A training corpus from `documents` in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from sitetally.llm import mixing, overlap, packing, quality, toxicity
from sitetally.llm.common import prepare, table, written
from sitetally.llm.tokens import tokenizer_file


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def toxicity_filter(spark, docs, sf_dir):
    """Documents that don't score as toxic, by a model of the labelled ones among them."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: texts whose 5-word shingles overlap by a Jaccard similarity of 0.8 or more."""
    return overlap.keep_one(docs)


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("near-duplicates", near_dedup), ("mixing", source_mix), ("packing", pack)]

#: The tokenizer and the hashes have no DuckDB counterpart: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of sf_dir."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, f"stage-{place}")
    return docs
