"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from graphloom.llm import jaccard, packing, quality, suffix_dedup, toxicity
from graphloom.llm.common import ensure_checkpoint_dir, read_table
from graphloom.llm.queries import tokenizer_path


def quality_stage(spark, docs, sf_dir):
    """Rejected documents go. The model learns from the labelled documents among those given."""
    return quality.keep_good(docs, quality.fit_on(docs, read_table(spark, sf_dir, "labels")))


def toxicity_stage(spark, docs, sf_dir):
    """Toxic documents go."""
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near copies (Jaccard of five-word shingles, 0.8 or more) stays, the one with the smallest id."""
    return jaccard.one_of_each_group(docs)


def repeats_stage(spark, docs, sf_dir):
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    return suffix_dedup.remove_repeats(docs)


def packing_stage(spark, docs, sf_dir):
    """Tokenised and packed."""
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: Models, components and suffix arrays are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
