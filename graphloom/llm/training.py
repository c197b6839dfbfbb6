"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text

#: Of all labelled rows that may be learnt from, so many are used; a documented bound, the same at every size.
SAMPLE_ROWS = 5000
HELD_OUT_MODULUS = 4


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents that are not held out.

    Rows with a null id or label teach nothing; an id that is labelled repeatedly counts once, by its largest label,
    and of several texts with one id the smallest is taken.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", HELD_OUT_MODULUS))
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    )
    # at most `rows` ids: the broadcast's size is bounded by the parameter
    found = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def shuffled(found: list[tuple]) -> tuple[list[bytes], np.ndarray]:
    """Texts (UTF-8) and labels of (doc_id, text, y), in an order that does not depend on the one given."""
    found = sorted(found, key=lambda r: r[0])
    order = np.random.default_rng(7).permutation(len(found))
    return [found[i][1].encode() for i in order], np.array([found[i][2] for i in order], np.float64)

