"""Labelled documents for the fits: all label rows, or a bounded, seeded sample with their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000
HELD_OUT = 5


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Every fifth id by its checksum; never seen in a fit."""
    return F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0


def known(labels: DataFrame) -> DataFrame:
    """doc_id and quality of all labelled documents that are not held out. Repeated label rows count once."""
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return rows.where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, quality of at most `most` labelled documents that are not held
    out, chosen by a hash of the id."""
    chosen = known(labels).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")
