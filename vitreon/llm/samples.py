"""Bounded, deterministic samples of labelled documents for the classifiers.

Three parameters bound what training reads, and thereby what the driver holds: documents a label (per_class), bytes of a
text (text_bytes: longer ones never serve for training; they are scored whole all the same) and bytes of all texts of
a label (label_bytes: the last documents by hash of id are left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEXT_BYTES = 200_000
LABEL_BYTES = 48 << 20


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, text_bytes: int = TEXT_BYTES, label_bytes: int = LABEL_BYTES) -> list[tuple[bytes, int]]:
    """At most per_class texts of each label among the rows of labels that satisfy train, chosen by hash of id.

    Labels other than 0 and 1 and null ids are ignored; of contradicting labels of one id the larger counts.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("_y"))
    ids = ids.withColumn("_h", F.xxhash64("doc_id", F.lit(7)))
    chosen = None
    for y in (0, 1):
        one = ids.where(F.col("_y") == y).orderBy("_h", "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    # two labels of at most per_class ids, whatever the table's size
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    rows = text.join(F.broadcast(chosen.select("doc_id", "_y", "_h")), "doc_id").groupBy("doc_id", "_y", "_h").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("_y").orderBy("_h", "doc_id"))
    rows = rows.withColumn("_sum", so_far).where(F.col("_sum") <= label_bytes).select("doc_id", "_y", "_h", "text").collect()
    rows.sort(key=lambda r: (r["_h"], r["doc_id"]))
    return [(bytes(r["text"]), int(r["_y"])) for r in rows]
