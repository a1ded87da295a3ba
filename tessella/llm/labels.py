"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 4000
WINDOW_CHARS = 1 << 15


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def _first(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of least seeded hash of each label.

    A threshold on the hash, from each label's count, leaves about twice as many
    rows before any are ordered, so no task orders more than that.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    counts = dict(rows.groupBy("y").count().collect())
    out = None
    for y, n in sorted(counts.items()):
        own = rows.where(F.col("y") == y)
        if n > 4 * most:
            own = own.where(order < F.lit(int(-(2**63) + 2**64 * (2 * most / n))))
        own = own.orderBy(order, "doc_id").limit(most)
        out = own if out is None else out.unionByName(own)
    return rows.limit(0) if out is None else out


def labelled_documents(documents: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, seed: int = 11) -> DataFrame:
    """doc_id, text, y of at most ``per_class`` rows of each label, chosen by a hash of the id, whatever their text.

    Null ids, labels and texts are left out. Repeated label rows count once; an id
    with both labels is left out. Of several texts of one id, all come back.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    # At most 4 * per_class rows of two numbers, then at most half as many: these broadcasts are bounded.
    found = ids.join(F.broadcast(_first(known, 2 * per_class, seed)), "doc_id").distinct()
    chosen = _first(found, per_class, seed)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")


def windows(sample: DataFrame, chars: int = WINDOW_CHARS, seed: int = 12) -> DataFrame:
    """text, y of each sampled id: the text, or a window of ``chars`` characters at a seeded place of a longer one.

    Of several texts of one id, one counts.
    """
    n = F.length("text")
    at = F.when(n > chars, F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n - chars + 1) + 1).otherwise(1)
    cut = sample.select("doc_id", "y", F.substring("text", at.cast("int"), F.lit(chars)).alias("text"))
    return cut.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").select("text", "y")
