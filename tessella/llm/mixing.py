"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. A source stops at
``max_epochs`` times its own size; what it cannot take is shared again among the
others by weight, until no source is above its stop. That fixed point has a
closed form: order sources by stop / weight; the sources that stop are a prefix
of that order, namely those whose stop is at most their share of what the earlier
ones leave over. Two window sums over the table of sources give it, without a loop.

A source whose target is r times its size takes every document floor(r) times.
The fractional repetition goes through its documents in the order of a seeded
hash until the target is met; the document at the border gives its first words
only, so a source's total is its target rounded down to a word.

Scale: texts are never shuffled. Sizes are pre-aggregated per source and hash
bucket (4096 buckets), so a source with a third of all rows is summed in many
tasks, and only rows of one bucket a source, that of the border, are ordered. The
table of sources is broadcast if it has at most ``BROADCAST_SOURCES`` rows (its
count is checked) and joined by shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch, spare_mark

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MAX_EPOCHS, SEED = 1.5, 2.0, 17
BROADCAST_SOURCES = 20_000
_BUCKET_HEX = 3


def word_count(text: Column) -> Column:
    """Number of words; null has none. Blank runs are folded, so one split counts them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order of code point, null last, take ``weights`` in turn. An empty
    source has target 0.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    in_turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    stops = sizes.select("source", "source_size", in_turn.alias("weight"), (max_epochs * F.col("source_size")).alias("stop"), (budget * F.sum("source_size").over(everything)).alias("budget"))
    rank = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    level = stops.withColumn("level", left / F.sum("weight").over(onward)).withColumn("ratio", F.col("stop") / F.col("weight"))
    # The level of the first source that doesn't stop holds for all after it.
    reached = level.withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    share = F.when(F.col("ratio") <= F.col("level"), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.col("open")))
    return reached.select("source", "source_size", share.alias("target"))


def plan(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    mark: str = "__",
) -> DataFrame:
    """All columns of ``documents``, none of which may begin with ``mark``, and __size, __source_size, __target, __whole, __extra (words of the last, fractional repetition).

    Needs doc_id, text and source. Null texts and blank ones have size 0 and are
    taken 0 words; a null source is a source; a null id is hashed as an empty
    string. Repeated rows are rows of their own. Ties in the hash order are
    broken by id and size, and rows alike in all three are interchangeable. Another
    ``mark`` than "__" begins the new columns' names instead.
    """
    if any(c.startswith(mark) for c in documents.columns):
        raise ValueError(f"a column's name begins with {mark!r}")
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = documents.withColumn(f"{mark}size", word_count(F.col("text"))).withColumn(f"{mark}key", key)
    bucket = F.substring(f"{mark}key", 1, _BUCKET_HEX)
    sums = scratch.keep(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum(f"{mark}size").alias("words")), "buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", rate).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rests = targets.select(F.col("source").alias(f"{mark}source"), "rest")
    last = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .join(rests, F.col("source").eqNullSafe(F.col(f"{mark}source")))
        .where("before <= rest")
        .groupBy(f"{mark}source")
        .agg(F.max(F.struct("bucket", "before", "rest")).alias("at"))
        .select(f"{mark}source", F.col("at.bucket").alias(f"{mark}bucket"), (F.col("at.rest") - F.col("at.before")).alias(f"{mark}room"))
    )
    per_source = targets.select(F.col("source").alias(f"{mark}of"), F.col("source_size").alias(f"{mark}source_size"), F.col("target").alias(f"{mark}target"), F.col("whole").alias(f"{mark}whole"))
    per_source = scratch.keep(per_source.join(last, F.col(f"{mark}of").eqNullSafe(F.col(f"{mark}source"))).drop(f"{mark}source"), "sources")
    scratch.drop("buckets")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    placed = rows.join(per_source, F.col("source").eqNullSafe(F.col(f"{mark}of")), "left").drop(f"{mark}of").withColumn(f"{mark}own", bucket)
    extra = F.when(F.col(f"{mark}own") < F.col(f"{mark}bucket"), F.col(f"{mark}size")).otherwise(F.lit(0).cast("long"))
    inner = placed.where(F.col(f"{mark}own") != F.col(f"{mark}bucket")).withColumn(f"{mark}extra", extra)
    earlier = Window.partitionBy("source", f"{mark}own").orderBy(f"{mark}key", "doc_id", f"{mark}size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(f"{mark}size").over(earlier), F.lit(0))
    edge = placed.where(F.col(f"{mark}own") == F.col(f"{mark}bucket")).withColumn(f"{mark}extra", F.least(f"{mark}size", F.greatest(F.lit(0), F.col(f"{mark}room") - used)).cast("long"))
    return inner.unionByName(edge).drop(f"{mark}own", f"{mark}bucket", f"{mark}room", f"{mark}key")


def _first_words(extra: str):
    import re

    word = re.compile(WORD)

    def run(batches):
        for frame in batches:
            cut = []
            for text, n in zip(frame["text"], frame[extra], strict=True):
                end = 0
                for k, m in enumerate(word.finditer(text), 1):
                    end = m.end()
                    if k == n:
                        break
                cut.append(text[:end])
            yield frame.assign(text=cut)

    return run


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mixed documents: the columns of ``documents``, a row for each whole repetition, and one for the fractional one."""
    mark = spare_mark(documents)
    planned = plan(documents, mark=mark, **how)
    columns = documents.columns
    size, extra, times = (F.col(f"{mark}{c}") for c in ("size", "extra", "times"))
    whole = planned.withColumn(f"{mark}times", F.col(f"{mark}whole") + (extra == size).cast("int")).where((size > 0) & (times > 0))
    whole = whole.withColumn(f"{mark}copy", F.explode(F.sequence(F.lit(1), times))).select(*columns)
    part = planned.where((extra > 0) & (extra < size)).select(*columns, f"{mark}extra")
    return whole.unionByName(part.mapInPandas(_first_words(f"{mark}extra"), part.schema).select(*columns))
