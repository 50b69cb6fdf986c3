"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.llm.tables import guarded, settled, small

#: A word: a run of anything but a blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from rows of source and size.

    The sources weigh ``weights`` in code point order (null last), repeating, and share
    ``share`` of all sizes. A target stops at ``most`` times its source's size; the rest is
    shared again by weight. The level at which that ends is found in one pass over the sources
    in order of size to weight. Both windows see one row per source, never documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (per_source.withColumn("place", place)
              .withColumn("weight", F.element_at(listed, (F.col("place") - 1) % len(weights) + 1))
              .withColumn("ceiling", F.lit(float(most)) * F.col("source_size")))
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    level = ((F.lit(float(share)) * F.sum("source_size").over(every)
              - F.coalesce(F.sum("ceiling").over(before), none))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)))
    leveled = ranked.withColumn("level", level).withColumn(
        "level", F.when(F.col("level") * F.col("weight") < F.col("ceiling"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("first", first).select(
        "source", "source_size",
        F.coalesce(F.least("ceiling", F.col("first") * F.col("weight")), "ceiling").alias("target"))


def draw(seed: str, key: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
          most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Every row with size, source_size, target, rate, copies and taken.

    A row is repeated floor(rate) times, plus once more if a draw seeded by the doc_id falls
    below the fraction of its source's rate, target / source_size. Nulls: text counts as empty,
    source is a source of its own, doc_id draws as one value. Rows of one doc_id draw alike.
    A source without words has rate 0; an empty table gives no rows. Columns of ``docs`` with
    the names of the results are replaced.
    """
    sized = docs.withColumn("size", word_count())
    counted = settled(sized.groupBy("source").agg(F.sum("size").alias("size")))
    targets = small(source_targets(counted, weights, share, most)
                    .withColumnRenamed("source", "__source"))
    joined = (sized.drop("source_size", "target", "rate", "copies", "taken")
              .join(targets, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    extra = (draw(seed) < F.col("rate") - whole).cast("long")
    return (joined.withColumn("rate", rate).withColumn("copies", whole + extra)
            .withColumn("taken", F.col("copies") * F.col("size")))


def emitted(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` says, with its own columns."""
    rows, back = guarded(docs, "doc_id", "text", "source")
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return back(mixed(rows, **settings).where("copies > 0").withColumn("__copy", F.explode(copies)))
