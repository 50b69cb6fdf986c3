"""Tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from frameprobe.session import ensure_checkpoint_dir, scratch_path

#: A table is broadcast up to this many rows; every caller keeps its rows under 200 bytes.
BROADCAST_ROWS = 200_000

ROW = "__row_id"

#: Rows of an Arrow batch of texts; Spark's own default of ten thousand long texts is a lot for a worker.
BATCH_ROWS = 1_000


def settled(df: DataFrame) -> DataFrame:
    """The rows as checkpointed in the shared folder, so that a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``written`` with a row number (unique, not gapless) that no later scan can change."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A settled table with the broadcast hint if its counted rows allow it, else without.

    ``weight`` says for how many rows a row of any width counts.
    """
    df = settled(df)
    count = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if count <= rows else df


def guarded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``needed`` under names that no operator uses, and the way back."""
    names = {c: c if c in needed else f"__c{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return frame, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from here on, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, text: str, fields: list[StructField],
              function: Callable[[pa.Array], list], drop: bool = False) -> DataFrame:
    """The rows with the columns that ``function`` makes from each Arrow batch of ``text``.

    ``drop`` leaves ``text`` out. ``function`` returns one array for each of ``fields``.
    """
    short_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if not (drop and f.name == text)]
    names = [f.name for f in [*kept, *fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.column(batch.schema.get_field_index(text)))
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(x) for x in made)], names=names)

    return df.mapInArrow(run, StructType([*kept, *fields]))
