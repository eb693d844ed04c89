"""Per-key processing that doesn't slow down on keys holding most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one chunk: what one task handles of one key at a time.
CHUNK_ROWS = 1 << 18


def running_offsets(df: DataFrame, keys: Sequence[str], weight: Column | None = None, order: Sequence[Column] | None = None, out: str = "row_no") -> DataFrame:
    """``df`` with ``out``: per key the sum of ``weight`` (default 1: a gapless number) over the rows before.

    Exact offsets: weights are summed per key and input partition, those sums are added up over the
    partitions before, and a row's value is its partition's offset plus the running sum within the
    partition, in ``order``. No task sees more of a key than one input partition holds of it. ``df``
    must come straight from storage, written rows (``session.cut``) or a hash exchange with a stated
    number of partitions, so that its partitions are the same each time they are read; round-robin and
    range exchanges aren't, as they depend on the columns read. A null key is a key of its own.
    """
    keys = list(keys)
    at = df.withColumn("_part", F.spark_partition_id()).withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint"))
    sums = at.groupBy(*keys, "_part").agg(F.sum("_w").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("_off", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_op"), "_off")
    on = F.col("_part") == F.col("_op")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_part").orderBy(*(order or [F.lit(0)]))
    place = F.row_number().over(within) - 1 if weight is None else F.coalesce(F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(offsets, on).withColumn(out, (F.col("_off") + place).cast("bigint")).drop("_part", "_op", "_off", "_w", *[f"_k_{k}" for k in keys])


def numbered_chunks(df: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``row_no`` (0, 1, ... within each key) and ``chunk_no``, its equal-sized chunk."""
    return running_offsets(df, keys).withColumn("chunk_no", F.floor(F.col("row_no") / chunk_rows))


def per_key(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], merged: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per-key states: ``partial`` aggregates over equal-sized chunks, ``merged`` over a key's chunks.

    ``merged`` refers to the columns of ``partial``; chunks are merged in the order of their
    numbers where an expression asks for it (``chunk_no`` is there). A null key is a key.
    """
    keys = list(keys)
    chunks = numbered_chunks(df, keys, chunk_rows).groupBy(*keys, "chunk_no").agg(*[c.alias(n) for n, c in partial.items()])
    return chunks.groupBy(*keys).agg(*[c.alias(n) for n, c in merged.items()])
