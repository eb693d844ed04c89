"""Differences between two copies of a dataset, located by a matrix of checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.session import broadcast_if_small, cut

#: Rows a key bucket holds on average, and the least number of buckets: buckets grow with the rows, so that one difference never makes many rows be read again.
BUCKET_ROWS, LEAST_BUCKETS = 8, 1024
_LOW = 0xFFFFFFFF


def same_hash(c: Column) -> Column:
    """A digest without regard to letter case."""
    return F.lower(c)


def same_etag(c: Column) -> Column:
    """An entity tag without weakness mark and double quotes."""
    return F.regexp_replace(c, r'^W/|"', "")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("k"), F.lit(buckets).cast("bigint"))


def _matrix(side: DataFrame, fields: Sequence[str], buckets: int, prefix: str) -> DataFrame:
    """One row per bucket: for the keys (column 0) and each field an additive hash of 2 x 64 bits.

    The two 64-bit hashes of a value are summed as 32-bit halves, so sums are exact up to 2^31 rows
    in a bucket and never overflow.
    """
    sums = []
    for i, f in enumerate([None, *fields]):
        of = [F.col("k")] if f is None else [F.col("k"), F.col(f).isNull(), F.col(f)]
        for j in range(2):
            h = F.xxhash64(F.lit(2 * i + j), *of)
            sums += [F.sum(h.bitwiseAND(_LOW)).alias(f"_{i}_{j}a"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"_{i}_{j}b")]
    m = side.groupBy(_bucket(buckets).alias("b")).agg(*sums)
    return m.select(F.col("b").alias(f"{prefix}b"), *[F.array(*[f"_{i}_{j}{x}" for j in range(2) for x in "ab"]).alias(f"{prefix}{i}") for i in range(len(fields) + 1)])


def copy_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Rows ``(row_key, field_name, difference)``: ``missing_left``, ``missing_right``, ``differs``.

    Each side is summed to a matrix of additive hashes, one cell per key bucket and column. Only
    buckets in which a cell differs are read again and joined by key, and in them only the columns
    whose cells differ are compared, null-safely. ``field_name`` is ``*`` for missing rows.

    Sides must already be normalised; ``fields`` are compared as strings. Several rows of one key
    on one side count as one: the greatest by field values, nulls least. Null keys are ignored.
    Other columns may be there under any name; they aren't read. ``buckets`` is by default a bucket
    for ``BUCKET_ROWS`` rows. The unequal buckets are written once and counted: few are broadcast, many
    are joined by a shuffle.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, max(left.count(), right.count()) // BUCKET_ROWS)
    names = [f"f{i}" for i in range(len(fields))]

    def canonical(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.struct(*[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)]).alias("v"))
        return rows.groupBy("k").agg(F.max("v").alias("v")).select("k", "v.*")

    left, right = canonical(left), canonical(right)
    cells = _matrix(left, names, buckets, "l").join(_matrix(right, names, buckets, "r"), F.col("lb") == F.col("rb"), "full_outer")
    unequal = F.lit(0)
    for i in range(len(names) + 1):
        unequal = unequal.bitwiseOR(F.when(F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")), 0).otherwise(1 << i))
    todo = broadcast_if_small(cut(cells.select(F.coalesce("lb", "rb").alias("tb"), unequal.alias("mask")).filter("mask != 0")))

    def suspects(df: DataFrame, prefix: str, mask: bool) -> DataFrame:
        kept = df.join(todo, _bucket(buckets) == F.col("tb"))
        return kept.select(*[F.col(c).alias(prefix + c) for c in ["k", *names]], *[F.col("mask").alias(f"{prefix}mask")] * mask)

    both = suspects(left, "l", True).join(suspects(right, "r", True), F.col("lk") == F.col("rk"), "full_outer")
    mask = F.coalesce("lmask", "rmask")
    found = F.when(F.col("lk").isNull(), F.array(F.struct(F.lit("*").alias("field_name"), F.lit("missing_left").alias("difference")))).when(
        F.col("rk").isNull(), F.array(F.struct(F.lit("*").alias("field_name"), F.lit("missing_right").alias("difference")))
    )
    each = [
        F.when((mask.bitwiseAND(2 << i) != 0) & ~F.col(f"l{n}").eqNullSafe(F.col(f"r{n}")), F.struct(F.lit(f).alias("field_name"), F.lit("differs").alias("difference")))
        for i, (f, n) in enumerate(zip(fields, names))
    ]
    found = found.otherwise(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return both.select(F.coalesce("lk", "rk").alias("row_key"), F.explode(found).alias("x")).select("row_key", "x.*")
