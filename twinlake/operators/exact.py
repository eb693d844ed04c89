"""Exact duplicates: candidate reduction by size, partial and full digest, groups and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.session import broadcast_if_small, cut


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``keys`` occur more than once. Keys are counted map-side and semi-joined, so no key is gathered."""
    often = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return df.join(often, on, "left_semi")


def size_buckets(df: DataFrame, min_size: int = 0) -> DataFrame:
    """Sizes that occur more than once, in ascending order."""
    return df.filter(F.col("size") >= min_size).groupBy("size").agg(F.count("*").alias("n_files")).filter("n_files > 1").orderBy("size")


def single_sizes(df: DataFrame) -> DataFrame:
    """Files whose size occurs once: no digest is needed to know them unique."""
    return df.groupBy("size").agg(F.min("path").alias("path"), F.count("*").alias("n")).filter("n = 1").select("path", "size")


def staged_digests(df: DataFrame, content: Column, sample: int = 65536) -> DataFrame:
    """``(path, size, stage, digest)``: contents are only digested as far as needed to tell files apart.

    A size that occurs once ends at stage ``size``; then only the samples of the rest are digested, and
    one that occurs once ends at ``partial``; the rest are digested whole. What moves between stages
    is path, size and sample digest. The paths whose content is needed are counted: few are broadcast,
    so that contents are filtered where they are read; many are joined by a shuffle. ``path`` is unique.
    """
    rows = df.select("path", content.alias("content"))
    sizes = cut(rows.select("path", F.length("content").alias("size")))

    def only(paths: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(paths), F.col("path") == F.col("p"), "left_semi")

    alike = cut(repeated(sizes, "size").select(F.col("path").alias("p")))
    sampled = cut(only(alike).select("path", F.length("content").alias("size"), P.partial_digest(F.col("content"), sample).alias("partial")))
    close = cut(repeated(sampled, "size", "partial").select(F.col("path").alias("p")))
    full = only(close).select("path", F.length("content").alias("size"), F.lit("full").alias("stage"), P.full_digest(F.col("content")).alias("digest"))
    partial = sampled.join(close, F.col("path") == F.col("p"), "left_anti").select("path", "size", F.lit("partial").alias("stage"), F.col("partial").alias("digest"))
    single = sizes.join(alike, F.col("path") == F.col("p"), "left_anti").select("path", "size", F.lit("size").alias("stage"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(partial).unionByName(single)


def exact_groups(df: DataFrame, min_size: int = 0) -> DataFrame:
    """One row per digest held by two or more distinct paths; size is that of the smallest path."""
    rows = df.filter((F.col("size") >= min_size) & F.col("full_hash").isNotNull())
    each = rows.groupBy("full_hash", "path").agg(F.min("size").alias("size"))
    out = each.groupBy("full_hash").agg(F.count("*").alias("n_members"), F.min(F.struct("path", "size")).alias("f"), F.sum("size").alias("bytes"))
    return out.filter("n_members >= 2").select("full_hash", "n_members", F.col("f.size").alias("size"), F.col("f.path").alias("first_path"), "bytes")


def single_digests(df: DataFrame) -> DataFrame:
    """Files outside archives whose digest no other such file has."""
    rows = df.filter("NOT is_archive_member AND full_hash IS NOT NULL")
    return rows.groupBy("full_hash").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("size").alias("size")).filter("n = 1").select("path", "full_hash", "size")
