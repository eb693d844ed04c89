"""Inventories: which files count, how bundles and archives enter, and how sources are joined to one list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P


def reject_reason(path: Column, size: Column, min_size: int = 0, globs: Sequence[str] = ()) -> Column:
    """Why a file isn't scanned, by the first test that it fails; null for a file that is."""
    return (
        F.when(P.excluded_segment(P.parent(path)), "folder name").when(P.excluded_place(path), "excluded place").when(P.matches_any(path, globs), "pattern")
        .when(path.endswith(P.PLACEHOLDER_SUFFIX), "placeholder").when(size < min_size, "size")
    )


def root_verdict(root: Column) -> Column:
    """Why a folder can't be scanned as a root; null if it can. A root needs three parts with the slash."""
    return F.when(F.trim(root) == "", "empty").when(P.depth(root) <= 2, "too shallow").when(P.excluded_place(root), "excluded place")


def additive_digest(c: Column) -> Column:
    """Eight sums of 32 bits over the rows' SHA-256, as text: equal for equal multisets of rows, in any order."""
    h = F.sha2(c, 256)
    return F.concat_ws("-", *[F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")).cast("string") for i in range(8)])


def rolled_up(df: DataFrame, root: Column, min_size: int = 0) -> DataFrame:
    """One row per bundle root: its files, total size, newest mtime and a digest of (relative path, size, hash).

    The digest is additive, so a bundle of any number of files is summed map-side and never gathered.
    Files without a root stay out; bundles below ``min_size`` are dropped.
    """
    rel = F.substr("path", F.length("_root") + 2)
    entry = F.concat_ws("\x00", rel, F.col("size").cast("string"), F.coalesce("full_hash", F.lit("")))
    rows = df.withColumn("_root", root).filter("_root IS NOT NULL AND _root != ''")
    out = rows.groupBy("_root").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"), F.max("mtime").alias("mtime"), additive_digest(entry).alias("digest"))
    return out.filter(F.col("size") >= min_size).withColumnRenamed("_root", "path")


def member_rows(df: DataFrame) -> DataFrame:
    """Archive members with their archive's mtime and no inode of their own; members of unknown archives keep theirs."""
    members = df.filter("is_archive_member").withColumn("outer_path", P.outer_archive(F.col("path")))
    outers = df.filter("NOT is_archive_member").select(F.col("path").alias("_o"), F.col("mtime").alias("_om"), F.col("size").alias("outer_size"))
    out = members.join(outers, F.col("outer_path") == F.col("_o"), "left")
    return out.select("path", "outer_path", "size", F.coalesce("_om", "mtime").alias("mtime"), "outer_size", "full_hash", F.lit(0).cast("bigint").alias("inode"))


def united_sources(df: DataFrame, keep_unhashed: bool = False) -> DataFrame:
    """Local rows and the cloud rows that carry a provider digest, which then is their known digest."""
    cloud = df.filter("source_id != 'local'")
    cloud = cloud if keep_unhashed else cloud.filter("foreign_hash IS NOT NULL")
    return df.filter("source_id = 'local'").unionByName(cloud.withColumn("precomputed_full_hash", F.coalesce("foreign_hash", "precomputed_full_hash")))


def near_duplicate_intake(df: DataFrame) -> DataFrame:
    """Local files outside archives that are large enough images, audio or video, with their kind."""
    ext = P.suffix(F.col("path"))
    kind = F.when(ext.isin(*P.IMAGE_SUFFIXES) & (F.col("size") >= 10_000), "image").when(ext.isin(*P.AUDIO_SUFFIXES) & (F.col("size") >= 100_000), "audio").when(ext.isin(*P.VIDEO_SUFFIXES) & (F.col("size") >= 1_000_000), "video")
    return df.filter("NOT is_archive_member AND source_id = 'local'").withColumn("kind", kind).filter("kind IS NOT NULL")
