"""Cloud listings exported as JSON lines, brought to the inventory's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.session import cut

DRIVE = "id string, name string, mimeType string, size string, md5Checksum string, modifiedTime string, trashed boolean, shared boolean, ownedByMe boolean, parents array<string>, version string, owners array<struct<emailAddress:string>>"
ONEDRIVE = "id string, name string, size bigint, eTag string, deleted struct<state:string>, folder struct<childCount:int>, remoteItem struct<id:string>, file struct<hashes:struct<sha256Hash:string>>, parentReference struct<path:string>, lastModifiedDateTime string, createdBy struct<user:struct<id:string>>"
PHOTOS = "id string, filename string, mediaMetadata struct<creationTime:string>"
#: Most folders above a file whose names make its path.
PARENT_HOPS = 50


def folder_paths(folders: DataFrame, hops: int = PARENT_HOPS) -> DataFrame:
    """``(id, folder_path, is_cut)`` of ``folders (id, name, parent)``: names joined from the top, by doubling.

    Each round joins every folder with the names its ancestor has so far and is written, so chains of n
    folders take log n rounds and plans stay small. A folder has the ``hops`` names nearest to it; ``is_cut``
    says that there were more, as there always are on a cycle. Of two rows with one id the lesser holds.
    """
    held = folders.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("name", "parent")).alias("v"))
    rows = cut(held.select("id", F.array("v.name").alias("names"), F.col("v.parent").alias("up")))
    done = 1
    while done < hops + 1 and not rows.filter("up IS NOT NULL").isEmpty():
        above = rows.select(F.col("id").alias("a"), F.col("names").alias("an"), F.col("up").alias("au"))
        names = F.concat(F.coalesce("an", F.array().cast("array<string>")), "names")
        rows = cut(rows.join(above, F.col("up") == F.col("a"), "left").select("id", F.slice(names, -F.least(F.size(names), F.lit(hops + 1)), hops + 1).alias("names"), F.col("au").alias("up")))
        done *= 2
    return rows.select("id", F.array_join(F.slice("names", -F.least(F.size("names"), F.lit(hops)), hops), "/").alias("folder_path"), (F.size("names") > hops).alias("is_cut"))


def _inventory(df: DataFrame, source: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(
        F.concat(F.lit(f"{source}://"), "rel").alias("path"), "size", "mtime", zero.alias("inode"), zero.alias("dev"), F.lit(1).cast("bigint").alias("nlink"), F.lit(False).alias("is_archive_member"), F.lit(False).alias("is_bundle"),
        "is_shared", F.lit(None).cast("string").alias("precomputed_full_hash"), F.lit(source).alias("source_id"), "foreign_hash", "etag", F.col("id").alias("cloud_file_id"), "owner",
    )


def _epoch(text) -> F.Column:
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def drive_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A drive listing: without native documents, trashed entries, folders and entries lacking id or size.

    A file is shared if it says so or isn't provably one's own.
    """
    rows = spark.read.schema(DRIVE).json(path)
    folders = rows.filter("mimeType = 'application/vnd.google-apps.folder'").select("id", "name", F.try_element_at("parents", F.lit(1)).alias("parent"))
    live = rows.filter("id IS NOT NULL AND NOT coalesce(trashed, false) AND NOT startswith(coalesce(mimeType, ''), 'application/vnd.google-apps.')").withColumn("bytes", F.expr("try_cast(size AS BIGINT)")).filter("bytes >= 0")
    placed = live.withColumn("up", F.try_element_at("parents", F.lit(1))).join(folder_paths(folders).select(F.col("id").alias("fid"), "folder_path"), F.col("up") == F.col("fid"), "left")
    out = placed.select(
        "id", F.concat_ws("/", "folder_path", "name").alias("rel"), F.col("bytes").alias("size"), _epoch(F.col("modifiedTime")).alias("mtime"), (F.coalesce("shared", F.lit(False)) | ~F.coalesce("ownedByMe", F.lit(False))).alias("is_shared"),
        F.concat(F.lit("md5:"), F.lower("md5Checksum")).alias("foreign_hash"), F.col("version").alias("etag"), F.try_element_at("owners", F.lit(1))["emailAddress"].alias("owner"),
    )
    return _inventory(out, source)


def onedrive_files(spark: SparkSession, path: str, source: str, me: str) -> DataFrame:
    """A drive listing by changes: without deleted entries, folders and files lacking a SHA-256."""
    rows = spark.read.schema(ONEDRIVE).json(path).filter("id IS NOT NULL AND deleted IS NULL AND folder IS NULL AND file.hashes.sha256Hash IS NOT NULL")
    owner = F.col("createdBy.user.id")
    folder = F.regexp_replace(F.coalesce("parentReference.path", F.lit("")), "^[^:]*:/?", "")
    out = rows.select("id", F.concat_ws("/", F.nullif(folder, F.lit("")), "name").alias("rel"), "size", _epoch(F.col("lastModifiedDateTime")).alias("mtime"), (F.col("remoteItem").isNotNull() | ~F.coalesce(owner == me, F.lit(False))).alias("is_shared"), F.concat(F.lit("sha256:"), F.lower("file.hashes.sha256Hash")).alias("foreign_hash"), F.col("eTag").alias("etag"), owner.alias("owner"))
    return _inventory(out, source)


def photo_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A photo service's listing: no size and no digest; the etag is id and time of creation."""
    rows = spark.read.schema(PHOTOS).json(path).filter("id IS NOT NULL")
    made = F.col("mediaMetadata.creationTime")
    out = rows.select("id", F.coalesce("filename", "id").alias("rel"), F.lit(0).cast("bigint").alias("size"), _epoch(made).alias("mtime"), F.lit(False).alias("is_shared"), F.lit(None).cast("string").alias("foreign_hash"), F.concat_ws(":", "id", made).alias("etag"), F.lit(None).cast("string").alias("owner"))
    return _inventory(out, source)
