"""Copying between sources: the plan, resuming, verification, clean-up refusals and undo, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.versions import latest

# Fixed value: types of documents that only exist at their provider.
NATIVE_MIME = "application/vnd.google-apps."
# Largest file of a destination in bytes.
FILE_LIMITS = {"gdrive": 5 * 1024**4, "onedrive": 250 * 1024**3}


def file_limit(dest_id: str, gigabytes: float | None = None) -> int | None:
    """Bytes a file may have at the destination; null for no limit."""
    return int(gigabytes * 1024**3) if gigabytes else FILE_LIMITS.get(dest_id.split(":", 1)[0])


def migration_plan(source: DataFrame, dest: DataFrame, limit: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), min_size: int = 0, max_size: int | None = None, exclude_shared: bool = True, exclude_native: bool = True) -> DataFrame:
    """``(source_path, dest_expected_path, action, reason)`` for each source file that passes the filters.

    In this order: shared files are deferred, then native documents (by ``mime``, where the source has that
    column: they have no bytes to copy), files outside patterns or sizes dropped, files above the
    limit are errors, files that the destination holds with equal size and a digest of one algorithm
    are skipped, all others copied. ``max_size`` is inclusive. The destination is joined by relative path;
    of several files at one path, that of the greatest path counts.
    """
    d = dest.withColumn("rel", P.without_scheme(F.col("path"), F.col("source_id"))).filter("rel != ''").groupBy("rel").agg(F.max(F.struct("path", "size", "foreign_hash")).alias("v")).select(F.col("rel").alias("_rel"), F.col("v.size").alias("_size"), F.col("v.foreign_hash").alias("_hash"))
    rows = source.withColumn("dest_expected_path", P.relative_destination(F.col("path"), F.col("source_id"))).join(d, F.col("dest_expected_path") == F.col("_rel"), "left")
    tagged = (P.digest_algorithm(F.col("foreign_hash")) == P.digest_algorithm(F.col("_hash"))) & (P.digest_hex(F.col("foreign_hash")) == P.digest_hex(F.col("_hash")))
    there = F.coalesce((F.col("size") == F.col("_size")) & tagged, F.lit(False))
    dropped = (~P.matches_any(F.col("path"), include) if include else F.lit(False)) | P.matches_any(F.col("path"), exclude) | (F.col("size") < min_size)
    dropped = dropped if max_size is None else dropped | (F.col("size") > max_size)
    over = F.lit(False) if limit is None else F.col("size") > limit
    native = F.coalesce(F.col("mime").startswith(NATIVE_MIME), F.lit(False)) & F.lit(exclude_native) if "mime" in source.columns else F.lit(False)
    shared = F.coalesce("is_shared", F.lit(False)) & F.lit(exclude_shared)
    action = F.when(shared | native, "defer").when(dropped, None).when(over, "error").when(there, "skip").otherwise("copy")
    reason = {"defer": "shared file", "error": "over size limit", "skip": "identical at destination", "copy": "eligible"}
    out = rows.withColumn("action", action).filter("action IS NOT NULL")
    why = F.lit(None).cast("string")
    for k, v in reason.items():
        why = F.when(F.col("action") == k, v).otherwise(why)
    why = F.when(native & ~shared, "native document").otherwise(why)
    return out.select("source_id", F.col("path").alias("source_path"), "size", "dest_expected_path", "action", why.alias("reason"))


def resumed(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """The new manifest: rows done before are skipped and carry their state; other rows start as planned."""
    done = latest(manifest.filter("source_path IS NOT NULL"), ["source_path"], "updated_at", ["state", "dest_cloud_file_id", "dest_etag", "verified", "cleanup_done"]).filter("state = 'done'")
    done = done.select(F.col("source_path").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("dest_cloud_file_id", "dest_etag", "verified", "cleanup_done")])
    rows = plan.filter("source_path IS NOT NULL").dropDuplicates(["source_path"]).join(done, F.col("source_path") == F.col("_p"), "left")
    state = F.when(F.col("_p").isNotNull(), "skipped").when(F.col("action") == "copy", "pending").otherwise("skipped")
    return rows.select("source_path", "action", state.alias("state"), F.col("_p").isNotNull().alias("is_resumed"), F.col("_dest_cloud_file_id").alias("dest_cloud_file_id"), F.col("_dest_etag").alias("dest_etag"), F.coalesce("_verified", F.lit(False)).alias("verified"), F.coalesce("_cleanup_done", F.lit(False)).alias("cleanup_done"))


def verified(manifest: DataFrame, dest: DataFrame, same_etag) -> DataFrame:
    """``(source_path, status, verified)`` of rows done: ``missing``, ``drifted`` or ``verified`` at the destination.

    ``dest (cloud_file_id, etag)``; etags are compared after ``same_etag``. With a digest of the source
    and one of the destination in one algorithm, a difference is ``mismatch``.
    """
    there = dest.filter("cloud_file_id IS NOT NULL").groupBy(F.col("cloud_file_id").alias("_id")).agg(F.max("etag").alias("_etag"))
    rows = manifest.filter("state = 'done'").join(there, F.col("dest_cloud_file_id") == F.col("_id"), "left")
    match = P.digests_match(F.col("source_hash"), F.concat_ws(":", "uploaded_hash_algo", "uploaded_hash"))
    status = F.when(F.col("_id").isNull(), "missing").when(~same_etag(F.col("dest_etag")).eqNullSafe(same_etag(F.col("_etag"))), "drifted").when(match == F.lit(False), "mismatch").otherwise("verified")
    return rows.select("source_path", status.alias("status"), (status == "verified").alias("verified"))


def cleanup_refusals(manifest: DataFrame) -> DataFrame:
    """Rows done for which sources may not be removed yet, and why: any such row refuses the whole clean-up."""
    reason = F.when(~F.coalesce("verified", F.lit(False)), "not verified").when(F.col("verified_ts").isNull() | F.isnan("verified_ts"), "no time of verification")
    return manifest.filter("state = 'done'").select("source_path", reason.alias("reason")).filter("reason IS NOT NULL")


def undo_plan(manifest: DataFrame) -> DataFrame:
    """What undoing would do to each row done, and the state after it."""
    cleaned = F.coalesce("cleanup_done", F.lit(False))
    step = F.when(cleaned & F.col("source_cloud_trash_id").isNull(), "refuse: no id in the trash").when(cleaned, "restore source, remove copy").when(F.col("dest_cloud_file_id").isNull(), "refuse: no copy").otherwise("remove copy")
    return manifest.filter("state = 'done'").select("source_path", step.alias("step"), F.when(step.startswith("refuse"), "done").otherwise("pending").alias("state_after"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def hash_verdict(source_hash: Column, algorithm: Column, uploaded: Column) -> Column:
    """``match``, ``differ`` or ``unknown`` where algorithms differ or a digest is missing."""
    m = P.digests_match(source_hash, F.concat_ws(":", algorithm, uploaded))
    return F.when(m, "match").when(~m, "differ").otherwise("unknown")


def copy_seconds(size: Column, megabits: float) -> Column:
    """Time that a throttled copy of ``size`` bytes takes."""
    return size * 8 / (megabits * 1e6)
