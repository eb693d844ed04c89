"""Queries of the general data problems: snapshot changes, copy differences, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.operators.copydiff import copy_differences, same_etag, same_hash
from twinlake.operators.heavykeys import per_key
from twinlake.operators.snapshots import snapshot_changes
from twinlake.operators.versions import latest
from twinlake.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added, removed or changed between consecutive snapshots of ``files``."""
    return snapshot_changes(table(spark, sf_dir, "files"))


P1_SQL = """
WITH held AS (
  SELECT snapshot_id, path, source_id, size, mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, path ORDER BY delivered_at DESC NULLS LAST, source_id DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS rn
    FROM files WHERE path IS NOT NULL AND snapshot_id IS NOT NULL) WHERE rn = 1),
steps AS (
  SELECT source_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY source_id ORDER BY snapshot_id) AS before
  FROM (SELECT DISTINCT source_id, snapshot_id FROM files WHERE path IS NOT NULL)),
cur AS (SELECT h.*, s.before FROM held h JOIN steps s USING (source_id, snapshot_id) WHERE s.before IS NOT NULL),
old AS (SELECT h.*, s.snapshot_id AS later FROM held h JOIN steps s ON h.source_id = s.source_id AND h.snapshot_id = s.before)
SELECT CAST(coalesce(cur.snapshot_id, old.later) AS INTEGER) AS snapshot_id, coalesce(cur.path, old.path) AS path,
  CASE WHEN old.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM cur FULL JOIN old ON cur.path = old.path AND cur.source_id = old.source_id AND cur.snapshot_id = old.later
WHERE old.path IS NULL OR cur.path IS NULL OR cur.size IS DISTINCT FROM old.size OR abs(cur.mtime - old.mtime) > 0.001
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rows and unequal fields of plan and manifest, manifest and destination, two trees.

    A tree copy has a row where its element of hashes_per_member is there and not null: an entry with
    one such element is a row missing in the other copy, one with none is a row of neither.
    """
    fields = ["source_file_id", "source_etag", "source_size", "source_hash", "source_mime", "dest_expected_path", "action"]

    def plain(df: DataFrame, *more: str) -> DataFrame:
        shape = {"source_etag": same_etag, "source_hash": same_hash, "dest_etag": same_etag}
        return df.select("source_path", *[shape.get(c, lambda x: x)(F.col(c)).alias(c) for c in [*fields, *more]])

    plan = plain(table(spark, sf_dir, "migration_entries"))
    done = ["state", "dest_cloud_file_id", "dest_etag"]
    manifest = plain(latest(table(spark, sf_dir, "migration_manifest").filter("source_path IS NOT NULL"), ["source_path"], "updated_at", [*fields, *done]), *done)

    delivered = table(spark, sf_dir, "files").filter("snapshot_id = 4 AND path IS NOT NULL")
    there = latest(delivered, ["path"], "delivered_at", ["source_id", "cloud_file_id", "etag"]).filter("source_id = 'gdrive:vault'")
    copied = manifest.filter("state = 'done' AND dest_cloud_file_id IS NOT NULL").select(F.col("dest_cloud_file_id").alias("id"), "dest_etag")

    entries = table(spark, sf_dir, "tree_diff_entries").filter("tree_group_id IS NOT NULL AND relative_path IS NOT NULL")
    member = lambda i: same_hash(F.get("hashes_per_member", F.lit(i)))
    tree = entries.groupBy(F.concat_ws(":", F.col("tree_group_id").cast("string"), "relative_path").alias("row_key")).agg(F.max(F.struct(member(0).alias("a"), member(1).alias("b"))).alias("v"))

    def tree_copy(side: str) -> DataFrame:
        return tree.select("row_key", F.col(f"v.{side}").alias("hashes_per_member")).filter("hashes_per_member IS NOT NULL")

    pairs = {
        "plan_manifest": copy_differences(plan, manifest, "source_path", fields),
        "manifest_dest": copy_differences(copied, there.select(F.col("cloud_file_id").alias("id"), same_etag(F.col("etag")).alias("dest_etag")), "id", ["dest_etag"]),
        "tree": copy_differences(tree_copy("a"), tree_copy("b"), "row_key", ["hashes_per_member"]),
    }
    out = [df.select(F.lit(name).alias("copy_pair"), "row_key", "field_name", "difference") for name, df in pairs.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_P5_FIELD = "SELECT 'plan_manifest' AS copy_pair, l.source_path AS row_key, '{0}' AS field_name, 'differs' AS difference FROM plan l JOIN man r USING (source_path) WHERE l.{0} IS DISTINCT FROM r.{0}"
P5_SQL = (
    """
WITH plan AS (SELECT DISTINCT source_path, source_file_id, replace(regexp_replace(source_etag, '^W/', ''), '"', '') AS source_etag, source_size,
    lower(source_hash) AS source_hash, source_mime, dest_expected_path, action FROM migration_entries WHERE source_path IS NOT NULL),
man AS (SELECT source_path, source_file_id, replace(regexp_replace(source_etag, '^W/', ''), '"', '') AS source_etag, source_size,
    lower(source_hash) AS source_hash, source_mime, dest_expected_path, action, state, dest_cloud_file_id, replace(regexp_replace(dest_etag, '^W/', ''), '"', '') AS dest_etag
  FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY updated_at DESC) AS rn FROM migration_manifest WHERE source_path IS NOT NULL) WHERE rn = 1),
dest AS (SELECT cloud_file_id AS id, replace(regexp_replace(etag, '^W/', ''), '"', '') AS etag
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC) AS rn FROM files WHERE snapshot_id = 4) WHERE rn = 1 AND source_id = 'gdrive:vault' AND cloud_file_id IS NOT NULL),
copied AS (SELECT dest_cloud_file_id AS id, dest_etag AS etag FROM man WHERE state = 'done' AND dest_cloud_file_id IS NOT NULL),
tree AS (SELECT DISTINCT CAST(tree_group_id AS VARCHAR) || ':' || relative_path AS row_key, lower(hashes_per_member[1]) AS a, lower(hashes_per_member[2]) AS b FROM tree_diff_entries)
SELECT 'plan_manifest' AS copy_pair, source_path AS row_key, '*' AS field_name, 'missing_right' AS difference FROM plan WHERE source_path NOT IN (SELECT source_path FROM man)
UNION ALL SELECT 'plan_manifest', source_path, '*', 'missing_left' FROM man WHERE source_path NOT IN (SELECT source_path FROM plan)
UNION ALL """
    + " UNION ALL ".join(_P5_FIELD.format(f) for f in ["source_file_id", "source_etag", "source_size", "source_hash", "source_mime", "dest_expected_path", "action"])
    + """
UNION ALL SELECT 'manifest_dest', coalesce(l.id, r.id), CASE WHEN l.id IS NULL OR r.id IS NULL THEN '*' ELSE 'dest_etag' END,
  CASE WHEN l.id IS NULL THEN 'missing_left' WHEN r.id IS NULL THEN 'missing_right' ELSE 'differs' END
  FROM copied l FULL JOIN dest r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.etag IS DISTINCT FROM r.etag
UNION ALL SELECT 'tree', row_key, CASE WHEN a IS NULL OR b IS NULL THEN '*' ELSE 'hashes_per_member' END,
  CASE WHEN a IS NULL THEN 'missing_left' WHEN b IS NULL THEN 'missing_right' ELSE 'differs' END FROM tree WHERE a IS DISTINCT FROM b
"""
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per size of ``scan_stage`` and full_hash of ``files`` the file with the oldest mtime."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = table(spark, sf_dir, "scan_stage").select(
        F.lit("scan_stage.size").alias("field_name"), F.col("scan_id").alias("scope"), F.col("size").cast("string").alias("bucket"), "path", "mtime", F.col("staged_ts").alias("version")
    )
    hashed = table(spark, sf_dir, "files").filter("snapshot_id = 4").select(
        F.lit("files.full_hash").alias("field_name"), F.lit("4").alias("scope"), F.col("full_hash").alias("bucket"), "path", "mtime", F.unix_micros(F.col("delivered_at").cast("timestamp")).cast("double").alias("version")
    )
    rows = staged.unionByName(hashed).filter("path IS NOT NULL").repartition(parts, "scope", "path")
    held = latest(rows, ["field_name", "scope", "path"], "version", ["mtime", "bucket"]).filter("bucket IS NOT NULL")
    oldest = F.min(F.struct(F.col("mtime").isNull().alias("none"), "mtime", "path"))
    states = per_key(held, ["field_name", "scope", "bucket"], {"first": oldest, "n": F.count("*")}, {"first": F.min("first"), "n": F.sum("n")})
    return states.filter("n >= 2").select("field_name", "scope", "bucket", F.col("first.path").alias("path"))


P6_SQL = """
WITH staged AS (SELECT 'scan_stage.size' AS field_name, scan_id AS scope, CAST(size AS VARCHAR) AS bucket, path, mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id, path ORDER BY staged_ts DESC, mtime DESC, CAST(size AS VARCHAR) DESC) AS rn FROM scan_stage WHERE path IS NOT NULL) WHERE rn = 1),
hashed AS (SELECT 'files.full_hash' AS field_name, '4' AS scope, full_hash AS bucket, path, mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC, mtime DESC, full_hash DESC) AS rn FROM files WHERE snapshot_id = 4 AND path IS NOT NULL) WHERE rn = 1),
every AS (SELECT * FROM staged UNION ALL SELECT * FROM hashed),
ranked AS (SELECT *, count(*) OVER (PARTITION BY field_name, scope, bucket) AS n,
    row_number() OVER (PARTITION BY field_name, scope, bucket ORDER BY mtime ASC NULLS LAST, path) AS rn FROM every WHERE bucket IS NOT NULL)
SELECT field_name, scope, bucket, path FROM ranked WHERE rn = 1 AND n >= 2
"""

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p6_found": p6_found}
ORACLES = {"p1_found": P1_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
