"""Queries of the checks around moving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import manifests
from twinlake.operators.versions import latest
from twinlake.plans.inventory import INV, current
from twinlake.session import table

ACCOUNTS = ["gdrive:vault", "gdrive:studio", "onedrive:attic"]
ROOTS = ["/Users/bawis", "/Volumes"]


def _before(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").filter("snapshot_id = 3 AND path IS NOT NULL")
    return latest(files, ["path"], "delivered_at", ["size", "mtime", "etag", "source_id", "cloud_file_id", "is_shared", "is_archive_member", "full_hash"])


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of snapshot 3 as a plan, checked against snapshot 4."""
    return manifests.drifted(_before(spark, sf_dir), current(spark, sf_dir))


def cloud_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud rows that may not be acted on."""
    return current(spark, sf_dir).select("path", manifests.cloud_reject(ACCOUNTS).alias("reason")).filter("reason IS NOT NULL")


def unknown_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.unknown_accounts(current(spark, sf_dir), spark.createDataFrame([(a,) for a in ACCOUNTS], "source_id string"))


def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing all files of snapshot 3 that share a digest would be refused for."""
    return manifests.apply_plan(_before(spark, sf_dir), current(spark, sf_dir), ACCOUNTS, ROOTS)


def destination_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned destinations judged; some are spoiled for the purpose."""
    dest = F.when(F.col("source_size") % 7 == 0, F.concat(F.lit("../"), F.col("dest_expected_path"))).when(F.col("source_size") % 5 == 0, F.concat(F.lit("/"), F.col("dest_expected_path"))).otherwise(F.col("dest_expected_path"))
    return table(spark, sf_dir, "migration_entries").select("source_path", "source_size", "dest_expected_path").distinct().select("source_path", manifests.destination_reject(dest).alias("reason"))


def _trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local files as they might lie in a trash: every third with a number added to its name."""
    numbered = F.regexp_replace(P.base_name(F.col("path")), r"^(.+)(\.[^.]+)$", "$1 2$2")
    name = F.when(F.pmod(F.length("path"), F.lit(3)) == 0, numbered).otherwise(P.base_name(F.col("path")))
    return current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member").select(F.concat(F.lit("/Users/bawis/.Trash/"), F.substring(F.sha2("path", 256), 1, 4), F.lit("/"), name).alias("trash_path"), "size", "full_hash")


def trash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member").select("path", "size", "full_hash")
    return manifests.trash_candidates(moved, _trash(spark, sf_dir))


def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring the local files of snapshot 3 out of that trash."""
    gone = _before(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member").select("path", "size", "full_hash")
    return manifests.undo_plan(gone, _trash(spark, sf_dir), current(spark, sf_dir).filter("size % 2 = 0"))


_OLD = INV.replace("inv AS", "old AS").replace("snapshot_id = 4", "snapshot_id = 3")
_ACC = ", ".join(f"'{a}'" for a in ACCOUNTS)
_SHAPE = "CASE string_split(source_id, ':')[1] " + " ".join(f"WHEN '{p}' THEN regexp_matches(cloud_file_id, '{s}')" for p, s in manifests.ID_SHAPES.items()) + " ELSE true END"
_REJECT = f"CASE WHEN source_id = 'local' THEN NULL WHEN source_id NOT IN ({_ACC}) THEN 'unknown account' WHEN coalesce(cloud_file_id, '') = '' THEN 'no id' WHEN NOT {_SHAPE} THEN 'odd id' WHEN coalesce(etag, '') = '' THEN 'no etag' WHEN coalesce(is_shared, false) THEN 'shared' END"
_DRIFT = """drift AS (SELECT o.path, CASE WHEN n.path IS NULL THEN 'missing' WHEN o.size IS DISTINCT FROM n.size THEN 'size' WHEN coalesce(abs(o.mtime - n.mtime) > 0.001, false) THEN 'time'
  WHEN o.etag IS NOT NULL AND replace(regexp_replace(o.etag, '^W/', ''), '"', '') IS DISTINCT FROM replace(regexp_replace(n.etag, '^W/', ''), '"', '') THEN 'etag' ELSE 'same' END AS status FROM old o LEFT JOIN inv n ON o.path = n.path)"""
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_TRASHED = f"""trash AS (SELECT '/Users/bawis/.Trash/' || substr(sha256(path), 1, 4) || '/' || CASE WHEN length(path) % 3 = 0 THEN regexp_replace({_NAME}, '^(.+)(\\.[^.]+)$', '\\1 2\\2') ELSE {_NAME} END AS trash_path, size, full_hash
  FROM inv WHERE source_id = 'local' AND NOT is_archive_member),
names AS (SELECT DISTINCT trash_path, size, full_hash, unnest([regexp_extract(trash_path, '([^/]*)$', 1), regexp_replace(regexp_extract(trash_path, '([^/]*)$', 1), '^(.+?) \\d+(\\.[^.]+)?$', '\\1\\2')]) AS n FROM trash)"""
_FOUND = lambda t: f"""found AS (SELECT m.path, count(DISTINCT trash_path) AS n_candidates, min(trash_path) AS tp FROM {t} m LEFT JOIN names ON {_NAME.replace("path", "m.path")} = n AND m.size = names.size AND m.full_hash = names.full_hash WHERE m.source_id = 'local' AND NOT m.is_archive_member GROUP BY 1),
verdict AS (SELECT path, n_candidates, CASE WHEN n_candidates = 1 THEN tp END AS trash_path, CASE WHEN n_candidates = 0 THEN 'missing' WHEN n_candidates > 1 THEN 'ambiguous' ELSE 'found' END AS verdict FROM found)"""  # noqa: E731
_PLACE = "(" + " OR ".join(f"o.path = '{r}' OR starts_with(o.path, '{r}/')" for r in P.EXCLUDED_ROOTS) + " OR regexp_matches(o.path, '^/Users/[^/]+/Library(?:/|$)') OR regexp_matches(o.path, '^/Volumes/[^/]+/(?:" + "|".join(P.EXCLUDED_VOLUME_PARTS) + ")(?:/|$)') OR " + " OR ".join(f"contains(o.path, '{x}')" for x in P.EXCLUDED_PARTS) + ")"
_SEG = "[" + ", ".join(f"'{d}'" for d in P.EXCLUDED_DIRS) + "]"
QUERIES = {"drift": drift, "cloud_rejects": cloud_rejects, "unknown_accounts": unknown_accounts, "apply_plan": apply_plan, "destination_rejects": destination_rejects, "trash_candidates": trash_candidates, "undo_plan": undo_plan}
ORACLES = {
    "drift": f"WITH {INV}, {_OLD}, {_DRIFT} SELECT * FROM drift",
    "cloud_rejects": f"WITH {INV}, r AS (SELECT path, {_REJECT} AS reason FROM inv) SELECT * FROM r WHERE reason IS NOT NULL",
    "unknown_accounts": f"WITH {INV} SELECT source_id, count(*) AS n FROM inv WHERE source_id <> 'local' AND source_id NOT IN ({_ACC}) GROUP BY 1",
    "apply_plan": f"""WITH {INV}, {_OLD}, {_DRIFT} SELECT o.path, CASE WHEN source_id = 'local' THEN 'local' ELSE 'cloud' END AS rail, coalesce(CASE WHEN source_id <> 'local' THEN NULL WHEN is_archive_member THEN 'archive member'
        WHEN NOT ({" OR ".join(f"o.path = '{r}' OR starts_with(o.path, '{r}/')" for r in ROOTS)}) THEN 'outside roots' WHEN {_PLACE} OR list_has_any(string_split(o.path, '/'), {_SEG}) THEN 'excluded place' END,
        {_REJECT}, CASE WHEN status <> 'same' THEN 'changed: ' || status END) AS refusal FROM old o JOIN drift d ON o.path = d.path""",
    "destination_rejects": f"""WITH d AS (SELECT source_path, CASE WHEN source_size % 7 = 0 THEN '../' || dest_expected_path WHEN source_size % 5 = 0 THEN '/' || dest_expected_path ELSE dest_expected_path END AS dest FROM (SELECT DISTINCT source_path, source_size, dest_expected_path FROM migration_entries))
        SELECT source_path, CASE WHEN coalesce(dest, '') = '' THEN 'empty' WHEN starts_with(dest, '/') THEN 'absolute' WHEN list_contains(string_split(dest, '/'), '..') THEN 'leaves its root' WHEN list_has_any(string_split(dest, '/'), {_SEG}) THEN 'excluded place' END AS reason FROM d""",
    "trash_candidates": f"WITH {INV}, {_TRASHED}, {_FOUND('inv')} SELECT * FROM verdict",
    "undo_plan": f"WITH {INV}, {_OLD}, {_TRASHED}, {_FOUND('old')} SELECT v.path, CASE WHEN verdict <> 'found' THEN 'refuse: ' || verdict WHEN i.path IS NOT NULL THEN 'refuse: place taken' ELSE 'restore' END AS step FROM verdict v LEFT JOIN inv i ON i.path = v.path AND i.size % 2 = 0",
}
