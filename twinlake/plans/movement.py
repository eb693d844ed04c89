"""Queries over reconciliation, caches and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import caches, migrate, reconcile
from twinlake.operators.copydiff import same_etag
from twinlake.operators.versions import latest
from twinlake.plans.inventory import INV, current
from twinlake.session import table

BUDGET = 40_000_000
MANIFEST = ["source_id", "source_hash", "action", "state", "dest_cloud_file_id", "dest_etag", "uploaded_hash_algo", "uploaded_hash", "verified", "verified_ts", "cleanup_done", "source_cloud_trash_id"]


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests known from the snapshot before."""
    before = table(spark, sf_dir, "files").filter("snapshot_id = 3 AND source_id LIKE 'onedrive:%'")
    return before.select("source_id", "cloud_file_id", "etag", F.col("full_hash").alias("blake3"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.canonical_choice(reconcile.cross_source_buckets(current(spark, sf_dir)), _cache(spark, sf_dir))


def reconcile_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file of a size held by several sources gets a comparable digest."""
    return _choices(spark, sf_dir).select("path", "bucket_algorithm", "choice", "canonical")


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets to fetch, taken greedily within the budget."""
    return reconcile.fetch_plan(_choices(spark, sf_dir), BUDGET)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = _choices(spark, sf_dir)
    return reconcile.reconciled_files(choices, reconcile.fetch_plan(choices, BUDGET))


def hash_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of snapshot 3 as the cache, those of snapshot 4 put into it; some of them not computed yet."""
    files = table(spark, sf_dir, "files").filter("path IS NOT NULL AND source_id = 'local'")
    side = lambda n, h: latest(files.filter(F.col("snapshot_id") == n), ["path"], "delivered_at", ["size", "mtime", "full_hash"]).withColumn("full_hash", h)
    return caches.upserted(side(3, F.col("full_hash")), side(4, F.when(F.col("size") % 2 == 0, F.col("full_hash"))), values=["full_hash"])


def hash_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of snapshot 4 with the digest known from snapshot 3."""
    old = latest(table(spark, sf_dir, "files").filter("snapshot_id = 3 AND path IS NOT NULL"), ["path"], "delivered_at", ["size", "mtime", "full_hash"])
    return caches.looked_up(current(spark, sf_dir).select("path", "size", "mtime"), old, ["full_hash"])


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the staging table holds after every insert replaced its path."""
    return caches.stage_replaced(table(spark, sf_dir, "scan_stage"))


def stage_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows of the last day before the newest, per scan."""
    stage = table(spark, sf_dir, "scan_stage")
    now = stage.agg(F.max("staged_ts")).first()[0] or 0.0
    return caches.unexpired(stage, "staged_ts", now, 60 * 86400.0).groupBy("scan_id").agg(F.count("*").alias("n"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.cache_stats(table(spark, sf_dir, "scan_stage"), "scan_id", "inode")


def signals_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal cache: per path and source what was extracted last."""
    rows = table(spark, sf_dir, "signal_sets").select("path", "source_id", "mime_top", "id3_artist", "id3_album", "pdf_class", "extracted_at")
    return caches.put_latest(rows, ["path", "source_id"], "extracted_at")


def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan to copy two sources into the vault."""
    files = current(spark, sf_dir)
    return migrate.migration_plan(files.filter("source_id IN ('gdrive:studio', 'gdrive:household')"), files.filter("source_id = 'gdrive:vault'"), 1_000_000, exclude=["*.mov"], min_size=400)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "migration_manifest").filter("source_path IS NOT NULL"), ["source_path"], "updated_at", MANIFEST)


def migration_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.resumed(table(spark, sf_dir, "migration_entries"), table(spark, sf_dir, "migration_manifest"))


def migration_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether copies are still at the destination as they were made."""
    return migrate.verified(_manifest(spark, sf_dir), current(spark, sf_dir).filter("source_id = 'gdrive:vault'"), same_etag)


def migration_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.cleanup_refusals(_manifest(spark, sf_dir))


def migration_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.undo_plan(_manifest(spark, sf_dir))


def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.counts(_manifest(spark, sf_dir), "action", "state")


def migration_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether uploaded digests match the source's, where they can be compared; and throttled copy time."""
    rows = _manifest(spark, sf_dir).filter("state = 'done'")
    return rows.select("source_path", migrate.hash_verdict(F.col("source_hash"), F.col("uploaded_hash_algo"), F.col("uploaded_hash")).alias("verdict"), P.digest_algorithm(F.col("source_hash"), "blake3").alias("algorithm"))


_ALGO = "CASE WHEN instr({0}, ':') > 1 THEN lower(string_split({0}, ':')[1]) {1} END"
_TAG = lambda c: _ALGO.format(c, "")
_BARE = lambda c: _ALGO.format(c, f"WHEN {c} IS NOT NULL AND instr({c}, ':') = 0 AND {c} <> '' THEN 'blake3'")
_HEX = lambda c: f"lower(CASE WHEN instr({c}, ':') > 0 THEN regexp_extract({c}, '^[^:]*:(.*)$', 1) ELSE {c} END)"
_MATCH = lambda a, b: f"CASE WHEN {_BARE(a)} = {_BARE(b)} AND {_HEX(a)} <> '' AND {_HEX(b)} <> '' THEN {_HEX(a)} = {_HEX(b)} END"
_CHOICES = f"""{INV}, r AS (SELECT *, {_TAG("foreign_hash")} AS algorithm FROM inv WHERE NOT is_archive_member AND size IS NOT NULL),
b AS (SELECT size, min(path) AS first_path, CASE WHEN count(algorithm) = count(*) AND min(algorithm) = max(algorithm) THEN min(algorithm) END AS bucket_algorithm FROM r GROUP BY size HAVING count(*) >= 2 AND count(DISTINCT source_id) >= 2),
k AS (SELECT source_id, cloud_file_id, etag, max(full_hash) AS cached FROM files WHERE snapshot_id = 3 AND source_id LIKE 'onedrive:%' AND cloud_file_id IS NOT NULL AND etag IS NOT NULL GROUP BY ALL),
j AS (SELECT r.*, b.first_path, b.bucket_algorithm, k.cached, CASE WHEN bucket_algorithm IS NOT NULL THEN 'same algorithm' WHEN r.source_id = 'local' THEN 'local' WHEN cached IS NOT NULL THEN 'cached' WHEN r.cloud_file_id IS NULL OR r.etag IS NULL THEN 'unfetchable' ELSE 'fetch' END AS choice
  FROM r JOIN b USING (size) LEFT JOIN k ON r.source_id = k.source_id AND r.cloud_file_id = k.cloud_file_id AND r.etag = k.etag),
choices AS (SELECT *, CASE choice WHEN 'same algorithm' THEN {_HEX("foreign_hash")} WHEN 'local' THEN full_hash WHEN 'cached' THEN cached END AS canonical FROM j)"""
_FETCH = f"""WITH RECURSIVE {_CHOICES}, need AS (SELECT size, first_path, count(*) AS n_fetches, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY first_path, size) AS i FROM choices WHERE choice = 'fetch' GROUP BY size, first_path),
fold(i, rest, taken) AS (SELECT CAST(0 AS BIGINT), CAST({BUDGET} AS BIGINT), false UNION ALL SELECT n.i, CASE WHEN n.bytes <= f.rest THEN f.rest - n.bytes ELSE f.rest END, n.bytes <= f.rest FROM fold f JOIN need n ON n.i = f.i + 1)"""
_MAN = "man AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY updated_at DESC) AS rn FROM migration_manifest WHERE source_path IS NOT NULL) WHERE rn = 1)"
_ETAG = lambda c: f"""replace(regexp_replace({c}, '^W/', ''), '"', '')"""
_SIDE = lambda n: f"(SELECT path, size, mtime, full_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC) AS rn FROM files WHERE snapshot_id = {n} AND path IS NOT NULL) WHERE rn = 1)"
_LOCAL = lambda n: _SIDE(n).replace("path IS NOT NULL", "path IS NOT NULL AND source_id = 'local'")
_NEW = "CASE WHEN n.size % 2 = 0 THEN n.full_hash END"
_REL = "CASE WHEN starts_with(path, source_id || '://') THEN substr(path, length(source_id) + 4) ELSE path END"
QUERIES = {
    "reconcile_choices": reconcile_choices, "fetch_plan": fetch_plan, "reconciled": reconciled, "hash_cache_upsert": hash_cache_upsert, "hash_cache_lookup": hash_cache_lookup, "staged_rows": staged_rows, "stage_kept": stage_kept,
    "cache_stats": cache_stats, "signals_latest": signals_latest, "migration_plan": migration_plan, "migration_resumed": migration_resumed, "migration_verified": migration_verified, "migration_refusals": migration_refusals,
    "migration_undo": migration_undo, "migration_counts": migration_counts, "migration_hashes": migration_hashes,
}
ORACLES = {
    "reconcile_choices": f"WITH {_CHOICES} SELECT path, bucket_algorithm, choice, canonical FROM choices",
    "fetch_plan": f"{_FETCH} SELECT size, first_path, n_fetches, bytes, taken FROM need JOIN fold USING (i)",
    "reconciled": f"""{_FETCH}, t AS (SELECT size, taken FROM need JOIN fold USING (i)), x AS (SELECT c.*, NOT coalesce(t.taken, true) AS deferred FROM choices c LEFT JOIN t USING (size)),
        y AS (SELECT *, CASE WHEN NOT deferred AND canonical IS NOT NULL THEN canonical ELSE full_hash END AS h FROM x)
        SELECT path, source_id, h AS full_hash, (source_id <> 'local' AND NOT deferred AND canonical IS NOT NULL) OR h IS DISTINCT FROM full_hash AS reconciled, CASE WHEN deferred THEN 'budget exceeded' ELSE choice END AS status FROM y""",
    "hash_cache_upsert": f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN o.size ELSE n.size END AS size, CASE WHEN n.path IS NULL THEN o.mtime ELSE n.mtime END AS mtime,
        CASE WHEN n.path IS NULL THEN o.full_hash WHEN o.size = n.size AND abs(o.mtime - n.mtime) <= 1e-6 THEN coalesce({_NEW}, o.full_hash) ELSE {_NEW} END AS full_hash FROM {_LOCAL(3)} o FULL JOIN {_LOCAL(4)} n ON o.path = n.path""",
    "hash_cache_lookup": f"SELECT n.path, n.size, n.mtime, o.full_hash, o.path IS NOT NULL AS is_hit FROM {_SIDE(4)} n LEFT JOIN {_SIDE(3)} o ON o.path = n.path AND o.size = n.size AND abs(o.mtime - n.mtime) <= 1e-6",
    "staged_rows": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, path ORDER BY staged_ts DESC, size DESC, mtime DESC) AS rn FROM scan_stage) WHERE rn = 1",
    "stage_kept": "SELECT scan_id, count(*) AS n FROM scan_stage WHERE staged_ts >= (SELECT max(staged_ts) FROM scan_stage) - 5184000.0 GROUP BY 1",
    "cache_stats": "SELECT scan_id, count(*) AS n_rows, count(inode) AS n_known FROM scan_stage GROUP BY 1",
    "signals_latest": "SELECT path, source_id, mime_top, id3_artist, id3_album, pdf_class, extracted_at FROM (SELECT *, row_number() OVER (PARTITION BY path, source_id ORDER BY extracted_at DESC, mime_top DESC NULLS LAST, id3_artist DESC NULLS LAST, id3_album DESC NULLS LAST, pdf_class DESC NULLS LAST) AS rn FROM signal_sets) WHERE rn = 1",
    "migration_plan": f"""WITH {INV}, d AS (SELECT {_REL} AS rel, arg_max(size, path) AS dsize, arg_max(foreign_hash, path) AS dhash FROM inv WHERE source_id = 'gdrive:vault' GROUP BY 1),
        s AS (SELECT *, array_to_string(list_filter(string_split({_REL}, '/'), lambda p: p <> '' AND p <> '.'), '/') AS rel FROM inv WHERE source_id IN ('gdrive:studio', 'gdrive:household')),
        a AS (SELECT s.*, CASE WHEN is_shared THEN 'defer' WHEN ends_with(path, '.mov') OR size < 400 THEN NULL WHEN size > 1000000 THEN 'error'
          WHEN size = dsize AND {_TAG("foreign_hash")} = {_TAG("dhash")} AND {_HEX("foreign_hash")} = {_HEX("dhash")} THEN 'skip' ELSE 'copy' END AS action FROM s LEFT JOIN d USING (rel))
        SELECT source_id, path AS source_path, size, rel AS dest_expected_path, action, CASE action WHEN 'defer' THEN 'shared file' WHEN 'error' THEN 'over size limit' WHEN 'skip' THEN 'identical at destination' ELSE 'eligible' END AS reason FROM a WHERE action IS NOT NULL""",
    "migration_resumed": f"""WITH {_MAN}, p AS (SELECT DISTINCT source_path, action FROM migration_entries WHERE source_path IS NOT NULL)
        SELECT p.source_path, p.action, CASE WHEN m.source_path IS NOT NULL THEN 'skipped' WHEN p.action = 'copy' THEN 'pending' ELSE 'skipped' END AS state, m.source_path IS NOT NULL AS is_resumed, m.dest_cloud_file_id, m.dest_etag, coalesce(m.verified, false) AS verified, coalesce(m.cleanup_done, false) AS cleanup_done
        FROM p LEFT JOIN man m ON m.source_path = p.source_path AND m.state = 'done'""",
    "migration_verified": f"""WITH {INV}, {_MAN}, d AS (SELECT cloud_file_id AS id, max(etag) AS etag FROM inv WHERE source_id = 'gdrive:vault' AND cloud_file_id IS NOT NULL GROUP BY 1), u AS (SELECT *, concat_ws(':', uploaded_hash_algo, uploaded_hash) AS up FROM man WHERE state = 'done'),
        s AS (SELECT source_path, CASE WHEN d.id IS NULL THEN 'missing' WHEN {_ETAG("dest_etag")} IS DISTINCT FROM {_ETAG("d.etag")} THEN 'drifted' WHEN ({_MATCH("source_hash", "up")}) = false THEN 'mismatch' ELSE 'verified' END AS status FROM u LEFT JOIN d ON u.dest_cloud_file_id = d.id)
        SELECT source_path, status, status = 'verified' AS verified FROM s""",
    "migration_refusals": f"WITH {_MAN}, r AS (SELECT source_path, CASE WHEN NOT coalesce(verified, false) THEN 'not verified' WHEN verified_ts IS NULL OR isnan(verified_ts) THEN 'no time of verification' END AS reason FROM man WHERE state = 'done') SELECT * FROM r WHERE reason IS NOT NULL",
    "migration_undo": f"""WITH {_MAN}, s AS (SELECT source_path, CASE WHEN coalesce(cleanup_done, false) AND source_cloud_trash_id IS NULL THEN 'refuse: no id in the trash' WHEN coalesce(cleanup_done, false) THEN 'restore source, remove copy'
        WHEN dest_cloud_file_id IS NULL THEN 'refuse: no copy' ELSE 'remove copy' END AS step FROM man WHERE state = 'done') SELECT source_path, step, CASE WHEN starts_with(step, 'refuse') THEN 'done' ELSE 'pending' END AS state_after FROM s""",
    "migration_counts": f"WITH {_MAN} SELECT action, state, count(*) AS n FROM man GROUP BY 1, 2",
    "migration_hashes": f"""WITH {_MAN}, u AS (SELECT *, concat_ws(':', uploaded_hash_algo, uploaded_hash) AS up FROM man WHERE state = 'done')
        SELECT source_path, CASE {_MATCH("source_hash", "up")} WHEN true THEN 'match' WHEN false THEN 'differ' ELSE 'unknown' END AS verdict, {_BARE("source_hash")} AS algorithm FROM u""",
}
