"""Queries over the file inventory: intake, exact duplicates, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import exact, inventory, scoring
from twinlake.operators.versions import latest
from twinlake.session import table

COLUMNS = ["size", "mtime", "inode", "dev", "nlink", "is_archive_member", "is_bundle", "is_shared", "precomputed_full_hash", "source_id", "foreign_hash", "etag", "cloud_file_id", "owner", "full_hash", "reconciled"]
HOMES = ["/Users/bawis", "/Users/fohul"]


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of ``files``, each path as delivered last."""
    return latest(table(spark, sf_dir, "files").filter("snapshot_id = 4 AND path IS NOT NULL"), ["path"], "delivered_at", COLUMNS)


INV = "inv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC, etag DESC NULLS LAST) AS rn FROM files WHERE snapshot_id = 4 AND path IS NOT NULL) WHERE rn = 1)"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
SUFFIX = f"lower(regexp_extract({BASE}, '[^.].*?(\\.[^.]+)$', 1))"
DEPTH = "(len(list_filter(string_split(path, '/'), lambda p: p <> '')) + CASE WHEN starts_with(path, '/') THEN 1 ELSE 0 END)"
MARKER = f"regexp_matches(path, '{P.COPY_WORD}')"
COPYNAME = f"regexp_matches({BASE}, '{P.COPY_NAME}')"
HOMEISH = "list_filter(list_reverse(string_split(path, '/'))[2:], lambda p: p IN ('Desktop', 'Documents', 'Downloads', 'Pictures', 'Movies', 'Music'))[1]"


def file_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with the first test it fails, if any."""
    reason = inventory.reject_reason(F.col("path"), F.col("size"), 1024, ["*/to sort/*", "*.bin"])
    return current(spark, sf_dir).select("path", reason.alias("reason"))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths say: name, suffix, depth, marks of copies, home folder, drive, archive, destination."""
    p = F.col("path")
    return current(spark, sf_dir).select(
        "path", P.base_name(p).alias("name"), P.suffix(p).alias("suffix"), P.stem(p).alias("stem"), P.parent(p).alias("parent"), P.depth(p).alias("depth"), P.has_copy_word(p).alias("copy_word"), P.has_copy_name(p).alias("copy_name"),
        P.homeish_ancestor(p).alias("home"), P.is_external(p).alias("external"), P.under_copy_folder(p).alias("copy_folder"), P.archive_kind(p).alias("archive"), P.outer_archive(p).alias("outer_path"),
        P.relative_destination(p, F.col("source_id")).alias("destination"), P.human_bytes(F.col("size")).alias("shown_size"), F.substring(F.sha2("path", 256), 1, 8).alias("path_hash"),
    )


def scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First folders of local paths, to one, two and three levels, judged as roots of a scan."""
    local = current(spark, sf_dir).filter("source_id = 'local'")
    root = F.explode(F.array(*[F.concat(F.lit("/"), F.array_join(F.slice(F.split("path", "/"), 2, n), "/")) for n in (1, 2, 3)]))
    return local.select(root.alias("root")).distinct().select("root", inventory.root_verdict(F.col("root")).alias("verdict"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders taken as bundles, rolled up to one row each."""
    return inventory.rolled_up(current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member"), P.parent(F.col("path")), 1)


def suffix_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles told by their suffix, rolled up; some folders get one for the purpose."""
    folder = P.parent(F.col("path"))
    named = F.concat(folder, F.when(F.length(folder) % 4 == 0, ".App").otherwise(""), F.lit("/"), P.base_name(F.col("path")))
    rows = current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member").withColumn("path", named)
    return inventory.rolled_up(rows, P.bundle_root(F.col("path")), 1).select("path", "n_files", "size", "mtime")


def trash_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each local file would land in a trash, and whether it lies in one."""
    rows = current(spark, sf_dir).filter("source_id = 'local'")
    return rows.select("path", P.trash_folder(F.col("path"), HOMES[0], 501).alias("trash"), P.inside_trash(F.col("path"), HOMES[0], 501).alias("is_inside"))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members as rows of the inventory, with their archive's mtime."""
    return inventory.member_rows(current(spark, sf_dir))


def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and hashed cloud rows by source."""
    out = inventory.united_sources(current(spark, sf_dir))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.count("precomputed_full_hash").alias("n_known"), F.sum("size").alias("bytes"))


def media_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are compared as images, audio or video."""
    return inventory.near_duplicate_intake(current(spark, sf_dir)).select("path", "kind", "size")


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_buckets(current(spark, sf_dir), 1)


def single_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.single_sizes(current(spark, sf_dir))


def staged_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken as file contents, digested in stages; samples of 256 bytes so that all stages occur."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")
    return exact.staged_digests(docs, F.encode("text", "utf-8"), 256)


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(current(spark, sf_dir), 1)


def single_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.single_digests(current(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored_members(current(spark, sf_dir), HOMES[:1], ["gdrive:vault", "onedrive:attic"])


def scored_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of exact groups with score, keeper and informational marks."""
    return _scored(spark, sf_dir).select("full_hash", "path", F.round("score", 6).alias("score"), "is_informational", "is_proposed_keeper")


def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each contribution occurs and what it adds."""
    each = _scored(spark, sf_dir).select(F.explode("signals").alias("s"))
    return each.groupBy(F.col("s.name").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("s.contribution"), 4).alias("total"))


def group_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reclaim(_scored(spark, sf_dir))


def discard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.discards(_scored(spark, sf_dir))


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, members and reclaimable bytes in all."""
    return scoring.reclaim(_scored(spark, sf_dir)).agg(F.count("*").alias("total_groups"), F.sum("n_members").alias("total_members"), F.sum("reclaim_bytes").alias("total_reclaim"))


def _within_sql(roots) -> str:
    return " OR ".join(f"path = '{r}' OR starts_with(path, '{r}/')" for r in roots)


_PLACE = (
    "(" + _within_sql(P.EXCLUDED_ROOTS) + " OR regexp_matches(path, '^/Users/[^/]+/Library(?:/|$)') OR regexp_matches(path, '^/Volumes/[^/]+/(?:" + "|".join(P.EXCLUDED_VOLUME_PARTS) + ")(?:/|$)') OR "
    + " OR ".join(f"contains(path, '{x}')" for x in P.EXCLUDED_PARTS) + ")"
)
_SCORED = f"""
{INV},
dup AS (SELECT * FROM inv WHERE full_hash IN (SELECT full_hash FROM inv WHERE full_hash IS NOT NULL GROUP BY full_hash HAVING count(*) > 1)),
links AS (SELECT full_hash, dev, inode FROM dup WHERE NOT is_archive_member AND source_id = 'local' AND inode IS NOT NULL AND dev IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
info AS (SELECT d.*, d.is_archive_member OR coalesce(d.is_shared, false) OR starts_with(d.source_id, 'icloud:') OR starts_with(d.source_id, 'gphotos:')
    OR (l.full_hash IS NOT NULL AND NOT d.is_archive_member AND d.source_id = 'local') AS is_informational
  FROM dup d LEFT JOIN links l ON d.full_hash = l.full_hash AND d.dev = l.dev AND d.inode = l.inode),
feat AS (SELECT full_hash AS g, max(mtime) AS newest, min(mtime) AS oldest, max(size) AS largest, min(size) AS smallest, bool_or(NOT starts_with(path, '/Volumes/')) AS any_internal, bool_or(source_id = 'local') AS any_local
  FROM info WHERE NOT is_informational GROUP BY 1),
sig AS (SELECT i.full_hash, i.path, i.source_id, i.size, i.is_informational, {DEPTH} AS depth,
  CASE WHEN is_informational THEN [] ELSE [
    {{'name': 'cloud_when_local_exists', 'c': CASE WHEN source_id <> 'local' AND any_local THEN -3.0 END}},
    {{'name': 'retained_cloud_order[' || CASE WHEN source_id IN ('gdrive:vault', 'onedrive:attic') THEN source_id ELSE 'unlisted' END || ']', 'c': CASE WHEN source_id = 'local' THEN NULL WHEN source_id = 'gdrive:vault' THEN 1.0 WHEN source_id = 'onedrive:attic' THEN 0.0 ELSE -0.01 END}},
    {{'name': 'path_marker_backup', 'c': CASE WHEN {MARKER} THEN -8.0 END}},
    {{'name': 'filename_copy_marker', 'c': CASE WHEN {COPYNAME} THEN -6.0 END}},
    {{'name': 'under_active_home', 'c': CASE WHEN {_within_sql(HOMES[:1])} THEN 4.0 END}},
    {{'name': 'under_inactive_home', 'c': CASE WHEN {HOMEISH} IS NOT NULL AND NOT ({_within_sql(HOMES[:1])}) THEN -4.0 END}},
    {{'name': 'downloads_transit', 'c': CASE WHEN {HOMEISH} = 'Downloads' THEN -2.0 END}},
    {{'name': 'depth_penalty_per_level', 'c': -0.5 * {DEPTH}}},
    {{'name': 'newest_mtime', 'c': CASE WHEN newest <> oldest AND mtime = newest THEN 3.0 END}},
    {{'name': 'oldest_mtime_tiebreak', 'c': CASE WHEN newest <> oldest AND mtime = oldest THEN 1.0 END}},
    {{'name': 'external_drive_penalty', 'c': CASE WHEN starts_with(path, '/Volumes/') AND any_internal THEN -2.0 END}},
    {{'name': 'larger_size', 'c': CASE WHEN smallest < largest AND size = largest THEN 2.0 END}}] END AS signals
  FROM info i LEFT JOIN feat ON i.full_hash = feat.g),
scored AS (SELECT *, round(coalesce(list_sum([CAST(s.c AS DOUBLE) for s in signals if s.c IS NOT NULL]), 0.0), 6) AS score FROM sig),
ranked AS (SELECT *, CASE WHEN is_informational THEN false ELSE row_number() OVER (PARTITION BY full_hash, is_informational ORDER BY score DESC, depth, path DESC) = 1 END AS is_proposed_keeper FROM scored)
"""

QUERIES = {
    "file_intake": file_intake, "file_paths": file_paths, "scan_roots": scan_roots, "bundles": bundles, "suffix_bundles": suffix_bundles, "trash_places": trash_places, "archive_members": archive_members, "united_sources": united_sources, "media_intake": media_intake,
    "size_buckets": size_buckets, "single_sizes": single_sizes, "staged_digests": staged_digests, "exact_groups": exact_groups, "single_digests": single_digests, "scored_members": scored_members,
    "score_contributions": score_contributions, "group_reclaim": group_reclaim, "discard_plan": discard_plan, "report_totals": report_totals,
}
_DIGEST = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
_DIRS = ", ".join(f"'{d}'" for d in P.EXCLUDED_DIRS)
_WORDS = ", ".join(f"'{w}'" for w in P.TREE_COPY_WORDS)
ORACLES = {
    "suffix_bundles": f"""WITH {INV}, b AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, size, mtime FROM inv WHERE source_id = 'local' AND NOT is_archive_member)
        SELECT folder || '.App' AS path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime FROM b WHERE length(folder) % 4 = 0 GROUP BY folder HAVING sum(size) >= 1""",
    "trash_places": f"""WITH {INV} SELECT path, CASE WHEN path LIKE '/Volumes/%' THEN '/Volumes/' || string_split(path, '/')[3] || '/.Trashes/501' ELSE '{HOMES[0]}/.Trash' END AS trash,
        starts_with(path, '{HOMES[0]}/.Trash/') OR (path LIKE '/Volumes/%' AND string_split(path, '/')[4] = '.Trashes' AND string_split(path, '/')[5] = '501' AND len(string_split(path, '/')) > 5) AS is_inside FROM inv WHERE source_id = 'local'""",
    "file_intake": f"""WITH {INV} SELECT path, CASE WHEN list_has_any(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), [{_DIRS}]) THEN 'folder name' WHEN {_PLACE} THEN 'excluded place'
        WHEN regexp_matches(path, '/to sort/') OR ends_with(path, '.bin') THEN 'pattern' WHEN ends_with(path, '.icloud') THEN 'placeholder' WHEN size < 1024 THEN 'size' END AS reason FROM inv""",
    "file_paths": f"""WITH {INV} SELECT path, {BASE} AS name, {SUFFIX} AS suffix, regexp_replace({BASE}, '^(.+)\\.[^.]+$', '\\1') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, CAST({DEPTH} AS INTEGER) AS depth,
        {MARKER} AS copy_word, {COPYNAME} AS copy_name, {HOMEISH} AS home, starts_with(path, '/Volumes/') AS external, list_has_any([lower(p) for p in string_split(path, '/')], [{_WORDS}]) AS copy_folder,
        CASE WHEN regexp_matches(lower(path), '\\.(tar\\.(gz|bz2|xz)|tgz|tbz2|txz|tar)$') THEN 'tar' WHEN ends_with(lower(path), '.zip') THEN 'zip' END AS archive, string_split(path, '::')[1] AS outer_path,
        array_to_string(list_filter(string_split(CASE WHEN starts_with(path, source_id || '://') THEN substr(path, length(source_id) + 4) ELSE path END, '/'), lambda p: p <> '' AND p <> '.'), '/') AS destination,
        CASE WHEN size >= 1099511627776 THEN printf('%.1f TB', size / 1099511627776.0) WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0) WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0)
          WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%d B', size) END AS shown_size, substr(sha256(path), 1, 8) AS path_hash FROM inv""",
    "scan_roots": f"""WITH {INV}, r AS (SELECT DISTINCT '/' || array_to_string(string_split(path, '/')[2:n + 1], '/') AS path FROM inv, (SELECT unnest([1, 2, 3]) AS n) WHERE source_id = 'local')
        SELECT path AS root, CASE WHEN trim(path) = '' THEN 'empty' WHEN {DEPTH} <= 2 THEN 'too shallow' WHEN {_PLACE} THEN 'excluded place' END AS verdict FROM r""",
    "bundles": f"""WITH {INV}, e AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, size, mtime, sha256(concat_ws(chr(0), {BASE}, CAST(size AS VARCHAR), coalesce(full_hash, ''))) AS h
        FROM inv WHERE source_id = 'local' AND NOT is_archive_member) SELECT root AS path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime, {_DIGEST} AS digest FROM e WHERE root <> '' GROUP BY root HAVING sum(size) >= 1""",
    "archive_members": f"""WITH {INV}, m AS (SELECT *, string_split(path, '::')[1] AS outer_path FROM inv WHERE is_archive_member)
        SELECT m.path, m.outer_path, m.size, coalesce(o.mtime, m.mtime) AS mtime, o.size AS outer_size, m.full_hash, CAST(0 AS BIGINT) AS inode FROM m LEFT JOIN inv o ON o.path = m.outer_path AND NOT o.is_archive_member""",
    "united_sources": f"""WITH {INV} SELECT source_id, count(*) AS n, count(CASE WHEN source_id <> 'local' THEN coalesce(foreign_hash, precomputed_full_hash) ELSE precomputed_full_hash END) AS n_known, CAST(sum(size) AS BIGINT) AS bytes
        FROM inv WHERE source_id = 'local' OR foreign_hash IS NOT NULL GROUP BY 1""",
    "media_intake": f"""WITH {INV}, k AS (SELECT path, size, CASE WHEN {SUFFIX} IN ({", ".join(repr(x) for x in P.IMAGE_SUFFIXES)}) AND size >= 10000 THEN 'image' WHEN {SUFFIX} IN ({", ".join(repr(x) for x in P.AUDIO_SUFFIXES)}) AND size >= 100000 THEN 'audio'
        WHEN {SUFFIX} IN ({", ".join(repr(x) for x in P.VIDEO_SUFFIXES)}) AND size >= 1000000 THEN 'video' END AS kind FROM inv WHERE NOT is_archive_member AND source_id = 'local') SELECT path, kind, size FROM k WHERE kind IS NOT NULL""",
    "size_buckets": f"WITH {INV} SELECT size, count(*) AS n_files FROM inv WHERE size >= 1 GROUP BY size HAVING count(*) > 1",
    "single_sizes": f"WITH {INV} SELECT min(path) AS path, size FROM inv GROUP BY size HAVING count(*) = 1",
    "staged_digests": """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS path, encode(text) AS b, CAST(octet_length(encode(text)) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL),
        p AS (SELECT path, b, size, sha256(CASE WHEN size > 512 THEN b[1:256] || b[size - 255:size] ELSE b[1:256] END) AS partial, count(*) OVER (PARTITION BY size) AS ns FROM c),
        q AS (SELECT *, count(*) OVER (PARTITION BY size, partial) AS np FROM p)
        SELECT path, size, CASE WHEN ns = 1 THEN 'size' WHEN np = 1 THEN 'partial' ELSE 'full' END AS stage, CASE WHEN ns = 1 THEN NULL WHEN np = 1 THEN partial ELSE sha256(b) END AS digest FROM q""",
    "exact_groups": f"WITH {INV} SELECT full_hash, count(*) AS n_members, min_by(size, path) AS size, min(path) AS first_path, CAST(sum(size) AS BIGINT) AS bytes FROM inv WHERE size >= 1 GROUP BY full_hash HAVING count(*) >= 2",
    "single_digests": f"WITH {INV} SELECT min(path) AS path, full_hash, min(size) AS size FROM inv WHERE NOT is_archive_member GROUP BY full_hash HAVING count(*) = 1",
    "scored_members": f"WITH {_SCORED} SELECT full_hash, path, score, is_informational, is_proposed_keeper FROM ranked",
    "score_contributions": f"WITH {_SCORED} SELECT s.name AS name, count(*) AS n, round(CAST(sum(s.c) AS DOUBLE), 4) AS total FROM (SELECT unnest(signals) AS s FROM sig) WHERE s.c IS NOT NULL GROUP BY 1",
    "group_reclaim": f"WITH {_SCORED} SELECT full_hash, count(*) AS n_members, CAST(sum(CASE WHEN NOT is_proposed_keeper AND NOT is_informational THEN size ELSE 0 END) AS BIGINT) AS reclaim_bytes, max(CASE WHEN is_proposed_keeper THEN path END) AS keeper FROM ranked GROUP BY 1",
    "discard_plan": f"WITH {_SCORED} SELECT full_hash, path, size, CASE WHEN source_id = 'local' THEN 'local' ELSE 'cloud' END AS rail FROM ranked WHERE NOT is_proposed_keeper AND NOT is_informational AND full_hash IN (SELECT full_hash FROM ranked WHERE is_proposed_keeper)",
    "report_totals": f"WITH {_SCORED}, g AS (SELECT full_hash, count(*) AS n, sum(CASE WHEN NOT is_proposed_keeper AND NOT is_informational THEN size ELSE 0 END) AS r FROM ranked GROUP BY 1) SELECT count(*) AS total_groups, CAST(sum(n) AS BIGINT) AS total_members, CAST(sum(r) AS BIGINT) AS total_reclaim FROM g",
}
