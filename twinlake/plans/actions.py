"""Queries from findings to actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import actions, caches, inventory, scoring, similarity, trees
from twinlake.operators.versions import latest
from twinlake.plans import inventory as I
from twinlake.plans import near as N
from twinlake.plans import organizing as O
from twinlake.plans import safety as S
from twinlake.plans import trees as T
from twinlake.plans.inventory import INV, SUFFIX, current
from twinlake.session import cut, table

ROOTS, HOMES = ["/Users/bawis", "/Volumes"], ["/Users/bawis"]
DEST = "/Users/bawis/Sorted"


def actionable_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be removed of exact, picture and tree groups, by rail."""
    exact = I._scored(spark, sf_dir).withColumns({"group_id": F.col("full_hash"), "is_keeper": F.col("is_proposed_keeper")})
    pictures = similarity_members(spark, sf_dir, "image").withColumnRenamed("component", "group_id")
    projects = T.tree_members(spark, sf_dir).select(F.col("component").alias("group_id"), F.col("root").alias("path"), F.lit("local").alias("source_id"), "is_keeper", F.lit(False).alias("is_informational"), F.lit(None).alias("size"))
    return actions.by_rail(actions.actionable({"exact": exact, "image": pictures, "tree": projects})).select("kind", "path", "rail")


def similarity_members(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Members of near-duplicate groups with where they are from; near duplicates are local files."""
    media = N._media(spark, sf_dir, kind).withColumnRenamed("code", "key")
    members = similarity.near_groups(media, similarity.hamming_pairs(media.withColumnRenamed("key", "code"), 8), "distance", "max")[1]
    sizes = media.select(F.col("path").alias("_p"), "size")
    return members.join(sizes, F.col("path") == F.col("_p")).select("component", "path", F.lit("local").alias("source_id"), "is_keeper", F.lit(False).alias("is_informational"), "size")


def _git(root) -> F.Column:
    """A git state by the length of the path, as a probe would give it."""
    return F.when(F.length(root) % 5 == 0, "dirty").when(F.length(root) % 7 == 0, F.lit(None)).otherwise("clean")


def tree_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of the last scans judged as if each were to be removed whole."""
    infos = table(spark, sf_dir, "project_infos").filter("root IS NOT NULL").select("root").distinct()
    folders = current(spark, sf_dir).filter("source_id = 'local'").select(F.explode(trees.ancestors(F.col("path"))).alias("dir")).distinct()
    return actions.tree_refusals(infos.withColumn("git_state", _git(F.col("root"))), folders, ROOTS, HOMES)


def pending_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exact duplicates wait to be removed."""
    return scoring.pending_discards(I._scored(spark, sf_dir))


def weights_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by name, as numbers and as shown."""
    return scoring.weights_listed(spark).select("name", "weight", actions.signed(F.col("weight")).alias("shown"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = S._before(spark, sf_dir).select(F.col("path").alias("_b"), "size", "mtime")
    plan = O.organized_names(spark, sf_dir).join(before, F.col("path") == F.col("_b")).drop("_b")
    spoiled = F.when(F.col("size") % 11 == 0, F.concat(F.lit("../"), F.col("destination"))).otherwise(F.col("destination"))
    return plan.select("path", spoiled.alias("destination"), "size", "mtime")


def organizer_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of snapshot 3 moved to dated names, checked against snapshot 4; some destinations are spoiled for the purpose."""
    return actions.organizer_moves(_moves(spark, sf_dir), current(spark, sf_dir), ROOTS)


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of moves, and what is there after them: two of three files at their destination, one of five places taken again."""
    names = O.organized_names(spark, sf_dir).select("path", F.concat(F.lit(DEST + "/"), F.regexp_replace("destination", r"^\.", "")).alias("destination"))
    there = names.filter(F.length("path") % 3 != 0).select(F.col("destination").alias("path"))
    return names, there.unionByName(names.filter(F.length("path") % 5 == 0).select("path"))


def organizer_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.organizer_undo(*_moved(spark, sf_dir))


def emptied_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by day that are empty once the files with an even size are restored from them."""
    files = current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member")
    place = F.concat_ws("/", F.lit(DEST), F.date_format(F.timestamp_seconds("mtime"), "yyyy/MM-dd"), F.sha2("path", 256))
    rows = files.select(place.alias("path"), "size")
    return actions.emptied_folders(rows.filter("size % 4 != 0").select(F.col("path").alias("destination")), rows, DEST)


def names_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names in snapshot 4 that weren't in snapshot 3."""
    return actions.new_names(S._before(spark, sf_dir), current(spark, sf_dir))


def changes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first changed files by path."""
    return actions.shown_changes(S.drift(spark, sf_dir))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["action", "state", "source_size", "error_message", "source_blake3", "dest_blake3"]
    return latest(table(spark, sf_dir, "migration_manifest").filter("source_path IS NOT NULL"), ["source_path"], "updated_at", columns)


def copy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after a run that tried two of three rows: some failed, some came out short."""
    rows = _manifest(spark, sf_dir)
    n = F.length("source_path")
    outcomes = rows.filter(n % 3 != 0).select("source_path", F.col("source_size").alias("size"), (F.col("source_size") - F.when(n % 7 == 0, 1).otherwise(0)).alias("uploaded_size"), F.when(n % 5 == 0, "quota").alias("error"))
    return actions.copy_states(rows, outcomes)


def content_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.content_verdicts(_manifest(spark, sf_dir))


def cloud_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of digests of cloud files: per file and etag the one delivered last."""
    rows = table(spark, sf_dir, "files").filter("source_id != 'local' AND cloud_file_id IS NOT NULL AND etag IS NOT NULL AND full_hash IS NOT NULL")
    return caches.put_latest(rows.select("source_id", "cloud_file_id", "etag", "full_hash", "delivered_at"), ["source_id", "cloud_file_id", "etag"], "delivered_at")


def signal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local files of snapshot 4 and whether their signals are known for the time they have; some are of another time."""
    signals = table(spark, sf_dir, "signal_sets").filter("path IS NOT NULL").select("path", "source_id", "extracted_at", "mime_top")
    held = caches.put_latest(signals, ["path", "source_id"], "extracted_at")
    files = current(spark, sf_dir).select("path", "source_id", "mtime")
    times = files.select(F.col("path").alias("_p"), (F.col("mtime") + F.when(F.length("path") % 4 == 0, 1.0).otherwise(0.0)).alias("mtime"))
    known = held.join(times, F.col("path") == F.col("_p")).drop("_p", "extracted_at")
    return caches.looked_up(files, known, ["mime_top"], keys=("path", "source_id"))


def near_outside_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, sound and film for the near-duplicate passes: large enough, with a signature, and not in a project that stands for them."""
    media = inventory.near_duplicate_intake(current(spark, sf_dir)).filter("full_hash IS NOT NULL")
    grouped = T.tree_members(spark, sf_dir).select("root")
    return trees.covered(media, grouped).filter("NOT is_covered").select("path", "kind", "size")


def audio_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sound files alike: members, keeper, least similarity, range of durations."""
    media = N._media(spark, sf_dir, "audio").withColumn("key", F.concat_ws("@", "code", F.col("duration").cast("string")))
    return _timed(media, similarity.audio_pairs(media.select("key", "duration", similarity._words(F.col("code")).alias("words"))))


def video_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of films alike: members, keeper, least similarity, range of durations."""
    frames = F.array(F.col("code"), *[F.sha2(F.concat(F.substring("full_hash", 1, 64), F.lit(str(i))), 256) for i in range(4)])
    media = N._media(spark, sf_dir, "video").withColumn("key", F.concat_ws("@", "code", F.col("duration").cast("string"))).withColumn("frames", frames)
    return _timed(media, cut(similarity.video_pairs(media.select("key", "duration", "frames"))))


def _timed(media: DataFrame, pairs: DataFrame) -> DataFrame:
    groups, members = similarity.near_groups(media.select("path", "key", "size", "full_hash"), pairs, "similarity", "min")
    times = media.select(F.col("path").alias("_p"), "duration")
    span = members.join(times, F.col("path") == F.col("_p")).groupBy(F.col("component").alias("_c")).agg(F.min("duration").alias("shortest"), F.max("duration").alias("longest"))
    return groups.join(span, F.col("component") == F.col("_c")).select("component", "n_members", "keeper", F.round("similarity", 6).alias("similarity"), "shortest", "longest", "reclaim_bytes")


def _timed_sql(kind: str, pairs: str) -> str:
    return f"""WITH RECURSIVE {N._media_sql({"audio": P.AUDIO_SUFFIXES, "video": P.VIDEO_SUFFIXES}[kind])}, mk AS (SELECT *, code || '@' || CAST(CAST(duration AS DOUBLE) AS VARCHAR) AS key FROM m),
pairs AS ({pairs}), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node), stat AS (SELECT component, min(similarity) AS similarity FROM pairs JOIN comp ON pairs.a = comp.node GROUP BY 1)
SELECT component, count(*) AS n_members, arg_max(path, (size, path)) AS keeper, any_value(stat.similarity) AS similarity, CAST(min(duration) AS DOUBLE) AS shortest, CAST(max(duration) AS DOUBLE) AS longest, CAST(sum(size) - max(size) AS BIGINT) AS reclaim_bytes
FROM mk JOIN comp ON mk.key = comp.node JOIN stat USING (component) GROUP BY component HAVING min(full_hash) <> max(full_hash)"""


def _outside(path: str, roots) -> str:
    return "NOT (" + " OR ".join(f"{path} = '{r}' OR starts_with({path}, '{r}/')" for r in roots) + ")"


_EXCLUDED = f"({I._PLACE} OR list_has_any(string_split(path, '/'), [{', '.join(repr(d) for d in P.EXCLUDED_DIRS)}]))"
_MAN = "man AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY updated_at DESC) AS rn FROM migration_manifest WHERE source_path IS NOT NULL) WHERE rn = 1)"
_OLD = "old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC) AS rn FROM files WHERE snapshot_id = 3 AND path IS NOT NULL) WHERE rn = 1)"
QUERIES = {
    "actionable_rails": actionable_rails, "tree_refusals": tree_refusals, "pending_discards": pending_discards, "weights_listed": weights_listed, "organizer_moves": organizer_moves, "organizer_undo": organizer_undo,
    "emptied_folders": emptied_folders, "names_since": names_since, "changes_shown": changes_shown, "copy_states": copy_states, "content_verdicts": content_verdicts, "cloud_hashes": cloud_hashes, "signal_lookup": signal_lookup,
    "near_outside_trees": near_outside_trees, "audio_groups": audio_groups, "video_groups": video_groups,
}
ORACLES = {
    "actionable_rails": f"""SELECT 'exact' AS kind, path, rail FROM ({I.ORACLES["discard_plan"]}) UNION ALL SELECT 'image', path, 'local' FROM ({N.ORACLES["image_members"]}) WHERE NOT is_keeper
        UNION ALL SELECT 'tree', root, 'tree' FROM ({T.ORACLES["tree_members"]}) WHERE NOT is_keeper""",
    "tree_refusals": f"""WITH {INV}, d AS (SELECT DISTINCT unnest(list_transform(range(2, greatest(len(string_split(path, '/')) - 1, 2) + 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS dir FROM inv WHERE source_id = 'local'),
        r AS (SELECT DISTINCT root AS path FROM project_infos WHERE root IS NOT NULL)
        SELECT path AS root, CASE WHEN {_EXCLUDED} THEN 'excluded place' WHEN path NOT IN (SELECT dir FROM d) THEN 'not a folder' WHEN {_outside("path", ROOTS)} THEN 'outside roots' WHEN {_outside("path", HOMES)} THEN 'outside active homes'
          WHEN length(path) % 5 = 0 THEN 'uncommitted changes' WHEN length(path) % 7 = 0 THEN 'git state unknown' END AS refusal FROM r""",
    "organizer_moves": f"""WITH {INV}, {_OLD}, p AS (SELECT n.path, CASE WHEN o.size % 11 = 0 THEN '../' || n.destination ELSE n.destination END AS destination, o.size, o.mtime FROM ({O.ORACLES["organized_names"]}) n JOIN old o ON n.path = o.path),
        q AS (SELECT p.*, count(*) OVER (PARTITION BY destination) AS n, i.size AS s, i.mtime AS m, i.path AS there FROM p LEFT JOIN inv i ON i.path = p.path)
        SELECT path, destination, CASE WHEN {_EXCLUDED} THEN 'refuse: excluded source' WHEN {_outside("path", ROOTS)} THEN 'refuse: outside roots' WHEN destination = '' THEN 'refuse: destination: empty' WHEN starts_with(destination, '/') THEN 'refuse: destination: absolute'
          WHEN list_contains(string_split(destination, '/'), '..') THEN 'refuse: destination: leaves its root' WHEN list_has_any(string_split(destination, '/'), [{", ".join(repr(d) for d in P.EXCLUDED_DIRS)}]) THEN 'refuse: destination: excluded place'
          WHEN n > 1 THEN 'refuse: destination taken' WHEN there IS NULL THEN 'refuse: missing' WHEN size IS DISTINCT FROM s THEN 'refuse: changed: size' WHEN abs(mtime - m) > 0.001 THEN 'refuse: changed: time' ELSE 'move' END AS step FROM q""",
    "pending_discards": f"SELECT count(*) AS n_pending, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (WITH {I._SCORED} SELECT size FROM ranked WHERE NOT is_proposed_keeper AND NOT is_informational)",
    "weights_listed": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE), '{v:+.2f}')" for k, v in scoring.WEIGHTS.items()) + ") AS t(name, weight, shown)",
    "organizer_undo": f"""WITH n AS (SELECT path, '{DEST}/' || regexp_replace(destination, '^\\.', '') AS destination FROM ({O.ORACLES["organized_names"]})),
        there AS (SELECT destination AS p FROM n WHERE length(path) % 3 <> 0 UNION SELECT path FROM n WHERE length(path) % 5 = 0)
        SELECT path, destination, CASE WHEN {_EXCLUDED} THEN 'refuse: excluded place' WHEN destination NOT IN (SELECT p FROM there) THEN 'refuse: gone from destination' WHEN path IN (SELECT p FROM there) THEN 'refuse: place taken' ELSE 'restore' END AS step FROM n""",
    "emptied_folders": f"""WITH {INV}, r AS (SELECT strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y/%m-%d') AS day, size FROM inv WHERE source_id = 'local' AND NOT is_archive_member),
        d AS (SELECT '{DEST}/' || day AS dir, size FROM r UNION ALL SELECT '{DEST}/' || substr(day, 1, 4), size FROM r) SELECT dir FROM d GROUP BY dir HAVING count(*) FILTER (WHERE size % 4 = 0 OR size IS NULL) = 0""",
    "names_since": f"WITH {INV}, {_OLD} SELECT DISTINCT {I.BASE} AS name FROM inv WHERE {I.BASE} NOT IN (SELECT {I.BASE} FROM old)",
    "changes_shown": f"SELECT * FROM ({S.ORACLES['drift']}) WHERE status <> 'same' ORDER BY path LIMIT 10",
    "copy_states": f"""WITH {_MAN}, t AS (SELECT *, state <> 'done' AND action = 'copy' AS open, length(source_path) AS n FROM man)
        SELECT source_path, CASE WHEN state = 'done' THEN 'done' WHEN action <> 'copy' THEN 'skipped' WHEN n % 3 = 0 THEN 'pending' WHEN n % 5 = 0 OR (n % 7 = 0 AND source_size IS NOT NULL) THEN 'error' ELSE 'done' END AS state,
          CASE WHEN open AND n % 3 <> 0 THEN CASE WHEN n % 5 = 0 THEN 'quota' WHEN n % 7 = 0 AND source_size IS NOT NULL THEN 'sizes differ' END END AS reason FROM t""",
    "content_verdicts": f"WITH {_MAN} SELECT source_path, CASE WHEN source_blake3 IS NULL OR dest_blake3 IS NULL THEN 'unread' WHEN lower(source_blake3) = lower(dest_blake3) THEN 'verified' ELSE 'mismatch' END AS verdict FROM man WHERE state = 'done'",
    "cloud_hashes": """SELECT source_id, cloud_file_id, etag, full_hash, delivered_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, cloud_file_id, etag ORDER BY delivered_at DESC, full_hash DESC) AS rn FROM files
        WHERE source_id <> 'local' AND cloud_file_id IS NOT NULL AND etag IS NOT NULL AND full_hash IS NOT NULL) WHERE rn = 1""",
    "signal_lookup": f"""WITH {INV}, s AS (SELECT * FROM (SELECT path, source_id, mime_top, row_number() OVER (PARTITION BY path, source_id ORDER BY extracted_at DESC, mime_top DESC NULLS LAST) AS rn FROM signal_sets WHERE path IS NOT NULL) WHERE rn = 1)
        SELECT i.path, i.source_id, i.mtime, CASE WHEN length(i.path) % 4 <> 0 THEN s.mime_top END AS mime_top, s.path IS NOT NULL AND length(i.path) % 4 <> 0 AS is_hit FROM inv i LEFT JOIN s ON i.path = s.path AND i.source_id = s.source_id""",
    "near_outside_trees": f"""WITH t AS (SELECT root FROM ({T.ORACLES["tree_members"]})) SELECT path, kind, size FROM ({I.ORACLES["media_intake"]}) WHERE NOT EXISTS (SELECT 1 FROM t WHERE path = root OR starts_with(path, root || '/'))""",
    "audio_groups": _timed_sql("audio", f"""SELECT * FROM (SELECT x.key AS a, y.key AS b, round(1 - ({N._bits("x.code", "y.code", 8)}) / 256.0, 6) AS similarity FROM (SELECT DISTINCT key, code, duration FROM mk) x JOIN (SELECT DISTINCT key, code, duration FROM mk) y
        ON x.key < y.key AND abs(x.duration - y.duration) <= 2) WHERE similarity >= 0.95"""),
    "video_groups": _timed_sql("video", f"""SELECT DISTINCT a, b, similarity FROM (WITH p AS (SELECT DISTINCT code, duration, key, substr(full_hash, 1, 64) AS h FROM mk), f AS (SELECT key, duration, [code{"".join(f", sha256(h || '{i}')" for i in range(4))}] AS fr FROM p)
        SELECT x.key AS a, y.key AS b, round(1 - ({" + ".join(N._bits(f"x.fr[{k + 1}]", f"y.fr[{k + 1}]", 8) for k in range(5))}) / 5.0 / 256, 6) AS similarity FROM f x JOIN f y ON x.key < y.key AND abs(x.duration - y.duration) <= 5) WHERE similarity >= 0.9"""),
}
