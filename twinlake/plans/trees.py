"""Queries over project trees and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import archives, inventory, trees
from twinlake.plans.inventory import DEPTH, INV, current
from twinlake.session import table


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project roots of the inventory: source folders two levels below Projects, by their configuration files."""
    files = current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member")
    entries = files.select(P.parent(F.col("path")).alias("dir"), F.when(P.suffix(F.col("path")) == ".toml", "pyproject.toml").otherwise(P.base_name(F.col("path"))).alias("name"))
    return trees.marked_folders(entries)


def tree_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects found in the inventory, a file with suffix .toml standing for a marker."""
    return trees.projects(current(spark, sf_dir), _roots(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = trees.latest_projects(table(spark, sf_dir, "project_infos"))
    return files, trees.project_groups(files, 0.5)


def tree_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of alike projects with keeper and score."""
    out = trees.tree_keepers(_groups(spark, sf_dir)[1])
    return out.withColumn("similarity", F.round("similarity", 6))


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_report(*_groups(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def tree_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 differing files of each group."""
    return trees.shown_differences(*_groups(spark, sf_dir)).withColumn("hashes", F.array_join(F.transform("hashes", lambda h: F.coalesce(h, F.lit("-"))), ","))


def tree_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups that aren't wholly inside found projects."""
    files = current(spark, sf_dir).select("path", "full_hash")
    often = files.groupBy("full_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("full_hash").alias("h"))
    return trees.uncovered_groups(files.join(often, F.col("full_hash") == F.col("h"), "left_semi"), _roots(spark, sf_dir))


def files_outside_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files not below a found project."""
    return trees.covered(current(spark, sf_dir).select("path", "size"), _roots(spark, sf_dir)).filter("NOT is_covered").select("path", "size")


def archives_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the inventory whose members all exist as files."""
    files = current(spark, sf_dir)
    on_disk = files.filter("NOT is_archive_member")
    return archives.archive_groups(archives.redundant_archives(inventory.member_rows(files), on_disk), on_disk)


def orders_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same division at size: orders as archives, line items as members, small parts on disk; returned ones count as skipped."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("outer_path"), F.col("l_partkey").alias("full_hash"), "l_returnflag")
    parts = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("full_hash"))
    skipped = items.filter("l_returnflag = 'R'").select("outer_path")
    return archives.redundant_archives(items, parts, skipped).select(F.col("outer_path").alias("orderkey"), "n_members")


_ROOTS = """roots AS (SELECT root, min(name) AS marker FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, CASE WHEN lower(path) LIKE '%.toml' THEN 'pyproject.toml' END AS name
  FROM inv WHERE source_id = 'local' AND NOT is_archive_member) WHERE name IS NOT NULL GROUP BY root)"""
_ANC = "unnest([array_to_string(string_split(path, '/')[1:n], '/') for n in range(2, len(string_split(path, '/')))])"
_HITS = f"""hits AS (SELECT DISTINCT path FROM (SELECT path, unnest([array_to_string(string_split(path, '/')[1:n], '/') for n in range(2, len(string_split(path, '/')) + 1)]) AS dir FROM inv) JOIN roots ON dir = root)"""
_TREES = f"""WITH RECURSIVE held AS (SELECT root, file_hashes, total_bytes FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY scanned_at DESC) AS rn FROM project_infos WHERE root IS NOT NULL) WHERE rn = 1),
f AS (SELECT root, total_bytes, e.key AS rel, lower(e.value) AS hash FROM (SELECT root, total_bytes, unnest(map_entries(file_hashes)) AS e FROM held)),
t AS (SELECT DISTINCT root, hash FROM f WHERE hash IS NOT NULL), n AS (SELECT root, count(*) AS n FROM t GROUP BY root),
pairs AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM (SELECT p.root AS a, q.root AS b, count(*) AS c FROM t p JOIN t q ON p.hash = q.hash AND p.root < q.root GROUP BY 1, 2) JOIN n x ON x.root = a JOIN n y ON y.root = b WHERE c / (x.n + y.n - c) >= 0.5),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node AS root, min(other) AS component FROM reach GROUP BY node),
sim AS (SELECT component, min(similarity) AS similarity FROM pairs JOIN comp ON a = root GROUP BY 1),
mem AS (SELECT component, root AS path, similarity, list_has_any([lower(p) for p in string_split(root, '/')], [{", ".join(f"'{w}'" for w in P.TREE_COPY_WORDS)}]) AS copied FROM comp JOIN sim USING (component)),
deep AS (SELECT *, {DEPTH} AS depth FROM mem),
fact AS (SELECT component, arg_min(path, (depth, path)) FILTER (WHERE NOT copied) AS outside, bool_or(copied) AS some_copied, arg_min(path, (depth, path)) AS least FROM deep GROUP BY 1),
kept AS (SELECT component, path AS root, similarity, path = CASE WHEN some_copied AND outside IS NOT NULL THEN outside ELSE least END AS is_keeper, CASE WHEN some_copied AND outside IS NOT NULL THEN 'outside copy folders' ELSE 'shallowest path' END AS reason, copied FROM deep JOIN fact USING (component)),
member_list AS (SELECT component, list(root ORDER BY root) AS members FROM comp GROUP BY 1),
cells AS (SELECT component, rel, map_from_entries(list((root, hash))) AS m FROM f JOIN comp USING (root) GROUP BY 1, 2),
diff AS (SELECT component, rel, [m[r] for r in members] AS hashes, len(list_filter([m[r] for r in members], lambda h: h IS NULL)) = 0 AND len(list_distinct([m[r] for r in members])) = 1 AS identical FROM cells JOIN member_list USING (component))"""
QUERIES = {
    "tree_projects": tree_projects, "tree_members": tree_members, "tree_report": tree_report, "tree_shown": tree_shown, "tree_uncovered": tree_uncovered,
    "files_outside_trees": files_outside_trees, "archives_redundant": archives_redundant, "orders_redundant": orders_redundant,
}
ORACLES = {
    "tree_projects": f"""WITH {INV}, {_ROOTS}, a AS (SELECT path, size, full_hash, {_ANC} AS dir FROM inv WHERE source_id = 'local' AND NOT is_archive_member AND NOT contains(path, '::')),
        i AS (SELECT path, size, full_hash, arg_max(dir, length(dir)) AS root FROM a JOIN roots ON dir = root GROUP BY ALL)
        SELECT root, marker, regexp_extract(root, '([^/]*)$', 1) AS name, count(*) AS n_files, count(DISTINCT full_hash) AS n_hashes, CAST(sum(size) AS BIGINT) AS total_bytes FROM i JOIN roots USING (root) GROUP BY ALL""",
    "tree_members": f"{_TREES} SELECT component, root, round(similarity, 6) AS similarity, is_keeper, reason, CASE WHEN is_keeper THEN 0.0 WHEN copied THEN -5.0 ELSE 0.0 END AS score FROM kept",
    "tree_report": f"""{_TREES}, d AS (SELECT component, count(*) FILTER (WHERE identical) AS identical_files, count(*) FILTER (WHERE NOT identical) AS differing_files FROM diff GROUP BY 1)
        SELECT component, count(*) AS n_members, round(min(similarity), 6) AS similarity, max(CASE WHEN is_keeper THEN root END) AS keeper, max(reason) AS reason, CAST(sum(CASE WHEN is_keeper THEN 0 ELSE total_bytes END) AS BIGINT) AS reclaim_bytes, max(identical_files) AS identical_files, max(differing_files) AS differing_files
        FROM kept JOIN held USING (root) JOIN d USING (component) GROUP BY component""",
    "tree_shown": f"{_TREES}, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY rel) AS place FROM diff WHERE NOT identical) SELECT component, CAST(place AS INTEGER) AS place, rel, array_to_string([coalesce(h, '-') for h in hashes], ',') AS hashes FROM r WHERE place <= 50",
    "tree_uncovered": f"WITH {INV}, {_ROOTS}, {_HITS}, g AS (SELECT full_hash, count(*) AS n_members, count(h.path) AS n_covered FROM inv LEFT JOIN hits h USING (path) GROUP BY 1 HAVING count(*) > 1) SELECT * FROM g WHERE n_covered < n_members",
    "files_outside_trees": f"WITH {INV}, {_ROOTS}, {_HITS} SELECT path, size FROM inv WHERE path NOT IN (SELECT path FROM hits)",
    "archives_redundant": f"""WITH {INV}, m AS (SELECT string_split(path, '::')[1] AS outer_path, full_hash FROM inv WHERE is_archive_member),
        r AS (SELECT outer_path, count(*) AS n_members FROM m GROUP BY 1 HAVING bool_and(full_hash IN (SELECT full_hash FROM inv WHERE NOT is_archive_member AND full_hash IS NOT NULL)))
        SELECT path, n_members, size, mtime, full_hash, -1.0 AS score, size AS reclaim_bytes FROM r JOIN inv ON path = outer_path WHERE NOT is_archive_member""",
    "orders_redundant": """SELECT l_orderkey AS orderkey, count(*) AS n_members FROM lineitem GROUP BY 1
        HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40)) AND NOT bool_or(l_returnflag = 'R')""",
}
