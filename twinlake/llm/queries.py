"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlake.llm.groups import consolidated
from twinlake.llm.mixing import mixture, mixture_held
from twinlake.llm.names import same_performers_and_albums
from twinlake.llm.packing import fill_report, packed, packing_held
from twinlake.llm.setjoin import similar_projects
from twinlake.llm.subjects import composition, subjects_of
from twinlake.llm.survivors import best_members
from twinlake.llm.tokens import sized_documents
from twinlake.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path with the smallest path linked to it through common groups."""
    return consolidated(table(spark, sf_dir, "group_members"))


P2_SQL = """
WITH RECURSIVE rows_ AS (SELECT DISTINCT group_id, path FROM group_members WHERE path IS NOT NULL),
edges AS (SELECT DISTINCT r.path AS a, m.least AS b FROM rows_ r JOIN (SELECT group_id, min(path) AS least FROM rows_ GROUP BY group_id) m USING (group_id)),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(path, other) AS (SELECT DISTINCT path, path FROM rows_ UNION SELECT r.path, e.b FROM reach r JOIN both_ e ON r.other = e.a)
SELECT path, min(other) AS group_path FROM reach GROUP BY path
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that mean the same performer or album."""
    return same_performers_and_albums(table(spark, sf_dir, "signal_sets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving member of each duplicate group."""
    return best_members(table(spark, sf_dir, "group_members"))


P4_SQL = """
WITH m AS (SELECT group_id, path,
    max({'o': scored_at, 'v': score}) FILTER (WHERE score IS NOT NULL AND NOT isnan(score)) AS s,
    max({'o': scored_at, 'v': is_proposed_keeper}) FILTER (WHERE is_proposed_keeper IS NOT NULL) AS k,
    max({'o': scored_at, 'v': is_informational}) FILTER (WHERE is_informational IS NOT NULL) AS i
  FROM group_members WHERE path IS NOT NULL AND group_id IS NOT NULL GROUP BY group_id, path),
n AS (SELECT group_id FROM m GROUP BY group_id HAVING count(*) >= 2),
r AS (SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY s.v DESC, coalesce(k.v, 0) DESC, path) AS rn
  FROM m WHERE s IS NOT NULL AND i.v = 0 AND group_id IN (SELECT group_id FROM n))
SELECT group_id, path FROM r WHERE rn = 1
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of projects whose sets of file hashes overlap by 0.6 or more."""
    return similar_projects(table(spark, sf_dir, "project_infos"))


P7_SQL = """
WITH held AS (SELECT root, file_hashes FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY scanned_at DESC) AS rn FROM project_infos WHERE root IS NOT NULL) WHERE rn = 1),
t AS (SELECT DISTINCT root, lower(h) AS h FROM (SELECT root, unnest(map_values(file_hashes)) AS h FROM held) WHERE h IS NOT NULL),
n AS (SELECT root, count(*) AS n FROM t GROUP BY root),
c AS (SELECT a.root AS root_a, b.root AS root_b, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.root < b.root GROUP BY 1, 2)
SELECT root_a, root_b FROM c JOIN n x ON x.root = root_a JOIN n y ON y.root = root_b WHERE c / (x.n + y.n - c) >= 0.6
"""

def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's pieces with their container of 2,048 tokens, place in it and step group."""
    return packed(sized_documents(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of ``p8_packed`` are."""
    return fill_report(p8_packed(spark, sf_dir))


def p8_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text whether ``p8_packed`` places it whole, inside its container and in one piece if it fits."""
    docs = cut(sized_documents(table(spark, sf_dir, "documents")))
    return packing_held(packed(docs), docs)


P8_HELD_SQL = "SELECT doc_id, true AS whole, true AS inside, true AS split_only_if_long FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture(sized_documents(table(spark, sf_dir, "documents"), "source"), table(spark, sf_dir, "mix_targets"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of texts in each filled slot of each output shard."""
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its target share and what the selection reaches."""
    return _mixture(spark, sf_dir)[1]


def p9_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target whether ``p9_mixed`` keeps repeats, blocks and share."""
    docs = cut(sized_documents(table(spark, sf_dir, "documents"), "source"))
    return mixture_held(*mixture(docs, table(spark, sf_dir, "mix_targets")), docs)


P9_HELD_SQL = "SELECT source, target_share, max_repeats, true AS repeats_kept, true AS blocks_once, true AS share_kept FROM mix_targets WHERE source IS NOT NULL AND target_share > 0"


def _subject_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each text: those of about a fifth of its sentences or more."""
    return subjects_of(*_subject_tables(spark, sf_dir))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts are on each subject."""
    return composition(*_subject_tables(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p8_held": p8_held,
    "p9_mixed": p9_mixed,
    "p9_shares": p9_shares,
    "p9_held": p9_held,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
ORACLES = {"p2_found": P2_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p8_held": P8_HELD_SQL, "p9_held": P9_HELD_SQL}
