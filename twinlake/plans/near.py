"""Queries of the near-duplicate passes. Signatures are stood in for by digests, some of them altered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators import inventory, similarity
from twinlake.plans.inventory import INV, SUFFIX, current

def _kind():
    return F.pmod(F.length("path"), F.lit(3))


def _code():
    """A digest with some bits changed by the path's length, as a re-encoded picture's hash would have."""
    h = F.col("full_hash")
    return F.when(_kind() == 1, F.concat(F.translate(F.substring(h, 1, 2), "0123456789abcdef", "1032547698badcfe"), F.substring(h, 3, 62))).when(_kind() == 2, F.concat(F.substring(h, 1, 62), F.translate(F.substring(h, 63, 2), "0123456789abcdef", "2301674589cdabef"))).otherwise(h)


def _media(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    suffixes = {"image": P.IMAGE_SUFFIXES, "audio": P.AUDIO_SUFFIXES, "video": P.VIDEO_SUFFIXES}[kind]
    return current(spark, sf_dir).filter(P.suffix(F.col("path")).isin(*suffixes) & ~F.col("is_archive_member")).select("path", "size", F.concat_ws(":", "full_hash", _kind().cast("string")).alias("full_hash"), _code().alias("code"), (F.pmod(F.col("size"), F.lit(400)) / 2.0).alias("duration"))


_CODE = """CASE length(path) % 3 WHEN 1 THEN translate(substr(full_hash, 1, 2), '0123456789abcdef', '1032547698badcfe') || substr(full_hash, 3, 62)
  WHEN 2 THEN substr(full_hash, 1, 62) || translate(substr(full_hash, 63, 2), '0123456789abcdef', '2301674589cdabef') ELSE full_hash END"""


def _media_sql(suffixes) -> str:
    return f"{INV}, m AS (SELECT path, size, full_hash || ':' || CAST(length(path) % 3 AS VARCHAR) AS full_hash, {_CODE} AS code, (size % 400) / 2.0 AS duration FROM inv WHERE NOT is_archive_member AND {SUFFIX} IN ({', '.join(repr(x) for x in suffixes)}))"


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct picture codes within eight bits."""
    return similarity.hamming_pairs(_media(spark, sf_dir, "image"), 8)


def _groups(spark: SparkSession, sf_dir: str):
    images = _media(spark, sf_dir, "image")
    return similarity.near_groups(images.withColumnRenamed("code", "key"), similarity.hamming_pairs(images, 8), "distance", "max")


def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate pictures with keeper, worst distance and similarity in percent."""
    return _groups(spark, sf_dir)[0].withColumn("similarity_pct", F.round(100 * (1 - F.col("distance") / 256.0), 4))


def image_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


def audio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound prints of eight samples alike by 0.95 within two seconds."""
    prints = _media(spark, sf_dir, "audio").select(F.concat_ws("@", "code", F.col("duration").cast("string")).alias("key"), "duration", similarity._words(F.col("code")).alias("words"))
    return similarity.audio_pairs(prints).withColumn("similarity", F.round("similarity", 6))


def video_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films of five frames alike by 0.9 within five seconds."""
    frames = F.array(F.col("code"), *[F.sha2(F.concat(F.substring("full_hash", 1, 64), F.lit(str(i))), 256) for i in range(4)])
    films = _media(spark, sf_dir, "video").select(F.concat_ws("@", "code", F.col("duration").cast("string")).alias("key"), "duration", frames.alias("frames"))
    return similarity.video_pairs(films).withColumn("similarity", F.round("similarity", 6))


def _bits(x: str, y: str, n: int) -> str:
    return " + ".join(f"CAST(bit_count(xor(CAST('0x' || substr({x}, {8 * i + 1}, 8) AS BIGINT), CAST('0x' || substr({y}, {8 * i + 1}, 8) AS BIGINT))) AS INTEGER)" for i in range(n))


_IMAGE = _media_sql(P.IMAGE_SUFFIXES)
_PAIRS = f"""c AS (SELECT DISTINCT code, {", ".join(f"CAST('0x' || substr(code, {8 * i + 1}, 8) AS BIGINT) AS w{i}" for i in range(8))} FROM m WHERE length(code) = 64),
pairs AS (SELECT * FROM (SELECT x.code AS a, y.code AS b, {" + ".join(f"CAST(bit_count(xor(x.w{i}, y.w{i})) AS INTEGER)" for i in range(8))} AS distance FROM c x JOIN c y ON x.code < y.code) WHERE distance <= 8)"""
_COMPS = f"""WITH RECURSIVE {_IMAGE}, {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
mem AS (SELECT component, path, size, full_hash FROM m JOIN comp ON m.code = comp.node),
grp AS (SELECT component, count(*) AS n_members, min(size) AS smallest, max(size) AS largest, CAST(sum(size) AS BIGINT) AS bytes, arg_max(path, (size, path)) AS keeper FROM mem GROUP BY 1 HAVING min(full_hash) <> max(full_hash)),
stat AS (SELECT component, max(distance) AS distance FROM pairs JOIN comp ON pairs.a = comp.node GROUP BY 1)"""
QUERIES = {"image_pairs": image_pairs, "image_groups": image_groups, "image_members": image_members, "audio_pairs": audio_pairs, "video_pairs": video_pairs}
ORACLES = {
    "image_pairs": f"WITH {_IMAGE}, {_PAIRS} SELECT a, b, distance FROM pairs",
    "image_groups": f"{_COMPS} SELECT component, n_members, smallest, largest, distance, keeper, bytes - largest AS reclaim_bytes, round(100 * (1 - distance / 256.0), 4) AS similarity_pct FROM grp JOIN stat USING (component)",
    "image_members": f"{_COMPS} SELECT component, path, path = keeper AS is_keeper, round(CASE WHEN path = keeper THEN 0.0 WHEN largest > 0 THEN -1 - (1 - size / largest) ELSE -1.0 END, 6) AS score FROM mem JOIN grp USING (component)",
    "audio_pairs": f"""WITH {_media_sql(P.AUDIO_SUFFIXES)}, p AS (SELECT DISTINCT code, duration, code || '@' || CAST(CAST(duration AS DOUBLE) AS VARCHAR) AS key FROM m)
        SELECT * FROM (SELECT x.key AS a, y.key AS b, round(1 - ({_bits("x.code", "y.code", 8)}) / 256.0, 6) AS similarity FROM p x JOIN p y ON x.key < y.key AND abs(x.duration - y.duration) <= 2) WHERE similarity >= 0.95""",
    "video_pairs": f"""WITH {_media_sql(P.VIDEO_SUFFIXES)}, p AS (SELECT DISTINCT code, duration, code || '@' || CAST(CAST(duration AS DOUBLE) AS VARCHAR) AS key, substr(full_hash, 1, 64) AS h FROM m),
        f AS (SELECT key, duration, [code{"".join(f", sha256(h || '{i}')" for i in range(4))}] AS fr FROM p)
        SELECT * FROM (SELECT x.key AS a, y.key AS b, round(1 - ({" + ".join(_bits(f"x.fr[{k + 1}]", f"y.fr[{k + 1}]", 8) for k in range(5))}) / 5.0 / 256, 6) AS similarity FROM f x JOIN f y ON x.key < y.key AND abs(x.duration - y.duration) <= 5) WHERE similarity >= 0.9""",
}
