"""Queries of the organizer over signal sets, documents and events."""

from __future__ import annotations

import mimetypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import lexicons as L
from twinlake.functions import paths as P
from twinlake.operators import organize
from twinlake.plans.inventory import BASE, INV, SUFFIX, current
from twinlake.session import table

SIGNALS = ["mime_top", "mime_sub", "mtime_year", "mtime_month", "fname_year", "fname_issuer", "fname_keywords", "id3_artist", "id3_albumartist", "id3_album", "exif_year", "exif_month", "exif_ts_epoch", "video_year", "video_ts_epoch", "pdf_author", "pdf_year", "pdf_class", "pdf_class_confidence"]


def name_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, numbers, words and issuers in file names."""
    out = organize.name_signals(current(spark, sf_dir).select("path"))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("fname_keywords", "path_tokens")})


def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified by weighted phrases."""
    return organize.classified_texts(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "doc_id", "text").withColumn("confidence", F.round("confidence", 6))


def signals_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal set per file, each field as last extracted."""
    out = organize.merged_signals(table(spark, sf_dir, "signal_sets").filter("path IS NOT NULL"), ["path"], "extracted_at", SIGNALS)
    return out.withColumn("fname_keywords", F.concat_ws(",", "fname_keywords"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.classified(organize.merged_signals(table(spark, sf_dir, "signal_sets").filter("path IS NOT NULL"), ["path"], "extracted_at", SIGNALS))


def organized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file belongs, how sure that is, and what else it could be."""
    rows = _classified(spark, sf_dir)
    return rows.select("path", "domain", "subfolder", F.round("confidence", 6).alias("confidence"), "rule", F.array_join(F.transform("alternatives", lambda a: a["domain"]), ",").alias("others"), organize.destination(F.col("domain"), F.col("subfolder"), P.base_name(F.col("path"))).alias("destination"))


def organized_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"))


def organized_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose files belong together."""
    return organize.coherent_folders(_classified(spark, sf_dir), 3, 0.6)


def organized_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherent folders that would be split."""
    rows = _classified(spark, sf_dir)
    return organize.split_groups(rows, organize.coherent_folders(rows, 3, 0.6))


def organized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final names in one flat folder per suffix, with collisions set apart."""
    files = current(spark, sf_dir).filter("source_id = 'local' AND NOT is_archive_member").select("path", "mtime", P.suffix(F.col("path")).alias("folder"))
    return organize.final_names(files, "prefix_date")


def media_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events among photos and videos of the whole collection, by gaps of twelve hours."""
    rows = organize.merged_signals(table(spark, sf_dir, "signal_sets").filter("path IS NOT NULL AND mime_top IN ('image', 'video')"), ["path"], "extracted_at", ["exif_ts_epoch", "video_ts_epoch", "mime_top"])
    media = rows.select("path", F.coalesce("exif_ts_epoch", "video_ts_epoch").alias("ts"), F.when(F.col("mime_top") == "video", "Videos").otherwise("Photos").alias("domain"))
    return organize.media_events(media)


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user of the event table, by gaps of twelve hours."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = organize.sessions(rows, "us", 12 * 3600 * 1e6, ["user_id"], ["event_id"])
    return out.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"))


_K = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_CLASS_OPTIONS = ", ".join(
    "{'c': (" + " + ".join(f"CASE WHEN contains(low, '{p.lower()}') THEN {w} ELSE 0 END" for p, w in phrases.items()) + f") / {float(sum(phrases.values()))}, 'i': {-i}, 'l': '{label}', 'n': " + " + ".join(f"CASE WHEN contains(low, '{p.lower()}') THEN 1 ELSE 0 END" for p in phrases) + "}"
    for i, (label, phrases) in enumerate(L.TEXT_CLASSES.items())
)
_SAYS = {"fname_keywords": "len(fname_keywords) > 0", "exif_ts_epoch": "exif_ts_epoch <> 0", "video_ts_epoch": "video_ts_epoch <> 0", "pdf_class_confidence": "pdf_class_confidence <> 0"}
_MERGED = "merged AS (SELECT path, " + ", ".join(f"(max({{'o': extracted_at, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL AND {_SAYS.get(c, 'true')})).v AS {c}" for c in SIGNALS) + " FROM signal_sets WHERE path IS NOT NULL GROUP BY path)"
_FILL = {
    "year": "coalesce(CAST(nullif(pdf_year, 0) AS VARCHAR), CAST(nullif(exif_year, 0) AS VARCHAR), CAST(nullif(video_year, 0) AS VARCHAR), CAST(nullif(fname_year, 0) AS VARCHAR), CAST(nullif(mtime_year, 0) AS VARCHAR), 'Undated')",
    "yyyy_mm": "coalesce(CASE WHEN exif_year <> 0 AND exif_month <> 0 THEN printf('%04d-%02d', exif_year, exif_month) END, CASE WHEN mtime_year <> 0 AND mtime_month <> 0 THEN printf('%04d-%02d', mtime_year, mtime_month) END, 'Undated')",
    "artist": """coalesce(nullif(trim(regexp_replace(coalesce(nullif(id3_albumartist, ''), id3_artist), '[\\\\/:*?"<>|]', ' ', 'g')), ''), 'UnknownArtist')""",
    "album": """coalesce(nullif(trim(regexp_replace(id3_album, '[\\\\/:*?"<>|]', ' ', 'g')), ''), 'UnknownAlbum')""",
    "vendor": "'UnknownVendor'", "institution": "'UnknownInstitution'",
}


def _test_sql(kind: str, argument: str, weight: float) -> str:
    if kind == "text":
        return f"CASE WHEN pdf_class = '{argument}' THEN {weight} * greatest(pdf_class_confidence, 0.7) ELSE 0.0 END"
    if kind == "word":
        return f"CASE WHEN list_has_any([lower(k) for k in fname_keywords], {_K(argument)}) THEN {weight} ELSE 0.0 END"
    if kind == "issuer":
        return f"CASE WHEN lower(fname_issuer) IN ({', '.join(repr(p.lower()) for p in {'vendor': L.VENDORS, 'institution': L.INSTITUTIONS, 'brokerage': L.BROKERAGES}[argument])}) THEN {weight} ELSE 0.0 END"
    if kind == "mime":
        return f"CASE WHEN lower(mime_top) = '{argument}' THEN {weight} ELSE 0.0 END"
    return f"CASE WHEN coalesce(nullif(id3_albumartist, ''), id3_artist, '') <> '' AND coalesce(id3_album, '') <> '' THEN {weight} WHEN coalesce(nullif(id3_albumartist, ''), id3_artist, '') <> '' OR coalesce(id3_album, '') <> '' THEN {weight * 0.4} ELSE 0.0 END"


_OPTIONS = ", ".join(
    "{'s': -greatest(" + ", ".join(f"CAST({_test_sql(*t)} AS DOUBLE)" for t in tests) + f", 0.0), 'p': {-precedence}, 't': {-template.count('{')}, 'rule': '{name}', 'domain': '{domain}', 'subfolder': "
    + " || '/' || ".join(_FILL[p[1:-1]] if p.startswith("{") else f"'{p}'" for p in template.split("/")) + "}"
    for name, domain, template, precedence, tests in L.RULES
)
_ORGANIZED = f"""{_MERGED}, opt AS (SELECT path, list_sort(list_filter([{_OPTIONS}], lambda o: o.s < 0)) AS r FROM merged),
best AS (SELECT path, r, CASE WHEN len(r) > 0 THEN least(-r[1].s, 1.0) ELSE 0.0 END AS score FROM opt),
org AS (SELECT path, CASE WHEN score >= 0.75 THEN r[1].domain ELSE 'Unsorted' END AS domain, CASE WHEN score >= 0.75 THEN r[1].subfolder WHEN score >= 0.4 THEN r[1].domain ELSE '' END AS subfolder,
  score AS confidence, CASE WHEN score >= 0.4 THEN r[1].rule END AS rule, array_to_string([o.domain for o in r[2:4]], ',') AS others FROM best)"""
_FOLDERS = f"""{_ORGANIZED}, pl AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, domain, subfolder, count(*) AS n FROM org GROUP BY ALL),
tp AS (SELECT folder, CAST(sum(n) AS BIGINT) AS n_files, min({{'n': -n, 'domain': domain, 'subfolder': subfolder}}) AS b, bool_or(starts_with(subfolder, 'Music/')) AS music, bool_or(starts_with(subfolder, 'Books')) AS books FROM pl GROUP BY 1),
fold AS (SELECT folder, n_files, -b.n AS n_dominant, concat_ws('/', nullif(b.domain, ''), nullif(b.subfolder, '')) AS destination,
  CASE WHEN b.domain = 'Media' AND music THEN 'music_album' WHEN b.domain = 'Media' AND books THEN 'book_series' WHEN b.domain IN ('Photos', 'Videos') THEN 'photo_event' ELSE 'directory' END || ':' || regexp_extract(folder, '([^/]*)$', 1) AS group_id
  FROM tp WHERE n_files >= 3 AND -b.n / n_files >= 0.6 AND b.domain <> 'Unsorted')"""
_STEM = f"regexp_replace({BASE}, '^(.+)\\.[^.]+$', '\\1')"
_DATE = f"regexp_extract({BASE}, '(?:^|\\D)((?:19|20)\\d{{2}}[-_./](?:0[1-9]|1[0-2])[-_./](?:0[1-9]|[12]\\d|3[01]))(?:\\D|$)', 1)"
def music_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags read back from files made of the signals: each distinct row of them as the head of a music file."""
    from twinlake.sources.signals import read_signals

    @F.udf("binary", useArrow=True)
    def tagged(artist: str, band: str, album: str) -> bytes:
        frames = b"".join(k + len(v).to_bytes(4, "big") + b"\0\0" + v for k, t in ((b"TPE1", artist), (b"TPE2", band), (b"TALB", album)) if t is not None for v in [b"\1" + t.encode("utf-16")])
        n = len(frames)
        return b"ID3\3\0\0" + bytes((n >> s) & 127 for s in (21, 14, 7, 0)) + frames + b"\xff\xfb" + bytes(64)

    rows = table(spark, sf_dir, "signal_sets").select("path", "id3_artist", "id3_albumartist", "id3_album").filter("path IS NOT NULL").distinct()
    files = rows.select(F.concat("path", F.lit(".mp3")).alias("path"), tagged("id3_artist", "id3_albumartist", "id3_album").alias("content"))
    return read_signals(files).select("path", "id3_artist", "id3_albumartist", "id3_album", "failed")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by suffix, year and month by time of each file."""
    from twinlake.sources.signals import name_and_time_signals

    return name_and_time_signals(current(spark, sf_dir))


def _tag_sql(c: str) -> str:
    return f"nullif(trim(string_split({c}, chr(0))[1]), '') AS {c}"


_TYPES = "MAP {" + ", ".join(f"'{s}': '{t}'" for s, t in sorted(mimetypes.types_map.items())) + "}"
QUERIES = {
    "music_tags": music_tags, "file_kinds": file_kinds,
    "name_signals": name_signals, "text_classes": text_classes, "signals_merged": signals_merged, "organized": organized, "organized_domains": organized_domains, "organized_folders": organized_folders,
    "organized_splits": organized_splits, "organized_names": organized_names, "media_events": media_events, "user_sessions": user_sessions,
}
ORACLES = {
    "music_tags": f"SELECT path || '.mp3' AS path, {_tag_sql('id3_artist')}, {_tag_sql('id3_albumartist')}, {_tag_sql('id3_album')}, CAST(NULL AS VARCHAR) AS failed FROM (SELECT DISTINCT path, id3_artist, id3_albumartist, id3_album FROM signal_sets WHERE path IS NOT NULL)",
    "file_kinds": f"""WITH {INV}, t AS (SELECT path, {_TYPES}[{SUFFIX}] AS m, make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000) AS d FROM inv)
        SELECT path, string_split(m, '/')[1] AS mime_top, string_split(m, '/')[2] AS mime_sub, CAST(year(d) AS INTEGER) AS mtime_year, CAST(month(d) AS INTEGER) AS mtime_month FROM t""",
    "name_signals": f"""WITH {INV} SELECT path, translate(nullif({_DATE}, ''), '_./', '---') AS fname_date, CAST(nullif(CASE WHEN {_DATE} <> '' THEN substr({_DATE}, 1, 4) ELSE regexp_extract({BASE}, '(?:^|\\D)((?:19|20)\\d{{2}})(?:\\D|$)', 1) END, '') AS INTEGER) AS fname_year,
        CAST(nullif(regexp_extract({BASE}, '(?i)(?:^|[^A-Za-z0-9])(?:IMG|DSC|MVI|VID|PXL)_?(\\d{{2,6}})', 1), '') AS INTEGER) AS fname_seqno, array_to_string(list_sort(list_filter({_K(L.FILENAME_KEYWORDS)}, lambda k: contains(lower({BASE}), k))), ',') AS fname_keywords,
        list_filter({_K((*L.VENDORS, *L.INSTITUTIONS, *L.BROKERAGES))}, lambda v: contains(translate(lower({_STEM}), '_-', '  '), lower(v)))[1] AS fname_issuer,
        array_to_string(list_filter(regexp_split_to_array(lower({_STEM}), '[/_\\-.\\s]+'), lambda t: t <> ''), ',') AS path_tokens FROM inv""",
    "text_classes": f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, list_max([{_CLASS_OPTIONS}]) AS b FROM t)
        SELECT doc_id, CASE WHEN b.c > 0 THEN b.l END AS label, round(CASE WHEN b.c > 0 THEN b.c ELSE 0.0 END, 6) AS confidence, CAST(CASE WHEN b.c > 0 THEN b.n ELSE 0 END AS INTEGER) AS n_hits FROM b""",
    "signals_merged": f"WITH {_MERGED} SELECT * REPLACE (coalesce(array_to_string(fname_keywords, ','), '') AS fname_keywords) FROM merged",
    "organized": f"WITH {_ORGANIZED} SELECT path, domain, subfolder, round(confidence, 6) AS confidence, rule, coalesce(others, '') AS others, concat_ws('/', nullif(domain, ''), nullif(subfolder, ''), {BASE}) AS destination FROM org",
    "organized_domains": f"WITH {_ORGANIZED} SELECT domain, count(*) AS n FROM org GROUP BY 1",
    "organized_folders": f"WITH {_FOLDERS} SELECT * FROM fold",
    "organized_splits": f"WITH {_FOLDERS} SELECT group_id, folder, count(DISTINCT (domain, subfolder)) AS n_folders FROM org JOIN fold ON folder = regexp_extract(path, '^(.*)/[^/]*$', 1) GROUP BY ALL HAVING count(DISTINCT (domain, subfolder)) > 1",
    "organized_names": f"""WITH {INV}, f AS (SELECT path, {SUFFIX} AS folder, strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y-%m-%d') || '_' || {BASE} AS name FROM inv WHERE source_id = 'local' AND NOT is_archive_member),
        g AS (SELECT *, min(path) OVER (PARTITION BY folder, name) AS first FROM f)
        SELECT path, concat_ws('/', nullif(folder, ''), CASE WHEN path = first THEN name ELSE {_STEM} || '_' || substr(sha256(path), 1, 8) || regexp_extract({BASE}, '^.+(\\.[^.]+)$', 1) END) AS destination, path <> first AS is_collision FROM g""",
    "media_events": f"""WITH {_MERGED}, m AS (SELECT path, coalesce(exif_ts_epoch, video_ts_epoch) AS ts, CASE WHEN mime_top = 'video' THEN 'Videos' ELSE 'Photos' END AS domain FROM merged WHERE mime_top IN ('image', 'video')),
        l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, path) >= 43200 THEN 1 ELSE 0 END AS new FROM m WHERE ts IS NOT NULL), s AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM l),
        e AS (SELECT session_no, count(*) AS n_files, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(domain, (ts, path)) AS domain FROM s GROUP BY 1 HAVING count(*) >= 5),
        n AS (SELECT *, strftime(make_timestamp(CAST(floor(first_ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS a, strftime(make_timestamp(CAST(floor(last_ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS b FROM e)
        SELECT session_no, CASE WHEN a = b THEN a ELSE a || '_to_' || b END AS event, domain, n_files, first_ts, last_ts, substr(a, 1, 4) || '/' || CASE WHEN a = b THEN a ELSE a || '_to_' || b END AS subfolder FROM n""",
    "user_sessions": """WITH l AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM l) SELECT user_id, session_no, count(*) AS n, min(event_id) AS least_event FROM s GROUP BY 1, 2""",
}
