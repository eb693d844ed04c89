"""Organizing files: signals from names and texts, rules, destinations, coherent folders, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions import lexicons as L
from twinlake.functions import paths as P
from twinlake.session import cut

CONFIDENT, HINTED = 0.75, 0.4


def name_signals(files: DataFrame) -> DataFrame:
    """``(path, fname_date, fname_year, fname_seqno, fname_keywords, fname_issuer, path_tokens)`` from file names.

    A date needs non-digits around it; without one, a lone year counts. Keywords are plain substrings.
    The issuer is the first hit among vendors, institutions and brokerages.
    """
    name = P.base_name(F.col("path"))
    date = F.regexp_extract(name, r"(?:^|\D)((?:19|20)\d{2}[-_./](?:0[1-9]|1[0-2])[-_./](?:0[1-9]|[12]\d|3[01]))(?:\D|$)", 1)
    year = F.regexp_extract(name, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    number = F.regexp_extract(name, r"(?i)(?:^|[^A-Za-z0-9])(?:IMG|DSC|MVI|VID|PXL)_?(\d{2,6})", 1)
    low = F.lower(name)
    words = F.array_sort(F.filter(F.array(*[F.lit(k) for k in L.FILENAME_KEYWORDS]), lambda k: F.contains(low, k)))
    spaced = F.translate(F.lower(P.stem(F.col("path"))), "_-", "  ")
    issuers = F.filter(F.array(*[F.lit(v) for v in (*L.VENDORS, *L.INSTITUTIONS, *L.BROKERAGES)]), lambda v: F.contains(spaced, F.lower(v)))
    tokens = F.filter(F.split(F.lower(P.stem(F.col("path"))), r"[/_\-.\s]+"), lambda t: t != "")
    return files.select(
        "path", F.translate(F.nullif(date, F.lit("")), "_./", "---").alias("fname_date"), F.nullif(F.when(date != "", F.substring(date, 1, 4)).otherwise(year), F.lit("")).cast("int").alias("fname_year"),
        F.nullif(number, F.lit("")).cast("int").alias("fname_seqno"), words.alias("fname_keywords"), F.try_element_at(issuers, F.lit(1)).alias("fname_issuer"), tokens.alias("path_tokens"),
    )


def classified_texts(texts: DataFrame, key: str, text: str, classes: dict[str, dict[str, int]] = L.TEXT_CLASSES) -> DataFrame:
    """``(key, label, confidence, n_hits)``: the class whose phrases weigh most of its total; ties go to the earlier class.

    Phrases are substrings in any case. A text without a hit, null or empty, has no label.
    """
    low = F.lower(F.col(text))
    options = []
    for i, (label, phrases) in enumerate(classes.items()):
        raw, hits = F.lit(0), F.lit(0)
        for p, w in phrases.items():
            hit = F.contains(low, F.lit(p.lower()))
            raw, hits = raw + F.when(hit, w).otherwise(0), hits + F.when(hit, 1).otherwise(0)
        options.append(F.struct((raw / float(sum(phrases.values()))).alias("c"), F.lit(-i).alias("i"), F.lit(label).alias("l"), hits.alias("n")))
    best = F.array_max(F.array(*options))
    hit = best["c"] > 0
    return texts.select(F.col(key), F.when(hit, best["l"]).alias("label"), F.coalesce(F.when(hit, best["c"]), F.lit(0.0)).alias("confidence"), F.coalesce(F.when(hit, best["n"]), F.lit(0)).alias("n_hits"))


def merged_signals(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per ``keys`` each column's latest value that says anything: not null, empty or 0.0. One aggregation, no sort."""
    kinds = dict(rows.dtypes)

    def says(c: str) -> Column:
        v = F.col(c)
        return v.isNotNull() & (F.size(v) > 0 if kinds[c].startswith("array") else v != 0.0 if kinds[c] == "double" else F.lit(True))

    return rows.groupBy(*keys).agg(*[F.max(F.when(says(c), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in columns])


def year_hint() -> Column:
    years = [F.nullif(F.col(c), F.lit(0)) for c in ("pdf_year", "exif_year", "video_year", "fname_year", "mtime_year")]
    return F.coalesce(*[y.cast("string") for y in years], F.lit("Undated"))


def month_hint() -> Column:
    def month(y: str, m: str) -> Column:
        return F.when((F.col(y) != 0) & (F.col(m) != 0), F.format_string("%04d-%02d", F.col(y), F.col(m)))

    return F.coalesce(month("exif_year", "exif_month"), month("mtime_year", "mtime_month"), F.lit("Undated"))


def _issuer(pool: Sequence[str], unknown: str) -> Column:
    return F.coalesce(F.when(F.lower("fname_issuer").isin(*[p.lower() for p in pool]), F.col("fname_issuer")), F.lit(unknown))


def _fill(template: str) -> Column:
    values = {
        "year": year_hint(), "yyyy_mm": month_hint(), "artist": F.coalesce(P.clean_part(F.coalesce(F.nullif("id3_albumartist", F.lit("")), "id3_artist")), F.lit("UnknownArtist")), "album": F.coalesce(P.clean_part(F.col("id3_album")), F.lit("UnknownAlbum")),
        "vendor": _issuer(L.VENDORS, "UnknownVendor"), "institution": _issuer(L.INSTITUTIONS, "UnknownInstitution"), "brokerage": _issuer(L.BROKERAGES, "UnknownBrokerage"),
        "employer": F.coalesce(P.clean_part(F.col("pdf_author")), F.lit("UnknownEmployer")), "issuer": F.coalesce(P.clean_part(F.col("fname_issuer")), F.lit("Unknown")),
    }
    return F.concat_ws("/", *[values.get(p[1:-1], F.lit("Unknown")) if p.startswith("{") else F.lit(p) for p in template.split("/")])


def _test(kind: str, argument: str | tuple, weight: float) -> Column:
    """What one test of a rule gives; ``sum`` adds up the tests in its argument, to ``weight`` at most."""
    if kind == "sum":
        total = F.lit(0.0)
        for t in argument:
            total = total + F.coalesce(_test(*t), F.lit(0.0))
        return F.least(total, F.lit(float(weight)))
    if kind == "text":
        return F.when(F.col("pdf_class") == argument, weight * F.greatest(F.col("pdf_class_confidence"), F.lit(0.7)))
    if kind == "word":
        return F.when(F.arrays_overlap(F.transform("fname_keywords", F.lower), F.array(*[F.lit(w) for w in argument])), F.lit(weight))
    if kind == "issuer":
        pool = {"vendor": L.VENDORS, "institution": L.INSTITUTIONS, "brokerage": L.BROKERAGES}[argument]
        return F.when(F.lower("fname_issuer").isin(*[p.lower() for p in pool]), F.lit(weight))
    if kind == "mime":
        return F.when(F.lower("mime_top") == argument, F.lit(weight))
    artist = (F.coalesce(F.nullif("id3_albumartist", F.lit("")), F.col("id3_artist"), F.lit("")) != "") & F.lit(True)
    album = F.coalesce(F.col("id3_album"), F.lit("")) != ""
    return F.when(artist & album, F.lit(weight)).when(artist | album, F.lit(weight * 0.4))


def classified(signals: DataFrame, rules=L.RULES, confident: float = CONFIDENT, hinted: float = HINTED) -> DataFrame:
    """``signals`` with domain, subfolder, confidence, rule and alternatives (the next three, best first).

    Rules rank by score, precedence, number of placeholders and id. Below ``confident`` a file is
    Unsorted: under the best rule's domain from ``hinted`` on, flat below. No rule at all gives 0.0.
    """
    options = []
    for name, domain, template, precedence, tests in rules:
        score = F.greatest(*[F.coalesce(_test(*t), F.lit(0.0)) for t in tests], F.lit(0.0))
        options.append(F.struct((-score).alias("s"), F.lit(-precedence).alias("p"), F.lit(-template.count("{")).alias("t"), F.lit(name).alias("rule"), F.lit(domain).alias("domain"), _fill(template).alias("subfolder")))
    ranked = F.array_sort(F.filter(F.array(*options), lambda o: o["s"] < 0))
    rows = signals.withColumn("_r", ranked).withColumn("_best", F.try_element_at("_r", F.lit(1)))
    score = F.coalesce(F.when(F.col("_best").isNotNull(), F.least(-F.col("_best.s"), F.lit(1.0))), F.lit(0.0))
    sure, hint = score >= confident, score >= hinted
    domain = F.when(sure, F.col("_best.domain")).otherwise("Unsorted")
    folder = F.when(sure, F.col("_best.subfolder")).when(hint, F.col("_best.domain")).otherwise("")
    others = F.transform(F.slice("_r", 2, 3), lambda o: F.struct(o["domain"].alias("domain"), o["subfolder"].alias("subfolder"), F.least(-o["s"], F.lit(1.0)).alias("confidence")))
    return rows.withColumns({"domain": domain, "subfolder": folder, "confidence": score, "rule": F.when(hint, F.col("_best.rule")), "alternatives": others}).drop("_r", "_best")


def destination(domain: Column, subfolder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(domain, F.lit("")), F.nullif(subfolder, F.lit("")), name)


def coherent_folders(entries: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """Folders of ``entries (path, domain, subfolder)`` of which a share goes to one place: its kind and counts.

    Folders need ``least`` files; Unsorted is no place. Of equally frequent places the first by name counts.
    """
    rows = entries.withColumn("folder", P.parent(F.col("path")))
    places = rows.groupBy("folder", "domain", "subfolder").agg(F.count("*").alias("n"))
    top = places.groupBy("folder").agg(F.sum("n").alias("n_files"), F.min(F.struct((-F.col("n")).alias("n"), "domain", "subfolder")).alias("b"), F.max(F.col("subfolder").startswith("Music/")).alias("music"), F.max(F.col("subfolder").startswith("Books")).alias("books"))
    out = top.select("folder", "n_files", (-F.col("b.n")).alias("n_dominant"), F.col("b.domain").alias("domain"), F.col("b.subfolder").alias("subfolder"), "music", "books")
    out = out.filter((F.col("n_files") >= least) & (F.col("n_dominant") / F.col("n_files") >= share) & (F.col("domain") != "Unsorted"))
    kind = F.when((F.col("domain") == "Media") & F.col("music"), "music_album").when((F.col("domain") == "Media") & F.col("books"), "book_series").when(F.col("domain").isin("Photos", "Videos"), "photo_event").otherwise("directory")
    return out.select("folder", "n_files", "n_dominant", destination(F.col("domain"), F.col("subfolder"), F.lit(None).cast("string")).alias("destination"), F.concat_ws(":", kind, P.base_name(F.col("folder"))).alias("group_id"))


def split_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Coherent groups whose files would end in more than one folder: what an apply step refuses."""
    rows = entries.withColumn("_f", P.parent(F.col("path"))).join(groups.select(F.col("folder").alias("_g"), "group_id"), F.col("_f") == F.col("_g"))
    return rows.groupBy("group_id", F.col("_g").alias("folder")).agg(F.countDistinct("domain", "subfolder").alias("n_folders")).filter("n_folders > 1")


def sessions(rows: DataFrame, ts: str, gap: float, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``session_no``: a gap of ``gap`` or more (in the unit of ``ts``) begins the next session of its key.

    Rows are range-partitioned by key and time and written once, so a key with most rows, or no key at
    all, is spread over tasks. Each partition's last time and number of gaps per key are carried to
    the partitions after it by windows over those few numbers and joined back; the rest is local to the
    partition. Null times are ignored; a null key is a key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    live = rows.filter(F.col(ts).isNotNull())
    placed = cut(live.repartitionByRange(parts, *keys, ts).withColumn("_part", F.spark_partition_id()).withColumn("_all", F.lit(0)))
    within = Window.partitionBy("_all", *keys, "_part").orderBy(ts, *order)
    along = Window.partitionBy("_all", *keys).orderBy("_part")

    def carried(df: DataFrame, sums: DataFrame, value: str) -> DataFrame:
        side = sums.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_part").alias("_s_part"), value)
        on = F.col("_part") == F.col("_s_part")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        return df.join(side, on).drop("_s_part", *[f"_s_{k}" for k in keys])

    lasts = placed.groupBy("_all", *keys, "_part").agg(F.max(ts).alias("_last")).withColumn("_before", F.lag("_last").over(along))
    gapped = carried(placed, lasts, "_before").withColumn("_before", F.coalesce(F.lag(ts).over(within), "_before")).withColumn("_new", F.when(F.col(ts) - F.col("_before") >= gap, 1).otherwise(0))
    gaps = gapped.groupBy("_all", *keys, "_part").agg(F.sum("_new").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = carried(gapped, gaps, "_off").withColumn("session_no", (F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_off")).cast("bigint"))
    return out.drop("_part", "_all", "_before", "_new", "_off")


def media_events(entries: DataFrame, gap_hours: float = 12.0, least: int = 5) -> DataFrame:
    """``(session_no, event, domain, n_files, first_ts, last_ts)`` of photos and videos ``entries (path, ts, domain)``.

    Times split where the gap is ``gap_hours`` or more; smaller events than ``least`` are left to
    their months. An event is named by its first and last day in UTC; its domain is that of its first
    file, Photos unless that is Videos.
    """
    rows = sessions(entries, "ts", gap_hours * 3600, order=["path"])
    events = rows.groupBy("session_no").agg(F.count("*").alias("n_files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.struct("ts", "path", "domain")).alias("f")).filter(F.col("n_files") >= least)
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    a, b = day(F.col("first_ts")), day(F.col("last_ts"))
    name = F.when(a == b, a).otherwise(F.concat(a, F.lit("_to_"), b))
    return events.select("session_no", name.alias("event"), F.when(F.col("f.domain") == "Videos", "Videos").otherwise("Photos").alias("domain"), "n_files", "first_ts", "last_ts", F.concat(F.substring(name, 1, 4), F.lit("/"), name).alias("subfolder"))


def final_names(entries: DataFrame, policy: str = "preserve") -> DataFrame:
    """``entries (path, folder, mtime)`` with the name each file gets and its place, collisions set apart.

    ``preserve`` keeps names; ``prefix_date`` puts the UTC day in front; ``hash`` appends 8 digits of the
    path's digest. Of files at one place the smallest path keeps its name, the others get the digits.
    """
    name, mark = P.base_name(F.col("path")), F.substring(F.sha2("path", 256), 1, 8)
    marked = F.concat(P.stem(F.col("path")), F.lit("_"), mark, F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    new = {"preserve": name, "prefix_date": F.concat(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd"), F.lit("_"), name), "hash": marked}[policy]
    rows = entries.withColumn("_place", F.concat_ws("/", F.nullif("folder", F.lit("")), new))
    first = rows.groupBy("_place").agg(F.min("path").alias("_first")).withColumnRenamed("_place", "_p")
    out = rows.join(first, F.col("_place") == F.col("_p"))
    return out.select("path", F.when(F.col("path") == F.col("_first"), F.col("_place")).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), marked)).alias("destination"), (F.col("path") != F.col("_first")).alias("is_collision"))
