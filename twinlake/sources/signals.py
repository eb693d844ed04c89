"""Signals read from file contents: music tags, picture and film metadata, PDF information and first page."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.organize import classified_texts

#: Characters of a PDF's first page that are read, and the least confidence of a class that is kept.
PAGE_CHARACTERS, CLASS_CONFIDENCE = 5000, 0.6
SCHEMA = (
    "path string, id3_artist string, id3_albumartist string, id3_album string, id3_track int, id3_year int, id3_genre string, exif_date_original string, exif_year int, exif_month int, exif_make string, exif_model string, "
    "exif_gps_lat double, exif_gps_lon double, exif_ts_epoch double, video_create_date string, video_year int, video_ts_epoch double, video_duration_s double, "
    "pdf_title string, pdf_author string, pdf_creation_date string, pdf_year int, pdf_keywords string, pdf_first_page_text string, failed string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _year(text: str | None) -> int | None:
    m = re.search(r"(?<!\d)(1[89]|20)\d\d(?!\d)", text or "")
    return int(m[0]) if m else None


def _stamp(text: str | None) -> float | None:
    """Seconds since 1970 of a picture's time, which has no zone and is taken for UTC."""
    try:
        return datetime.strptime((text or "").strip("\0 ")[:19], "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
    except ValueError:
        return None


def _id3(data: bytes) -> dict[str, str]:
    """Text frames of an ID3 tag of version 2.3 or 2.4."""
    number = lambda b, bits: sum(x << (bits * (len(b) - 1 - i)) for i, x in enumerate(b))
    at, end, out = 10, 10 + number(data[6:10], 7), {}
    if data[5] & 0x40:
        at += number(data[at : at + 4], 7) if data[3] == 4 else 4 + number(data[at : at + 4], 8)
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name, size = data[at : at + 4].decode("latin-1"), number(data[at + 4 : at + 8], 7 if data[3] == 4 else 8)
        body = data[at + 10 : at + 10 + size]
        if name.startswith("T") and name != "TXXX" and body:
            out[name] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").split("\0")[0].strip(" ")
        at += 10 + size
    return out


def _vorbis(data: bytes) -> dict[str, str]:
    """Comments of a FLAC file."""
    at, out = 4, {}
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 4:
            i = at + 4 + 4 + int.from_bytes(data[at + 4 : at + 8], "little")
            for _ in range(int.from_bytes(data[i : i + 4], "little")):
                n = int.from_bytes(data[i + 4 : i + 8], "little")
                k, _, v = data[i + 8 : i + 8 + n].decode("utf-8", "replace").partition("=")
                out.setdefault(k.upper(), v.strip())
                i += 4 + n
        if kind & 0x80:
            break
        at += 4 + size
    return out


def music(data: bytes) -> dict:
    """Tags of MP3 (ID3 versions 1 and 2) and FLAC files."""
    if data[:4] == b"fLaC":
        t = _vorbis(data)
        artist, band, album, genre, date, track = (t.get(k) for k in ("ARTIST", "ALBUMARTIST", "ALBUM", "GENRE", "DATE", "TRACKNUMBER"))
    else:
        t = _id3(data) if data[:3] == b"ID3" else {}
        old = data[-128:] if data[-128:-125] == b"TAG" else b""
        last = lambda a, b: old[a:b].decode("latin-1").split("\0")[0].strip()
        artist, album, genre = t.get("TPE1") or last(33, 63), t.get("TALB") or last(63, 93), t.get("TCON")
        band, date, track = t.get("TPE2"), t.get("TDRC") or t.get("TYER") or last(93, 97), t.get("TRCK")
    m = re.match(r"\d+", track or "")
    return {"id3_artist": artist or None, "id3_albumartist": band or None, "id3_album": album or None, "id3_genre": genre or None, "id3_year": _year(date), "id3_track": int(m[0]) if m else None}


def picture(data: bytes) -> dict:
    """Camera, time and place of a JPEG or TIFF file."""
    start = data.find(b"Exif\0\0", 0, 1 << 17) + 6 if data[:2] == b"\xff\xd8" else 0
    if start == 5:
        return {}
    tiff = data[start:]
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def fields(at: int) -> dict:
        out = {}
        for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
            size = sizes.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * i)[0]
            if kind == 2:
                out[tag] = tiff[place : place + count].split(b"\0")[0].decode("latin-1").strip()
            elif kind in (3, 4):
                out[tag] = struct.unpack_from(order + "HI"[kind - 3], tiff, place)[0]
            elif kind == 5:
                pairs = struct.unpack_from(order + f"{2 * count}I", tiff, place)
                out[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        return out

    main = fields(struct.unpack_from(order + "I", tiff, 4)[0])
    more = fields(main[0x8769]) if 0x8769 in main else {}
    gps = fields(main[0x8825]) if 0x8825 in main else {}
    degrees = lambda v, mark: sum(x / 60**i for i, x in enumerate(v)) * (-1 if mark in ("S", "W") else 1) if v else None
    taken = more.get(0x9003) or main.get(0x0132)
    ts = _stamp(taken)
    day = datetime.fromtimestamp(ts, timezone.utc) if ts is not None else None
    return {
        "exif_date_original": taken or None, "exif_ts_epoch": ts, "exif_year": day and day.year, "exif_month": day and day.month, "exif_make": main.get(0x010F) or None, "exif_model": main.get(0x0110) or None,
        "exif_gps_lat": degrees(gps.get(2), gps.get(1)), "exif_gps_lon": degrees(gps.get(4), gps.get(3)),
    }


def film(data: bytes) -> dict:
    """Time of creation and duration of an MP4 or QuickTime file."""

    def box(at: int, end: int, name: bytes) -> tuple[int, int]:
        while at + 8 <= end:
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            head = 16 if size == 1 else 8
            size = int.from_bytes(data[at + 8 : at + 16], "big") if size == 1 else size or end - at
            if kind == name:
                return at + head, min(end, at + size)
            if size < 8:
                raise ValueError("broken box")
            at += size
        raise ValueError(f"no {name.decode()} box")

    at, end = box(*box(0, len(data), b"moov"), b"mvhd")
    made, scale, length = struct.unpack_from(">QxxxxxxxxIQ" if data[at] == 1 else ">IxxxxII", data, at + 4)
    ts = made - 2_082_844_800.0 if made > 2_082_844_800 else None  # boxes count from 1904
    day = datetime.fromtimestamp(ts, timezone.utc) if ts is not None else None
    return {"video_ts_epoch": ts, "video_create_date": day and day.strftime("%Y-%m-%d"), "video_year": day and day.year, "video_duration_s": length / scale if scale else None}


_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_SHOWN = re.compile(rb"\[((?:\\.|[^\]\\])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|T[dD]\b|ET\b)")


def _pdf_text(raw: bytes) -> str:
    text = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), raw, flags=re.S)
    return text.decode("utf-16") if text[:2] in (b"\xfe\xff", b"\xff\xfe") else text.decode("cp1252", "replace")


def pdf(data: bytes) -> dict:
    """Title, author and year of a PDF file, and the text of the first content stream that shows any."""
    if data[:5] != b"%PDF-":
        raise ValueError("no PDF")
    entry = lambda k: next((_pdf_text(m[1]).strip() or None for m in re.finditer(rb"/" + k + rb"\s*\(((?:\\.|[^\\()])*)\)", data)), None)
    made, page = entry(b"CreationDate"), None
    for m in re.finditer(rb"stream\r?\n", data):
        if data[m.start() - 3 : m.start()] == b"end":
            continue
        raw = data[m.end() : data.find(b"endstream", m.end())]
        if b"/FlateDecode" in data[max(0, m.start() - 512) : m.start()].rpartition(b"obj")[2]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        if b"BT" in raw:
            said = ["\n" if x[3] else "".join(_pdf_text(s[1]) for s in _STRING.finditer(x[1] or x[2])) for x in _SHOWN.finditer(raw)]
            if page := re.sub(r"\s*\n\s*", "\n", "".join(said)).strip()[:PAGE_CHARACTERS]:
                break
    return {"pdf_title": entry(b"Title"), "pdf_author": entry(b"Author"), "pdf_creation_date": made, "pdf_year": _year((made or "").removeprefix("D:")[:4]), "pdf_keywords": entry(b"Keywords"), "pdf_first_page_text": page or None}


#: What reads the files of a suffix.
READERS: dict[str, Callable[[bytes], dict]] = {".mp3": music, ".flac": music, ".jpg": picture, ".jpeg": picture, ".tif": picture, ".tiff": picture, ".mp4": film, ".m4v": film, ".mov": film, ".pdf": pdf}


def read_signals(files: DataFrame) -> DataFrame:
    """One row of signals for each of ``files (path, content)`` whose suffix has a reader; ``SCHEMA`` has the columns.

    A file that its reader can't make sense of gives a row that only says ``failed``; no file fails another. What
    isn't there is null. Contents are read in Arrow batches; small ``maxRecordsPerBatch`` bounds their memory.
    A null content fails; a null path is ignored.
    """
    rows = files.select("path", "content").filter(P.suffix(F.col("path")).isin(*READERS)).withColumn("suffix", P.suffix(F.col("path")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, suffix in b[["path", "content", "suffix"]].itertuples(index=False):
                try:
                    found = READERS[suffix](bytes(content))
                except Exception as e:  # any broken file
                    found = {"failed": type(e).__name__}
                out.append([path, *[found.get(c) for c in _COLUMNS[1:]]])
            frame = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
            yield frame.astype({c: "Int64" for c in ("id3_year", "id3_track", "exif_year", "exif_month", "video_year", "pdf_year")} | {c: "float64" for c in ("exif_ts_epoch", "exif_gps_lat", "exif_gps_lon", "video_ts_epoch", "video_duration_s")})

    return rows.mapInPandas(read, SCHEMA)


def with_pdf_class(signals: DataFrame, least: float = CLASS_CONFIDENCE) -> DataFrame:
    """``signals`` with ``pdf_class`` and ``pdf_class_confidence`` of the first page; a class below ``least`` isn't kept."""
    found = classified_texts(signals.filter("pdf_first_page_text IS NOT NULL"), "path", "pdf_first_page_text").select(F.col("path").alias("_p"), "label", "confidence").filter(F.col("confidence") >= least)
    return signals.join(found, F.col("path") == F.col("_p"), "left").withColumns({"pdf_class": F.col("label"), "pdf_class_confidence": F.col("confidence")}).drop("_p", "label", "confidence")


def name_and_time_signals(files: DataFrame) -> DataFrame:
    """``(path, mime_top, mime_sub, mtime_year, mtime_month)`` from the suffix and the time, in the session's zone."""
    import mimetypes

    known = {s: t.split("/", 1) for s, t in mimetypes.types_map.items()}
    types = F.create_map(*[F.lit(x) for s, (top, sub) in sorted(known.items()) for x in (s, f"{top}/{sub}")])
    mime = F.try_element_at(types, P.suffix(F.col("path")))
    day = F.timestamp_seconds("mtime")
    return files.select("path", F.substring_index(mime, "/", 1).alias("mime_top"), F.substring_index(mime, "/", -1).alias("mime_sub"), F.year(day).alias("mtime_year"), F.month(day).alias("mtime_month"))
