"""Signals read from small files made here."""

import struct
import zlib

from twinlake.sources import signals as R


def _id3(version, **frames):
    size = lambda n: bytes((n >> s) & 127 for s in (21, 14, 7, 0)) if version == 4 else n.to_bytes(4, "big")
    body = b"".join(k.encode() + size(len(v)) + b"\0\0" + v for k, v in frames.items())
    return b"ID3" + bytes([version, 0, 0]) + bytes((len(body) >> s) & 127 for s in (21, 14, 7, 0)) + body + bytes(20)


def _tiff(order):
    """A TIFF with camera, time and place."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    entry = lambda tag, kind, count, value: pack("HHI", tag, kind, count) + (value if isinstance(value, bytes) else pack("I", value))
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8)
    main = pack("H", 4) + entry(0x010F, 2, 4, b"Cam\0") + entry(0x0110, 2, 8, 200) + entry(0x8769, 4, 1, 100) + entry(0x8825, 4, 1, 130) + pack("I", 0)
    out = bytearray(400)
    put = lambda at, b: out.__setitem__(slice(at, at + len(b)), b)
    put(0, head + main)
    put(100, pack("H", 1) + entry(0x9003, 2, 20, 220) + pack("I", 0))
    put(130, pack("H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, 250) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, 280) + pack("I", 0))
    put(200, b"Model 1\0")
    put(220, b"2019:05:06 07:08:09\0")
    put(250, pack("6I", 10, 1, 30, 1, 0, 1))
    put(280, pack("6I", 20, 1, 0, 1, 36, 1))
    return bytes(out)


def _box(name, body):
    return (8 + len(body)).to_bytes(4, "big") + name + body


def _pdf(page):
    stream = zlib.compress(page)
    return b"%PDF-1.4\n1 0 obj<</Title (A \\(b\\)) /Author (Me) /CreationDate (D:20170203)>>endobj\n2 0 obj<</Filter /FlateDecode /Length 1>>stream\n" + stream + b"\nendstream endobj\n"


def test_music():
    for version in (3, 4):
        got = R.music(_id3(version, TPE1=b"\3Ann", TPE2=b"\1" + "Bänd".encode("utf-16"), TALB=b"\0Alb\xfcm", TDRC=b"\0002011-02", TRCK=b"\x003/12"))
        assert (got["id3_artist"], got["id3_albumartist"], got["id3_album"], got["id3_year"], got["id3_track"]) == ("Ann", "Bänd", "Albüm", 2011, 3)
    old = b"x" * 50 + b"TAG" + b"T".ljust(30, b"\0") + b"A".ljust(30, b"\0") + b"L".ljust(30, b"\0") + b"1999" + bytes(31)
    assert R.music(old)["id3_artist"] == "A" and R.music(old)["id3_year"] == 1999 and R.music(b"")["id3_artist"] is None
    comment = lambda t: len(t).to_bytes(4, "little") + t
    block = comment(b"v") + (2).to_bytes(4, "little") + comment("ARTIST=Zoë".encode()) + comment(b"album=Q")
    assert R.music(b"fLaC" + b"\x84" + len(block).to_bytes(3, "big") + block)["id3_artist"] == "Zoë"


def test_pictures():
    for order in "<>":
        for data in (_tiff(order), b"\xff\xd8\xff\xe1\0\0Exif\0\0" + _tiff(order)):
            got = R.picture(data)
            assert got["exif_make"] == "Cam" and got["exif_model"] == "Model 1" and got["exif_ts_epoch"] == 1557126489.0 and (got["exif_year"], got["exif_month"]) == (2019, 5)
            assert abs(got["exif_gps_lat"] + 10.5) < 1e-9 and abs(got["exif_gps_lon"] - 20.01) < 1e-9
    assert R.picture(b"\xff\xd8\xff\xd9") == {}


def test_films():
    head = struct.pack(">IIIII", 0, 2_082_844_800 + 86400, 0, 1000, 2500) + bytes(80)
    got = R.film(_box(b"ftyp", b"isom") + _box(b"moov", _box(b"mvhd", head)))
    assert got == {"video_ts_epoch": 86400.0, "video_create_date": "1970-01-02", "video_year": 1970, "video_duration_s": 2.5}


def test_pdf_files():
    got = R.pdf(_pdf(b"BT (Hello ) Tj [(wor) 20 (ld)] TJ T* (two \\050x\\051) Tj ET"))
    assert (got["pdf_title"], got["pdf_author"], got["pdf_year"], got["pdf_first_page_text"]) == ("A (b)", "Me", 2017, "Hello world\ntwo (x)")
    assert len(R.pdf(_pdf(b"BT (" + b"a" * 9000 + b") Tj ET"))["pdf_first_page_text"]) == R.PAGE_CHARACTERS


def test_broken_files_fail_alone(spark):
    page = b"BT (invoice number total due payment invoice amount due bill to) Tj ET"
    data = [("/a.mp3", _id3(4, TPE1=b"\3Ann")), ("/b.JPG", b"\xff\xd8Exif\0\0??"), ("/c.pdf", b"junk"), ("/d.mp4", b""), ("/e.txt", b"x"), ("/f.pdf", _pdf(page)), ("/g.mov", None), (None, b"x"), ("/h.tif", _tiff("<"))]
    out = R.with_pdf_class(R.read_signals(spark.createDataFrame([(p, c, "z") for p, c in data], "path string, content binary, failed string")))
    got = {r["path"]: r for r in out.collect()}
    assert sorted(got) == ["/a.mp3", "/b.JPG", "/c.pdf", "/d.mp4", "/f.pdf", "/g.mov", "/h.tif"] and {p for p, r in got.items() if r["failed"]} == {"/b.JPG", "/c.pdf", "/d.mp4", "/g.mov"}
    assert got["/a.mp3"]["id3_artist"] == "Ann" and got["/h.tif"]["exif_year"] == 2019 and got["/f.pdf"]["pdf_first_page_text"].startswith("invoice")
    assert got["/f.pdf"]["pdf_class"] is None or got["/f.pdf"]["pdf_class_confidence"] >= R.CLASS_CONFIDENCE
    assert R.read_signals(spark.createDataFrame([], "path string, content binary")).count() == 0
