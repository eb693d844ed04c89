"""Path functions, intake, exact duplicates and scoring."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlake.functions import paths as P
from twinlake.operators import exact, inventory, scoring

BASE = dict(size=100, mtime=1.0, inode=1, dev=1, nlink=1, is_archive_member=False, is_bundle=False, is_shared=False, precomputed_full_hash=None, source_id="local", foreign_hash=None, etag=None, cloud_file_id=None, owner=None, full_hash="h", reconciled=False)
SCHEMA = "path string, size bigint, mtime double, inode bigint, dev bigint, nlink bigint, is_archive_member boolean, is_bundle boolean, is_shared boolean, precomputed_full_hash string, source_id string, foreign_hash string, etag string, cloud_file_id string, owner string, full_hash string, reconciled boolean"


def inv(spark, *files):
    out = []
    for i, f in enumerate(files):
        r = BASE | {"inode": 100 + i} | f
        out.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,word,name", [
    ("/a/backup/x.txt", True, False), ("/a/MyBackupFiles/x", True, False), ("/a/background/x", False, False), ("/a/OLD/x", True, False), ("/a/OLDER_stuff/x", True, False), ("/a/GOLD/x", False, False), ("/a/goldBar/x", False, False),
    ("/a/b/foo (1).txt", False, True), ("/a/b/foo copy.txt", True, True), ("/a/b/foo copy 2.txt", True, True), ("/a/b/foo-2.txt", False, True), ("/a/b/foo-2", False, False), ("/a/b/foo.txt", False, False), ("/a/XMLCopyTool/x", True, False),
])
def test_copy_marks(spark, path, word, name):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(P.has_copy_word(F.col("path")), P.has_copy_name(F.col("path"))).first()[:] == (word, name)


def test_path_parts(spark):
    p = F.col("p")
    assert one(spark, P.suffix(p), p="/a/b.C/x.tar.GZ") == ".gz" and one(spark, P.suffix(p), p="/a/.hidden") == "" and one(spark, P.suffix(p), p="/a/b.c/x") == ""
    assert one(spark, P.stem(p), p="/a/x.tar.gz") == "x.tar" and one(spark, P.depth(p), p="/a/b/c.txt") == 4 and one(spark, P.depth(p), p="g://a/b") == 3
    assert one(spark, P.homeish_ancestor(p), p="/Users/x/Downloads/Music/y.mp3") == "Music" and one(spark, P.homeish_ancestor(p), p="/Users/x/Downloads") is None
    assert one(spark, P.outer_archive(p), p="/a/x.zip::in/y") == "/a/x.zip" and one(spark, P.archive_kind(p), p="/a/x.TGZ") == "tar" and one(spark, P.archive_kind(p), p="/a/x.zipx") is None
    assert one(spark, P.relative_destination(p, F.col("s")), p="gdrive:v://A//b/./c", s="gdrive:v") == "A/b/c"
    assert one(spark, P.human_bytes(F.col("n")), n=1536) == "1.5 KB" and one(spark, P.human_bytes(F.col("n")), n=12) == "12 B"
    assert one(spark, P.under_copy_folder(p), p="/a/BAK/x") and not one(spark, P.under_copy_folder(p), p="/a/bakery/x")


def test_globs_cross_slashes(spark):
    m = lambda g, s: one(spark, P.matches_any(F.col("p"), [g]), p=s)
    assert m("*.mov", "/a/b/c.mov") and m("/a/*/x", "/a/b/c/x") and not m("*.mov", "/a/c.mov2") and m("/a/?.t[xy]t", "/a/b.txt") and not m("/a/?.t[xy]t", "/a/bb.txt")


@pytest.mark.parametrize("a,b,want", [("md5:AB", "MD5:ab", True), ("md5:ab", "md5:cd", False), ("md5:ab", "sha256:ab", None), ("ab", "blake3:AB", True), (None, "md5:ab", None), ("md5:", "md5:ab", None), ("", "md5:ab", None)])
def test_digests_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(P.digests_match(F.col("a"), F.col("b"))).first()[0] is want


def test_partial_digest_takes_the_tail_only_above_two_samples(spark):
    df = spark.createDataFrame([(b"a" * 4 + x + b"b" * 2,) for x in (b"", b"1", b"2", b"11111", b"21111")], "c binary")
    got = [r[0] for r in df.select(P.partial_digest(F.col("c"), 4)).collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] != got[0]


def test_intake_reasons(spark):
    df = spark.createDataFrame([("/a/.git/x", 9), ("/usr/x", 9), ("/Volumes/B/System/x", 9), ("/Users/me/Library/x", 9), ("/a/x.icloud", 9), ("/a/x", 1), ("/a/x", 9), ("/a/.git", 9), ("/users/x", 9)], "path string, size bigint")
    got = [r[0] for r in df.select(inventory.reject_reason(F.col("path"), F.col("size"), 5)).collect()]
    assert got == ["folder name", "excluded place", "excluded place", "excluded place", "placeholder", "size", None, None, None]


def test_rolled_up_digest_doesn_t_depend_on_order(spark):
    a = inv(spark, dict(path="/x.app/a", full_hash="1", size=3, mtime=5.0), dict(path="/x.app/c/b", full_hash="2", size=4))
    b = inv(spark, dict(path="/y.app/c/b", full_hash="2", size=4), dict(path="/y.app/a", full_hash="1", size=3, mtime=5.0))
    c = inv(spark, dict(path="/z.app/a", full_hash="2", size=3, mtime=5.0), dict(path="/z.app/c/b", full_hash="1", size=4))
    root = F.regexp_extract("path", r"^(.*?\.app)/", 1)
    x, y, z = [inventory.rolled_up(d, root).first() for d in (a, b, c)]
    assert x["digest"] == y["digest"] != z["digest"] and (x["size"], x["mtime"], x["n_files"]) == (7, 5.0, 2)
    assert inventory.rolled_up(a, root, 8).count() == 0


def test_staged_digests(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", "xx"), ("c", "xy"), ("d", "longer"), ("e", ""), ("f", "")], "path string, text string")
    got = {r["path"]: (r["stage"], r["digest"]) for r in exact.staged_digests(df, F.encode("text", "utf-8")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "full", "b": "full", "c": "partial", "d": "size", "e": "full", "f": "full"} and got["a"] == got["b"] and got["d"][1] is None


def test_live_copy_beats_backup_and_repeated_paths_count_once(spark):
    df = inv(spark, dict(path="/Users/me/Documents/x.txt"), dict(path="/Users/me/Documents/backup/x.txt"), dict(path="/Users/me/y", full_hash="other"), dict(path="/Users/me/Documents/x.txt", full_hash=None))
    scored = scoring.scored_members(df, ["/Users/me"]).collect()
    assert {r["path"]: r["is_proposed_keeper"] for r in scored} == {"/Users/me/Documents/x.txt": True, "/Users/me/Documents/backup/x.txt": False}
    same = inv(spark, dict(path="/a/x"), dict(path="/a/x"))
    assert exact.exact_groups(same).count() == 0


def test_informational_members(spark):
    df = inv(
        spark, dict(path="/a/1", inode=7), dict(path="/a/2", inode=7), dict(path="/a/z.zip::3", is_archive_member=True, inode=0, dev=0), dict(path="g://4", source_id="gdrive:v", inode=0, dev=0), dict(path="g://5", source_id="gdrive:v", inode=0, dev=0),
        dict(path="i://6", source_id="icloud:p"), dict(path="p://7", source_id="gphotos:a"), dict(path="p://8", source_id="gphotos:b"), dict(path="g://9", source_id="gdrive:v", is_shared=True), dict(path="/a/10", inode=None),
    )
    got = {r["path"].rsplit("/", 1)[-1].split("::")[-1]: r["is_informational"] for r in scoring.informational(df, ["gphotos:b"]).collect()}
    assert got == {"1": True, "2": True, "3": True, "4": False, "5": False, "6": True, "7": True, "8": False, "9": True, "10": False}
    links = inv(spark, dict(path="/a/1", inode=7), dict(path="/a/2", inode=7))
    assert [r["is_proposed_keeper"] for r in scoring.scored_members(links).collect()] == [False, False] and scoring.reclaim(scoring.scored_members(links)).first()["reclaim_bytes"] == 0
    assert scoring.discards(scoring.scored_members(links)).count() == 0


def test_keeper_ties_take_the_largest_path(spark):
    got = scoring.scored_members(inv(spark, dict(path="/a/x"), dict(path="/a/y"), dict(path="/a/b/z"))).filter("is_proposed_keeper").collect()
    assert [r["path"] for r in got] == ["/a/y"]
    assert scoring.scored_members(inv(spark)).count() == 0


def test_united_sources(spark):
    df = inv(spark, dict(path="/a"), dict(path="g://b", source_id="gdrive:v"), dict(path="g://c", source_id="gdrive:v", foreign_hash="md5:1"))
    got = {r["path"]: r["precomputed_full_hash"] for r in inventory.united_sources(df).collect()}
    assert got == {"/a": None, "g://c": "md5:1"} and inventory.united_sources(df, True).count() == 3


def test_local_walk_and_archives(spark, tmp_path):
    import tarfile
    import zipfile

    from twinlake.sources import walk

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y.txt").write_bytes(b"hello")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "no").write_bytes(b"hello")
    inner = tmp_path / "in.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(tmp_path / "out.zip", "w") as z:
        z.write(inner, "in.zip")
        z.writestr("flat.txt", "flat")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a b" / "x+y.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    os.remove(inner)
    got = {r["path"] for r in walk.local_files(spark, [str(tmp_path)]).collect()}
    assert got == {f"{tmp_path}/{n}" for n in ("a b/x+y.txt", "out.zip", "t.tar.gz", "bad.zip")}
    members = {r["path"].removeprefix(str(tmp_path)): (r["size"], r["skip_reason"]) for r in walk.archive_members(spark, [str(tmp_path)]).collect()}
    assert members == {"/out.zip::in.zip": (members["/out.zip::in.zip"][0], None), "/out.zip::in.zip::deep.txt": (4, None), "/out.zip::flat.txt": (4, None), "/t.tar.gz::x": (5, None), "/bad.zip": (None, "corrupt")}
    assert "/out.zip::in.zip::deep.txt" not in {r["path"].removeprefix(str(tmp_path)) for r in walk.archive_members(spark, [str(tmp_path)], 1).collect()}
    assert rows(walk.hashed_files(spark, [str(tmp_path)]).filter("path LIKE '%x+y%'").select("size")) == [(5,)]


def test_bundles_and_trashes(spark):
    paths = ["/a/X.APP/in/y", "/a/b.app", "/a/n.rtfd/m.app/f", "/a/.app.d/x", "x.bundle/y", None, ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(P.bundle_root(F.col("p"))).collect()] == ["/a/X.APP", None, "/a/n.rtfd", None, "x.bundle", None, None]
    data = [("/Users/me/a", "/Users/me/.Trash", False), ("/Volumes/V/a", "/Volumes/V/.Trashes/7", False), ("/Volumes/V/.Trashes/7/a", "/Volumes/V/.Trashes/7", True), ("/Volumes/V/.Trashes/8/a", "/Volumes/V/.Trashes/7", False), ("/Users/me/.Trash/a", "/Users/me/.Trash", True), ("/Users/me/.Trash/../a", "/Users/me/.Trash", False)]
    df = spark.createDataFrame([(d[0],) for d in data], "p string")
    assert [tuple(r) for r in df.select("p", P.trash_folder(F.col("p"), "/Users/me", 7), P.inside_trash(F.col("p"), "/Users/me", 7)).collect()] == data
