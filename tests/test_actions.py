"""From findings to actions: the awkward cases."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlake.operators import actions as A
from twinlake.operators import migrate, scoring

MEMBERS = "group_id string, path string, source_id string, is_keeper boolean, is_informational boolean, size bigint, kind string"


def test_rails_of_all_kinds(spark):
    exact = spark.createDataFrame([("1", "a", "local", True, False, 1, "?"), ("1", "b", "local", False, False, 1, "?"), ("1", "c", "gdrive:x", False, False, None, "?"), ("1", "d", "local", False, True, 1, "?"), ("2", "e", "local", False, False, 1, "?")], MEMBERS)
    tree = spark.createDataFrame([("1", "/t", "local", False, False, 9, "?"), ("1", "/u", "local", True, False, 9, "?")], MEMBERS)
    got = rows(A.by_rail(A.actionable({"exact": exact, "tree": tree, "audio": exact.limit(0)})), "kind", "path", "rail")
    assert got == [("exact", "b", "local"), ("exact", "c", "cloud"), ("tree", "/t", "tree")]
    with pytest.raises(ValueError):
        A.actionable({})


def test_tree_refusals_in_order(spark):
    data = [("/Users/me/a", "clean"), ("/Users/me/b", "dirty"), ("/Users/me/c", None), ("/Users/me/file", "clean"), ("/System/x", "clean"), ("/Volumes/v/p", "none"), ("/else/q", "clean")]
    folders = spark.createDataFrame([(r,) for r, _ in data if r != "/Users/me/file"] * 2, "dir string")
    discards = spark.createDataFrame(data, "root string, git_state string")
    got = dict(rows(A.tree_refusals(discards, folders, ["/Users", "/Volumes"], ["/Users/me"])))
    assert got == {"/Users/me/a": None, "/Users/me/b": "uncommitted changes", "/Users/me/c": "git state unknown", "/Users/me/file": "not a folder", "/System/x": "excluded place", "/Volumes/v/p": "outside active homes", "/else/q": "outside roots"}
    assert {r[1] for r in rows(A.tree_refusals(discards, folders, ["/Users"], []))} == {"no active homes"}


def test_organizer_moves_and_undo(spark):
    plan = spark.createDataFrame([("/r/a", "x/a", 1, 1.0), ("/r/b", "x/b", 1, 1.0), ("/r/c", "x/c", None, 1.0), ("/r/d", "../d", 1, 1.0), ("/q/e", "x/e", 1, 1.0), ("/r/f", "x/f", 1, 1.0), ("/r/g", "x/f", 1, 1.0), ("/r/h", "x/h", 1, 1.0)], "path string, destination string, size bigint, mtime double")
    now = spark.createDataFrame([("/r/a", 1, 1.0005), ("/r/b", 2, 1.0), ("/r/c", None, 2.0), ("/r/d", 1, 1.0), ("/q/e", 1, 1.0), ("/r/f", 1, 1.0), ("/r/g", 1, 1.0)], "path string, size bigint, mtime double")
    got = {r["path"]: r["step"] for r in A.organizer_moves(plan, now, ["/r"]).collect()}
    assert got["/r/a"] == "move" and got["/r/b"].endswith("changed: size") and got["/r/c"].endswith("changed: time") and got["/r/d"].endswith("leaves its root") and got["/q/e"].endswith("outside roots")
    assert got["/r/f"] == got["/r/g"] == "refuse: destination taken" and got["/r/h"].endswith("missing")
    manifest = spark.createDataFrame([("/r/a", "/s/a"), ("/r/b", "/s/b"), ("/r/c", "/s/c"), ("/System/x", "/s/x")], "path string, destination string")
    there = spark.createDataFrame([("/s/a",), ("/s/b",), ("/r/b",), ("/s/x",), (None,)], "path string")
    assert {r["path"]: r["step"] for r in A.organizer_undo(manifest, there).collect()} == {"/r/a": "restore", "/r/b": "refuse: place taken", "/r/c": "refuse: gone from destination", "/System/x": "refuse: excluded place"}


def test_emptied_folders_stop_at_the_root_and_the_hops(spark):
    now = spark.createDataFrame([("/s/a/b/c/1",), ("/s/a/2",), ("/s/d/e/3",)], "path string")
    gone = spark.createDataFrame([("/s/a/b/c/1",), ("/s/d/e/3",), (None,)], "destination string")
    assert rows(A.emptied_folders(gone, now, "/s")) == [("/s/a/b",), ("/s/a/b/c",), ("/s/d",), ("/s/d/e",)]
    assert rows(A.emptied_folders(gone, now, "/s", 1)) == [("/s/a/b/c",), ("/s/d/e",)]


def test_copy_states_and_small_things(spark):
    manifest = spark.createDataFrame([("a", "copy", "pending"), ("b", "copy", "pending"), ("c", "copy", "error"), ("d", "skip", "pending"), ("e", "copy", "done"), ("f", "copy", "pending")], "source_path string, action string, state string")
    tried = spark.createDataFrame([("a", 1, 1, None), ("b", 2, 1, None), ("c", 1, 1, "quota"), ("c", 1, 1, None), ("e", 1, 0, "late"), ("f", 1, 1, "broken")], "source_path string, size bigint, uploaded_size bigint, error string")
    assert rows(A.copy_states(manifest, tried)) == sorted([("a", "done", None), ("b", "error", "sizes differ"), ("c", "done", None), ("d", "skipped", None), ("e", "done", None), ("f", "error", "broken")], key=repr)
    assert A.byte_budget(-1) == 0 and A.byte_budget(1.5) == 1572864
    assert [r[0] for r in spark.createDataFrame([(1.0,), (-0.005,), (0.0,)], "x double").select(A.signed(F.col("x"))).collect()] == ["+1.00", "-0.01", "+0.00"]
    names = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(A.new_names(names("/a/x", "/b/y"), names("/c/x", "/c/z", "/d/z"))) == [("z",)]


def test_native_documents_and_clones(spark):
    files = spark.createDataFrame([("gdrive:v://a", "gdrive:v", 1, None, False, "application/vnd.google-apps.document"), ("gdrive:v://b", "gdrive:v", 1, None, None, "text/plain"), ("gdrive:v://c", "gdrive:v", 1, None, True, None)], "path string, source_id string, size bigint, foreign_hash string, is_shared boolean, mime string")
    got = {r["source_path"]: (r["action"], r["reason"]) for r in migrate.migration_plan(files, files.limit(0)).collect()}
    assert got == {"gdrive:v://a": ("defer", "native document"), "gdrive:v://b": ("copy", "eligible"), "gdrive:v://c": ("defer", "shared file")}
    one = spark.createDataFrame([(p, "h", 1, 2, "local", False, False, c) for p, c in (("/a", 5), ("/b", 5), ("/c", None), ("/d", None))], "path string, full_hash string, dev bigint, inode bigint, source_id string, is_archive_member boolean, is_shared boolean, clone_id bigint").withColumn("inode", F.xxhash64("path"))
    assert [p for p, i in rows(scoring.informational(one), "path", "is_informational") if i] == ["/a", "/b"]
