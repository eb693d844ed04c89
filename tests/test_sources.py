"""Cloud listings, documents, configuration and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_inventory import inv
from twinlake.operators import scoring
from twinlake.sources import documents, exports
from twinlake.streaming import incremental

FOLDER = "application/vnd.google-apps.folder"


def _lines(path, *objects):
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


def test_drive_listing(spark, tmp_path):
    p = _lines(
        tmp_path / "d.json", {"id": "r", "name": "Top", "mimeType": FOLDER}, {"id": "s", "name": "Sub", "mimeType": FOLDER, "parents": ["r"]}, {"id": "c1", "name": "c1", "mimeType": FOLDER, "parents": ["c2"]}, {"id": "c2", "name": "c2", "mimeType": FOLDER, "parents": ["c1"]},
        {"id": "1", "name": "a.txt", "size": "5", "md5Checksum": "AB", "parents": ["s"], "ownedByMe": True, "modifiedTime": "2024-01-02T03:04:05.000Z"}, {"id": "2", "name": "b", "size": "5", "md5Checksum": "cd", "ownedByMe": True, "trashed": True}, {"id": "3", "name": "doc", "size": "1", "mimeType": "application/vnd.google-apps.document"},
        {"id": "4", "name": "x", "size": "many"}, {"id": "5", "name": "nohash", "size": "7", "shared": True}, {"name": "noid", "size": "7"}, {"id": "6", "name": "cyc", "size": "1", "parents": ["c1"]},
    )
    got = {r["cloud_file_id"]: r for r in exports.drive_files(spark, p, "gdrive:v").collect()}
    assert set(got) == {"1", "5", "6"} and got["1"]["path"] == "gdrive:v://Top/Sub/a.txt" and got["1"]["foreign_hash"] == "md5:ab" and not got["1"]["is_shared"] and got["1"]["mtime"] == 1704164645.0
    assert got["5"]["is_shared"] and got["5"]["foreign_hash"] is None and got["6"]["path"].endswith("/cyc")


def test_deep_folders(spark):
    data = [(str(i), f"f{i}", str(i - 1) if i else None) for i in range(30)]
    df = spark.createDataFrame([*data, ("x", "x", "y"), ("y", "y", "x"), ("z", None, "0")], "id string, name string, parent string")
    got = {r["id"]: (r["folder_path"], r["is_cut"]) for r in exports.folder_paths(df).collect()}
    assert got["29"] == ("/".join(f"f{i}" for i in range(30)), False) and got["0"] == ("f0", False) and got["x"][1] and got["x"][0].count("/") == exports.PARENT_HOPS - 1
    for hops in (1, 5, 29, 30):
        short = {r["id"]: (r["folder_path"], r["is_cut"]) for r in exports.folder_paths(df, hops).collect()}
        assert short["29"] == ("/".join(f"f{i}" for i in range(30 - hops, 30)), hops < 30)


def test_onedrive_and_photo_listings(spark, tmp_path):
    p = _lines(
        tmp_path / "o.json", {"id": "1", "name": "a", "size": 3, "eTag": "e", "file": {"hashes": {"sha256Hash": "AB"}}, "parentReference": {"path": "/drive/root:/X/Y"}, "createdBy": {"user": {"id": "me"}}}, {"id": "2", "name": "f", "folder": {"childCount": 1}},
        {"id": "3", "name": "b", "size": 3, "file": {"hashes": {"sha256Hash": "cd"}}}, {"id": "4", "name": "c", "size": 3, "file": {"hashes": {}}}, {"id": "5", "deleted": {"state": "deleted"}},
    )
    got = {r["cloud_file_id"]: (r["path"], r["foreign_hash"], r["is_shared"]) for r in exports.onedrive_files(spark, p, "onedrive:a", "me").collect()}
    assert got == {"1": ("onedrive:a://X/Y/a", "sha256:ab", False), "3": ("onedrive:a://b", "sha256:cd", True)}
    q = _lines(tmp_path / "p.json", {"id": "1", "filename": "x.jpg", "mediaMetadata": {"creationTime": "2024-01-01T00:00:00Z"}})
    r = exports.photo_files(spark, q, "gphotos:a").first()
    assert (r["size"], r["foreign_hash"], r["etag"]) == (0, None, "1:2024-01-01T00:00:00Z")


def test_report_round_trip(spark, tmp_path):
    scored = scoring.scored_members(inv(spark, dict(path="/a/x"), dict(path="/a/b/y"), dict(path="/c", full_hash="q")))
    documents.write_json(documents.report_groups(scored), str(tmp_path / "r"))
    back = documents.read_json(spark, str(tmp_path / "r"))
    assert rows(documents.flat_members(back).select("path", "score", "is_proposed_keeper")) == rows(scored.select("path", "score", "is_proposed_keeper"))
    (tmp_path / "old.json").write_text('{"id": "1", "members": [{"path": "/a"}]}')
    assert documents.flat_members(documents.read_json(spark, str(tmp_path / "old.json"))).first()["source_id"] is None
    (tmp_path / "bad.json").write_text('{"id": "1", "members": [')
    with pytest.raises(Exception):
        documents.read_json(spark, str(tmp_path / "bad.json")).collect()
    page = documents.summary_html("A & B", spark.createDataFrame([("<x>", 1)], "k string, n int"))
    assert "A &amp; B" in page and "&lt;x&gt;" in page


def test_documents_are_replaced_whole(spark, tmp_path):
    p = str(tmp_path / "doc")
    for i in range(4):
        before = documents.read_json(spark, p, "n int") if i else None
        documents.write_json(spark.range(i, i + 2).selectExpr("cast(id AS int) AS n"), p)
        assert rows(documents.read_json(spark, p, "n int")) == [(i,), (i + 1,)]
        assert before is None or rows(before) == [(i - 1,), (i,)]
    with pytest.raises(ValueError):
        documents.summary_html("t", spark.range(documents.PAGE_ROWS + 1))


def test_large_groups_are_written_in_parts(spark):
    scored = scoring.scored_members(inv(spark, *[dict(path=f"/a/{i:03}") for i in range(25)], dict(path="/b/x", full_hash="z"), dict(path="/b/y", full_hash="z")))
    got = documents.report_groups(scored, 10).select("full_hash", "part_no", F.size("members").alias("n"), "reclaim_bytes").collect()
    assert sorted(r["n"] for r in got if r["full_hash"] != "z") == [5, 10, 10] and [r["n"] for r in got if r["full_hash"] == "z"] == [2]
    assert len({r["reclaim_bytes"] for r in got if r["full_hash"] != "z"}) == 1


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('top = 1\n[scan]\nmin = 2\n[scan.deep]\nx = "y"\n')
    assert documents.read_config(str(tmp_path / "c.toml")) == {"top": 1, "scan.min": 2, "scan.deep.x": "y"} and documents.read_config(str(tmp_path / "none")) == {}
    (tmp_path / "w.json").write_text('{"depth_penalty_per_level": -1}')
    assert documents.read_weights(str(tmp_path / "w.json"))["depth_penalty_per_level"] == -1.0 and documents.read_weights()["depth_penalty_per_level"] == -0.5
    (tmp_path / "w.json").write_text('{"odd": -1}')
    with pytest.raises(ValueError):
        documents.read_weights(str(tmp_path / "w.json"))


def _streamed(spark, tmp_path, batches, schema, make, mode="append"):
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).json(str(src))
    query = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, b in enumerate(batches):
            _lines(src / f"{i}.json", *b)
            query.processAllAvailable()
        return rows(spark.table("out"))
    finally:
        query.stop()


def test_new_files_stream(spark, tmp_path):
    at = lambda d: f"2024-01-{d:02}T00:00:00"
    row = lambda p, h, d: {"path": p, "full_hash": h, "delivered_at": at(d)}
    got = _streamed(spark, tmp_path, [[row("a", "1", 1), row("a", "1", 2)], [row("a", "1", 3), row("a", "2", 3), row("b", "1", 3)]], "path string, full_hash string, delivered_at timestamp", lambda s: incremental.new_files(s).select("path", "full_hash"))
    assert got == [("a", "1"), ("a", "2"), ("b", "1")]


def test_session_stream_matches_batch(spark, tmp_path):
    hours = [0, 5, 11, 24, 30, 100]
    events = [{"user_id": 1, "ts": f"2024-01-{1 + h // 24:02}T{h % 24:02}:00:00"} for h in hours] + [{"user_id": 1, "ts": "2024-03-01T00:00:00"}]
    got = _streamed(spark, tmp_path, [events[:3], events[3:], [{"user_id": 2, "ts": "2024-04-01T00:00:00"}]], "user_id int, ts timestamp", lambda s: incremental.event_sessions(s).select("user_id", "n"))
    assert [n for u, n in got if u == 1][:3] == [1, 2, 3] or sorted(n for u, n in got if u == 1) == [1, 1, 2, 3]


def test_accounts(spark, tmp_path):
    p = tmp_path / "accounts.toml"
    assert documents.read_accounts(spark, str(p)).count() == 0
    p.write_text('[[accounts]]\nid = "gdrive:a"\ntype = "gdrive"\n[[accounts]]\nlabel = "no id"\n[[accounts]]\nid = "b"\n')
    p.chmod(0o644)
    with pytest.raises(PermissionError):
        documents.read_accounts(spark, str(p))
    p.chmod(0o600)
    assert rows(documents.read_accounts(spark, str(p)), "id", "type", "user") == [("b", "", ""), ("gdrive:a", "gdrive", "")]
    p.write_text('[[accounts]]\nid = "b"\n[[accounts]]\nid = "b"\n')
    with pytest.raises(ValueError):
        documents.read_accounts(spark, str(p))


def test_groups_and_decisions_are_appended_and_cleared(spark, tmp_path):
    scored = scoring.scored_members(inv(spark, dict(path="/a/x"), dict(path="/a/b/y")))
    p, q = str(tmp_path / "groups"), str(tmp_path / "decisions")
    for t in (1.0, 2.0):
        documents.append_groups(scored, p, "exact", t)
    got = spark.read.parquet(p)
    assert got.count() == 4 and rows(got.select("kind", "created_ts").distinct()) == [("exact", 1.0), ("exact", 2.0)]
    one = spark.createDataFrame([("g", "/a", "/b", None, True, 1.0)], "group_id string, kept_path string, discarded_path string, features map<string,double>, user_overrode boolean, ts double")
    documents.append_decisions(one.withColumn("other", F.lit(1)), q)
    documents.append_decisions(one.limit(0), q)
    assert spark.read.parquet(q).count() == 1
    documents.clear_table(spark, q)
    documents.clear_table(spark, str(tmp_path / "none"))
    assert spark.read.parquet(q).count() == 0 and spark.read.parquet(q).columns == one.columns
