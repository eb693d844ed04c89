"""Reports, plans and manifests as JSON; small HTML summaries; configuration files."""

from __future__ import annotations

import html
import json
import os
import tomllib
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.operators.heavykeys import running_offsets
from twinlake.operators.scoring import WEIGHTS

#: Members in one row of a report, rows of a page, and the file that names the current version of a document.
PART_MEMBERS, PAGE_ROWS, POINTER = 10_000, 1000, "CURRENT"
#: Layout of a report's groups; fields that older files lack come as null.
REPORT = (
    "id string, kind string, full_hash string, part_no bigint, reclaim_bytes bigint, members array<struct<path:string,size:bigint,mtime:double,score:double,"
    "signals:array<struct<name:string,contribution:double>>,is_proposed_keeper:boolean,is_informational:boolean,source_id:string>>"
)


def report_groups(scored: DataFrame, most: int = PART_MEMBERS) -> DataFrame:
    """Scored members nested to rows of at most ``most`` members: a group has as many rows as it needs, numbered by ``part_no``.

    So a group with a third of all files is no single row. ``reclaim_bytes`` is the group's in each of its rows.
    """
    gone = ~F.col("is_proposed_keeper") & ~F.col("is_informational")
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = running_offsets(scored.repartition(parts, "full_hash", "path"), ["full_hash"], order=[F.col("path")], out="_no").withColumn("part_no", F.floor(F.col("_no") / most))
    bytes_ = scored.groupBy(F.col("full_hash").alias("_g")).agg(F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("reclaim_bytes"))
    member = F.struct("path", "size", "mtime", "score", "signals", "is_proposed_keeper", "is_informational", "source_id")
    out = placed.groupBy("full_hash", "part_no").agg(F.array_sort(F.collect_list(member)).alias("members")).join(bytes_, F.col("full_hash") == F.col("_g"))
    return out.select(F.substring("full_hash", 1, 16).alias("id"), F.lit("exact").alias("kind"), "full_hash", "part_no", "reclaim_bytes", "members")


def flat_members(groups: DataFrame) -> DataFrame:
    return groups.select("id", "full_hash", F.explode("members").alias("m")).select("id", "full_hash", "m.*")


def write_json(df: DataFrame, path: str) -> None:
    """A committed write: the rows go to a new folder below ``path``, then a pointer is set to it.

    Until the pointer is replaced readers find the whole document before, after that the new one. Folders
    of the last two versions are kept, older ones are deleted.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    last = _version(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/_NEXT-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri() if folder.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), overwrite)
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in (version, last):
            fs.delete(s.getPath(), True)


def _version(spark: SparkSession, path: str) -> str | None:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.sparkContext.textFile(f"{path}/{POINTER}", 1).first() if fs.exists(pointer) else None


def read_json(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """Reads the current version, or the files at ``path``, with the known layout; fails on malformed lines, as files may have been edited by hand."""
    version = _version(spark, path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{version}" if version else path)


def summary_html(title: str, totals: DataFrame) -> str:
    """A page with one table of ``totals``; values are escaped. More than ``PAGE_ROWS`` rows are no summary and are refused."""
    rows = totals.limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"a page shows at most {PAGE_ROWS} rows; write the rest as JSON")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in totals.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def read_config(path: str) -> dict:
    """A TOML file as flat settings: sections are joined to their keys with dots; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        tree = tomllib.load(f)

    def flat(prefix: str, t: Mapping) -> dict:
        out: dict = {}
        for k, v in t.items():
            out |= flat(f"{prefix}{k}.", v) if isinstance(v, Mapping) else {f"{prefix}{k}": v}
        return out

    return flat("", tree)


def read_weights(path: str | None = None) -> dict[str, float]:
    """The scoring weights, with those of a JSON file in their place."""
    if path is None or not os.path.exists(path):
        return dict(WEIGHTS)
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := given.keys() - WEIGHTS.keys():
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    return WEIGHTS | {k: float(v) for k, v in given.items()}


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """``(id, type, label, user, added_ts)`` of the registered accounts in a TOML file; a missing file has none.

    A file that others than its owner may read or write is refused, and so is an id that comes twice. Entries
    without an id are ignored; other fields that lack are empty. Secrets aren't in this file and aren't read.
    """
    rows = []
    if os.path.exists(path):
        if os.stat(path).st_mode & 0o077:
            raise PermissionError(f"{path} may be used by others than its owner")
        with open(path, "rb") as f:
            entries = tomllib.load(f).get("accounts", [])
        rows = [tuple(str(e.get(k, "")) for k in ("id", "type", "label", "user", "added_ts")) for e in entries if isinstance(e, Mapping) and "id" in e]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("an account is registered twice")
    return spark.createDataFrame(rows, "id string, type string, label string, user string, added_ts string")


def append_groups(members: DataFrame, path: str, kind: str, created: float) -> None:
    """Append scored groups to the table of groups: one row a member, with the kind and the time they were found."""
    rows = members.select(F.lit(kind).alias("kind"), F.lit(float(created)).alias("created_ts"), F.col("full_hash").alias("group_id"), "path", "score", "is_proposed_keeper", "is_informational")
    rows.write.mode("append").partitionBy("kind").parquet(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Append ``decisions (group_id, kept_path, discarded_path, features, user_overrode, ts)`` to the log: one row a discarded file, so a large group is no large row."""
    decisions.select("group_id", "kept_path", "discarded_path", "features", "user_overrode", "ts").write.mode("append").parquet(path)


def clear_table(spark: SparkSession, path: str) -> None:
    """Empty a cache table; its layout stays. What isn't there is left alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
