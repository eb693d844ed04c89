"""Local folders and archives as inventories."""

from __future__ import annotations

import hashlib
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.inventory import reject_reason

#: Archives in archives are opened to this depth, and only up to this size.
ARCHIVE_DEPTH, NESTED_BYTES = 2, 512 << 20
MEMBER_SCHEMA = "outer_path string, path string, size bigint, full_hash string, skip_reason string"


def _content(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    out = reader.load([f"file://{r}" if r.startswith("/") else r for r in dict.fromkeys(roots)])
    return out.withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/+", "/")))


def local_files(spark: SparkSession, roots: Sequence[str], min_size: int = 0, globs: Sequence[str] = ()) -> DataFrame:
    """``(path, size, mtime, source_id, is_archive_member)`` of files below ``roots`` that pass the intake; contents aren't read."""
    rows = _content(spark, roots).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"))
    kept = rows.filter(reject_reason(F.col("path"), F.col("size"), min_size, globs).isNull())
    return kept.select("path", "size", (F.col("us") / 1e6).alias("mtime"), F.lit("local").alias("source_id"), F.lit(False).alias("is_archive_member"))


def hashed_files(spark: SparkSession, roots: Sequence[str], min_size: int = 0) -> DataFrame:
    """The files with partial and full digests of their contents."""
    rows = _content(spark, roots).filter(reject_reason(F.col("path"), F.col("length"), min_size).isNull())
    return rows.select("path", F.col("length").alias("size"), P.partial_digest(F.col("content")).alias("partial_hash"), P.full_digest(F.col("content")).alias("full_hash"))


def _opened(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member, content, why skipped) of one archive."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield (i.filename, None, "encrypted") if i.flag_bits & 1 else (i.filename, z.read(i), None)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read(), None


def expand(path: str, data: bytes, depth: int = ARCHIVE_DEPTH, most: int = NESTED_BYTES) -> list[tuple]:
    """Rows (virtual path, size, digest, why skipped) of an archive and those inside it.

    An inner archive is a member itself and is opened while depth is left; at the limit it stays
    closed. Broken, encrypted and too large ones give a row that says so.
    """
    rows: list[tuple] = []
    try:
        for name, content, why in _opened(path, data):
            inner = f"{path}::{name}"
            if why:
                rows.append((inner, None, None, why))
                continue
            rows.append((inner, len(content), hashlib.sha256(content).hexdigest(), None))
            if name.lower().endswith(P.ARCHIVE_SUFFIXES) and depth > 1:
                rows += [(inner, None, None, "nested archive too large")] if len(content) > most else expand(inner, content, depth - 1, most)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError):
        rows.append((path, None, None, "corrupt"))
    return rows


def archive_members(spark: SparkSession, roots: Sequence[str], depth: int = ARCHIVE_DEPTH) -> DataFrame:
    """``(outer_path, path, size, full_hash, skip_reason)`` of all members of zip and tar archives below ``roots``."""
    rows = _content(spark, roots).filter(P.archive_kind(F.col("path")).isNotNull()).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *r) for p, c in zip(b["path"], b["content"]) for r in expand(p, bytes(c), depth)]
            yield pd.DataFrame(out, columns=["outer_path", "path", "size", "full_hash", "skip_reason"]).astype({"size": "Int64"})

    return rows.mapInPandas(members, MEMBER_SCHEMA)
