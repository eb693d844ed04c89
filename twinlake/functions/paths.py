"""Column expressions over file paths, digests and file names."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places that are never scanned, and names that mark copies.
EXCLUDED_ROOTS = (
    "/System", "/Library", "/Applications", "/usr", "/opt", "/sbin", "/bin", "/etc", "/private/etc", "/var/db", "/private/var/db", "/var/log", "/private/var/log",
    "/var/vm", "/private/var/vm", "/var/root", "/private/var/root", "/var/audit", "/private/var/audit", "/var/folders", "/private/var/folders", "/var/tmp", "/private/var/tmp", "/Users/Shared",
)
EXCLUDED_VOLUME_PARTS = ("System", "Library", "Applications", "usr", "opt", "private/etc", "private/var/(?:db|log|vm|root|audit|folders|tmp)", "Users/[^/]+/Library")
EXCLUDED_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache")
EXCLUDED_PARTS = ("/.git/objects/", "/System Volume Information/", "/.Trashes/")
PLACEHOLDER_SUFFIX = ".icloud"
BUNDLE_SUFFIXES = (".app", ".pages", ".numbers", ".keynote", ".rtfd", ".sparsebundle", ".xcodeproj", ".playground", ".framework", ".bundle")
COPY_WORDS = ("backup", "backups", "old", "older", "archive", "archives", "duplicate", "duplicates", "copy", "copies")
TREE_COPY_WORDS = ("backup", "backups", "old", "older", "archive", "archives", "bak", "copy", "copies")
HOMEISH = ("Desktop", "Documents", "Downloads", "Pictures", "Movies", "Music")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif", ".bmp", ".tiff", ".tif")
AUDIO_SUFFIXES = (".mp3", ".m4a", ".flac", ".wav", ".ogg", ".aac", ".wma", ".opus")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".wmv", ".flv", ".m4v")
ARCHIVE_SUFFIXES = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar", ".zip")

# Fixed value: a file name that a copy command made: "a (1).x", "a copy.x", "a copy 2.x", "a-2.x".
COPY_NAME = r"(?i)(?:\s\(\d+\)|\scopy|\scopy\s\d+|-\d+)\.[^.]+$"


def _copy_word_pattern(words: Sequence[str] = COPY_WORDS) -> str:
    """A word of a camel-cased, snake-cased or spaced name; without look-around, so any engine takes it."""
    low, cap, up = "|".join(words), "|".join(w.capitalize() for w in words), "|".join(w.upper() for w in words)
    return f"(?:^|[^A-Za-z])(?:{low})(?:[^a-z]|$)|(?:{cap})(?:[^a-z]|$)|(?:^|[^A-Z])(?:{up})(?:$|[^A-Za-z]|[A-Z][a-z])"


COPY_WORD = _copy_word_pattern()


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for none or a name that only begins with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def depth(path: Column) -> Column:
    """Number of path parts, the leading slash counting as one."""
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")) + F.when(path.startswith("/"), 1).otherwise(0)


def within(path: Column, roots: Sequence[str]) -> Column:
    """Whether the path is one of ``roots`` or below one, by text alone."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def excluded_place(path: Column) -> Column:
    volumes = "^/Volumes/[^/]+/(?:" + "|".join(EXCLUDED_VOLUME_PARTS) + ")(?:/|$)"
    out = within(path, EXCLUDED_ROOTS) | path.rlike(r"^/Users/[^/]+/Library(?:/|$)") | path.rlike(volumes)
    for p in EXCLUDED_PARTS:
        out = out | path.contains(p)
    return out


def excluded_segment(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern over a whole string; ``*`` crosses slashes."""
    return "(?s)^" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(glob)).removeprefix("(?s:").removesuffix(")") + "$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def has_copy_word(path: Column) -> Column:
    return path.rlike(COPY_WORD)


def has_copy_name(path: Column) -> Column:
    return base_name(path).rlike(COPY_NAME)


def homeish_ancestor(path: Column) -> Column:
    """Name of the nearest ancestor folder that is a usual home folder; null if there is none."""
    above = F.slice(F.reverse(F.split(path, "/")), 2, 1 << 20)
    found = F.filter(above, lambda p: p.isin(*HOMEISH))
    return F.try_element_at(found, F.lit(1))


def under_copy_folder(path: Column) -> Column:
    """Whether any part of the path is a copy word as a whole, in any case."""
    return F.arrays_overlap(F.transform(F.split(path, "/"), F.lower), F.array(*[F.lit(w) for w in TREE_COPY_WORDS]))


def is_external(path: Column) -> Column:
    return path.startswith("/Volumes/")


def bundle_root(path: Column, suffixes: Sequence[str] = BUNDLE_SUFFIXES) -> Column:
    """The outermost folder above a path whose name ends like a bundle's, in any case; null if there is none. A bundle in a bundle is part of it."""
    parts = F.split(path, "/")
    ends = lambda name: F.lower(name).rlike("(?:" + "|".join(re.escape(x) for x in suffixes) + ")$")
    at = F.array_position(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ends), True)
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))


def trash_folder(path: Column, home: str, uid: int) -> Column:
    """The trash that a removed file lands in: the user's own, or that of the external volume the file is on."""
    volume = F.regexp_extract(path, "^(/Volumes/[^/]+)(?:/|$)", 1)
    return F.when(volume != "", F.concat(volume, F.lit(f"/.Trashes/{uid}"))).otherwise(F.lit(f"{home}/.Trash"))


def inside_trash(path: Column, home: str, uid: int) -> Column:
    """Whether a path lies below a trash of the user, where alone files are restored from; a path with ``..`` never does."""
    return (path.startswith(f"{home}/.Trash/") | path.rlike(rf"^/Volumes/[^/]+/\.Trashes/{uid}/")) & ~F.array_contains(F.split(path, "/"), "..")


def archive_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(tar\.(gz|bz2|xz)|tgz|tbz2|txz|tar)$"), "tar").when(low.endswith(".zip"), "zip")


def outer_archive(path: Column) -> Column:
    return F.substring_index(path, "::", 1)


def without_scheme(path: Column, source: Column) -> Column:
    """The path without its source's ``id://`` or ``id:/`` in front."""
    two, one = F.concat(source, F.lit("://")), F.concat(source, F.lit(":/"))
    return F.when(F.startswith(path, two), F.substr(path, F.length(two) + 1)).when(F.startswith(path, one), F.substr(path, F.length(one) + 1)).otherwise(path)


def relative_destination(path: Column, source: Column) -> Column:
    """Path below the destination's root: no scheme, no empty or current-folder parts."""
    return F.array_join(F.filter(F.split(without_scheme(path, source), "/"), lambda p: (p != "") & (p != ".")), "/")


def digest_algorithm(h: Column, bare: str | None = None) -> Column:
    """Algorithm before the colon of a tagged digest, in lower case; ``bare`` (or null) for an untagged one."""
    return F.when(F.instr(h, ":") > 1, F.lower(F.substring_index(h, ":", 1))).when(h.isNotNull() & (F.instr(h, ":") == 0) & (h != ""), F.lit(bare))


def digest_hex(h: Column) -> Column:
    return F.lower(F.when(F.instr(h, ":") > 0, F.regexp_extract(h, r"^[^:]*:(.*)$", 1)).otherwise(h))


def digests_match(a: Column, b: Column) -> Column:
    """True or false for digests of one algorithm; null where they can't be compared."""
    known = (digest_algorithm(a, "blake3") == digest_algorithm(b, "blake3")) & (digest_hex(a) != "") & (digest_hex(b) != "")
    return F.when(known, digest_hex(a) == digest_hex(b))


def full_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def partial_digest(content: Column, sample: int = 65536) -> Column:
    """Digest of the first ``sample`` bytes, and of the last where the content is longer than two samples."""
    tail = F.when(F.length(content) > 2 * sample, F.substring(content, -sample, sample)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.substring(content, 1, sample), tail), 256)


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out


def clean_part(c: Column) -> Column:
    """A name made safe as one path part; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', " ")), F.lit(""))
