"""Path columns: normal form, extension, language, safety, ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java",
    "cpp": "cpp", "hpp": "cpp", "c": "c", "h": "c", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "m": "objective-c", "mm": "objective-c", "ipynb": "jupyter",
    "md": "markdown", "markdown": "markdown",
}
#: Folder for the engine's own state, never read as input.
STATE_DIR = ".context"


def slashes(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")


def normalized(path: Column) -> Column:
    """Backslashes as slashes, runs of slashes as one, empty as a dot."""
    out = slashes(path)
    return F.when(out == "", F.lit(".")).otherwise(out)


def extension(path: Column) -> Column:
    """Lower-cased, after the last dot of the last segment; null if there is none or it is empty."""
    found = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(found != "", F.lower(found))


def language(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[F.lower(F.ltrim(F.trim(ext), F.lit(".")))], F.lit("text"))


def safe(path: Column) -> Column:
    """A path inside the root: trimmed, without ./ and outer slashes; null if absolute or climbing."""
    out = slashes(F.trim(path))
    bare = F.regexp_replace(F.regexp_replace(out, r"^(\./)+", ""), "^/+|/+$", "")
    bad = out.startswith("/") | out.rlike("^[A-Za-z]:/") | F.concat(F.lit("/"), bare, F.lit("/")).contains("/../")
    return F.when(~bad, F.when(bare == "", F.lit(".")).otherwise(bare))


def reserved(path: Column) -> Column:
    """Whether a path lies in the engine's state folder."""
    return (path == STATE_DIR) | path.startswith(STATE_DIR + "/")


def ignore_regex(patterns: Iterable[str]) -> str | None:
    """One expression for all patterns: their segments fit neighbouring segments anywhere in the path.

    A segment `*.x` fits segments that end in .x; nothing else is special.
    """
    out = set()
    for p in patterns:
        p = re.sub("/+", "/", p.strip().replace("\\", "/"))
        segments = [s for s in p.split("/") if s and s != "."]
        if segments:
            out.add("/".join(rf"(?:\*|[^/]*)\.{re.escape(s[2:])}" if s.startswith("*.") else re.escape(s) for s in segments))
    return f"(?:^|/)(?:{'|'.join(sorted(out))})(?:/|$)" if out else None


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    fits = ignore_regex(patterns)
    if fits is None:
        return F.lit(False)
    plain = F.regexp_replace(F.regexp_replace(slashes(F.trim(path)), r"(^|/)(\./)+", "$1"), "^/+|/+$", "")
    return plain.rlike(fits)


def allowed_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether the extension is listed; an empty list lets all through."""
    listed = sorted({e.strip().strip(".").lower() for e in extensions} - {""})
    return F.coalesce(extension(path).isin(*listed), F.lit(False)) if listed else F.lit(True)
