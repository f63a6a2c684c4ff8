"""Text helpers: metadata keys, versions, watershed codes, path patterns."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalise_meta_key(key: Column | str) -> Column:
    """Lower case without spaces, dashes and underscores."""
    return F.regexp_replace(F.lower(_col(key)), "[ _-]", "")


def sanitize_version(version: Column | str) -> Column:
    """Drop leading zeros of every number in a version text."""
    return F.regexp_replace(F.trim(_col(version)), r"\b0+([0-9])", "$1")


# Fixed value: the grammar of a semantic version.
SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    r"(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?"
    r"(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?$"
)


def version_parts(version: Column | str) -> Column:
    """Struct of major, minor, patch, prerelease; null where the text is no version."""
    clean = sanitize_version(version)
    number = lambda group: F.regexp_extract(clean, SEMVER, group).try_cast("int")
    return F.when(
        clean.rlike(SEMVER),
        F.struct(
            number(1).alias("major"),
            number(2).alias("minor"),
            number(3).alias("patch"),
            F.regexp_extract(clean, SEMVER, 4).alias("prerelease"),
        ),
    )


def huc_prefix(code: Column | str, level: int) -> Column:
    """Watershed code at a coarser level (2, 4, 6, 8, 10 or 12 characters)."""
    if level not in (2, 4, 6, 8, 10, 12):
        raise ValueError(f"no such watershed level: {level}")
    return F.substring(_col(code), 1, level)


def huc_folder(code: Column | str) -> Column:
    """Folder label of a watershed code."""
    return F.concat(F.lit("HUC_"), _col(code))


def tags_to_text(tags: Column | str) -> Column:
    """Tags joined by commas."""
    return F.array_join(_col(tags), ",")


def text_to_tags(text: Column | str) -> Column:
    """Comma text to trimmed tags."""
    return F.transform(F.split(_col(text), ","), lambda tag: F.trim(tag))


def matches_any(path: Column | str, patterns: Sequence[str]) -> Column:
    """Does any pattern match from the start of the path, whatever the case?"""
    tests = [_col(path).rlike(f"(?i)^(?:{pattern})") for pattern in patterns]
    return reduce(lambda a, b: a | b, tests)


def folder_of(path: Column | str) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(_col(path), "/[^/]*$", "")


def without_extension(path: Column | str) -> Column:
    """Path without its last extension; a leading dot starts a name, not an extension."""
    stem = r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$"
    return F.regexp_replace(_col(path), stem, "$1")


def epoch_ms_to_ts(millis: Column | str) -> Column:
    return F.timestamp_millis(_col(millis))


def ts_to_epoch_ms(moment: Column | str) -> Column:
    return F.unix_millis(_col(moment).cast("timestamp"))
