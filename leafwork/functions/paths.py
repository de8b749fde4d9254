"""File paths and attachment URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id
from leafwork.functions.text import slug

MAX_ATTACHMENT_BYTES = 512 * 1024  # fixed value: default size limit


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def child_directory(path: Column) -> Column:
    """Directory of the children of the page stored at `path`."""
    return F.regexp_replace(path, r"\.md$", "")


def joined_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[blank_to_null(part) for part in parts])


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def _url_path(url: Column) -> Column:
    """Decoded path of a URL; null when an escape is broken. A plus sign is not a blank here."""
    raw = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def hosted_file_id(url: Column) -> Column:
    """Id of a file in the workspace's own object storage; null for any other URL."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    parts = F.split(F.regexp_replace(_url_path(url), "^/+|/+$", ""), "/")
    return F.when(
        host.contains("s3") & host.contains("amazonaws.com") & (F.size(parts) >= 2),
        normalize_id(F.get(parts, F.lit(1))),
    )


def attachment_name(url: Column) -> Column:
    """Local file name: last path segment, form-decoded, as slug with a lower-case extension."""
    segment = F.substring_index(_url_path(url), "/", -1)
    name = F.coalesce(F.try_url_decode(segment), segment)
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.concat(slug(F.regexp_replace(name, r"\.[^.]*$", "")), F.lower(extension))


def suffixed(name: Column, short_id: Column) -> Column:
    """`base.ext` -> `base-<short id>.ext`."""
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), short_id, extension)


def relative_to(path: Column, base: Column) -> Column:
    """`path` as seen from directory `base`; both are relative to the same root."""
    there = F.split(path, "/")
    here = F.filter(F.split(base, "/"), lambda part: part != "")
    same = F.transform(F.arrays_zip(here.alias("a"), F.slice(there, 1, F.size(here)).alias("b")),
                       lambda pair: F.coalesce(pair["a"] == pair["b"], F.lit(False)))
    mismatch = F.array_position(same, False)
    shared = F.when(mismatch > 0, mismatch - 1).otherwise(F.size(here)).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(here) - shared)
    down = F.slice(there, shared + 1, F.size(there))
    return F.array_join(F.concat(up, down), "/")
