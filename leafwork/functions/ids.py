"""Identifiers: normal form, dashed form, ids in URLs, index shards, parent precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def normalize_id(value: Column) -> Column:
    return F.replace(value, F.lit("-"), F.lit(""))


def dashed_id(value: Column) -> Column:
    """8-4-4-4-12 form of a 32-character id; other lengths stay as they are."""
    pieces = [F.substring(value, at, width) for at, width in
              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(value) == 32, F.concat_ws("-", *pieces)).otherwise(value)


def packed(value: Column) -> Column:
    """The id in binary, 16 bytes for one of 32 hex digits; `unpacked` gives every id back as it was.

    For keys that travel through joins: half the bytes of the text. Other ids become longer than 16
    bytes, so no two ids share a value. The order of the values is not that of the ids.
    """
    other = F.concat(F.lit(bytes(17)), value.cast("binary"))
    return F.when(value.rlike(r"^[0-9a-f]{32}\z"), F.unhex(value)).otherwise(other)


def unpacked(value: Column) -> Column:
    other = F.substring(value, 18, 2**31 - 1).cast("string")
    return F.when(F.octet_length(value) == 16, F.lower(F.hex(value))).otherwise(other)


def parent_id(parent: Column) -> Column:
    """Parent reference of a page in order of precedence; the data source id is not one."""
    return F.coalesce(
        *[blank_to_null(parent[name]) for name in ("page_id", "database_id", "block_id", "space_id")]
    )


def is_workspace_level(parent: Column) -> Column:
    return F.coalesce(parent["type"].isin("workspace", "space"), F.lit(False)) | F.coalesce(
        parent["workspace"], F.lit(False)
    )


def page_id_from_text(value: Column) -> Column:
    """Normalised id in a URL or a raw id; null when there is none."""
    text = F.trim(value)
    path = F.try_url_decode(
        F.replace(F.regexp_extract(text, r"^https?://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B"))
    )
    last = F.regexp_extract(F.regexp_replace(path, "^/+|/+$", ""), "([^/]*)$", 1)
    tail = F.regexp_extract(last, "([0-9a-fA-F]{32})$", 1)
    # five dash-separated groups of 36 characters in all are taken as an id without looking inside
    grouped = F.regexp_extract(last, r"((?:[^-]*-){4}[^-]*)$", 1)
    from_url = F.when(tail != "", tail).when(
        F.octet_length(grouped) == 36, normalize_id(grouped)
    )
    bare = normalize_id(text)
    return F.when(text.rlike("^https?://"), from_url).when(
        bare.rlike("^[0-9a-fA-F]{32}$"), bare
    )


SHARD_COUNT = 256  # fixed value


def shard_key(value: Column) -> Column:
    """Two hex characters: the start of the id, or an FNV-1a (32 bit) bucket where it is not hex.

    Only the low byte of the hash is used, and the low byte of a product depends on the low bytes
    of its factors alone, so the fold runs modulo 256: offset 0x811c9dc5 -> 0xc5, prime
    0x01000193 -> 0x93.
    """
    text = F.lower(normalize_id(value))
    raw = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(
        F.sequence(F.lit(1), F.octet_length(text)),
        lambda at: F.conv(F.substr(raw, at * 2 - 1, F.lit(2)), 16, 10).cast("int"),
    )
    folded = F.aggregate(
        octets,
        F.lit(0xC5),
        lambda state, octet: ((state.bitwiseXOR(octet)) * 0x93).bitwiseAND(F.lit(0xFF)),
    )
    hashed = F.when(text == "", F.lit(0xC5)).otherwise(folded)
    return F.when(text.rlike("^[0-9a-f]{2}"), F.substring(text, 1, 2)).otherwise(
        F.lower(F.lpad(F.hex(hashed), 2, "0"))
    )
