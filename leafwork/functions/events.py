"""Signature, freshness and routing of edit events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # SHA-256 block size in bytes
MAX_AGE_SECONDS = 300  # fixed value

# Event types by route.
CHANGES = (
    "page.created", "page.updated", "page.content_updated", "page.properties_updated",
    "database.created", "database.updated", "database.content_updated",
    "database.properties_updated",
)
DELETIONS = ("page.deleted", "page.undeleted", "database.deleted", "database.undeleted")


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of text under a secret known when the plan is built."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def is_fresh(timestamp: Column, received_at: Column) -> Column:
    """Whether the header time (Unix seconds as text) is less than five minutes off."""
    sent = timestamp.try_cast("bigint")
    micros = F.unix_micros(received_at) - sent * 1_000_000
    clean = timestamp.rlike(r"^[+-]?\d+$")
    return F.coalesce(clean & (F.abs(micros) < MAX_AGE_SECONDS * 1_000_000), F.lit(False))


def is_authentic(
    secret: str | None, signature: Column, timestamp: Column, body: Column, received_at: Column
) -> Column:
    """Signature and freshness check; without a secret everything passes."""
    if not secret:
        return F.lit(True)
    present = (F.coalesce(signature, F.lit("")) != "") & (F.coalesce(timestamp, F.lit("")) != "")
    matches = signature == hmac_sha256(secret, F.concat(timestamp, body))
    return F.coalesce(present & is_fresh(timestamp, received_at) & matches, F.lit(False))


def route(kind: Column, entity_id: Column, token: Column) -> Column:
    """`queue`, `deletion`, `verification` or `ignored`."""
    named = F.coalesce(entity_id, F.lit("")) != ""
    return (
        F.when(kind.isin(*CHANGES) & named, "queue")
        .when(kind.isin(*DELETIONS) & named, "deletion")
        .when((F.coalesce(kind, F.lit("")) == "") & (F.coalesce(token, F.lit("")) != ""), "verification")
        .otherwise("ignored")
    )
