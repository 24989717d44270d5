"""Stable identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(c: Column) -> Column:
    """The first 16 hex characters of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed of two SHA-256 over padded keys."""
    if len(key) > 64:
        raise ValueError("key longer than a block")
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    lit = lambda b: F.unhex(F.lit(b.hex()))
    inner = F.unhex(F.sha2(F.concat(lit(pads[0]), message.cast("binary")), 256))
    return F.sha2(F.concat(lit(pads[1]), inner), 256)


def fnv1a_32(c: Column) -> Column:
    """FNV-1a over UTF-16 units below 2^16 (code points), as unsigned 32-bit in a long."""
    return F.aggregate(
        F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")),
        F.lit(0x811C9DC5).cast("long"),
        lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(0x01000193), F.lit(1 << 32)),
    )


def short_reference(c: Column) -> Column:
    """Six upper-case base-16 characters that stand for a session id on screen."""
    return F.upper(F.substring(F.lpad(F.lower(F.hex(fnv1a_32(c))), 8, "0"), 1, 6))


def event_fingerprint(event_type: Column, category: Column, name: Column, success: Column, duration: Column, utc_ts: Column, provenance: Column) -> Column:
    """Hash of an event's visible fields; null success is -1, an unreadable time is named as such."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tri = F.when(success.isNull(), -1).when(success, 1).otherwise(0)
    when = F.coalesce(F.date_format(utc_ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("time-unavailable"))
    return stable_hash(F.concat_ws("|", text(event_type), text(category), text(name), tri.cast("string"), text(duration), when, text(provenance)))


def live_session_id(agent: Column, source_session_id: Column) -> Column:
    return stable_hash(F.concat_ws(":", agent, source_session_id))
