"""Keys, content hashes and pseudonyms as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def render(value: Column, kind: str = "string") -> Column:
    """A value as text for hashing: nulls as None, booleans as True/False, whole floats without their point."""
    if kind == "boolean":
        text = F.when(value, "True").otherwise("False")
    elif kind in ("double", "float"):
        text = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def digest(parts: list[Column], length: int = 32) -> Column:
    """SHA-256 of the parts as text. A null part is None, so that it can't shift the others."""
    parts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts).cast("binary"), 256), 1, length)


def event_uid(*parts: Column, length: int = 32) -> Column:
    """Content hash of rendered parts; see render()."""
    return digest(list(parts), length)


def link_uid(parent: Column, child: Column, relation: Column, method: Column, length: int = 32) -> Column:
    return digest([parent, child, relation, method], length)


def lineage_id(entity: Column, window_id: Column, root: Column, length: int = 32) -> Column:
    return digest([entity, window_id.cast("string"), root], length)


def window_id(t: Column, period_ns: int, epoch_ns: int = 0) -> Column:
    """Number of the tumbling window; instants before the epoch have negative ones."""
    shifted = t - F.lit(epoch_ns)
    return ((shifted - F.pmod(shifted, F.lit(period_ns))) / F.lit(period_ns)).cast("long")


def stable_shard(key: Column, shards: int) -> Column:
    """Shard by the first 8 bytes of SHA-256, big-endian."""
    top = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (top % F.lit(shards)).cast("int")


def normalize_text(value: Column) -> Column:
    """Trimmed; empty and missing words become null; whole numbers lose their point."""
    text = F.trim(value.cast("string"))
    text = F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(~F.lower(text).isin("", "nan", "none", "null", "<na>", "nat"), text)


def normalize_hostname(value: Column, strip_domain: bool = False) -> Column:
    host = F.regexp_replace(F.lower(normalize_text(value)), r"\.$", "")
    if strip_domain:
        host = F.when(host.rlike(r"^[0-9.]+$") | host.contains(":"), host).otherwise(F.substring_index(host, ".", 1))
    return host


def compose_key(*parts: Column, sep: str = ":") -> Column:
    """Parts joined; null if any is."""
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws(sep, *parts))


def compose_link_key(near: Column, far_chassis: Column, far_port: Column) -> Column:
    """One name for a link seen from either end."""
    far = compose_key(far_chassis, far_port)
    return F.when(near.isNotNull() & far.isNotNull(), F.array_join(F.array_sort(F.array(near, far)), "|"))


def mac_oui(mac: Column, supplied: Column | None = None) -> Column:
    own = F.substring_index(F.lower(F.regexp_replace(mac, "-", ":")), ":", 3)
    return F.coalesce(F.lower(supplied), own) if supplied is not None else own


def pseudonymize(value: Column, key: bytes, length: int = 32) -> Column:
    """HMAC-SHA256 by its definition, so that values never leave the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    once = F.sha2(F.concat(F.unhex(F.lit(inner)), value.cast("string").cast("binary")), 256)
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(once)), 256), 1, length)


def merkle_root(uids: Column) -> Column:
    """Root over the sorted distinct ids: leaves sha256(00 | id), nodes sha256(01 | left | right), an odd node goes up as
    it is. Levels are folded by pairs inside the array; 40 levels hold more ids than an array can."""
    level = F.transform(F.array_sort(F.array_distinct(uids)), lambda u: F.sha2(F.concat(F.unhex(F.lit("00")), u.cast("binary")), 256))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        level,
        lambda acc, k: F.when(F.size(acc) <= 1, acc).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(acc) - 1) / 2).cast("int")),
                lambda i: F.when(F.get(acc, 2 * i + 1).isNotNull(), F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.get(acc, 2 * i)), F.unhex(F.get(acc, 2 * i + 1))), 256)).otherwise(F.get(acc, 2 * i)),
            )
        ),
        lambda acc: F.get(acc, F.lit(0)),
    )
