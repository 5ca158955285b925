"""Stamps: the layer and subject of a row, what decided its numbers, and fingerprints of whole windows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.identity import compose_key, normalize_hostname, normalize_text

#: Tiers of determinism, what stands for an unknown part, and for a start without a checkpoint.
TIERS = ("bitwise", "numeric", "best_effort")
UNKNOWN, COLD_START = "unknown", "cold-start"
DIGEST = 16
HOST_COLUMNS = ("hostname",)
#: Two primes below 2**61: sums of a window's row hashes are kept modulo each.
MODULI = (2305843009213693951, 2305843009213693921)


def stamp_envelope(df: DataFrame, osi_layer: int, entity_columns: list[str], overwrite: bool = False, host_columns: tuple[str, ...] = HOST_COLUMNS) -> DataFrame:
    """osi_layer, and entity_key where a row has none: the entity's columns composed, hosts in their normal form; null if a part is
    missing. With overwrite all keys are composed."""
    if isinstance(osi_layer, bool) or not 0 <= osi_layer <= 7:
        raise ValueError(f"a layer is a number from 0 to 7, not {osi_layer!r}")
    if not entity_columns:
        raise ValueError("a row needs a subject: name its columns")
    if missing := [c for c in entity_columns if c not in df.columns]:
        raise KeyError(f"columns that the key needs: {missing}")
    key = compose_key(*(normalize_hostname(F.col(c)) if c in host_columns else F.col(c).cast("string") for c in entity_columns))
    if "entity_key" in df.columns and not overwrite:
        key = F.coalesce(normalize_text(F.col("entity_key")), key)
    return df.withColumns({"osi_layer": F.lit(osi_layer), "entity_key": key})


def _plain(value: object) -> object:
    """A setting in the form that is hashed: whole floats as whole numbers, truth values as words, keys in order."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def settings_hash(settings: dict) -> str:
    """A digest of settings that doesn't depend on their order or on how a number is spelled."""
    if not settings:
        raise ValueError("no settings to hash")
    return hashlib.sha256(json.dumps(_plain(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:DIGEST]


def pipeline_fingerprint(**parts: object) -> str:
    """A digest of everything that decides a number (configuration, schema_versions, thresholds, code_commit, image_digest, reference_data); a part that isn't known is ``unknown``,
    and an empty one is an error."""
    needed = {"configuration", "schema_versions", "thresholds", "code_commit", "image_digest", "reference_data"}
    if set(parts) != needed or any(v is None or v in ("", {}) for v in parts.values()):
        raise ValueError(f"give each of {sorted(needed)}, or {UNKNOWN!r} for it")
    return settings_hash(parts)


def stamp_determinism(df: DataFrame, tier: str, stamps: dict[str, str | int], models: DataFrame | None = None, entity: str = "user_principal", window: str = "window_id", resumed_from: str = COLD_START) -> DataFrame:
    """determinism_tier, the stamps, resumed_from, model_version and model_fallback.

    models: (entity, window_id, model_version); a row takes the model of its entity and window, else the window's fallback (null entity) with
    model_fallback true; without either both are null. Fallbacks are one row a window; a model table has one row a key.
    """
    if tier not in TIERS:
        raise ValueError(f"{tier!r} is none of {TIERS}")
    out = df.withColumns({"determinism_tier": F.lit(tier)} | {k: F.lit(v) for k, v in stamps.items()} | {"resumed_from": F.lit(resumed_from)})
    if models is None:
        return out.withColumns({"model_version": F.lit(None).cast("string"), "model_fallback": F.lit(None).cast("boolean")})
    own = models.where("entity IS NOT NULL").select(normalize_text(F.col("entity")).alias("_e"), F.col("window_id").alias("_w"), F.col("model_version").alias("_own"))
    rest = models.where("entity IS NULL").select(F.col("window_id").alias("_fw"), F.col("model_version").alias("_rest"))
    out = out.join(own, (normalize_text(F.col(entity)) == F.col("_e")) & (F.col(window) == F.col("_w")), "left").join(rest, F.col(window) == F.col("_fw"), "left")
    version = F.coalesce("_own", "_rest")
    out = out.withColumns({"model_version": version, "model_fallback": F.when(version.isNotNull(), F.col("_own").isNull())})
    return out.drop("_e", "_w", "_own", "_fw", "_rest")


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two 60-bit numbers of a row's values as text; null and the text ``null`` differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16))  # type: ignore[return-value]


def window_fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, rows and fingerprint: a hash of the multiset of rows.

    Two hashes of each row are summed, each modulo a prime: sums don't depend on order or partitioning, are made by partial
    aggregation and merge, and a row that stands twice changes them.
    """
    first, second = row_hashes(columns)
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(first).alias("_a"), F.sum(second).alias("_b"))
    kept = [(F.col(c) % F.lit(m).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string") for c, m in zip(("_a", "_b"), MODULI, strict=True)]
    return out.select(*keys, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *kept), 256).alias("fingerprint"))
