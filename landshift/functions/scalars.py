"""Rounding, identifiers and canonical JSON as native column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F


def decimals(x: Column, places: int) -> Column:
    """Half-even rounding on the scaled double (codegen'd, no BigDecimal per row)."""
    scale = float(10**places)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def round2(x: Column) -> Column:
    return decimals(x, 2)


def round6(x: Column) -> Column:
    return decimals(x, 6)


def ratio(num: Column, den: Column, empty: float = 1.0) -> Column:
    """num / den; the given value where the denominator is zero."""
    safe = F.when(den == 0, F.lit(None)).otherwise(den)
    return F.coalesce(num.cast("double") / safe.cast("double"), F.lit(float(empty)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def uuid5_url(*parts: Column | str) -> Column:
    """RFC 4122 version-5 UUID, URL namespace, of the ':'-joined parts."""
    name = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and explicit nulls."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def request_key(
    source_hashes: Column, pair_id: Column, config_hash: Column, model_version: Column,
    rule_version: Column, operation: Column,
) -> Column:
    """Content hash that makes a processing request idempotent."""
    return sha256(canonical_json({
        "source_asset_hashes": source_hashes,
        "image_pair_id": pair_id,
        "processing_configuration_hash": config_hash,
        "model_version": model_version,
        "rule_set_version": rule_version,
        "operation_type": operation,
    }))


def row_digest(*cols: Column | str) -> Column:
    """64-bit digest of a row; summed (as decimal) it is independent of row order."""
    return F.xxhash64(*cols).cast("decimal(38,0)")


def codes(*rules: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def first_code(*rules: tuple[Column, str]) -> Column:
    """The first code whose condition holds, else null."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in rules])
