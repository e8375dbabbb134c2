"""Sensitive keys in JSON text, credentials in URIs, log-safe projections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from landshift.functions.constants import LOG_TEXT_LIMIT, PERSONAL_TERMS, SECRET_TERMS

# Every JSON string token, with the colon that follows when the token is a key.
_TOKEN = r'"((?:[^"\\]|\\.)*)"(\s*:)?'


def json_keys(text: Column) -> Column:
    """All keys at any depth of a JSON text."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.transform(
        F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.regexp_extract(t, _TOKEN, 1)
    )


def has_sensitive_key(text: Column) -> Column:
    terms = "|".join(SECRET_TERMS)
    return F.exists(json_keys(text), lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).rlike(terms))


def uri_has_secrets(uri: Column) -> Column:
    """User information or a query part."""
    return uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@") | uri.rlike(r"^[^#?]*\?[^#]")


def safe_metadata(metadata: Column) -> Column:
    """Map of strings without personal keys, values cut to the log limit."""
    terms = "|".join(PERSONAL_TERMS)
    kept = F.map_filter(metadata, lambda k, v: ~F.lower(k).rlike(terms))
    return F.transform_values(kept, lambda k, v: F.left(v, F.lit(LOG_TEXT_LIMIT)))


def safe_metadata_json(text: Column) -> Column:
    """The same for a JSON object: nested values are dropped, strings cut, scalars kept as text."""
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    terms = "|".join(PERSONAL_TERMS)
    scalar = F.map_filter(
        fields,
        lambda k, v: ~F.lower(k).rlike(terms)
        & ~F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False)),
    )
    return F.transform_values(scalar, lambda k, v: F.left(F.try_variant_get(v, "$", "string"), F.lit(LOG_TEXT_LIMIT)))
