"""Pull-request events: authentication, filtering and validation as column expressions.

The same functions serve a batch table and a stream of (headers, body) rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from changerisk.functions.commits import valid_repo_name, valid_sha1
from changerisk.functions.text import strip

# Event contract.
SUPPORTED_ACTIONS = ["opened", "synchronize", "reopened"]
EVENT_TYPE = "pull_request"
_BLOCK = 64  # bytes of a SHA-256 block


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a binary column: two hashes with key pads made on the driver."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name; the last of several wins."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def signature_ok(body: Column, signature: Column, secret: str) -> Column:
    given = F.lower(strip(F.substring(signature, 8, 2**31 - 1)))
    usable = (
        F.startswith(signature, F.lit("sha256="))
        & (given != "")
        & (F.octet_length(body) > 0)
        & F.lit(bool(secret))
    )
    return F.coalesce(usable & (given == hmac_sha256(body, secret)), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _either(v: Column, path: str) -> Column:
    """Value under base, else under head, else empty."""
    return F.coalesce(
        F.nullif(_text(v, f"$.pull_request.base.{path}"), F.lit("")),
        F.nullif(_text(v, f"$.pull_request.head.{path}"), F.lit("")),
        F.lit(""),
    )


def _starts(v: Column, path: str, kind: str) -> Column:
    word = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.startswith(word, F.lit(kind)), F.lit(False))


def classify_events(events: DataFrame, secret: str | None = None) -> DataFrame:
    """Validated pull-request columns and ``reject_reason`` (null when accepted).

    The signature is checked before the body is parsed: a row that fails it keeps no parsed field.
    """
    sig = header(F.col("headers"), "x-hub-signature-256")
    staged = events.withColumns(
        {
            "delivery_id": F.coalesce(header(F.col("headers"), "x-github-delivery"), F.lit("")),
            "event_type": F.coalesce(header(F.col("headers"), "x-github-event"), F.lit("")),
        }
    )
    auth = F.lit(None).cast("string")
    if secret:
        auth = F.when(F.coalesce(sig, F.lit("")) == "", "missing_signature").when(
            ~signature_ok(F.col("body"), sig, secret), "bad_signature"
        )
    staged = staged.withColumn("_auth", auth)
    body = F.col("body").cast("string")
    readable = F.col("_auth").isNull() & (F.col("event_type") == EVENT_TYPE)
    staged = staged.withColumn(
        "_v", F.when(readable & F.is_valid_utf8(body), F.try_parse_json(body))
    )
    v = F.col("_v")
    state_given = F.try_variant_get(v, "$.pull_request.state", "variant").isNotNull()
    state = F.when(state_given, _text(v, "$.pull_request.state")).otherwise("open")
    fields = {
        "action": F.coalesce(_text(v, "$.action"), F.lit("")),
        "owner": _either(v, "repo.owner.login"),
        "repository": _either(v, "repo.name"),
        "number": F.try_variant_get(v, "$.pull_request.number", "bigint"),
        "title": F.coalesce(_text(v, "$.pull_request.title"), F.lit("")),
        "html_url": F.coalesce(_text(v, "$.pull_request.html_url"), F.lit("")),
        "base_ref": F.coalesce(_text(v, "$.pull_request.base.ref"), F.lit("")),
        "base_sha": F.coalesce(_text(v, "$.pull_request.base.sha"), F.lit("")),
        "head_ref": F.coalesce(_text(v, "$.pull_request.head.ref"), F.lit("")),
        "head_sha": F.coalesce(_text(v, "$.pull_request.head.sha"), F.lit("")),
        "state": state,
    }
    staged = staged.withColumns(fields)
    c = F.col
    reason = (
        F.when(c("_auth").isNotNull(), c("_auth"))
        .when(c("event_type") != EVENT_TYPE, "unsupported_event")
        .when(v.isNull(), "malformed_json")
        .when(~_starts(v, "$", "OBJECT"), "not_object")
        .when(~c("action").isin(SUPPORTED_ACTIONS), "unsupported_action")
        .when(~_starts(v, "$.pull_request", "OBJECT"), "missing_pull_request")
        .when(F.coalesce(c("state") != "open", F.lit(True)), "not_open")
        .when(~valid_repo_name(c("owner")), "invalid_owner")
        .when(~valid_repo_name(c("repository")), "invalid_repository")
        .when(
            ~_starts(v, "$.pull_request.number", "BIGINT") | F.coalesce(c("number") <= 0, F.lit(True)),
            "invalid_number",
        )
        .when(~valid_sha1(c("base_sha")), "invalid_base_sha")
        .when(~valid_sha1(c("head_sha")), "invalid_head_sha")
    )
    return staged.withColumn("reject_reason", reason).drop("_auth", "_v")


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).drop("reject_reason", "headers", "body")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNotNull())


def supported_events(events: DataFrame) -> DataFrame:
    """Events on the right type, action and state, from already parsed columns."""
    return events.where(
        (F.col("event_type") == EVENT_TYPE)
        & F.col("action").isin(SUPPORTED_ACTIONS)
        & (F.coalesce("state", F.lit("open")) == "open")
    )
