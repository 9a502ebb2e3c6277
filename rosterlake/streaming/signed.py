"""Signed messages: which ones come from who holds the secret, unchanged and fresh. Columns only, for tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256

MOST_SECONDS = 3600
#: White space outside of strings of a JSON text.
LOOSE = r'("(?:[^"\\]|\\.)*")|\s+'


def _unpadded(part: Column) -> Column:
    """Bytes of base64 for addresses; null if it is none."""
    whole = F.concat(F.translate(part, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.try_to_binary(whole, F.lit("base64"))


def verdict(body: Column, authorization: Column, received_at: Column, secret: str, most_seconds: int = MOST_SECONDS) -> Column:
    """ok, or why a message is refused: no_secret, no_token, bad_token, bad_algorithm, bad_signature, stale, other_body.

    authorization: Bearer and a token of header, claims and signature (HS256);
    its claims hold when it was made (iat, seconds) and the body's SHA-256
    (payload_hash), of the body as it is or without white space between its
    parts. Escapes and numbers of the body aren't written anew for that.
    """
    if not secret:
        return F.lit("no_secret")
    token = F.regexp_extract(F.coalesce(authorization, F.lit("")), r"(?i)^bearer\s+(\S.*?)\s*$", 1)
    parts = F.split(token, r"\.")
    part = lambda i: F.get(parts, i)
    header, claims = (F.try_parse_json(F.try_validate_utf8(_unpadded(part(i)).cast("string"))) for i in (0, 1))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    at = lambda name, t: F.try_variant_get(claims, f"$.{name}", t)
    is_object = kind(header).startswith("OBJECT") & kind(claims).startswith("OBJECT")
    signature = _unpadded(part(2))
    signed = F.lower(F.hex(signature)) == hmac_sha256(secret, F.concat_ws(".", part(0), part(1)))
    fresh = kind(at("iat", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.abs(F.unix_micros(received_at) / 1e6 - at("iat", "double")) <= most_seconds)
    want = F.when(kind(at("payload_hash", "variant")) == "STRING", F.lower(at("payload_hash", "string")))
    text = F.coalesce(body.cast("string"), F.lit(""))
    same = (F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256) == want) | (F.sha2(F.regexp_replace(text, LOOSE, "$1").cast("binary"), 256) == want)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(token == "", "no_token").when((F.size(parts) != 3) | header.isNull() | claims.isNull() | signature.isNull(), "bad_token").when(no(is_object & (F.try_variant_get(header, "$.alg", "string") == "HS256")), "bad_algorithm")
        .when(no(signed), "bad_signature").when(no(fresh), "stale").when(no(same), "other_body").otherwise("ok")
    )


def verified(messages: DataFrame, secret: str, body: str = "body", authorization: str = "authorization", received_at: str = "received_at") -> DataFrame:
    """The messages that are what they say; put deduplicated() behind it, as a token may come again within the hour."""
    return messages.where(verdict(F.col(body), F.col(authorization), F.col(received_at), secret) == "ok")
