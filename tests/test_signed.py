import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from rosterlake.functions import text as tf
from rosterlake.streaming import events, signed

SECRET = "s3cret"
NOW = 1_767_268_800  # 2026-01-01 12:00:00


def url(raw):
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def token(body, secret=SECRET, header=None, **claims):
    head = url(json.dumps({"alg": "HS256", "typ": "JWT"} if header is None else header).encode())
    held = url(json.dumps({"iat": NOW - 5, "payload_hash": hashlib.sha256(body.encode()).hexdigest(), **claims}).encode())
    return f"Bearer {head}.{held}." + url(hmac.new(secret.encode(), f"{head}.{held}".encode(), hashlib.sha256).digest())


def verdicts(spark, rows, secret=SECRET):
    df = spark.createDataFrame([(k, b, a) for k, (b, a) in enumerate(rows)], "k int, body string, authorization string").withColumn("received_at", F.timestamp_seconds(F.lit(NOW)))
    return [r["v"] for r in df.select("k", signed.verdict(F.col("body"), F.col("authorization"), F.col("received_at"), secret).alias("v")).orderBy("k").collect()]


def test_what_is_refused(spark):
    body = '{"text": "été ouvert", "n": [1, 2]}'
    compact = json.dumps(json.loads(body), separators=(",", ":"), ensure_ascii=False)
    good = token(body)
    cases = [
        (body, good, "ok"), (body, token(compact), "ok"), (body, good.replace("Bearer", "bearer") + "  ", "ok"), (body + " ", good, "other_body"), (body.replace("ouvert", "ferme"), good, "other_body"), (None, token(""), "ok"),
        (body, None, "no_token"), (body, "", "no_token"), (body, "Bearer ", "no_token"), (body, good.replace("Bearer", "Basic"), "no_token"), (body, good + ".x", "bad_token"), (body, "Bearer a.b", "bad_token"), (body, "Bearer %%.%%.%%", "bad_token"),
        (body, "Bearer " + ".".join([url(b"no json"), url(b"{}"), "AAAA"]), "bad_token"), (body, token(body, header={"alg": "none"}), "bad_algorithm"), (body, token(body, header=["HS256"]), "bad_algorithm"), (body, token(body, secret="other"), "bad_signature"),
        (body, good[:-3] + "AAA", "bad_signature"), (body, token(body, iat=NOW - 3600), "ok"), (body, token(body, iat=NOW - 3601), "stale"), (body, token(body, iat=NOW + 3601), "stale"), (body, token(body, iat=float(NOW) + 0.5), "ok"),
        (body, token(body, iat=str(NOW)), "stale"), (body, token(body, iat=None), "stale"), (body, token(body, payload_hash=5), "other_body"), (body, token(body, payload_hash=hashlib.sha256(body.encode()).hexdigest().upper()), "ok"),
    ]
    assert verdicts(spark, [c[:2] for c in cases]) == [c[2] for c in cases]
    assert verdicts(spark, [(body, good)], "") == ["no_secret"]
    long = "k" * 100
    assert verdicts(spark, [(body, token(body, secret=long))], long) == ["ok"]


def test_keyed_ids_are_hmacs(spark):
    values = ["+33612345678", "", "été", None]
    rows = spark.createDataFrame([(v,) for v in values], "a string")
    for secret in ("s", "k" * 64, "k" * 65):
        want = [None if v is None else hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest()[:10] for v in values]
        assert [r["k"] for r in rows.select(tf.keyed_id(secret)("a").alias("k")).collect()] == want
    assert [r["m"] for r in rows.select(tf.mask_tail(F.col("a")).alias("m")).collect()] == ["***5678", "?", "***été", "?"]


def test_clocks_ahead_are_refused_too(spark):
    rows = spark.createDataFrame([("old", -3601), ("edge", -3600), ("now", 0), ("ahead", 3600), ("far", 3601)], "k string, d long")
    rows = rows.select("k", F.timestamp_seconds(F.lit(NOW) + F.col("d")).alias("ts"), F.timestamp_seconds(F.lit(NOW)).alias("received_at"))
    assert {r["k"] for r in events.fresh(rows).collect()} == {"edge", "now", "ahead"}
