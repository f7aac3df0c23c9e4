"""Whether a credential opens a plot or a list, decided in columns.

Credentials are selective-disclosure tokens: three base64url parts joined by
dots, then disclosures behind tildes.  ``with_signatures`` checks the
signatures (Ed25519); ``signed`` says whether one holds, and a credential
without it is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ed25519
from ..functions.lineage import spread

#: Fixed value: seconds that clocks may differ by.
SKEW = 300
#: Signatures that a task makes or checks; each takes up to a millisecond.
SIGNATURES = 4_000
CLAIMS = "exp long, iat long, vct string, sub string, scope string, scopes array<string>, jti string, _sd array<string>, status_list string, status_index long"


def from_base64url(text: Column) -> Column:
    """The bytes; null if it is no base64url."""
    standard = F.translate(F.regexp_replace(text, r"\s", ""), "-_", "+/")
    return F.try_to_binary(F.rpad(standard, F.ceil(F.length(standard) / 4).cast("int") * 4, "="), F.lit("base64"))


def to_base64url(binary: Column) -> Column:
    return F.translate(F.rtrim(F.regexp_replace(F.base64(binary), r"\s", ""), F.lit("=")), "+/", "-_")


def claims_of(token: Column) -> Column:
    return F.from_json(from_base64url(F.get(F.split(token, r"\."), F.lit(1))).cast("string"), CLAIMS)


def disclosures_of(credential: Column) -> Column:
    return F.filter(F.slice(F.split(credential, "~"), 2, 1_000_000), lambda x: x != "")


def disclosed_fields(disclosures: Column) -> Column:
    """Values of the disclosures ``[salt, name, value]`` whose name begins with ``fields.``."""
    read = F.transform(disclosures, lambda x: F.from_json(from_base64url(x).cast("string"), "array<string>"))
    return F.transform(F.filter(read, lambda x: F.get(x, F.lit(1)).startswith("fields.")), lambda x: F.get(x, F.lit(2)))


#: Bytes that a status list may unpack to; the lists come from outside.
UNPACKED = 16 * 1024 * 1024


@F.pandas_udf(T.BinaryType())
def inflate(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """zlib streams unpacked; null where one can't be, or would be larger than ``UNPACKED`` bytes."""

    def one(x):
        if x is None:
            return None
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(x, UNPACKED)
        except zlib.error:
            return None
        return out if stream.eof else None

    for part in packed:
        yield part.map(one)


def status_lists(lists: DataFrame) -> DataFrame:
    """``list_id, bits`` from ``lists(list_id, body)``: JSON with ``encoded``, a token with ``lst`` inside, or the bare text."""
    plain = F.get_json_object("body", "$.encoded")
    token = F.get_json_object(F.when(F.size(F.split("body", r"\.")) == 3, from_base64url(F.get(F.split("body", r"\."), F.lit(1))).cast("string")), "$.vc.credentialSubject.status_list.lst")
    return lists.select("list_id", inflate(from_base64url(F.coalesce(plain, token, F.col("body")))).alias("bits"))


def bit_of(bits: Column, index: Column) -> Column:
    """The bit at an index, lowest of each byte first; null beyond the end."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(index / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.when((index >= 0) & (index < F.length(bits) * 8), F.call_function("shiftright", byte, (index % 8).cast("int")).bitwiseAND(F.lit(1)))


@F.pandas_udf(T.BooleanType())
def verified(public: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether each signature is its key's; keys are decoded once a worker."""
    return pd.Series([ed25519.verify(*row) for row in zip(public, message, signature)], dtype=bool)


def with_signatures(credentials: DataFrame, keys: DataFrame, algorithm: str = "EdDSA") -> DataFrame:
    """``credentials`` with ``signed``: whether the token in ``credential`` is signed by the key that its header names.

    ``keys(kid, public)`` has raw public keys of 32 bytes; a key is found by
    ``kid``.  The header has to name the algorithm, so that none is chosen by
    the sender.  Unknown keys, broken tokens and nulls aren't signed.  Of a key
    that is listed twice with different bytes none is trusted.  Credentials are
    dealt evenly over tasks, however few files or keys they come from.
    """
    token = F.split(F.get(F.split("credential", "~"), F.lit(0)), r"\.")
    header = F.from_json(from_base64url(F.get(token, F.lit(0))).cast("string"), "alg string, kid string")
    once = keys.groupBy(F.col("kid").alias("_kid")).agg(F.min("public").alias("_public"), F.countDistinct("public").alias("_n")).filter("_n = 1").select("_kid", "_public")
    rows = credentials.drop("signed").withColumn("_token", token).withColumn("_header", header)
    rows = rows.join(once, F.col("_header.kid") == F.col("_kid"), "left")
    rows = spread(rows, SIGNATURES, credentials)
    whole = (F.size("_token") == 3) & (F.col("_header.alg") == algorithm) & F.col("_public").isNotNull()
    message = F.concat_ws(".", F.get("_token", F.lit(0)), F.get("_token", F.lit(1))).cast("binary")
    holds = verified(F.col("_public"), message, from_base64url(F.get("_token", F.lit(2))))
    return rows.withColumn("signed", F.coalesce(F.when(whole, holds), F.lit(False))).drop("_token", "_header", "_kid", "_public")


def check_grants(credentials: DataFrame, lists: DataFrame, vct: str, now: int) -> DataFrame:
    """``id, decision`` of ``credentials(id, credential, signed, geo_id, list_id)``: ``ok`` or the first check that fails.

    Signature, expiry (needed), issue time within the skew, kind, digests of
    the disclosures, list subject, disclosed plot, status bit.  A missing
    status list refuses; a credential that names none isn't revocable.
    """
    parts = F.split("credential", "~")
    rows = credentials.withColumn("c", claims_of(F.get(parts, F.lit(0)))).withColumn("d", disclosures_of(F.col("credential")))
    rows = rows.join(lists.select(F.col("list_id").alias("_l"), "bits"), F.col("c.status_list") == F.col("_l"), "left")
    digests = F.transform("d", lambda x: to_base64url(F.unhex(F.sha2(x, 256))))
    stray = F.size(F.array_except(digests, F.coalesce("c._sd", F.array().cast("array<string>")))) > 0
    bit = bit_of(F.col("bits"), F.col("c.status_index"))
    no = F.lit(False)
    decision = (
        F.when(~F.coalesce("signed", no), "bad_signature")
        .when(F.col("c.exp").isNull(), "no_expiry")
        .when(F.lit(now) > F.col("c.exp"), "expired")
        .when(F.coalesce(F.col("c.iat") > now + SKEW, no), "issued_in_future")
        .when(F.coalesce(F.col("c.vct"), F.lit("")) != vct, "wrong_kind")
        .when(stray, "unknown_disclosure")
        .when(F.col("list_id").isNotNull() & ~F.coalesce(F.col("c.sub") == F.col("list_id"), no), "other_list")
        .when(F.col("geo_id").isNotNull() & ~F.coalesce(F.array_contains(disclosed_fields(F.col("d")), F.col("geo_id")), no), "not_disclosed")
        .when(F.col("c.status_list").isNotNull() & bit.isNull(), "status_unreadable")
        .when(F.col("c.status_list").isNotNull() & (bit == 1), "revoked")
        .otherwise("ok")
    )
    return rows.select("id", decision.alias("decision"))


def check_authorities(credentials: DataFrame, vct: str, now: int) -> DataFrame:
    """``id, decision`` of ``credentials(id, credential, signed, scope)``; a scope not asked for isn't checked, ``global`` covers all."""
    rows = credentials.withColumn("c", claims_of(F.get(F.split("credential", "~"), F.lit(0))))
    scopes = F.coalesce(F.col("c.scopes"), F.when(F.col("c.scope").isNotNull(), F.array("c.scope")), F.array().cast("array<string>"))
    decision = (
        F.when(~F.coalesce("signed", F.lit(False)), "bad_signature").when(F.col("c.exp").isNull(), "no_expiry").when(F.lit(now) > F.col("c.exp"), "expired")
        .when(F.coalesce(F.col("c.vct"), F.lit("")) != vct, "wrong_kind").when(F.size(scopes) == 0, "no_scope")
        .when(F.col("scope").isNotNull() & ~F.coalesce(F.array_contains(scopes, F.col("scope")), F.lit(False)) & ~F.array_contains(scopes, "global"), "out_of_scope")
        .otherwise("ok")
    )
    return rows.select("id", decision.alias("decision"))


def gate_forward(requests: DataFrame) -> DataFrame:
    """``id, status, tier`` of trace-forward ``requests(id, capability, authority, grant, scope)``.

    ``authority`` and ``grant`` are decisions or null.  403 without capability
    and grant, 400 for an authority without a scope, 401 for a refused
    authority, 403 for a refused grant; tier 3 with an authority, else 1.
    """
    has = F.col("authority").isNotNull()
    status = F.when(~F.coalesce("capability", F.lit(False)) & F.col("grant").isNull() & ~has, 403).when(has & F.col("scope").isNull(), 400).when(has & (F.col("authority") != "ok"), 401).when(~has & F.col("grant").isNotNull() & (F.col("grant") != "ok"), 403).otherwise(200)
    return requests.select("id", status.alias("status"), F.when(status == 200, F.when(has, 3).otherwise(1)).alias("tier"))


def authorise(requests: DataFrame, issuer: bool = True, authority: bool = True) -> DataFrame:
    """``id, status, used_authority`` of read ``requests(id, internal, authority, grant, conceal)``.

    ``authority`` and ``grant`` are decisions (see ``check_authorities``,
    ``check_grants``) or null; ``internal`` requests proved the shared secret
    and pass.  Without an ``issuer`` key all others are refused (401), and
    without an ``authority`` key those that show an authority.  An authority
    decides first; one that fails is an error (401) only where existence isn't
    concealed, else the grant may still open.  What nothing opens is 404 where
    existence is concealed, 403 elsewhere.  Null flags count as false but
    ``conceal``, which counts as true.
    """
    conceal = F.coalesce("conceal", F.lit(True))
    shown, granted = F.col("authority").isNotNull(), F.coalesce(F.col("grant") == "ok", F.lit(False))
    by_authority = F.coalesce(F.col("authority") == "ok", F.lit(False)) & F.lit(authority)
    status = (
        F.when(F.coalesce("internal", F.lit(False)), 200).when(~F.lit(issuer) | (shown & ~F.lit(authority)), 401).when(by_authority, 200)
        .when(shown & ~conceal, 401).when(granted, 200).when(conceal, 404).otherwise(403)
    )
    return requests.select("id", status.alias("status"), ((status == 200) & by_authority & ~F.coalesce("internal", F.lit(False))).alias("used_authority"))


def with_failures(matches: DataFrame, failed: DataFrame) -> DataFrame:
    """``matches(request, tier, holder, ...)`` with ``status``: 502 for a tier 3 request whose look-up of holders ``failed(request)``; none of its rows shows a holder."""
    rows = matches.join(failed.select("request").distinct().withColumn("_f", F.lit(True)), "request", "left")
    status = F.when((F.col("tier") == 3) & F.coalesce("_f", F.lit(False)), 502).otherwise(200)
    return rows.withColumn("status", status).withColumn("holder", F.when(F.col("status") == 200, F.col("holder"))).select(*matches.columns, "status")


def with_holders(matches: DataFrame, holders: DataFrame) -> DataFrame:
    """Matches with ``holder, holder_status`` in tier 3; in tier 1 both are null for every row."""
    joined = matches.join(holders.select("list_id", F.col("account").alias("_h")), "list_id", "left")
    open_ = F.col("tier") == 3
    return joined.select(*matches.columns, F.when(open_, F.col("_h")).alias("holder"), F.when(open_, F.when(F.col("_h").isNull(), "unresolved").otherwise("resolved")).alias("holder_status"))
