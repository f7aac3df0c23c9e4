import json

import pytest

from plotgraph.functions import ed25519
from plotgraph.operators import credentials

#: Test vectors 1 to 3 of RFC 8032, section 7.1: seed, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("vector", VECTORS)
def test_vectors(vector):
    seed, public, message, signature = map(bytes.fromhex, vector)
    assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature
    assert ed25519.verify(public, message, signature)
    for bit in (0, 100, 255, 256, 400, 511):
        broken = bytearray(signature)
        broken[bit // 8] ^= 1 << bit % 8
        assert not ed25519.verify(public, message, bytes(broken))
    assert not ed25519.verify(public, message + b"x", signature)
    # The same number plus the order isn't taken for it.
    high = (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little")
    assert not ed25519.verify(public, message, signature[:32] + high)
    assert not ed25519.verify(b"\xff" * 32, message, signature) and not ed25519.verify(public, message, signature[:63]) and not ed25519.verify(None, message, signature)


def test_tokens(spark):
    import base64

    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    seed = bytes(32)

    def token(alg="EdDSA", kid="a", seed=seed):
        message = f"{part(json.dumps({'alg': alg, 'kid': kid}).encode())}.{part(b'{}')}"
        return f"{message}.{part(ed25519.sign(seed, message.encode()))}"

    good = token()
    texts = {"good": good + "~", "disclosed": good + "~ZGlzYw~", "other key": token(seed=b"x" * 32), "unknown": token(kid="z"), "twice": token(kid="b"), "none": token(alg="none"), "two parts": good.rsplit(".", 1)[0], "no text": None, "empty": "", "cut": good[:-6]}
    rows = spark.createDataFrame([(n, t, True) for n, t in texts.items()], "id string, credential string, signed boolean")
    keys = spark.createDataFrame([("a", ed25519.public_key(seed)), ("b", ed25519.public_key(seed)), ("b", b"y" * 32)], "kid string, public binary")
    got = {r["id"] for r in credentials.with_signatures(rows, keys).collect() if r["signed"]}
    assert got == {"good", "disclosed"}
    assert credentials.with_signatures(rows.limit(0), keys).count() == 0


def test_even_tasks(spark):
    """Credentials of one key and one task's input are checked in several tasks."""
    from pyspark.sql import functions as F

    rows = spark.range(3 * credentials.SIGNATURES, numPartitions=1).select("id", F.lit("a.b.c").alias("credential"))
    keys = spark.createDataFrame([("a", ed25519.public_key(bytes(32)))], "kid string, public binary")
    parts = credentials.with_signatures(rows, keys).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 3 and sum(r["count"] for r in parts) == 3 * credentials.SIGNATURES
