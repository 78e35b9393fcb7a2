"""Compression and authenticated encryption of payloads.

Compression is zstd in Arrow batches, as Spark has no such scalar; encryption is Spark's own AES-GCM. An envelope is
MAGIC, a 16-byte salt, and Spark's 12-byte nonce, ciphertext and tag; its key is scrypt(password, salt). A repository seals
with one random data key instead (salt: zeros), which is stored wrapped: in an envelope of the password."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MAGIC = b"SNS1"
SALT = 16
#: Magic, salt, nonce and tag: no envelope is shorter.
LEAST = 4 + SALT + 12 + 16


def compress(level: int = 3):
    @F.pandas_udf(BinaryType())
    def run(x: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        return x.map(lambda b: None if b is None else c.compress(bytes(b)))

    return run


@F.pandas_udf(BinaryType())
def decompress(x: pd.Series) -> pd.Series:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return x.map(lambda b: None if b is None else d.decompress(bytes(b)) if len(b) else b"")


def is_encrypted(payload: Column) -> Column:
    return (F.octet_length(payload) >= 4) & (F.substring(payload, 1, 4) == F.lit(MAGIC))


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


def new_salt() -> bytes:
    return os.urandom(SALT)


def encrypt(payload: Column, password: str, salt: bytes) -> Column:
    return F.concat(F.lit(MAGIC), F.lit(salt), F.aes_encrypt(payload, F.lit(derive_key(password, salt)), F.lit("GCM")))


def seal(payload: Column, key: bytes) -> Column:
    """An envelope of a data key."""
    return F.concat(F.lit(MAGIC), F.lit(bytes(SALT)), F.aes_encrypt(payload, F.lit(key), F.lit("GCM")))


def unseal(payload: Column, key: bytes | None) -> Column:
    """Back from seal; plain payloads pass. An error where the key is missing or wrong or the payload damaged."""
    wrong = F.raise_error(F.lit("the data is encrypted: a password is needed" if key is None else "wrong password or damaged data")).cast("binary")
    opened = wrong if key is None else F.coalesce(F.try_aes_decrypt(F.substring(payload, 5 + SALT, 2**31 - 1), F.lit(key), F.lit("GCM")), wrong)
    return F.when(is_encrypted(payload), opened).otherwise(payload)


def wrap_key(spark: SparkSession, key: bytes, password: str, salt: bytes) -> bytes:
    return bytes(spark.range(1).select(encrypt(F.lit(key), password, salt).alias("w")).first().w)


def unwrap_key(spark: SparkSession, wrapped: bytes, password: str, salt: bytes) -> bytes | None:
    """None where the password is wrong."""
    key = spark.range(1).select(decrypt(F.lit(wrapped), password, [salt]).alias("k")).first().k
    return None if key is None else bytes(key)


def salt_of(payload: Column) -> Column:
    return F.substring(payload, 5, SALT)


def decrypt(payload: Column, password: str, salts: list[bytes]) -> Column:
    """Null where the password is wrong, the payload is damaged, or its salt is not among ``salts``."""
    body = F.substring(payload, 5 + SALT, 2**31 - 1)
    out = F.lit(None).cast("binary")
    for salt in salts:
        out = F.when(salt_of(payload) == F.lit(salt), F.try_aes_decrypt(body, F.lit(derive_key(password, salt)), F.lit("GCM"))).otherwise(out)
    return F.when(F.octet_length(payload) >= LEAST, out)


def maybe_decrypt(payload: Column, password: str | None, salts: list[bytes]) -> Column:
    """Plain payloads pass; encrypted ones need the password, an error otherwise."""
    wrong = F.raise_error(F.lit("the data is encrypted: a password is needed" if password is None else "wrong password or damaged data")).cast("binary")
    opened = wrong if password is None else F.coalesce(decrypt(payload, password, salts), wrong)
    return F.when(is_encrypted(payload), opened).otherwise(payload)
