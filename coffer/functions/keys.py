"""AES-GCM by built-in functions, and key derivation: by hashlib, and Argon2id (see ``argon2``)."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from coffer.functions import argon2
from coffer.model import KEY_SIZE, NONCE_SIZE

# Fixed costs of the derivations.
PBKDF2_ROUNDS, SCRYPT_N, SCRYPT_R, SCRYPT_P = 800_000, 262_144, 8, 1
ARGON2_KIB, ARGON2_PASSES, ARGON2_LANES = 262_144, 4, 2


def aes_seal(content: Column, key: Column, nonce: Column, data: Column) -> Column:
    """Ciphertext and tag; Spark puts the nonce before them, which is stored elsewhere here."""
    sealed = F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, data)
    return F.substring(sealed, F.lit(NONCE_SIZE + 1), F.length(sealed))


def aes_open(sealed: Column, key: Column, nonce: Column, data: Column) -> Column:
    """The content; null if key, nonce, data or tag don't fit."""
    return F.try_aes_decrypt(F.concat(nonce, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), data)


def derive_key(kind: str, password: str, salt: bytes, size: int = KEY_SIZE) -> bytes:
    if kind == "pbkdf2":
        return hashlib.pbkdf2_hmac("sha1", password.encode(), salt, PBKDF2_ROUNDS, size)
    if kind == "scrypt":
        return hashlib.scrypt(password.encode(), salt=salt, n=SCRYPT_N, r=SCRYPT_R, p=SCRYPT_P, maxmem=512 << 20, dklen=size)
    if kind == "argon2id":
        return argon2.derive(password.encode(), salt, size, ARGON2_KIB, ARGON2_PASSES, ARGON2_LANES)
    raise ValueError(f"no such key derivation: {kind}")


def derive(kind: Column, password: Column, salt: Column) -> Column:
    """One derivation per row: its cost is meant to be high, so spread rows over many tasks."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, passwords, salts in batches:
            yield pd.Series([derive_key(k, p, s) for k, p, s in zip(kinds, passwords, salts, strict=True)])

    return run(kind, password, salt)


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder; the cluster's own setting wins."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="coffer-checkpoint-"))
