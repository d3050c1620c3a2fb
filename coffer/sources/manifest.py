"""Manifests of backups: one JSON document, plain or sealed.

Plain: UTF-8 JSON. Sealed: cipher (1 byte), key derivation (1), then salt (32), nonce (12), compression (1, always 0), ciphertext and tag.
The format is a single document, so reading and writing one is the driver's; its entries become a table at once."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions import chacha, gcm, keys
from coffer.model import HEADER_SIZE, MANIFEST_NAME, NONCE_SIZE, SALT_SIZE, Cipher, CompressionMode, KeyDerivation, NameMode

SCHEMA = "relative_path string, original_path string, salt binary, nonce binary, source_hash string, position long"
#: Names in the document, by column.
NAMES = {"relative_path": "RelativePath", "original_path": "OriginalRelativePath", "salt": "Salt", "nonce": "Nonce", "source_hash": "SourceHash"}
HEADER = {"cipher": ("EncryptionAlgorithm", Cipher), "key_derivation": ("KeyDerivationAlgorithm", KeyDerivation), "name_mode": ("NameObfuscation", NameMode), "compression": ("Compression", CompressionMode)}
_DERIVED = {KeyDerivation.ARGON2ID: "argon2id", KeyDerivation.PBKDF2: "pbkdf2", KeyDerivation.SCRYPT: "scrypt"}


class WrongPassword(ValueError):
    """The tag of a sealed manifest doesn't fit."""


def kind_of(root: str) -> str:
    """``none``, ``plain`` or ``sealed``, by the first byte."""
    path = Path(root, MANIFEST_NAME)
    if not path.is_file():
        return "none"
    with path.open("rb") as f:
        return "plain" if f.read(1) == b"{" else "sealed"


def derivation(kind: KeyDerivation) -> str:
    return _DERIVED[kind]


def _one(spark: SparkSession, raw: bytes, column) -> bytes | None:
    value = spark.createDataFrame([(bytearray(raw),)], "content binary").select(column.alias("out")).first()["out"]
    return None if value is None else bytes(value)


def seal(spark: SparkSession, raw: bytes, password: str, kind: KeyDerivation, cipher: Cipher = Cipher.AES) -> bytes:
    head = os.urandom(SALT_SIZE + NONCE_SIZE) + b"\0"
    key = keys.derive_key(derivation(kind), password, head[:SALT_SIZE])
    if cipher == Cipher.CHACHA20:
        return head + chacha.seal_bytes(raw, key, head[SALT_SIZE:-1], head)
    if cipher != Cipher.AES:
        return head + gcm.seal_bytes(cipher.name.lower(), raw, key, head[SALT_SIZE:-1], head)
    column = keys.aes_seal(F.col("content"), F.lit(bytearray(key)), F.lit(bytearray(head[SALT_SIZE:-1])), F.lit(bytearray(head)))
    return head + _one(spark, raw, column)


def unseal(spark: SparkSession, raw: bytes, password: str, kind: KeyDerivation, cipher: Cipher = Cipher.AES) -> bytes:
    if len(raw) < HEADER_SIZE:
        raise ValueError("the payload is too short")
    head, body = raw[:HEADER_SIZE], raw[HEADER_SIZE:]
    key = keys.derive_key(derivation(kind), password, head[:SALT_SIZE])
    if cipher == Cipher.CHACHA20:
        out = chacha.open_bytes(body, key, head[SALT_SIZE:-1], head)
    elif cipher != Cipher.AES:
        out = gcm.open_bytes(cipher.name.lower(), body, key, head[SALT_SIZE:-1], head)
    else:
        out = _one(spark, body, keys.aes_open(F.col("content"), F.lit(bytearray(key)), F.lit(bytearray(head[SALT_SIZE:-1])), F.lit(bytearray(head))))
    if out is None:
        raise WrongPassword("wrong password, or the data was changed")
    return out


def read(spark: SparkSession, root: str, password: str = "") -> tuple[dict, DataFrame] | None:
    """Header and entries; null if there's no manifest or it can't be parsed. A wrong password is an error of its own."""
    path = Path(root, MANIFEST_NAME)
    if not path.is_file():
        return None
    raw = path.read_bytes()
    if raw[:1] != b"{":
        if len(raw) < 2 or raw[0] not in list(Cipher) or raw[1] not in list(KeyDerivation):
            return None
        raw = unseal(spark, raw[2:], password, KeyDerivation(raw[1]), Cipher(raw[0]))
    try:
        document = json.loads(raw)
        header = {k: kind(document[name]) for k, (name, kind) in HEADER.items()}
        entries = [(*(e.get(n) or "" for n in NAMES.values()), i) for i, e in enumerate(document.get("Entries") or [])]
    except (ValueError, KeyError, AttributeError, TypeError):
        return None
    df = spark.createDataFrame(entries, SCHEMA.replace("binary", "string"))
    return header, df.withColumns({c: F.unbase64(c) for c in ("salt", "nonce")})


def write(spark: SparkSession, root: str, header: dict, entries: DataFrame, password: str | None = None) -> bool:
    """Writes the manifest, sealed if there's a password. Without entries nothing is written, and an old one stays."""
    columns = [F.base64(c).alias(c) if c in ("salt", "nonce") else F.col(c) for c in NAMES]
    rows = entries.select(*columns).orderBy("relative_path").toLocalIterator()
    found = [{NAMES[c]: r[c] or "" for c in NAMES} for r in rows]
    if not found:
        return False
    document = {name: int(header[k]) for k, (name, _) in HEADER.items()} | {"Entries": found}
    raw = json.dumps(document, ensure_ascii=False).encode()
    if password:
        raw = bytes([header["cipher"], header["key_derivation"]]) + seal(spark, raw, password, header["key_derivation"], header["cipher"])
    target = Path(root, MANIFEST_NAME)
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_suffix(".part")
    temporary.write_bytes(raw)
    temporary.replace(target)
    return True
