"""Enumerations, job requests and results."""

from __future__ import annotations

import dataclasses
import enum

from pyspark.sql import DataFrame, SparkSession


class CompressionMode(enum.IntEnum):
    NONE = 0
    ZSTD_FAST = 1
    ZSTD = 2
    ZSTD_BEST = 3


class Operation(enum.IntEnum):
    ENCRYPT = 0
    DECRYPT = 1
    UPDATE = 2


class Cipher(enum.IntEnum):
    AES = 0
    TWOFISH = 1
    SERPENT = 2
    CHACHA20 = 3
    CAMELLIA = 4


class KeyDerivation(enum.IntEnum):
    ARGON2ID = 0
    PBKDF2 = 1
    SCRYPT = 2


class NameMode(enum.IntEnum):
    NONE = 0
    GUID = 1
    SHA256 = 2
    SHA512 = 3


class Strength(enum.IntEnum):
    VERY_WEAK = 0
    WEAK = 1
    FAIR = 2
    GOOD = 3
    STRONG = 4


class PasswordOptions(enum.IntFlag):
    NONE = 0
    UPPERCASE = 1
    LOWERCASE = 2
    NUMBERS = 4
    SPECIAL = 8
    EXCLUDE_SIMILAR = 16


#: Fixed values of the on-disk formats.
EXTENSION, MANIFEST_NAME, MAGIC = ".bzc", "manifest.bzc", b"BZC"
SALT_SIZE, NONCE_SIZE, TAG_SIZE, KEY_SIZE, HEADER_SIZE = 32, 12, 16, 32, 45
ZSTD_LEVELS = {CompressionMode.ZSTD_FAST: 1, CompressionMode.ZSTD: 3, CompressionMode.ZSTD_BEST: 19}

#: The dimension tables: (family, enumeration, name shown).
FAMILIES = {"cipher": Cipher, "compression": CompressionMode, "key_derivation": KeyDerivation, "name_mode": NameMode}


@dataclasses.dataclass(frozen=True)
class Request:
    """One job. Copies with changes: ``dataclasses.replace``."""

    source: str
    destination: str
    password: str = ""
    confirm_password: str = ""
    cipher: Cipher = Cipher.AES
    key_derivation: KeyDerivation = KeyDerivation.PBKDF2
    operation: Operation = Operation.ENCRYPT
    name_mode: NameMode = NameMode.NONE
    compression: CompressionMode = CompressionMode.NONE
    proceed_on_warnings: bool = False
    use_encryption: bool = True


@dataclasses.dataclass(frozen=True)
class Result:
    """A job's outcome, with what follows from it."""

    success: bool
    elapsed: float = 0.0
    total_bytes: int = 0
    processed: int = 0
    total: int = 0
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    skipped: int = 0
    #: A table (path, error) of all failures, of which ``errors`` shows the first; none where no file was tried.
    failures: DataFrame | None = dataclasses.field(default=None, compare=False, repr=False)

    def __post_init__(self):
        for name in ("elapsed", "total_bytes", "processed", "total"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        if self.processed > self.total:
            raise ValueError("more files processed than there are")

    @property
    def failed(self) -> int:
        return self.total - self.processed

    @property
    def success_rate(self) -> float:
        return self.processed / self.total if self.total else 0.0

    @property
    def partial(self) -> bool:
        return 0 < self.processed < self.total

    @property
    def bytes_per_second(self) -> float:
        return self.total_bytes / self.elapsed if self.elapsed > 0 else 0.0

    @property
    def files_per_second(self) -> float:
        return self.processed / self.elapsed if self.elapsed > 0 else 0.0


def catalog(spark: SparkSession) -> DataFrame:
    """All algorithms: family, id, name."""
    rows = [(family, int(x), x.name.lower()) for family, kind in FAMILIES.items() for x in kind]
    return spark.createDataFrame(rows, "family string, id int, name string").orderBy("family", "id")
