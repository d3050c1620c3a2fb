"""Columns over files: paths, hashes, names, sizes and headers of the on-disk formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coffer.model import EXTENSION, MAGIC, NONCE_SIZE, SALT_SIZE, CompressionMode, NameMode


def relative_path(path: Column, root: str) -> Column:
    """Path under a root; a scheme, as a binary file scan puts it, goes first."""
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """With its dot; empty if there is none."""
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def content_hash(content: Column) -> Column:
    """Base64 of SHA-256."""
    return F.base64(F.unhex(F.sha2(content, 256)))


def destination(path: Column, encrypted: Column | bool, compression: Column | int) -> Column:
    """Where a file goes when names stay: the extension marks what isn't a plain copy."""
    marked = F.lit(encrypted) | (F.lit(compression) != 0)
    return F.when(marked, F.concat(path, F.lit(EXTENSION))).otherwise(path)


def hashed_name(what: Column, name: Column, bits: int) -> Column:
    """Hex digest and the name's extension."""
    return F.concat(F.sha2(what, bits), extension(name))


def obfuscated(path: Column, content: Column, root: str, mode: NameMode) -> Column:
    """The path with each segment's name hidden: folders by the hash of where they are, the file by that of its content."""
    if mode == NameMode.NONE:
        return destination(path, True, 0)
    segments = F.split(path, "/")
    if mode == NameMode.GUID:
        raise ValueError("random names need a table of folders: see operators.catalog.random_names")
    bits = 256 if mode == NameMode.SHA256 else 512
    folders = F.transform(
        F.slice(segments, F.lit(1), F.size(segments) - 1),
        lambda s, i: hashed_name(F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/")), s, bits),
    )
    leaf = F.concat(F.sha2(content, bits), F.lit(EXTENSION))
    return F.array_join(F.concat(folders, F.array(leaf)), "/")


def size_text(n: Column) -> Column:
    """Bytes for people: one decimal, half up, in steps of 1024; the sign is dropped."""
    units = ("B", "KB", "MB", "GB", "TB")
    size = F.abs(n.cast("double"))
    out = F.lit(None).cast("string")
    for k in range(len(units) - 1, -1, -1):
        tenths = F.floor(size / float(1024**k) * 10 + 0.5)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {units[k]}"))
        due = size >= float(1024**k) if k else F.lit(True)
        out = F.when(due, text) if k == len(units) - 1 else out.when(due, text)
    return F.when(n == 0, "0 B").otherwise(out)


def header(content: Column) -> Column:
    """Salt, nonce and compression of a self-describing payload; null if it's too short."""
    size = SALT_SIZE + NONCE_SIZE + 1
    fields = F.struct(
        F.substring(content, 1, SALT_SIZE).alias("salt"),
        F.substring(content, SALT_SIZE + 1, NONCE_SIZE).alias("nonce"),
        F.conv(F.hex(F.substring(content, size, 1)), 16, 10).cast("int").alias("compression"),
    )
    return F.when(F.length(content) >= size, fields)


def associated_data(salt: Column, nonce: Column, mode: Column) -> Column:
    return F.concat(salt, nonce, F.unhex(F.lpad(F.hex(mode), 2, "0")))


def magic(content: Column) -> Column:
    """Compression mode of a compressed, unencrypted file; null if it isn't one."""
    known = (F.length(content) >= len(MAGIC) + 1) & (F.substring(content, 1, len(MAGIC)) == F.lit(bytearray(MAGIC)))
    mode = F.conv(F.hex(F.substring(content, len(MAGIC) + 1, 1)), 16, 10).cast("int")
    return F.when(known & mode.isin([int(m) for m in CompressionMode]), mode)
