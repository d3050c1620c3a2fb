"""Round trips of whole trees."""

import dataclasses
import random

import pytest

from coffer.functions import argon2, chacha, codec, gcm, keys
from coffer.model import Cipher, CompressionMode, KeyDerivation, NameMode, Operation, Request
from coffer.plans import jobs
from coffer.sources import manifest, trees

WORD = "anyPassword!123"


def put(root, tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)


def got(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def request(a, b, **more):
    return Request(str(a), str(b), WORD, WORD, proceed_on_warnings=True, **more)


@pytest.mark.parametrize("encrypted, mode, names", [(True, CompressionMode.ZSTD, NameMode.SHA256), (True, CompressionMode.NONE, NameMode.GUID), (False, CompressionMode.ZSTD_FAST, NameMode.NONE), (False, CompressionMode.NONE, NameMode.NONE)])
def test_round_trip(spark, tmp_path, encrypted, mode, names):
    tree = {"a.txt": b"File one content! " * 50, "sub/secret.txt": b"Secret content", "empty.bin": b""}
    put(tmp_path / "src", tree)
    made = jobs.run(spark, request(tmp_path / "src", tmp_path / "out", use_encryption=encrypted, compression=mode, name_mode=names))
    assert made.success and made.processed == 3, made
    if names != NameMode.NONE:
        assert not any("secret" in n for n in got(tmp_path / "out"))
    back = jobs.run(spark, request(tmp_path / "out", tmp_path / "back", operation=Operation.DECRYPT, use_encryption=encrypted))
    assert back.success and got(tmp_path / "back") == tree, back


def test_update(spark, tmp_path):
    src, out, back = tmp_path / "src", tmp_path / "out", tmp_path / "back"
    put(src, {"1.txt": b"one", "2.txt": b"two", "3.txt": b"three"})
    r = request(src, out, use_encryption=False, compression=CompressionMode.ZSTD)
    assert jobs.run(spark, r).success
    up = dataclasses.replace(r, operation=Operation.UPDATE)
    same = jobs.run(spark, up)
    assert same.success and same.total == 0
    put(src, {"1.txt": b"changed", "4.txt": b"four"})
    (src / "2.txt").unlink()
    done = jobs.run(spark, up)
    assert done.success and done.processed == 2 and "2.txt.bzc" not in got(out)
    assert jobs.run(spark, request(out, back, operation=Operation.DECRYPT, use_encryption=False)).processed == 3
    assert got(back) == {"1.txt": b"changed", "3.txt": b"three", "4.txt": b"four"}


def test_wrong_password_and_missing_manifest(spark, tmp_path):
    put(tmp_path / "src", {"x": b"secret data"})
    assert jobs.run(spark, request(tmp_path / "src", tmp_path / "out")).success
    assert manifest.kind_of(str(tmp_path / "out")) == "sealed"
    wrong = dataclasses.replace(request(tmp_path / "out", tmp_path / "b", operation=Operation.DECRYPT), password="otherPassword!1")
    assert "wrong password" in jobs.run(spark, wrong).errors[0]
    put(tmp_path / "none", {"file.bzc": b"fake"})
    assert jobs.run(spark, request(tmp_path / "none", tmp_path / "b", operation=Operation.DECRYPT)).errors == ("a manifest is required",)


def test_requests_are_checked(spark, tmp_path):
    put(tmp_path / "src", {"x": b"1"})
    assert jobs.errors_of(spark, Request(str(tmp_path / "src"), str(tmp_path / "src" / "in"), "short", "other")) == ["destination is inside the source", "too_short", "confirm_differs"]
    assert jobs.errors_of(spark, Request("", "", use_encryption=False)) == ["source path is required", "destination path is required"]
    assert "weak password" in jobs.warnings_of(spark, Request(str(tmp_path / "src"), str(tmp_path / "o"), "password123", "password123"))


def test_plain_copy(spark, tmp_path):
    put(tmp_path / "src", {"a/b": b"1", "c": b"2"})
    assert jobs.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "out")).processed == 2
    header, entries = manifest.read(spark, str(tmp_path / "out"))
    assert header["compression"] == CompressionMode.NONE and {r["source_hash"] for r in entries.collect()} == {""}
    assert trees.exists(str(tmp_path / "out")) and trees.free_space(str(tmp_path / "no" / "where")) > 0


def test_all_failures_are_counted_and_named(spark, tmp_path):
    put(tmp_path / "src", {"ok": b"1", **{f"d/{i}": b"x" for i in range(1100)}})
    for i in range(1100):  # folders where files should be
        (tmp_path / "out" / "d" / str(i)).mkdir(parents=True)
    made = jobs.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    assert (made.success, made.processed, made.total, made.failed) == (False, 1, 1101, 1100)
    assert len(made.errors) == jobs.SHOWN + 1 and made.errors[-1].startswith("1100 errors in all")
    assert {r["path"] for r in made.failures.collect()} == {f"d/{i}" for i in range(1100)}


def test_every_losing_file_is_named(spark, tmp_path):
    put(tmp_path / "src", {**{f"a{i}": b"%d" % i for i in range(150)}, **{f"A{i}": b"%d" % i for i in range(150)}})
    made = jobs.run(spark, request(tmp_path / "src", tmp_path / "out", use_encryption=False, compression=CompressionMode.NONE))
    assert (made.success, made.processed, made.total, made.failed) == (False, 150, 300, 150)
    assert {r["path"] for r in made.failures.collect()} == {f"a{i}" for i in range(150)} and made.errors[-1].startswith("150 errors in all")


def test_codec():
    for mode in list(CompressionMode)[1:]:
        raw = b"AAAAABBBBBCCCCC" * 200
        assert len(codec.compress_bytes(raw, mode)) < len(raw) and codec.decompress_bytes(codec.compress_bytes(raw, mode)) == raw
        assert codec.decompress_bytes(codec.compress_bytes(b"", mode)) == b""


def test_chacha_vector():
    """RFC 8439, 2.8.2."""
    key, nonce, data = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = chacha.seal_bytes(text, key, nonce, data)
    assert sealed[:16].hex() == "d31a8d34648e60db7b86afbc53ef7ec2" and sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert chacha.open_bytes(sealed, key, nonce, data) == text and chacha.open_bytes(sealed, key, nonce, b"") is None
    assert chacha.open_bytes(chacha.seal_bytes(b"", key, nonce, data), key, nonce, data) == b""


def test_other_cipher(spark, tmp_path):
    put(tmp_path / "src", {"a": b"one", "b/c": b"two" * 1000})
    assert jobs.run(spark, request(tmp_path / "src", tmp_path / "out", cipher=Cipher.CHACHA20, key_derivation=KeyDerivation.SCRYPT, compression=CompressionMode.ZSTD)).success
    assert jobs.run(spark, request(tmp_path / "out", tmp_path / "back", operation=Operation.DECRYPT)).success
    assert got(tmp_path / "back") == {"a": b"one", "b/c": b"two" * 1000}


@pytest.mark.parametrize("cipher, derivation", [(Cipher.SERPENT, KeyDerivation.PBKDF2), (Cipher.TWOFISH, KeyDerivation.SCRYPT), (Cipher.CAMELLIA, KeyDerivation.PBKDF2)])
def test_all_ciphers_and_derivations(spark, tmp_path, cipher, derivation):
    tree = {"a": b"This is a test file for encryption round trip!", "b/c": random.Random(1).randbytes(256 << 10)}
    put(tmp_path / "src", tree)
    assert jobs.run(spark, request(tmp_path / "src", tmp_path / "out", cipher=cipher, key_derivation=derivation)).success
    assert jobs.run(spark, request(tmp_path / "out", tmp_path / "back", operation=Operation.DECRYPT)).success
    assert got(tmp_path / "back") == tree


def test_gcm_by_definition():
    """GHASH against a block at a time; the standard's second test case; seals that open, and don't once a bit is turned."""
    rng = random.Random(5)
    h, message, y = rng.getrandbits(128), rng.randbytes(16 * 700), 0
    for i in range(0, len(message), 16):
        y = gcm._times(y ^ int.from_bytes(message[i : i + 16], "big"), h)
    assert gcm.ghash(h, message) == y
    assert gcm.ghash(0x66E94BD4EF8A2C3B884CFA59CA342B2E, bytes.fromhex("0388dace60b6a392f328c2b971b2fe78") + (128).to_bytes(16, "big")) == 0xF38CBB1AD69223DCC3457AE5B6B0F885
    for kind in gcm.CIPHERS:
        for n in (0, 1, 15, 16, 17, 1000):
            raw = rng.randbytes(n)
            sealed = gcm.seal_bytes(kind, raw, bytes(range(32)), bytes(12), b"data")
            assert gcm.open_bytes(kind, sealed, bytes(range(32)), bytes(12), b"data") == raw
            assert gcm.open_bytes(kind, sealed[:-1] + bytes([sealed[-1] ^ 1]), bytes(range(32)), bytes(12), b"data") is None


def test_ciphers_take_many_messages_at_once(monkeypatch):
    """Rows with keys, nonces and data of their own, nulls among them: as each alone; the key's blocks of all rows go to the cipher in few calls."""
    rng, calls = random.Random(8), []
    keys = [rng.randbytes(32) for _ in range(3)]
    rows = [(rng.randbytes(n), keys[i % 3], rng.randbytes(12), rng.randbytes(i % 40)) for i, n in enumerate([0, 1, 15, 16, 17, 63, 64, 65, 511, 512, 513, 20_000] * 10)]
    rows[5] = rows[50] = (None, *rows[5][1:])
    monkeypatch.setitem(gcm.CIPHERS, "serpent", lambda key, plain=gcm.CIPHERS["serpent"]: (lambda run: lambda x: calls.append(len(x)) or run(x))(plain(key)))
    for kind in ("chacha20", "serpent", "camellia", "twofish"):
        seal, unseal = (chacha.seal_many, chacha.open_many) if kind == "chacha20" else (lambda *a, k=kind: gcm.seal_many(k, *a), lambda *a, k=kind: gcm.open_many(k, *a))
        sealed = chacha.by_key(seal, rows)
        if kind == "serpent":
            assert len(calls) < 30 < len(rows)  # two for each row before
        one = (lambda raw, key, nonce, data: chacha.seal_bytes(raw, key, nonce, data)) if kind == "chacha20" else (lambda *row, k=kind: gcm.seal_bytes(k, *row))
        assert sealed == [None if None in row else one(*row) for row in rows]
        given = [(x, *row[1:]) for x, row in zip(sealed, rows, strict=True)]
        assert chacha.by_key(unseal, given) == [row[0] for row in rows]
        cut = [(x and x[: -1 - i % 20], *row[1:]) if i % 2 else (x, row[1], bytes(12), row[3]) for i, (x, row) in enumerate(zip(sealed, rows, strict=True))]
        assert chacha.by_key(unseal, cut) == [None] * len(rows)
    for n in (16, 512, 528, 16 * 700):  # Poly1305 against a block at a time
        key, message, total = rng.randbytes(32), b"\xff" * n, 0
        for i in range(0, n, 16):
            total = (total + int.from_bytes(message[i : i + 16], "little") + (1 << 128)) * (int.from_bytes(key[:16], "little") & chacha.CLAMP) % chacha.PRIME
        want = (total + int.from_bytes(key[16:], "little") & (1 << 128) - 1).to_bytes(16, "little")
        assert chacha.authenticators([key, bytes(32)], [message, message])[0] == want


def test_argon2_seals_manifests(spark, monkeypatch):
    monkeypatch.setattr(keys, "ARGON2_KIB", 64)  # in this process; a job's keys are derived elsewhere, at full cost
    for cipher in Cipher:
        sealed = manifest.seal(spark, b"document", WORD, KeyDerivation.ARGON2ID, cipher)
        assert manifest.unseal(spark, sealed, WORD, KeyDerivation.ARGON2ID, cipher) == b"document"


def test_argon2_library_agrees():
    for memory, passes, lanes in ((8, 1, 1), (77, 2, 2), (64, 3, 4)):
        other = argon2.by_library(b"pw", b"salt" * 4, 40, memory, passes, lanes)
        assert other in (None, argon2.in_numpy(b"pw", b"salt" * 4, 40, memory, passes, lanes))


@pytest.mark.parametrize("names", [NameMode.SHA256, NameMode.GUID])
def test_update_loses_no_file_and_keeps_folder_names(spark, tmp_path, names):
    src, out, back = tmp_path / "src", tmp_path / "out", tmp_path / "back"
    tree = {"d/one": b"same", "d/two": b"other", "d/e/deep": b"deep"}
    put(src, tree)
    r = request(src, out, name_mode=names)
    assert jobs.run(spark, r).success
    folders = {n.split("/")[0] for n in got(out) if "/" in n}
    more = {"d/three": b"same", "d/e/four": b"deep", "d/five": b"new", "d/six": b"new"}
    put(src, more)
    done = jobs.run(spark, dataclasses.replace(r, operation=Operation.UPDATE))
    assert done.success and done.processed == 4, done
    assert {n.split("/")[0] for n in got(out) if "/" in n} == folders and len(folders) == 1
    assert jobs.run(spark, request(out, back, operation=Operation.DECRYPT)).processed == 7
    assert got(back) == {**tree, **more}


def test_files_without_space_are_errors(spark, tmp_path, monkeypatch):
    put(tmp_path / "src", {"small": b"1", "large": b"2" * 5000})
    monkeypatch.setattr(trees, "free_space", lambda path: 3000)
    made = jobs.run(spark, request(tmp_path / "src", tmp_path / "out", use_encryption=False))
    assert (made.success, made.processed, made.total) == (False, 1, 2) and "large" in made.errors[0]
