"""Byte functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File signatures (hex) and what they stand for.
COMPRESSED_MAGIC = ("89504E47", "504B0304", "1F8B", "7F454C46", "47475546", "FFD8FF", "47494638")
CATEGORY_MAGIC = (
    ("89504E47", "compressed", "png", 1.0), ("504B0304", "compressed", "zip", 1.0), ("1F8B", "compressed", "gzip", 1.0), ("FFD8FF", "compressed", "jpeg", 1.0),
    ("474946383761", "compressed", "gif", 1.0), ("474946383961", "compressed", "gif", 1.0), ("424D", "raw_image", "bmp", 0.9), ("49492A00", "raw_image", "tiff", 0.9),
    ("4D4D002A", "raw_image", "tiff", 0.9), ("7F454C46", "binary", "elf", 0.9), ("25504446", "binary", "pdf", 0.9),
)
SQL_MARKS = ("SELECT ", "INSERT INTO ", "CREATE TABLE ")
CODE_MARKS = ("func ", "class ", "def ", "package ", "import ", "function ")


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def lsh_bucket(data: Column) -> Column:
    """The first two bytes, little endian; 0 with fewer."""
    h = F.hex(F.substring(data, 1, 2))
    return F.when(F.octet_length(data) < 2, F.lit(0)).otherwise(F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int"))


def similarity(distance: Column, size: Column) -> Column:
    """1 - distance / bits, not below 0; 0 for no bits."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / (size * 8)))


def bypasses(data: Column, entropy: Column) -> Column:
    """Already compressed by signature (more than 4 bytes), or above 7.8 bits a byte."""
    h = F.hex(F.substring(data, 1, 12))
    webp = h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250")
    return ((F.octet_length(data) > 4) & (any_of([h.startswith(m) for m in COMPRESSED_MAGIC]) | webp)) | (entropy > 7.8)


def adaptive_chunk_size(entropy: Column) -> Column:
    return F.when(entropy < 3, 64).when(entropy < 6, 128).otherwise(512)


def polynomial(seed: Column, length: Column) -> Column:
    """Hex of the bytes (a x^2 + b x + c) mod 256, a, b, c from the seed's low bytes."""
    seed = seed.cast("long")
    a, b, c = (F.shiftright(seed, k).bitwiseAND(F.lit(255)) for k in (0, 8, 16))
    byte = lambda x: F.lower(F.lpad(F.hex(F.pmod(a * x * x + b * x + c, F.lit(256))), 2, "0"))
    return F.when(length <= 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1), byte), ""))


def content_type(data: Column) -> Column:
    """ELF, ZIP, PNG, JSON, JSONL, LINES or UNKNOWN of a sample."""
    text = F.decode(data, "ISO-8859-1")
    lead = F.regexp_extract(text, r"^[ \t\n\r]*([\[{])", 1)
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n", ""))
    odd = F.char_length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    h = F.hex(F.substring(data, 1, 4))
    return (
        F.when(h == "7F454C46", "ELF").when(h == "504B0304", "ZIP").when(h == "89504E47", "PNG")
        .when((lead != "") & text.contains("}\n{"), "JSONL").when(lead != "", "JSON")
        .when((lines > 5) & (odd < F.floor(F.octet_length(data) / 10)), "LINES").otherwise("UNKNOWN")
    )


def category(data: Column, entropy: Column) -> tuple[Column, Column, Column]:
    """Category, hint and confidence of a head sample: signatures, then markup, SQL, code, printable share."""
    h, text = F.hex(F.substring(data, 1, 12)), F.decode(data, "ISO-8859-1")
    upper = F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    printable = F.char_length(F.regexp_replace(text, r"[^\x20-\x7e\n\r\t]", ""))
    cases = [(F.octet_length(data) == 0, ("empty", "none", 1.0))]
    cases += [(h.startswith(m), (c, k, p)) for m, c, k, p in CATEGORY_MAGIC]
    cases += [
        (h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), ("compressed", "webp", 1.0)),
        (text.contains("<svg") | upper.contains("XML"), ("raw_image", "svg", 0.8)),
        (any_of([upper.contains(m) for m in SQL_MARKS]), ("text_sql", "sql", 0.8)),
        (any_of([text.contains(m) for m in CODE_MARKS]), ("text_code", "code", 0.7)),
        (printable / F.octet_length(data) > 0.85, ("text_logs", "text", 0.7)),
        (entropy > 6.5, ("binary", "unknown", 0.5)),
        (F.lit(True), ("binary", "unknown", 0.3)),
    ]
    out = []
    for k in range(3):
        c = F.lit(cases[-1][1][k])
        for test, value in reversed(cases[:-1]):
            c = F.when(test, F.lit(value[k])).otherwise(c)
        out.append(c)
    return tuple(out)


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """HMAC from two nested digests; the key (at most 64 bytes) is given in hex."""
    key = bytes.fromhex(key_hex).ljust(64, b"\0")
    inner, outer = (bytes(x ^ y for x in key) for y in (0x36, 0x5C))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message), 256))), 256)


def convergent_encrypt(secret_hex: str, plain: Column) -> Column:
    """nonce | ciphertext | tag under a key that the secret and the plaintext's hash give: equal texts encrypt alike."""
    digest = F.unhex(F.sha2(plain, 256))
    return F.aes_encrypt(plain, F.unhex(hmac_sha256(secret_hex, digest)), F.lit("GCM"), F.lit("DEFAULT"), F.substring(digest, 1, 12))


def convergent_decrypt(secret_hex: str, sealed: Column, digest: Column) -> Column:
    return F.aes_decrypt(sealed, F.unhex(hmac_sha256(secret_hex, digest)), F.lit("GCM"))


def derive_key(password: bytes, salt: bytes, rounds: int = 100_000) -> bytes:
    """A 32-byte key by PBKDF2 with SHA-256, once on the driver."""
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password, salt, rounds, 32)


def new_salt() -> bytes:
    import os

    return os.urandom(16)


def one_line(text: Column) -> Column:
    """Line ends as blanks."""
    return F.translate(text, "\n", " ")


def high_entropy(entropy: Column) -> Column:
    """Too random for a search by bucket."""
    return entropy > 7.5


def is_model_file(data: Column) -> Column:
    """Whether it begins with the signature of model weights."""
    return F.hex(F.substring(data, 1, 4)) == "47475546"


def entry_size(version: Column) -> Column:
    """Bytes of a chunk entry in an archive of that version."""
    return F.when(version > 6, 25).otherwise(24)


def block_count(chunks: Column, per_block: int = 131_072) -> Column:
    return F.ceil(chunks / per_block).cast("int")
