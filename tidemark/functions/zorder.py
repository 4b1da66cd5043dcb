"""Z-order keys over (key hash, version) as Column expressions.

A key's 32-bit hash takes the even bits of a 64-bit value, the version the odd
ones.  For versions below 2**31 the value is a non-negative BIGINT, so signed
order is Z order.  Spreading, gathering and encoding are arithmetic that whole-stage
code generation compiles; the FNV hash folds over a key's bytes with a lambda, which
it does not.  Keys are text (their UTF-8 bytes count) or bytes.  Each builder has a
Python twin for literals and tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Shifts and masks that spread 32 bits over 64.
SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)
#: The 64-bit FNV-1a offset as two limbs, and its prime without the bit at 2**40.
FNV_HIGH, FNV_LOW, FNV_PRIME = 0xCBF29CE4, 0x84222325, 0x1B3
SHARDS, WORKERS = 16, 4


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def spread(x: Column) -> Column:
    x = x.cast("long").bitwiseAND(_long(MASK))
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(_long(mask))
    return x


def gather(z: Column) -> Column:
    masks = [mask for _, mask in SPREAD]
    z = z.bitwiseAND(_long(masks[-1]))
    for shift, mask in zip((1, 2, 4, 8, 16), [*masks[-2::-1], MASK], strict=True):
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(_long(mask))
    return z


def z_encode(key_hash: Column, version: Column) -> Column:
    """Z value of the low 32 bits of both."""
    return spread(key_hash).bitwiseOR(F.shiftleft(spread(version), 1))


def z_key_hash(z: Column) -> Column:
    return gather(z)


def z_version(z: Column) -> Column:
    return gather(F.shiftrightunsigned(z, 1))


def z_least(key_hash: Column) -> Column:
    """Z value of the key at version 0."""
    return spread(key_hash)


def z_greatest(key_hash: Column, version: int = 2**31 - 1) -> Column:
    """Z value of the key at the largest version; the default keeps it a non-negative BIGINT."""
    return z_encode(key_hash, F.lit(version))


def key_hash_le4(key: Column) -> Column:
    """The first four bytes, little-endian; shorter keys fold their bytes."""
    raw = key.cast("binary")
    size = F.octet_length(raw)
    digits = F.hex(raw)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long")
    folded = F.lit(0).cast("long")
    for i in range(3):
        folded = F.when(size > i, ((folded + byte(i)) * (31 + i)).bitwiseAND(_long(MASK))).otherwise(folded)
    whole = byte(0) + F.shiftleft(byte(1), 8) + F.shiftleft(byte(2), 16) + F.shiftleft(byte(3), 24)
    return F.when(size >= 4, whole).otherwise(folded)


def key_hash_fnv(key: Column) -> Column:
    """FNV-1a 64 as a struct of two 32-bit limbs, ``high`` and ``low``.

    BIGINT products of 64 bits would overflow, so the hash runs on limbs.
    """
    digits = F.hex(key.cast("binary"))
    size = (F.length(digits) / 2).cast("int")
    # an empty key has no bytes: sequence(1, 0) would count down
    bytes_ = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * FNV_PRIME
        high = (h["high"] * FNV_PRIME + F.shiftleft(low, 8) + F.shiftrightunsigned(product, 32)).bitwiseAND(_long(MASK))
        return F.struct(high.alias("high"), product.bitwiseAND(_long(MASK)).alias("low"))

    return F.aggregate(bytes_, F.struct(_long(FNV_HIGH).alias("high"), _long(FNV_LOW).alias("low")), step)


def key_hash_fnv_low(key: Column) -> Column:
    return key_hash_fnv(key)["low"]


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """Shard of a key: its FNV hash modulo a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    return key_hash_fnv_low(key).bitwiseAND(_long(shards - 1)).cast("int")


def bucket_width(workers: int = WORKERS) -> int:
    return (2**64 - 1) // workers


def z_bucket(z: Column, workers: int = WORKERS) -> Column:
    """Number of the equal Z range that a non-negative value lies in."""
    width = bucket_width(workers)
    if width >= 2**63:
        return F.lit(0).cast("long")
    return F.least(F.call_function("div", z, F.lit(width)), F.lit(workers - 1).cast("long"))


# Python twins ---------------------------------------------------------------


def py_spread(x: int) -> int:
    x &= MASK
    for shift, mask in SPREAD:
        x = (x | x << shift) & mask
    return x


def py_z(key_hash: int, version: int) -> int:
    return py_spread(key_hash) | py_spread(version) << 1


def py_le4(key: str | bytes) -> int:
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) >= 4:
        return int.from_bytes(raw[:4], "little")
    h = 0
    for i, b in enumerate(raw):
        h = (h + b) * (31 + i) & MASK
    return h


def py_fnv(key: str | bytes) -> int:
    h = FNV_HIGH << 32 | FNV_LOW
    for b in key.encode() if isinstance(key, str) else key:
        h = (h ^ b) * (2**40 + FNV_PRIME) % 2**64
    return h
