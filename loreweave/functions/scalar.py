"""Scalar functions as columns, and the few byte codecs that exist only for exchange."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE = "double"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot_product(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(_sum(F.zip_with(a, b, lambda x, y: x.cast(_DOUBLE) * y.cast(_DOUBLE))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast(_DOUBLE) * x.cast(_DOUBLE))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the lengths differ, a vector is empty or a norm is below 1e-8."""
    n = norm(a) * norm(b)
    small = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm(a) < 1e-8) | (norm(b) < 1e-8)
    return F.when(small, 0.0).otherwise(dot_product(a, b) / n)


def l2_distance(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast(_DOUBLE) - y.cast(_DOUBLE)) * (x.cast(_DOUBLE) - y.cast(_DOUBLE))))))


def normalize(a: Column) -> Column:
    """The unit vector; the vector itself where its norm is 0."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast(_DOUBLE))).otherwise(F.transform(a, lambda x: x.cast(_DOUBLE) / norm(a)))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("bigint"))))


def claim_pattern_hash(subj: Column, pred: Column) -> Column:
    """What claims of one slot share: subj ^ (pred << 32)."""
    return subj.cast("bigint").bitwiseXOR(F.shiftleft(pred.cast("bigint"), 32))


def domain_tags(mask: Column) -> Column:
    """Positions of the bits set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(mask, b) == 1)


def hex_id(data: Column) -> Column:
    return F.lower(F.hex(data))


def atom_key(hex_: Column) -> Column:
    """The first 8 bytes of a hexadecimal id: enough to spread by."""
    return F.substring(hex_, 1, 16)


def normalize_query(text: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[;,.:]", " "), r"\s+", " "))


def match_patterns(text: Column, patterns: list[str], most: float = 1.0) -> Column:
    """sqrt(share of the patterns that occur), times ``most``."""
    hits = sum((F.when(text.contains(p), 1).otherwise(0) for p in patterns), F.lit(0))
    return F.least(F.sqrt(hits / len(patterns)) * most, F.lit(most))


def trust_penalty(trust: Column, weight: float) -> Column:
    share = F.least(F.greatest(trust / 10000.0, F.lit(0.01)), F.lit(1.0))
    return weight * (1.0 / share - 1.0)


def age_penalty(valid_from: Column, now: int, weight: float) -> Column:
    """Per year of age; 0 for times that are null, 0 or in the future."""
    years = (F.lit(now) - valid_from) / (365.25 * 86400)
    return F.when(valid_from.isNull() | (valid_from == 0) | (valid_from > now), 0.0).otherwise(weight * years)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def encode_varint(value: int) -> bytes:
    """LEB128 of an unsigned number."""
    out = bytearray()
    while True:
        low, value = value & 0x7F, value >> 7
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def decode_varint(data: bytes) -> tuple[int, int]:
    """(value, bytes read)."""
    value = 0
    for i, b in enumerate(data):
        value |= (b & 0x7F) << (7 * i)
        if not b & 0x80:
            return value, i + 1
    raise ValueError("the number breaks off")


def encode_deltas(values: list[int]) -> bytes:
    """Ascending numbers as varints of their differences."""
    out, last = b"", 0
    for v in values:
        out, last = out + encode_varint(v - last), v
    return out


def decode_deltas(data: bytes) -> list[int]:
    out, last = [], 0
    while data:
        d, n = decode_varint(data)
        last += d
        out.append(last)
        data = data[n:]
    return out


def bitpack(values: list[int]) -> tuple[int, bytes]:
    """(bits a value, packed little-endian)."""
    bits = max((v.bit_length() for v in values), default=0)
    whole = sum(v << (i * bits) for i, v in enumerate(values))
    return bits, whole.to_bytes((bits * len(values) + 7) // 8, "little")


def bitunpack(bits: int, data: bytes, count: int) -> list[int]:
    whole = int.from_bytes(data, "little")
    return [(whole >> (i * bits)) & ((1 << bits) - 1) for i in range(count)]


class HybridClock:
    """(microseconds, counter): never steps back, and orders what one process has seen."""

    def __init__(self) -> None:
        self.phys, self.logical = 0, 0

    def tick(self, now: int) -> tuple[int, int]:
        if now > self.phys:
            self.phys, self.logical = now, 0
        else:
            self.logical += 1
        return self.phys, self.logical

    def update(self, now: int, other: tuple[int, int]) -> tuple[int, int]:
        top = max(now, self.phys, other[0])
        seen = [x[1] for x in ((self.phys, self.logical), other) if x[0] == top]
        self.phys, self.logical = top, max(seen) + 1 if seen else 0
        return self.phys, self.logical
