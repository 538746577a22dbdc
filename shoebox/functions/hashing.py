"""Hashes and bit distances as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def hex_bits(text: Column, digits: int = 16) -> Column:
    """The first hex digits of a text as a long; null where they are missing or are not hex."""
    bits = lambda head: F.when(head.rlike(f"^[0-9a-fA-F]{{{digits}}}$"), F.conv(head, 16, -10).cast("bigint"))
    return F.transform(F.array(F.substring(text, 1, digits)), bits)[0]  # so that a derived text is computed once


def hamming(a: Column, b: Column, digits: int = 16) -> Column:
    """Bits in which the first hex digits of two texts differ."""
    return F.bit_count(hex_bits(a, digits).bitwiseXOR(hex_bits(b, digits)))


def file_hash(content: Column) -> Column:
    """Hex SHA-256 of bytes or text."""
    return F.sha2(content.cast("binary"), 256)


def text_simhash(text: Column) -> Column:
    """64-bit fingerprint of the distinct lower-cased tokens, as 16 hex digits: a stand-in for an image hash.

    The bits that more than half of the tokens' hashes (the first half of their MD5) have. Texts without tokens and null have none.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    return _majority_hex(F.unhex(F.array_join(F.transform(tokens, lambda t: F.substring(F.md5(t), 1, 16)), "")))


@F.pandas_udf(StringType())
def _majority_hex(hashes: pd.Series) -> pd.Series:
    """The bits that more than half of the 8-byte hashes in a row's bytes have, as hex digits; their counts are one sum in numpy."""

    def of(data: bytes | None) -> str:
        rows = np.frombuffer(data or b"", np.uint8).reshape(-1, 8)
        ones = sum((np.unpackbits(rows[i : i + 4096], axis=1).sum(0, dtype=np.int64) for i in range(0, len(rows), 4096)), np.zeros(64, np.int64))
        return np.packbits(2 * ones > len(rows)).tobytes().hex()

    return pd.Series([of(d) for d in hashes], dtype=object)


#: Four lanes of 16 bits in a long; sums of up to LANE_MAX ones leave the top lane positive.
LANES = 0x0001000100010001
LANE_MAX = 16_000


def _lane_sum(k: int):
    return lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))


def _has(bit: int):
    return lambda h: F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1


def majority(hashes: Column) -> Column:
    """The bits that more than half of the longs have: lane k of 16 sums counts bits k, k + 16, k + 32 and k + 48 at once.

    Arrays beyond LANE_MAX are counted bit by bit.
    """
    zero = F.lit(0).cast("bigint")
    need = F.shiftright(F.size(hashes), 1).cast("bigint") + 1
    up = (F.lit(16384).cast("bigint") - need) * F.lit(LANES)  # lifts a lane's bit 14 where its count is enough
    out = zero
    for k in range(16):
        total = F.aggregate(hashes, zero, _lane_sum(k))
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(total + up, 14).bitwiseAND(F.lit(LANES)), k))
    many = zero
    for b in range(64):
        count = F.size(F.filter(hashes, _has(b)))
        many = many.bitwiseOR(F.when(count >= need, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(zero))
    return F.when(F.size(hashes) <= LANE_MAX, out).otherwise(many)
