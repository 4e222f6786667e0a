"""Run identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 0xFFFFFFFF


def run_id(ts: Column) -> Column:
    return F.concat(F.lit("SA-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def run_timestamp(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as bigint; 64-bit products cannot overflow."""
    digits = F.hex(text.cast("binary"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 - 1, 2), 16, 10).cast("bigint")
        return (h.bitwiseXOR(byte) * FNV_PRIME).bitwiseAND(F.lit(MASK_32))

    positions = F.when(
        F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, F.lit(FNV_OFFSET).cast("bigint"), step)


def fingerprint(timestamp: Column, path: Column) -> Column:
    """Short display fingerprint of one file in one run."""
    return F.concat(F.lit("AUD-"), F.lpad(F.hex(fnv1a_32(F.concat(timestamp, path))), 8, "0"))
