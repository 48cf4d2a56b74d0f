"""Integer helpers, seeds and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the seed formula.
EPOCH_FACTOR = 1315423911
PLACE_FACTOR = 2654435761


def int_div(value: Column, divisor: int) -> Column:
    """Exact integer division (truncating) on 64-bit values."""
    return F.call_function("div", value.cast("bigint"), F.lit(divisor).cast("bigint"))


def floor_multiple(value: Column, multiple: int) -> Column:
    """Largest multiple not above ``value``; unchanged when ``multiple`` is 1 or less."""
    if multiple <= 1:
        return value
    return value - F.pmod(value, F.lit(multiple))


def ceil_div(value: Column, divisor: int) -> Column:
    """Division rounded towards plus infinity, also for negative values."""
    up = value + F.lit(divisor - 1)
    return int_div(up - F.pmod(up, F.lit(divisor)), divisor)


def round_up(value: Column, multiple: int) -> Column:
    """Smallest multiple of ``multiple`` not below ``value``."""
    return ceil_div(value, multiple) * F.lit(multiple)


def _base(base_seed: int) -> Column:
    if not 0 <= base_seed < 2**31:
        raise ValueError("base_seed must be in [0, 2**31)")
    return F.shiftleft(F.lit(base_seed).cast("bigint"), 32)


def epoch_seed(base_seed: int, epoch: Column) -> Column:
    """Seed of the shard order in one epoch."""
    return _base(base_seed).bitwiseXOR(epoch.cast("bigint") * F.lit(EPOCH_FACTOR))


def document_seed(base_seed: int, epoch: Column, place: Column) -> Column:
    """Seed of the document order of the shard at ``place`` in one epoch."""
    return epoch_seed(base_seed, epoch).bitwiseXOR(place.cast("bigint") * F.lit(PLACE_FACTOR))


def shuffle_key(seed: Column, item: Column) -> Column:
    """Text key whose order is a seeded permutation of the items."""
    return F.md5(F.concat_ws(":", seed.cast("string"), item.cast("string")))


def shard_stem(shard_idx: Column) -> Column:
    """File stem of a shard."""
    return F.format_string("shard_%05d", shard_idx)


def first_hex_bucket(key: Column, digits: int = 3) -> Column:
    """Integer of the first hex digits of a key: equal-sized, order-preserving buckets."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")
