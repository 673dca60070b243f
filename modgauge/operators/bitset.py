"""Keys as a bit set of fixed size, to drop rows of other keys before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# 2^20 bits in maps of 32768, as bitmap_construct_agg builds them: 128 KB in all.
_BITS = 1 << 20
_MAP_BITS = 1 << 15


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BITS))


def key_bits(keys: DataFrame, key: str) -> Column:
    """A bit for every key, as a scalar map from map number to bits; its size does not grow with the keys."""
    slot = _slot(F.col(key))
    maps = (
        keys.select(F.floor(slot / _MAP_BITS).alias("map"), (slot % _MAP_BITS).alias("place"))
        .groupBy("map")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    return maps.agg(F.map_from_entries(F.collect_list(F.struct("map", "bits")))).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """False only for keys without a bit; a key that shares a bit with another passes."""
    slot = _slot(key)
    place = slot % _MAP_BITS
    byte = F.substring(F.element_at(bits, F.floor(slot / _MAP_BITS)), F.floor(place / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(number, (place % 8).cast("int")) == 1, F.lit(False))
