"""Geohash and grid expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cell(value: Column, low: float, high: float, bits: int) -> Column:
    cells = 1 << bits
    index = F.floor((value - F.lit(low)) / F.lit((high - low) / cells)).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(index, F.lit(cells - 1).cast("bigint")))


def geohash(longitude: Column, latitude: Column, precision: int) -> Column:
    """Geohash of a point: interleaved longitude and latitude bits in base 32."""
    bits = 5 * precision
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    x = _cell(longitude, -180.0, 180.0, x_bits)
    y = _cell(latitude, -90.0, 90.0, y_bits)
    letters = []
    for letter in range(precision):
        code = F.lit(0).cast("bigint")
        for bit in range(5 * letter, 5 * letter + 5):
            source, left = (x, x_bits - 1 - bit // 2) if bit % 2 == 0 else (y, y_bits - 1 - bit // 2)
            code = code * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("bigint"))
        letters.append(F.substring(F.lit(GEOHASH_ALPHABET), (code + 1).cast("int"), F.lit(1)))
    inside = longitude.between(-180, 180) & latitude.between(-90, 90)
    return F.when(inside, F.concat(*letters))


def bbox_overlaps(bbox: Column, other: tuple[float, float, float, float]) -> Column:
    """Do two ``[minLng, minLat, maxLng, maxLat]`` boxes touch or overlap?"""
    west, south, east, north = other
    return (
        (F.get(bbox, F.lit(0)) <= east)
        & (F.get(bbox, F.lit(2)) >= west)
        & (F.get(bbox, F.lit(1)) <= north)
        & (F.get(bbox, F.lit(3)) >= south)
    )
