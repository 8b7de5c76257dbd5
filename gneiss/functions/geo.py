"""Places: geohashes of 52 bits, great-circle distances, and search by radius or box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The earth's radius in metres, metres of the units, the limits of latitudes that a geohash codes.
EARTH = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
LAT_LIMIT, LON_LIMIT, STEPS = 85.05112878, 180.0, 26
#: Fixed alphabet of the textual geohash, whose latitudes go to 90.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def spread(c: Column) -> Column:
    """The low 32 bits of a whole number, a zero bit before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = let(c, lambda x: x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask)))  # noqa: B023
    return c


def squeezed(c: Column) -> Column:
    """The even bits of a whole number, side by side."""
    c = c.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        c = let(c, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask)))
    return c


def cell(c: Column, limit: float) -> Column:
    """Which of 2**STEPS equal parts of -limit to limit a coordinate is in."""
    return F.least(F.floor((c + limit) / (2 * limit) * (1 << STEPS)).cast("long"), F.lit((1 << STEPS) - 1))


def geohash_bits(lon: Column, lat: Column) -> Column:
    """GEOADD: the score of a place, 52 bits, longitude and latitude in turn; null outside the limits."""
    ok = F.abs(lon).between(0, LON_LIMIT) & F.abs(lat).between(0, LAT_LIMIT)
    return F.when(ok, F.shiftleft(spread(cell(lon, LON_LIMIT)), 1).bitwiseOR(spread(cell(lat, LAT_LIMIT))))


def position(bits: Column) -> Column:
    """GEOPOS: struct(lon, lat), the middle of the geohash's box."""
    middle = lambda c, limit: (c.cast("double") + 0.5) / (1 << STEPS) * (2 * limit) - limit
    return F.struct(middle(squeezed(F.shiftrightunsigned(bits, 1)), LON_LIMIT).alias("lon"), middle(squeezed(bits), LAT_LIMIT).alias("lat"))


def geohash(bits: Column) -> Column:
    """GEOHASH: 11 letters of the usual geohash of the decoded place, the last one `0` as there are only 52 bits."""

    def of_place(p: Column) -> Column:
        lat = F.least(F.floor((p["lat"] + 90) / 180 * (1 << STEPS)).cast("long"), F.lit((1 << STEPS) - 1))
        return F.shiftleft(spread(cell(p["lon"], LON_LIMIT)), 1).bitwiseOR(spread(lat))

    def letters(own: Column) -> Column:
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftrightunsigned(own, 52 - 5 * (k + 1)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(10)), F.lit("0"))

    return let(let(position(bits), of_place), letters)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """GEODIST: the great-circle distance."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * EARTH * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)) / UNITS[unit]


def search(df: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", desc: bool | None = None, count: int | None = None, any_order: bool = False, lon_col: str = "lon", lat_col: str = "lat", tie: str = "member", with_hash: bool = False, with_coord: bool = False) -> DataFrame:
    """GEOSEARCH FROMLONLAT: the rows within a radius, or a box (width, height), with `dist` in the unit; with_hash adds
    `hash`, the geohash of 52 bits, and with_coord `coord`, the place that it stands for.

    A range of latitudes comes first, and one of longitudes where it doesn't wrap; such filters reach the files. In a
    box the width is measured at the row's own latitude. desc None keeps any order, unless a count without any_order
    asks for the nearest.
    """
    x, y = F.col(lon_col), F.col(lat_col)
    high = (radius if radius is not None else box[1] / 2) * UNITS[unit]
    wide = (radius if radius is not None else box[0] / 2) * UNITS[unit]
    d_lat = math.degrees(high / EARTH) * 1.000001
    out = df.where(y.between(lat - d_lat, lat + d_lat))
    furthest = min(89.9, abs(lat) + d_lat)
    s = math.sin(min(wide / EARTH / 2, math.pi / 2)) / max(1e-9, math.cos(math.radians(furthest)))
    d_lon = math.degrees(2 * math.asin(s)) * 1.000001 if s < 1 else 360
    if -180 <= lon - d_lon and lon + d_lon <= 180:
        out = out.where(x.between(lon - d_lon, lon + d_lon))
    here = (F.lit(float(lon)), F.lit(float(lat)))
    out = out.withColumn("dist", distance(here[0], here[1], x, y, unit))
    if radius is not None:
        out = out.where(F.col("dist") <= radius)
    else:
        out = out.where((distance(here[0], here[1], here[0], y, unit) <= box[1] / 2) & (distance(here[0], y, x, y, unit) <= box[0] / 2))
    if desc is None and count is not None and not any_order:
        desc = False
    if desc is not None:
        out = out.orderBy(F.desc("dist") if desc else F.asc("dist"), tie)
    out = out if count is None else out.limit(count)
    if with_hash:
        out = out.withColumn("hash", geohash_bits(x, y))
    return out.withColumn("coord", position(geohash_bits(x, y))) if with_coord else out


def search_store(df: DataFrame, lon: float, lat: float, store_dist: bool = False, **how) -> DataFrame:
    """GEOSEARCHSTORE: what a search finds as a ranked set (member, score); scores are geohashes, or distances."""
    out = search(df, lon, lat, with_hash=True, **how)
    return out.select(F.col(how.get("tie", "member")).alias("member"), F.col("dist" if store_dist else "hash").cast("double").alias("score"))


def search_from(df: DataFrame, member: str, **how) -> DataFrame:
    """GEOSEARCH FROMMEMBER: around a row; it is an error if there is none."""
    tie = how.get("tie", "member")
    own = df.where(F.col(tie) == member).select(how.get("lon_col", "lon"), how.get("lat_col", "lat")).first()
    if own is None:
        raise KeyError(f"no member {member}")
    return search(df, own[0], own[1], **how)
