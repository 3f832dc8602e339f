"""Column functions. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_SITES_M = 6_371_008.8
RADIUS_TRACK_M = 6_371_000.0


def yes_probability(answer: Column, confidence: Column) -> Column:
    """Stated confidence as the probability of yes; an abstention or a missing answer is one half."""
    p = confidence / F.lit(100.0)
    return F.when(answer == "yes", p).when(answer == "no", 1 - p).otherwise(F.lit(0.5))


def binary_answer(answer: Column) -> Column:
    """1 for yes, 0 for no, NULL for an abstention or a missing answer."""
    return F.when(answer == "yes", F.lit(1.0)).when(answer == "no", F.lit(0.0))


def finite(x: Column) -> Column:
    """NULL unless finite, so that aggregates skip what isn't."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_mean(x: Column) -> Column:
    return F.avg(finite(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_SITES_M) -> Column:
    """Great-circle distance in metres of coordinates in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would take a missing place for 1


def ground_sample_m(altitude: Column, fov_degrees: float, width_px: int) -> Column:
    """Metres on the ground a pixel of a view straight down covers."""
    return 2 * altitude * F.lit(math.tan(math.radians(fov_degrees) / 2)) / F.lit(float(width_px))


def cell_edge(index: Column, size_px: int, grid: int) -> Column:
    """Pixel at which a grid row or column begins; halves go to the even neighbour."""
    return F.bround(index * F.lit(float(size_px)) / F.lit(float(grid))).cast("int")


def cell_area(row: Column, column: Column, grid: int, width_px: int, height_px: int) -> Column:
    height = cell_edge(row + 1, height_px, grid) - cell_edge(row, height_px, grid)
    width = cell_edge(column + 1, width_px, grid) - cell_edge(column, width_px, grid)
    return height * width


def request_id(*parts: Column) -> Column:
    """SHA-256 of the parts' text joined by a zero byte; a NULL part is written None, so it can't be taken for a missing one."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_fraction(seed: int, key: Column) -> Column:
    """A number from 0 to 1 (exclusive) from the first eight bytes of SHA-256 of "seed:key"."""
    head = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def spatial_block(lat: Column, lon: Column, size_m: float) -> Column:
    """Name of the cell of about size_m metres a place is in; meridians close up, down to a tenth."""
    lat_size = size_m / 111_320.0
    lon_size = F.lit(size_m) / (111_320.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    return F.concat_ws(":", F.floor(lat / lat_size).cast("string"), F.floor(lon / lon_size).cast("string"))


def split_of(fraction: Column, train: float, validation: float) -> Column:
    return F.when(fraction < train, "train").when(fraction < train + validation, "validation").otherwise("test")


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Dollars, of prices for a million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / F.lit(1e6)
