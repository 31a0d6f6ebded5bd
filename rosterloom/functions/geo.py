"""Places: distances, cells, polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
#: State names and their codes.
STATES = """
Alabama AL, Alaska AK, Arizona AZ, Arkansas AR, California CA, Colorado CO, Connecticut CT, Delaware DE, District of Columbia DC,
Florida FL, Georgia GA, Hawaii HI, Idaho ID, Illinois IL, Indiana IN, Iowa IA, Kansas KS, Kentucky KY, Louisiana LA, Maine ME,
Maryland MD, Massachusetts MA, Michigan MI, Minnesota MN, Mississippi MS, Missouri MO, Montana MT, Nebraska NE, Nevada NV,
New Hampshire NH, New Jersey NJ, New Mexico NM, New York NY, North Carolina NC, North Dakota ND, Ohio OH, Oklahoma OK, Oregon OR,
Pennsylvania PA, Rhode Island RI, South Carolina SC, South Dakota SD, Tennessee TN, Texas TX, Utah UT, Vermont VT, Virginia VA,
Washington WA, West Virginia WV, Wisconsin WI, Wyoming WY, Puerto Rico PR, Virgin Islands VI, Guam GU
"""


def state_code(text: Column) -> Column:
    """The two-letter code of a state's name or code, in any case; null for anything else."""
    pairs = [p.strip().rsplit(" ", 1) for p in STATES.replace("\n", " ").split(",")]
    known = F.create_map(*[F.lit(x) for name, code in pairs for x in (name.upper(), code, code, code)])
    return F.try_element_at(known, F.upper(F.trim(F.regexp_replace(text, r"\s+", " "))))


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_MILES) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def cell(degrees: Column, size: float = 0.25) -> Column:
    """Index of the nearest multiple of ``size``, halves to the even one."""
    return F.bround(degrees / F.lit(size)).cast("int")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over the (lat, lon) corners; a closed ring is implied."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, [*corners[1:], corners[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + (spans & (lon < F.lit(x2 - x1) * (lat - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))).cast("int")
    return crossings % 2 == 1
