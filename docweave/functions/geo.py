"""Geometry over structs of lat and lon in degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: metres in a unit, and the mean earth radius
METRES = {"mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "nmi": 1852.0}
EARTH = 6371008.7714


def metres(distance: str | float, unit: str = "m") -> float:
    if isinstance(distance, str):
        number = distance.rstrip("abcdefghijklmnopqrstuvwxyz")
        unit = distance[len(number) :].strip() or unit
        distance = float(number)
    if unit not in METRES:
        raise ValueError(f"unknown unit `{unit}`; expected one of {', '.join(METRES)}")
    if not distance >= 0:
        raise ValueError("a distance is not negative")
    return distance * METRES[unit]


def check(lat: float, lon: float) -> None:
    if not -90 <= lat <= 90 or not -180 <= lon <= 180:
        raise ValueError(f"({lat}, {lon}) is not on the earth")


def haversine(p: Column, lat: float, lon: float, plane: bool = False) -> Column:
    """Metres from a point; null for none."""
    check(lat, lon)
    a, b = F.radians(p["lat"]), F.radians(F.lit(lat))
    if plane:
        x = (F.radians(p["lon"]) - F.radians(F.lit(lon))) * F.cos((a + b) / 2)
        return EARTH * F.sqrt(x * x + (a - b) * (a - b))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(p["lon"]) - F.radians(F.lit(lon))) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(p: Column, top: float, left: float, bottom: float, right: float) -> Column:
    across = p["lon"].between(left, right) if left <= right else (p["lon"] >= left) | (p["lon"] <= right)  # over the date line
    return p["lat"].between(bottom, top) & across


def in_polygon(p: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) vertices."""
    if len(points) < 3:
        raise ValueError("a polygon has at least three points")
    crossings = []
    for (la, lo), (lb, ob) in zip(points, points[1:] + points[:1]):
        if la != lb:
            at = (ob - lo) * (p["lat"] - la) / (lb - la) + lo
            crossings.append((((F.lit(la) > p["lat"]) != (F.lit(lb) > p["lat"])) & (p["lon"] < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
