"""Geometry: distances, containment, parsing.

A geometry is a struct<kind, parts>: parts is an array of rings, lines or point lists of struct<lat, lon>.
A polygon's rings after the first are holes; a multi-polygon has the outer rings of its polygons.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean radius of the earth in metres.
EARTH = 6371008.7714

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(POINT)))])
GEO = "struct<kind:string,parts:array<array<struct<lat:double,lon:double>>>>"


@dataclass(frozen=True)
class Geo:
    """A geometry on the driver: kind and rings of (lat, lon)."""

    kind: str
    parts: tuple[tuple[tuple[float, float], ...], ...]

    @staticmethod
    def point(lat: float, lon: float) -> Geo:
        return Geo("Point", (((lat, lon),),))

    @staticmethod
    def polygon(*rings: list[tuple[float, float]]) -> Geo:
        return Geo("Polygon", tuple(tuple(r) for r in rings))

    @staticmethod
    def line(points: list[tuple[float, float]]) -> Geo:
        return Geo("LineString", (tuple(points),))

    def points(self) -> list[tuple[float, float]]:
        return [p for part in self.parts for p in part]

    def center(self) -> tuple[float, float]:
        lats, lons = zip(*self.points(), strict=True)
        return (min(lats) + max(lats)) / 2, (min(lons) + max(lons)) / 2

    def row(self) -> dict:
        return {"kind": self.kind, "parts": [[{"lat": float(a), "lon": float(b)} for a, b in p] for p in self.parts]}

    def column(self) -> Column:
        return F.struct(F.lit(self.kind).alias("kind"), F.array(*[F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in p]) for p in self.parts]).alias("parts"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def center(geo: Column) -> Column:
    """struct<lat, lon>: the middle of a geometry's bounds."""
    points = F.flatten(geo["parts"])
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(((F.array_min(lats) + F.array_max(lats)) / 2).alias("lat"), ((F.array_min(lons) + F.array_max(lons)) / 2).alias("lon"))


def distance(geo: Column, to: Geo) -> Column:
    lat, lon = to.center()
    c = center(geo)
    return haversine(c["lat"], c["lon"], F.lit(lat), F.lit(lon))


def distances(geos: Column, to: Geo) -> Column:
    """Metres from each of an array of geometries."""
    return F.transform(geos, lambda g: distance(g, to))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times; plain arithmetic, codegen'd."""
    crossed = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if a_lat == b_lat:
            continue
        at = F.lit((b_lon - a_lon) / (b_lat - a_lat)) * (lat - a_lat) + a_lon
        crossed = crossed + F.when(((F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)) & (lon < at), 1).otherwise(0)
    return crossed % 2 == 1


def point_in(lat: Column, lon: Column, polygon: Geo) -> Column:
    """Inside the first ring and no hole."""
    rings = [list(r) for r in polygon.parts]
    inside = in_ring(lat, lon, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(lat, lon, hole)
    return inside


# Relations of two geometries, in plain Python for the few shapes that columns can't express.


def _edges(ring: list) -> list:
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


def _inside(p: tuple, ring: list) -> bool:
    odd = False
    for a, b in _edges(ring):
        if p == a or _on(p, a, b):
            return True
        if (a[0] > p[0]) != (b[0] > p[0]) and p[1] < (b[1] - a[1]) * (p[0] - a[0]) / (b[0] - a[0]) + a[1]:
            odd = not odd
    return odd


def _side(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p: tuple, a: tuple, b: tuple) -> bool:
    return abs(_side(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    if any((_on(a, c, d), _on(b, c, d), _on(c, a, b), _on(d, a, b))):
        return True
    return (_side(a, b, c) > 0) != (_side(a, b, d) > 0) and (_side(c, d, a) > 0) != (_side(c, d, b) > 0)


def _covers_point(g: Geo, p: tuple) -> bool:
    if g.kind == "MultiPolygon":  # polygons don't overlap, so a point within a hole lies in an even number of rings
        rings = [list(r) for r in g.parts]
        return any(_on(p, a, b) for r in rings for a, b in _edges(r)) or sum(_inside(p, r) for r in rings) % 2 == 1
    if g.kind == "Polygon":
        rings = [list(r) for r in g.parts]
        return _inside(p, rings[0]) and not any(_inside(p, h) and not any(_on(p, a, b) for a, b in _edges(h)) for h in rings[1:])
    if "Line" in g.kind:
        return any(_on(p, a, b) for part in g.parts for a, b in zip(part, part[1:], strict=False))
    return p in g.points()


def _lines(g: Geo) -> list:
    if "Polygon" in g.kind:
        return [e for r in g.parts for e in _edges(list(r))]
    if "Line" in g.kind:
        return [e for part in g.parts for e in zip(part, part[1:], strict=False)]
    return [(p, p) for p in g.points()]


def intersects(a: Geo, b: Geo) -> bool:
    return any(_covers_point(a, p) for p in b.points()) or any(_covers_point(b, p) for p in a.points()) or any(_cross(*x, *y) for x in _lines(a) for y in _lines(b))


def contains(a: Geo, b: Geo) -> bool:
    """All of b lies in a."""
    if not all(_covers_point(a, p) for p in b.points()):
        return False
    if "Polygon" not in a.kind or len(b.points()) < 2:
        return True
    middles = [((x[0] + y[0]) / 2, (x[1] + y[1]) / 2) for x, y in _lines(b)]
    return all(_covers_point(a, m) for m in middles)


def relation(a: Geo, b: Geo) -> str:
    if contains(b, a):
        return "within"
    if contains(a, b):
        return "contains"
    return "intersects" if intersects(a, b) else "disjoint"


def _geo(row) -> Geo:
    return Geo(row["kind"], tuple(tuple((p["lat"], p["lon"]) for p in part) for part in row["parts"]))


def _related(geos: Column, to: Geo, test) -> Column:
    """Whether any of an array of geometries passes a test against ``to``, in Arrow batches behind a bounds check."""
    lats, lons = zip(*to.points(), strict=True)
    box = (min(lats), max(lats), min(lons), max(lons))

    def near(g: Column) -> Column:
        points = F.flatten(g["parts"])
        la, lo = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
        return (F.array_max(la) >= box[0]) & (F.array_min(la) <= box[1]) & (F.array_max(lo) >= box[2]) & (F.array_min(lo) <= box[3])

    @F.pandas_udf("boolean")
    def udf(column: pd.Series) -> pd.Series:
        return column.map(lambda found: bool(found is not None and any(test(_geo(g), to) for g in found)))

    # only geometries whose bounds meet are sent to Python
    return F.coalesce(udf(F.filter(geos, near)), F.lit(False))


def spatial_contains(geos: Column, what: Geo) -> Column:
    return _related(geos, what, contains)


def spatial_intersects(geos: Column, what: Geo) -> Column:
    return _related(geos, what, intersects)


_WKT = re.compile(r"^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*(\(.*\))\s*$", re.I | re.S)
_KINDS = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def from_wkt(text: str) -> Geo:
    m = _WKT.match(text)
    if not m:
        raise ValueError(f"not a geometry: {text[:60]}")
    rings = [[tuple(map(float, pair.split()[:2])) for pair in r.split(",")] for r in re.findall(r"\(([^()]+)\)", m[2])]
    return Geo(_KINDS[m[1].upper()], tuple(tuple((lat, lon) for lon, lat in r) for r in rings))


def from_geojson(text: str | dict) -> Geo | list[Geo]:
    """A geometry, or a list for collections; coordinates are (lon, lat)."""
    g = json.loads(text) if isinstance(text, str) else text
    kind, at = g["type"], g.get("coordinates")
    if kind == "GeometryCollection":
        found = [from_geojson(x) for x in g["geometries"]]
        return [x for r in found for x in ([r] if isinstance(r, Geo) else r)]
    if kind == "FeatureCollection":
        found = [from_geojson(x) for x in g["features"] if x.get("geometry")]
        return [x for r in found for x in ([r] if isinstance(r, Geo) else r)]
    if kind == "Feature":
        return from_geojson(g["geometry"])
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[kind]
    rings = [[at]] if depth == 0 else [at] if depth == 1 else at if depth == 2 else [r for p in at for r in p]
    return Geo(kind, tuple(tuple((float(p[1]), float(p[0])) for p in r) for r in rings))


def _polygons(g: Geo) -> list[list[int]]:
    """Places of a multipolygon's rings, each outer ring with the holes within it."""
    rings = [list(r) for r in g.parts]
    around = [[j for j, o in enumerate(rings) if j != i and all(_inside(p, o) for p in r)] for i, r in enumerate(rings)]
    outer = {i: [i] for i, a in enumerate(around) if len(a) % 2 == 0}
    for i, a in enumerate(around):
        if len(a) % 2:
            outer[max((j for j in a if j in outer), key=lambda j: len(around[j]))].append(i)
    return list(outer.values())


def to_geojson(g: Geo) -> str:
    rings = [[[lon, lat] for lat, lon in r] for r in g.parts]
    at = {"Point": lambda: rings[0][0], "MultiPoint": lambda: rings[0], "LineString": lambda: rings[0], "MultiPolygon": lambda: [[rings[i] for i in p] for p in _polygons(g)]}.get(g.kind, lambda: rings)()
    return json.dumps({"type": g.kind, "coordinates": at})


def fix_order(lat: float, lon: float) -> tuple[float, float]:
    """Swapped where the first can't be a latitude but the second can."""
    return (lon, lat) if abs(lat) > 90 >= abs(lon) else (lat, lon)


def point_wkt(c: Column) -> Column:
    """struct<lat, lon> of ``POINT (lon lat)`` text, null for others."""
    lon = F.regexp_extract(c, r"(?i)^\s*POINT\s*\(\s*([-+.0-9eE]+)\s+([-+.0-9eE]+)", 1).try_cast("double")
    lat = F.regexp_extract(c, r"(?i)^\s*POINT\s*\(\s*([-+.0-9eE]+)\s+([-+.0-9eE]+)", 2).try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))

