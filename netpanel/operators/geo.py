"""Polygons as arrays of rings of (lon, lat): small parts, the antimeridian, rounding, GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def ring_area(ring: Ring) -> float:
    """Signed area in square degrees (counter-clockwise positive)."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def unwrapped(ring: Ring) -> Ring:
    """The ring without jumps across the antimeridian: longitudes may leave -180 .. 180."""
    out: Ring = []
    shift = 0.0
    for k, (x, y) in enumerate(ring):
        if k:
            step = x - ring[k - 1][0]
            shift += 360 if step < -180 else -360 if step > 180 else 0
        out.append((x + shift, y))
    return out


def clipped(ring: Ring, bound: float, keep_below: bool) -> Ring:
    """The part of a ring on one side of a meridian."""
    inside = lambda p: p[0] <= bound if keep_below else p[0] >= bound
    out: Ring = []
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        if inside(a):
            out.append(a)
        if inside(a) != inside(b):
            t = (bound - a[0]) / (b[0] - a[0])
            out.append((bound, a[1] + t * (b[1] - a[1])))
    return out if len(out) >= 3 else []


def split_antimeridian(ring: Ring) -> list[Ring]:
    """The parts of a ring within -180 .. 180."""
    flat = unwrapped(ring)
    low, high = min(x for x, _ in flat), max(x for x, _ in flat)
    if low >= -180 and high <= 180:
        return [flat]
    parts = []
    for k in range(int((low + 180) // 360), int((high + 180) // 360) + 1):
        part = clipped(clipped(flat, 360 * k - 180, False), 360 * k + 180, True)
        if part:
            parts.append([(x - 360 * k, y) for x, y in part])
    return [p for p in parts if abs(ring_area(p)) > 1e-12]


def rounded_ring(ring: Ring, digits: int = 3) -> Ring:
    """Coordinates rounded, repeats dropped; empty if fewer than three points are left."""
    out: Ring = []
    for x, y in ring:
        p = (round(x, digits), round(y, digits))
        if not out or out[-1] != p:
            out.append(p)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 and abs(ring_area(out)) > 0 else []


def kept_parts(rings: list[Ring], least: float) -> list[Ring]:
    """Parts of at least that area; the largest one in any case."""
    if not rings:
        return []
    areas = [abs(ring_area(r)) for r in rings]
    top = areas.index(max(areas))
    return [r for k, r in enumerate(rings) if areas[k] >= least or k == top]


def geojson(rows: DataFrame, least: float = 0.0, digits: int = 3) -> DataFrame:
    """entity, feature: GeoJSON of each entity's outer rings (array of arrays of struct(lon, lat)), cut at the antimeridian."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for entity, rings in zip(batch["entity"], batch["rings"], strict=True):
                parts = [p for r in rings for p in split_antimeridian([(v["lon"], v["lat"]) for v in r])]
                parts = [p for p in (rounded_ring(r, digits) for r in kept_parts(parts, least)) if p]
                shape = {"type": "MultiPolygon", "coordinates": [[[list(v) for v in [*p, p[0]]]] for p in parts]}
                out.append(json.dumps({"type": "Feature", "id": int(entity), "geometry": shape}, separators=(",", ":")))
            yield pd.DataFrame({"entity": batch["entity"], "feature": out})

    return rows.select("entity", "rings").mapInPandas(features, "entity long, feature string")


def representative_points(rows: DataFrame) -> DataFrame:
    """entity, lon, lat: the mean vertex of the ring with most vertices, without leaving the SQL engine."""
    ring = F.reduce("rings", F.col("rings")[0], lambda a, b: F.when(F.size(b) > F.size(a), b).otherwise(a))
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[f]) / F.size(ring)
    return rows.select("entity", mean("lon").alias("lon"), mean("lat").alias("lat"))
