"""Well-known binary geometry in numpy, for use inside tasks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)


def strip_gp_header(blob: bytes | None) -> bytes | None:
    """Geometry bytes without the geopackage header; null for an empty geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    flags = blob[3]
    if flags & 0x10:
        return None
    envelope = (0, 32, 48, 48, 64)[(flags >> 1) & 0x07]
    return blob[8 + envelope :]


def parts_of(wkb: bytes) -> list[tuple[int, list[np.ndarray]]]:
    """Simple members of a geometry: ``(kind, rings)``, each ring an ``n x 2`` array."""
    found: list[tuple[int, list[np.ndarray]]] = []

    def read(at: int) -> int:
        order = "<" if wkb[at] == 1 else ">"
        code = struct.unpack_from(order + "I", wkb, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4
        extra = (1 if code & 0x80000000 else 0) + (1 if code & 0x40000000 else 0)
        code &= 0x0FFFFFFF
        extra += (0, 1, 1, 2)[code // 1000]
        kind, width = code % 1000, 2 + extra

        def points(at: int, n: int) -> tuple[np.ndarray, int]:
            flat = np.frombuffer(wkb, dtype=order + "f8", count=n * width, offset=at)
            return flat.reshape(n, width)[:, :2].astype("f8"), at + 8 * n * width

        def count(at: int) -> tuple[int, int]:
            return struct.unpack_from(order + "I", wkb, at)[0], at + 4

        if kind == POINT:
            xy, at = points(at, 1)
            if not np.isnan(xy).any():
                found.append((kind, [xy]))
        elif kind == LINE:
            n, at = count(at)
            xy, at = points(at, n)
            found.append((kind, [xy]))
        elif kind == POLYGON:
            rings, at = count(at)
            shape = []
            for _ in range(rings):
                n, at = count(at)
                xy, at = points(at, n)
                shape.append(xy)
            found.append((kind, shape))
        elif kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION):
            members, at = count(at)
            for _ in range(members):
                at = read(at)
        else:
            raise ValueError(f"geometry kind {kind} is not supported")
        return at

    read(0)
    return found


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian polygon."""
    body = struct.pack("<BII", 1, POLYGON, len(rings))
    for ring in rings:
        body += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *xy) for xy in ring)
    return body


def line_wkb(points: list[tuple[float, float]]) -> bytes:
    """Little-endian line."""
    return struct.pack("<BII", 1, LINE, len(points)) + b"".join(struct.pack("<dd", *xy) for xy in points)


def multi_line_wkb(lines: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian multi line."""
    return struct.pack("<BII", 1, MULTI_LINE, len(lines)) + b"".join(line_wkb(line) for line in lines)


BOX = "struct<min_x: double, min_y: double, max_x: double, max_y: double>"


def wkb_box(geometry: Column | str) -> Column:
    """Bounding box of a geometry column; null for a missing or empty geometry."""

    @F.pandas_udf(BOX)
    def box(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            rings = [] if blob is None else [r for _, shape in parts_of(bytes(blob)) for r in shape if len(r)]
            if rings:
                xy = np.concatenate(rings)
                rows.append((*xy.min(axis=0), *xy.max(axis=0)))
            else:
                rows.append((None,) * 4)
        return pd.DataFrame(rows, columns=["min_x", "min_y", "max_x", "max_y"], dtype="float64")

    return box(geometry)
