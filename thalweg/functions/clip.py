"""Cutting line segments at polygons in numpy, for use inside tasks."""

from __future__ import annotations

import struct
from typing import Iterator

import numpy as np
import pyarrow as pa

from .wkb import MULTI_LINE, POLYGON, parts_of

#: Numbers in a table of crossings, rows of one step of the search, pieces that lie in memory before lines are put together.
TABLE, AT_ONCE, PIECES = 1 << 14, 1 << 14, 100_000


def ranges(low: np.ndarray, count: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All numbers of the ranges ``low, low + 1, ...`` with the index of their range, some at a time."""
    stop = np.cumsum(count)
    start = stop - count
    total = int(stop[-1]) if len(stop) else 0
    for first in range(0, total, at_once):
        last = min(first + at_once, total)
        a, b = np.searchsorted(stop, first, side="right"), np.searchsorted(stop, last - 1, side="right") + 1
        n = np.minimum(stop[a:b], last) - np.maximum(start[a:b], first)
        yield np.repeat(np.arange(a, b), n), np.arange(first, last) - np.repeat(start[a:b] - low[a:b], n)


def polygon_edges(blobs: pa.Array) -> tuple[np.ndarray, ...]:
    """All polygons of some geometries: owner, number of edges, box and whether rings close; by edge ``x, y, dx, dy``.

    Polygons without edges are left out, and geometries with a coordinate that is no number.
    """
    n = len(blobs)
    blobs = blobs.cast(pa.binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int32, n + 1, 4 * blobs.offset).astype(np.int64)
    data = np.frombuffer(blobs.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    owners, counts, boxes, closed, edges = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 4))], [np.empty(0, bool)], [np.empty((0, 4))]
    rest = np.ones(n, bool)
    for size in np.unique(sizes).tolist():
        corners, odd = divmod(size - 13, 16)
        if odd or corners < 2:
            continue
        # simple polygons of as many corners are read at one time
        head = np.frombuffer(struct.pack("<BIII", 1, POLYGON, 1, corners), np.uint8)
        alike, some = np.flatnonzero(sizes == size), max(1, 2_000_000 // size)
        for at in range(0, len(alike), some):
            rows = alike[at : at + some]
            taken = data[offsets[rows][:, None] + np.arange(size)]
            plain = (taken[:, :13] == head).all(axis=1)
            rest[rows[plain]] = False
            ring = np.ascontiguousarray(taken[plain, 13:]).view("<f8").reshape(-1, corners, 2)
            sound = np.isfinite(ring).all(axis=(1, 2))
            ring, rows = ring[sound], rows[plain][sound]
            owners.append(rows)
            counts.append(np.full(len(rows), corners - 1))
            boxes.append(np.concatenate([ring.min(axis=1), ring.max(axis=1)], axis=1))
            closed.append((ring[:, 0] == ring[:, -1]).all(axis=1))
            edges.append(np.concatenate([ring[:, :-1], np.diff(ring, axis=1)], axis=2).reshape(-1, 4))
    for row in np.flatnonzero(rest).tolist():
        members = parts_of(blobs[row].as_py())
        if not all(np.isfinite(ring).all() for _, rings in members for ring in rings):
            continue
        for kind, rings in members:
            rings = [ring for ring in rings if kind == POLYGON and len(ring) > 1]
            if rings:
                corners = np.concatenate(rings)
                owners.append(np.array([row]))
                counts.append(np.array([len(corners) - len(rings)]))
                boxes.append(np.concatenate([corners.min(axis=0), corners.max(axis=0)])[None])
                closed.append(np.array([all((ring[0] == ring[-1]).all() for ring in rings)]))
                edges.extend(np.c_[ring[:-1], np.diff(ring, axis=0)] for ring in rings)
    return tuple(np.concatenate(c) for c in (owners, counts, boxes, closed, edges))


class Polygons:
    """Polygons in grids by size, each in the cell of its middle, to cut segments at them.

    Cells of a grid are numbered by rows, and its polygons lie in that order:
    what a segment meets in a row of cells is a range.
    """

    def __init__(self, blobs: pa.ChunkedArray, least: float) -> None:
        found, before = [], 0
        for chunk in blobs.chunks:
            owners, *others = polygon_edges(chunk)
            found.append((owners + before, *others))
            before += len(chunk)
        # tables of edges are large: no more than two copies at one time
        columns = [list(c) for c in zip(*found)]
        found.clear()
        owners, counts, box, closed = (np.concatenate(c) for c in columns[:4])
        edges = [np.concatenate([c[:, i] for c in columns[4]]) for i in range(4)]
        del columns
        self.levels, self.far = [], 0.0
        if not len(counts):
            return
        first = np.cumsum(counts) - counts
        box = [np.ascontiguousarray(c) for c in box.T]
        middle = [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]
        half = [(box[2] - box[0]) / 2, (box[3] - box[1]) / 2]
        size = np.maximum(np.maximum(half[0], half[1]) * 2, least)
        extent = max(box[2].max() - box[0].min(), box[3].max() - box[1].min())
        level = np.ceil(np.log(np.maximum(size, extent * 2.0**-30)) / np.log(4.0)).astype(np.int64)
        order, grids, start = [], [], 0
        for n in np.unique(level).tolist():
            rows, w = np.flatnonzero(level == n), 4.0**n
            ox, oy = middle[0][rows].min(), middle[1][rows].min()
            cx, cy = (((middle[i][rows] - o) / w).astype(np.int64) for i, o in ((0, ox), (1, oy)))
            columns = int(cx.max()) + 1
            code = cy * columns + cx
            sort = np.argsort(code, kind="stable")
            order.append(rows[sort])
            code = code[sort]
            cells = (int(cy.max()) + 1) * columns
            # small grids are looked up, sparse ones are searched
            dense = np.searchsorted(code, np.arange(cells + 1)) + start if cells <= 4 * len(rows) + 1000 else None
            per_cell = len(rows) / (1 + np.count_nonzero(np.diff(code)))
            grids.append((w, ox, oy, columns, np.unique(cy), code, dense, half[0][rows].max(), half[1][rows].max(), start, per_cell))
            start += len(rows)
        order = np.concatenate(order)
        self.levels, self.owner = grids, owners[order]
        self.box, self.middle = [b[order] for b in box], [m[order] for m in middle]
        self.closed, self.first, self.count = closed[order], first[order], counts[order]
        self.far = float(np.abs(box).max())
        # tables of crossings are a little wider than the polygon needs, so that few sizes occur
        self.table = (1 << np.ceil(np.log2(np.maximum(self.count, 4))).astype(np.int64)) if counts.min() < counts.max() else self.count
        self.padded = bool((self.table != self.count).any())
        self.edges = []
        while edges:
            column = edges.pop(0)
            self.edges.append(column if self.padded else column.reshape(len(order), -1)[order])

    def slack(self, segments: np.ndarray) -> np.ndarray:
        return 8 * np.spacing(np.maximum(np.abs(segments).max(axis=1), self.far))

    def _rows(self, grid: tuple, segments: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row of cells that may hold what a segment meets, among those in use, and how many there are."""
        w, _, oy, _, used, _, _, _, high = grid[:9]
        y1, y2 = segments[:, 1], segments[:, 3]
        low = np.searchsorted(used, np.floor((np.minimum(y1, y2) - high - slack - oy) / w))
        stop = np.searchsorted(used, np.floor((np.maximum(y1, y2) + high + slack - oy) / w), side="right")
        return low, np.maximum(stop - low, 0)

    def weights(self, segments: np.ndarray) -> np.ndarray:
        """About how many polygons each segment meets."""
        total, slack = np.zeros(len(segments)), self.slack(segments)
        for grid in self.levels:
            many = self._rows(grid, segments, slack)[1]
            wide = np.minimum(np.abs(segments[:, 2] - segments[:, 0]) / grid[0], grid[3])
            total += np.where(many > 0, many + wide, 0) * grid[10]
        return total

    def _pairs(self, segments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Segments and polygons whose box they cross or touch, each pair once."""
        x1, y1, x2, y2 = (np.ascontiguousarray(c) for c in segments.T)
        dx, dy, slack = x2 - x1, y2 - y1, self.slack(segments)
        low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        long_x, long_y, level, down = np.abs(dx), np.abs(dy), dy == 0, dy < 0
        for grid in self.levels:
            w, ox, oy, columns, used, code, dense, wide, high, start, _ = grid
            low, many = self._rows(grid, segments, slack)
            for seg, at in ranges(low, many):
                # rows in the segment's own direction, so that stretches mostly come in order
                row = used[np.where(down[seg], 2 * low[seg] + many[seg] - 1 - at, at)]
                near = slack[seg]
                bottom = oy + row * w - (high + near)
                top = bottom + w + 2 * (high + near)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    a, b = (bottom - y1[seg]) / dy[seg], (top - y1[seg]) / dy[seg]
                flat = level[seg]
                a, b = np.clip(np.where(flat, 0, np.minimum(a, b)), 0, 1), np.clip(np.where(flat, 1, np.maximum(a, b)), 0, 1)
                a, b = x1[seg] + dx[seg] * a, x1[seg] + dx[seg] * b
                c0 = np.clip(np.floor((np.minimum(a, b) - wide - near - ox) / w), 0, columns).astype(np.int64)
                c1 = np.clip(np.floor((np.maximum(a, b) + wide + near - ox) / w), -1, columns - 1).astype(np.int64)
                if dense is not None:
                    p0, p1 = dense[row * columns + c0], dense[row * columns + c1 + 1]
                else:
                    p0 = np.searchsorted(code, row * columns + c0) + start
                    p1 = np.searchsorted(code, row * columns + c1 + 1) + start
                for index, p in ranges(p0, np.maximum(p1 - p0, 0)):
                    s = seg[index]
                    b0, b1, b2, b3 = (b.take(p) for b in self.box)
                    touch = (low_x[s] <= b2) & (high_x[s] >= b0) & (low_y[s] <= b3) & (high_y[s] >= b1)
                    s, p, b0, b1, b2, b3 = s[touch], p[touch], b0[touch], b1[touch], b2[touch], b3[touch]
                    off_x, off_y = self.middle[0][p] - x1[s], self.middle[1][p] - y1[s]
                    lx, ly = long_x[s], long_y[s]
                    reach = (lx * (b3 - b1) + ly * (b2 - b0)) / 2
                    kind = reach + (reach + lx * np.abs(off_y) + ly * np.abs(off_x)) * 1e-9
                    near = np.abs(dx[s] * off_y - dy[s] * off_x) <= kind
                    yield s[near], p[near]

    def _edges(self, p: np.ndarray, width: int) -> list[np.ndarray]:
        """Edges of polygons as rows of a table ``width`` wide; what is left over is no number."""
        if not self.padded:
            return [c.take(p, axis=0) for c in self.edges]
        place, many = np.arange(width), self.count[p][:, None]
        at = self.first[p][:, None] + np.minimum(place, many - 1)
        return [np.where(place < many, c[at], np.nan) for c in self.edges]

    def _cut(self, segments: np.ndarray, s: np.ndarray, p: np.ndarray, width: int, few: int) -> tuple[np.ndarray, ...]:
        """Stretches of segments that lie in a polygon: indices of the two, and two fractions of the segment's length.

        Each segment is cut at its crossings with the polygon's edges, and at the
        ends of edges that run along it; a stretch belongs to the polygon if its
        middle does.
        """
        x1, y1, x2, y2 = segments[s].T
        sx, sy = (x2 - x1)[:, None], (y2 - y1)[:, None]
        ax, ay, ex, ey = self._edges(p, width)
        ox, oy = ax - x1[:, None], ay - y1[:, None]
        cross = sx * ey - sy * ex
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t, u = (ox * ey - oy * ex) / cross, (ox * sy - oy * sx) / cross
        cuts = np.where((cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t, 1.0)
        beside = cross == 0
        if beside.any():
            square = np.maximum(sx**2 + sy**2, 1e-300)
            beside &= np.abs(sx * oy - sy * ox) <= 1e-12 * square
            ends = [(ox * sx + oy * sy) / square, ((ox + ex) * sx + (oy + ey) * sy) / square]
            cuts = np.concatenate([cuts, *[np.where(beside & (v > 0) & (v < 1), v, 1.0) for v in ends]], axis=1)
        cuts.sort(axis=1)
        cuts = cuts[:, : int((cuts < 1).sum(axis=1).max())]
        t0 = np.concatenate([np.zeros((len(s), 1)), cuts], axis=1)
        t1 = np.concatenate([cuts, np.ones((len(s), 1))], axis=1)
        middle = (t0 + t1) / 2
        mx, my = x1[:, None] + sx * middle, y1[:, None] + sy * middle
        b0, b1, b2, b3 = (b[p][:, None] for b in self.box)
        slack = 1e-9 * (b2 - b0 + b3 - b1) + 8 * np.spacing(self.far)
        near = (mx >= b0 - slack) & (mx <= b2 + slack) & (my >= b1 - slack) & (my <= b3 + slack)
        index, piece = np.nonzero((t1 > t0) & (near | ~self.closed[p][:, None]))
        t0, t1, mx, my = (c[index, piece] for c in (t0, t1, mx, my))
        inside = np.zeros(len(index), bool)
        for at in range(0, len(index), few):
            some = slice(at, at + few)
            inside[some] = self._inside(p[index[some]], mx[some, None], my[some, None], width)
        index = index[inside]
        return s[index], p[index], t0[inside], t1[inside]

    def _inside(self, p: np.ndarray, mx: np.ndarray, my: np.ndarray, width: int) -> np.ndarray:
        """Do points lie in their polygons or on an edge?"""
        ax, ay, ex, ey = self._edges(p, width)
        bx, by = ax + ex, ay + ey
        with np.errstate(divide="ignore", invalid="ignore"):
            left_of = mx < ax + (my - ay) * ex / ey
        inside = (((ay > my) != (by > my)) & left_of).sum(axis=1) % 2 == 1
        rest = np.flatnonzero(~inside)
        if len(rest):
            ax, ay, ex, ey, bx, by, mx, my = (c[rest] for c in (ax, ay, ex, ey, bx, by, mx, my))
            inside[rest] = (
                (np.minimum(ax, bx) <= mx) & (mx <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= my)
                & (my <= np.maximum(ay, by)) & (np.abs(ex * (my - ay) - ey * (mx - ax)) <= 1e-12)
            ).any(axis=1)
        return inside

    def inside(self, segments: np.ndarray, chunk: int) -> tuple[np.ndarray, ...]:
        """All stretches of segments that lie in polygons: segment, owner of the polygon, two fractions."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        for s, p in self._pairs(segments):
            tables = self.table[p]
            for width in np.unique(tables).tolist() if self.padded else tables[:1].tolist():
                alike = np.flatnonzero(tables == width)
                few = max(1, min(chunk, TABLE // width))
                for at in range(0, len(alike), few):
                    some = alike[at : at + few]
                    seg, polygon, t0, t1 = self._cut(segments, s[some], p[some], width, few)
                    found.append((seg, self.owner[polygon], t0, t1))
        return tuple(np.concatenate(c) for c in zip(*found))


def _in_order(key: np.ndarray, place: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """The order by all four; stretches of a place mostly come in order."""
    places = int(place.max()) + 1
    if places * (int(key.max()) + 1) >= 1 << 62:
        return np.lexsort((t1, t0, place, key))
    code = key * places + place
    order = np.argsort(code, kind="stable")
    at, a, b = code[order], t0[order], t1[order]
    new = at[1:] != at[:-1]
    back = ~new & ((a[1:] < a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] < b[:-1])))
    if back.any():
        group = np.concatenate([[0], np.cumsum(new)])
        wrong = np.zeros(int(group[-1]) + 1, bool)
        wrong[group[1:][back]] = True
        rows = np.flatnonzero(wrong[group])
        some = order[rows]
        order[rows] = some[np.lexsort((t1[some], t0[some], code[some]))]
    return order


def rebuilt(
    key: np.ndarray, segment: np.ndarray, t0: np.ndarray, t1: np.ndarray, places: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys in order, and of each the length and the lines of its stretches.

    Overlaps count once, stretches that touch are one line.  A segment's place
    orders those of a key, and grows by one between those that follow each other.
    """
    n = len(key)
    if not n:
        return key, np.empty(0), pa.array([], pa.binary())
    order = _in_order(key, places[segment], t0, t1)
    key, segment, t0, t1 = key[order], segment[order], t0[order], t1[order]
    place, ends = places[segment], ends[segment]
    same = np.zeros(n, bool)
    same[1:] = (key[1:] == key[:-1]) & (place[1:] == place[:-1])
    last = np.concatenate([[0.0], t1[:-1]])
    if (same & (t0 < last)).any():
        # the farthest end so far within a segment
        known, rank = np.unique(t1, return_inverse=True)
        group = np.cumsum(~same)
        farthest = np.maximum.accumulate(group * len(known) + rank) - group * len(known)
        last = np.concatenate([[0.0], known[farthest][:-1]])
    begin = np.where(same, np.maximum(t0, last), t0)
    kept = t1 > begin
    if not kept.all():
        key, place, same, last, begin, t1, ends = (c[kept] for c in (key, place, same, last, begin, t1, ends))
        n = len(key)
    x1, y1, x2, y2 = ends.T
    sx, sy = x2 - x1, y2 - y1
    start = np.column_stack([x1 + sx * begin, y1 + sy * begin])
    stop = np.column_stack([x1 + sx * t1, y1 + sy * t1])
    longer = same & (last == begin)
    after = np.zeros(n, bool)
    after[1:] = (key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1) & (t1[:-1] == 1.0)
    after &= ~longer & (begin == 0.0)
    opens = ~longer & ~after
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    keys = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    length = np.bincount(keys, np.hypot(stop[:, 0] - start[:, 0], stop[:, 1] - start[:, 1]), len(heads))
    # a stretch gives its start, if it opens a line, and its end, unless the next one goes on from there
    ending = np.concatenate([~longer[1:], [True]])
    shown = np.column_stack([opens, ending])
    points = np.stack([start, stop], axis=1)[shown]
    line = np.flatnonzero(opens)
    corners = np.add.reduceat(shown.sum(axis=1), line)
    lines = np.bincount(keys[line], minlength=len(heads))
    bytes_of_line = 9 + 16 * corners
    bytes_of_key = 9 + np.bincount(keys[line], bytes_of_line, len(heads)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bytes_of_key)])
    line_at = np.cumsum(bytes_of_line) - bytes_of_line + 9 * (keys[line] + 1)

    def header(kind: int, many: np.ndarray) -> np.ndarray:
        head = np.empty(len(many), [("order", "u1"), ("kind", "<u4"), ("many", "<u4")])
        head["order"], head["kind"], head["many"] = 1, kind, many
        return head.view(np.uint8).reshape(-1, 9)

    data, free = np.empty(int(offsets[-1]), np.uint8), np.ones(int(offsets[-1]), bool)
    for at, head in ((offsets[:-1], header(MULTI_LINE, lines)), (line_at, header(2, corners))):
        at = at[:, None] + np.arange(9)
        data[at] = head
        free[at] = False
    data[free] = points.astype("<f8").view(np.uint8).ravel()
    geoms = pa.Array.from_buffers(
        pa.binary(), len(heads), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    )
    return key[heads], length, geoms
