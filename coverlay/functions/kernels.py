"""Vectorised geometry kernels: numpy over the Arrow buffers of one batch.

Spark decides which rows meet (cells, joins, shuffles); these functions only do the exact
arithmetic on the rows of a batch.  Nothing here loops over rows except tiling, which runs
on the zones alone.

Zone edges travel as ``binary``: four little-endian doubles per edge, copied as one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from coverlay.functions import geodesy

OUTSIDE, INSIDE, BOUNDARY = 0, 1, -1

# Parameter ranges shorter than this are rounding noise, not length.
T_NOISE = 1e-12
# Candidate combinations evaluated at once; bounds the memory of a batch.
BLOCK = 2_000_000


# --- ragged helpers -------------------------------------------------------------------------


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype("float64", copy=False)


def _flags(array: pa.Array) -> np.ndarray:
    return array.fill_null(False).to_numpy(zero_copy_only=False).astype(bool, copy=False)


def _offsets(lists: pa.Array) -> np.ndarray:
    """List offsets; an empty list array may come without an offset buffer at all."""
    return lists.offsets.to_numpy().astype("int64") if len(lists) else np.zeros(1, dtype="int64")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + counts[i] - 1`` for all i, concatenated."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype="int64")
    begin = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return begin + np.arange(total)


def _products(a_start, a_count, b_start, b_count):
    """All (row, a, b) index combinations per row."""
    size = a_count * b_count
    row = np.repeat(np.arange(len(size)), size)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    width = np.maximum(b_count, 1)[row]
    return row, a_start[row] + k // width, b_start[row] + k % width


def _blocks(size: np.ndarray):
    """Row slices whose combinations stay near ``BLOCK``."""
    group = np.cumsum(size) // BLOCK
    edges = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *edges.tolist(), len(size)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def _edges(blob: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge table (n x 4) plus start and count per row."""
    if len(blob) == 0:
        return np.zeros((0, 4)), np.zeros(0, "int64"), np.zeros(0, "int64")
    blob = blob.fill_null(b"")
    width = "int64" if pa.types.is_large_binary(blob.type) else "int32"
    offsets = np.frombuffer(blob.buffers()[1], dtype=width)[blob.offset : blob.offset + len(blob) + 1]
    data = blob.buffers()[2]
    raw = np.frombuffer(data, dtype="uint8")[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, "uint8")
    table = raw.view("float64").reshape(-1, 4) if raw.ctypes.data % 8 == 0 else raw.copy().view("float64").reshape(-1, 4)
    start = (offsets[:-1] - offsets[0]) // 32
    return table, start.astype("int64"), (np.diff(offsets) // 32).astype("int64")


class Shapes:
    """Flat view of a geometry column: coordinates plus offsets per ring, part and row."""

    def __init__(self, geom: pa.StructArray):
        parts = geom.field("parts")
        rings = parts.values
        points = rings.values
        ring_points = points.values
        self.valid = ~geom.is_null().to_numpy(zero_copy_only=False)
        self.kind = geom.field("kind")
        self.x = _numbers(ring_points.field("x"))
        self.y = _numbers(ring_points.field("y"))
        self.row_parts = _offsets(parts)
        self.part_rings = _offsets(rings)
        self.ring_points = _offsets(points)
        row_rings = self.part_rings[self.row_parts]
        self.row_points = self.ring_points[row_rings]
        self.rows = len(geom)
        self.ring_row = np.repeat(np.arange(self.rows), np.diff(row_rings))
        self.first_ring = row_rings[0] if len(row_rings) else 0
        self.ring_count = len(self.ring_row)

    def hole(self) -> np.ndarray:
        """True for every ring that is not the first of its part."""
        is_hole = np.ones(self.ring_count, dtype=bool)
        used = self.part_rings[self.row_parts[0] : self.row_parts[-1] + 1]
        starts = used[:-1][np.diff(used) > 0] - self.first_ring
        is_hole[starts] = False
        return is_hole

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edge table, ring index and row index of every edge, in order."""
        span = self.ring_points[self.first_ring : self.first_ring + self.ring_count + 1]
        count = np.maximum(np.diff(span) - 1, 0)
        i = _ranges(span[:-1], count)
        ring = np.repeat(np.arange(self.ring_count), count)
        table = np.column_stack([self.x[i], self.y[i], self.x[i + 1], self.y[i + 1]]) if len(i) else np.zeros((0, 4))
        return table, ring, self.ring_row[ring]


# --- measures -------------------------------------------------------------------------------


def measures(geom: pa.Array, projected: bool, back: bool) -> pa.Array:
    """Bounds, vertex count, area, edge length and centroid of every geometry.

    ``projected`` measures in the equal-area plane; ``back`` returns the centroid as lon/lat.
    """
    s = Shapes(geom)
    if projected:
        s.x, s.y = geodesy.project(np, s.x, s.y)
    rows = s.rows
    n = np.diff(s.row_points)
    has = n > 0
    nan = np.full(rows, np.nan)
    low_x, low_y, high_x, high_y = (nan.copy() for _ in range(4))
    origin_x, origin_y = nan.copy(), nan.copy()
    if has.any():
        begin = s.row_points[:-1][has]
        x, y = s.x[: s.row_points[-1]], s.y[: s.row_points[-1]]
        low_x[has], high_x[has] = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
        low_y[has], high_y[has] = np.minimum.reduceat(y, begin), np.maximum.reduceat(y, begin)
        origin_x[has], origin_y[has] = x[begin], y[begin]
    seg, ring, row = s.segments()
    # Coordinates relative to the first vertex: projected values are large and the plain
    # shoelace sum would lose half its digits.
    ax, ay = seg[:, 0] - origin_x[row], seg[:, 1] - origin_y[row]
    bx, by = seg[:, 2] - origin_x[row], seg[:, 3] - origin_y[row]
    cross = ax * by - bx * ay
    rings = s.ring_count
    twice = np.bincount(ring, cross, rings)
    sign = np.where(s.hole(), -1.0, 1.0) * np.sign(twice)
    total = np.bincount(s.ring_row, sign * twice, rows)
    mx = np.bincount(s.ring_row, sign * np.bincount(ring, (ax + bx) * cross, rings), rows)
    my = np.bincount(s.ring_row, sign * np.bincount(ring, (ay + by) * cross, rings), rows)
    length = np.bincount(row, np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1]), rows)
    flat = total > 0
    centre_x, centre_y = nan.copy(), nan.copy()
    centre_x[flat] = origin_x[flat] + mx[flat] / (3 * total[flat])
    centre_y[flat] = origin_y[flat] + my[flat] / (3 * total[flat])
    # Without area the centroid is that of the path, and of a lone point the point itself.
    weight = np.hypot(bx - ax, by - ay)
    path = ~flat & (length > 0)
    centre_x[path] = origin_x[path] + np.bincount(row, weight * (ax + bx) / 2, rows)[path] / length[path]
    centre_y[path] = origin_y[path] + np.bincount(row, weight * (ay + by) / 2, rows)[path] / length[path]
    single = ~flat & ~path & has
    centre_x[single], centre_y[single] = origin_x[single], origin_y[single]
    if back:
        centre_x, centre_y = geodesy.unproject(np, centre_x, centre_y)

    def column(values: np.ndarray, known: np.ndarray) -> pa.Array:
        return pa.array(values, type=pa.float64(), mask=~(known & s.valid))

    fields = {
        "xmin": column(low_x, has),
        "ymin": column(low_y, has),
        "xmax": column(high_x, has),
        "ymax": column(high_y, has),
        "n_points": pa.array(n.astype("int32"), mask=~s.valid),
        "area": column(total / 2, s.valid),
        "length": column(length, s.valid),
        "cx": column(centre_x, has),
        "cy": column(centre_y, has),
    }
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


# --- point location -------------------------------------------------------------------------


def _side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positive when the point is left of the edge, zero when on its line."""
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (x - e[:, 0]) * (e[:, 3] - e[:, 1])


def _in_box(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (
        (x >= np.minimum(e[:, 0], e[:, 2]))
        & (x <= np.maximum(e[:, 0], e[:, 2]))
        & (y >= np.minimum(e[:, 1], e[:, 3]))
        & (y <= np.maximum(e[:, 1], e[:, 3]))
    )


def _locate(x, y, table, start, count, parity) -> np.ndarray:
    """INSIDE, OUTSIDE or BOUNDARY per point, counting edges crossed on the way to +x."""
    result = np.zeros(len(x), dtype="int32")
    for a, b in _blocks(count):
        here = slice(a, b)
        idx = _ranges(start[here], count[here])
        row = np.repeat(np.arange(b - a), count[here])
        e, px, py = table[idx], x[here][row], y[here][row]
        side = _side(e, px, py)
        up = (e[:, 1] <= py) & (e[:, 3] > py) & (side > 0)
        down = (e[:, 1] > py) & (e[:, 3] <= py) & (side < 0)
        crossed = np.bincount(row, up | down, b - a).astype("int64") + parity[here]
        on = np.bincount(row, (side == 0) & _in_box(e, px, py), b - a) > 0
        result[here] = np.where(on, BOUNDARY, crossed % 2)
    return result


def locate_points(core: pa.Array, x: pa.Array, y: pa.Array, parity: pa.Array, blob: pa.Array) -> pa.Array:
    table, start, count = _edges(blob)
    where = _locate(_numbers(x), _numbers(y), table, start, count, _numbers(parity).astype("int64"))
    return pa.array(np.where(_flags(core), INSIDE, where).astype("int32"))


# --- polygons and lines against tile edges --------------------------------------------------


def _segments_touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where two closed segments share at least one point."""
    d1, d2 = _side(b, a[:, 0], a[:, 1]), _side(b, a[:, 2], a[:, 3])
    d3, d4 = _side(a, b[:, 0], b[:, 1]), _side(a, b[:, 2], b[:, 3])
    cross = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
    return (
        cross
        | ((d1 == 0) & _in_box(b, a[:, 0], a[:, 1]))
        | ((d2 == 0) & _in_box(b, a[:, 2], a[:, 3]))
        | ((d3 == 0) & _in_box(a, b[:, 0], b[:, 1]))
        | ((d4 == 0) & _in_box(a, b[:, 2], b[:, 3]))
    )


def _near(table, start, count, xmin, ymin, xmax, ymax):
    """Edges of each row whose box overlaps the row's box, as a new ragged table."""
    idx = _ranges(start, count)
    row = np.repeat(np.arange(len(start)), count)
    e = table[idx]
    keep = (
        (np.minimum(e[:, 0], e[:, 2]) <= xmax[row])
        & (np.maximum(e[:, 0], e[:, 2]) >= xmin[row])
        & (np.minimum(e[:, 1], e[:, 3]) <= ymax[row])
        & (np.maximum(e[:, 1], e[:, 3]) >= ymin[row])
    )
    n = np.bincount(row[keep], minlength=len(start))
    return e[keep], np.cumsum(n) - n, n


def _cell_box(cx: pa.Array, cy: pa.Array, size: float, margin: float):
    x, y = _numbers(cx), _numbers(cy)
    return x * size - margin, y * size - margin, (x + 1) * size + margin, (y + 1) * size + margin


def polygon_hits(geom, core, cx, cy, parity, blob, mx, my, size: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """``touches, centred``: what this cell can tell about a (polygon, zone) pair.

    A shared point is proved by a vertex of the polygon in this cell lying in the zone, a
    polygon edge meeting a zone edge, or a zone vertex lying in the polygon.  ``centred`` is
    true when the centroid ``mx, my`` (NaN: not asked for) is in this cell and zone.
    """
    s = Shapes(geom)
    is_core = _flags(core)
    table, start, count = _edges(blob)
    bx1, by1, bx2, by2 = _cell_box(cx, cy, size, margin)
    par = _numbers(parity).astype("int64")
    centred = np.zeros(s.rows, dtype=bool)
    if not np.isnan(mx).all():
        at = np.flatnonzero((np.floor(mx / size) == _numbers(cx)) & (np.floor(my / size) == _numbers(cy)))
        held = _locate(mx[at], my[at], table, start[at], count[at], par[at]) == INSIDE
        centred[at] = is_core[at] | held
    n = np.diff(s.row_points)
    row = np.repeat(np.arange(s.rows), n)
    x, y = s.x[s.row_points[0] : s.row_points[-1]], s.y[s.row_points[0] : s.row_points[-1]]
    here = (x >= bx1[row]) & (x <= bx2[row]) & (y >= by1[row]) & (y <= by2[row])
    row, x, y = row[here], x[here], y[here]
    where = np.where(is_core[row], INSIDE, _locate(x, y, table, start[row], count[row], par[row]))
    hit = np.bincount(row, where != OUTSIDE, s.rows) > 0

    open_rows = np.flatnonzero(~hit & ~is_core & (n > 0))
    if len(open_rows):
        seg, _, seg_row = s.segments()
        seg_count = np.bincount(seg_row, minlength=s.rows)
        seg_start = np.cumsum(seg_count) - seg_count
        box = _rowwise_bounds(s, open_rows)
        near, near_start, near_count = _near(table, start[open_rows], count[open_rows], *box)
        sizes = seg_count[open_rows] * near_count
        for a, b in _blocks(sizes):
            rows = open_rows[a:b]
            r, i, j = _products(seg_start[rows], seg_count[rows], near_start[a:b], near_count[a:b])
            touched = np.bincount(r, _segments_touch(seg[i], near[j]), b - a) > 0
            covered = _any_vertex_inside(near, near_start[a:b], near_count[a:b], seg, seg_start[rows], seg_count[rows])
            hit[rows] |= touched | covered
    return hit, centred


def _rowwise_bounds(s: Shapes, rows: np.ndarray):
    begin, end = s.row_points[:-1][rows], s.row_points[1:][rows]
    idx = _ranges(begin, end - begin)
    at = np.cumsum(end - begin) - (end - begin)
    x, y = s.x[idx], s.y[idx]
    return (
        np.minimum.reduceat(x, at),
        np.minimum.reduceat(y, at),
        np.maximum.reduceat(x, at),
        np.maximum.reduceat(y, at),
    )


def _any_vertex_inside(near, near_start, near_count, seg, seg_start, seg_count) -> np.ndarray:
    """Per row: is the start of any nearby zone edge inside the row's polygon?"""
    row = np.repeat(np.arange(len(near_start)), near_count)
    points = near[_ranges(near_start, near_count)]
    zero = np.zeros(len(row), dtype="int64")
    where = _locate(points[:, 0], points[:, 1], seg, seg_start[row], seg_count[row], zero)
    return np.bincount(row, where != OUTSIDE, len(near_start)) > 0


def _segment_table(x1, y1, x2, y2) -> np.ndarray:
    return np.column_stack([_numbers(x1), _numbers(y1), _numbers(x2), _numbers(y2)])


def line_hits(x1, y1, x2, y2, core, cx, cy, parity, blob, size: float, margin: float) -> pa.Array:
    """Does the segment share a point with the zone, as far as this cell can tell?"""
    seg = _segment_table(x1, y1, x2, y2)
    table, start, count = _edges(blob)
    bx1, by1, bx2, by2 = _cell_box(cx, cy, size, margin)
    par = _numbers(parity).astype("int64")
    hit = _flags(core).copy()
    for px, py in ((seg[:, 0], seg[:, 1]), (seg[:, 2], seg[:, 3])):
        here = np.flatnonzero(~hit & (px >= bx1) & (px <= bx2) & (py >= by1) & (py <= by2))
        hit[here] = _locate(px[here], py[here], table, start[here], count[here], par[here]) != OUTSIDE
    rest = np.flatnonzero(~hit)
    for a, b in _blocks(count[rest]):
        rows = rest[a:b]
        idx = _ranges(start[rows], count[rows])
        r = np.repeat(np.arange(b - a), count[rows])
        hit[rows] = np.bincount(r, _segments_touch(seg[rows][r], table[idx]), b - a) > 0
    return pa.array(hit)


MEASURES = ("planar", "equal_area", "ellipsoid")


def _lengths(x1, y1, x2, y2, measure: str) -> np.ndarray:
    """Length of straight segments: in own units, or in metres for lon/lat input."""
    if measure == "planar":
        return np.hypot(x2 - x1, y2 - y1)
    if measure == "equal_area":
        (ax, ay), (bx, by) = geodesy.project(np, x1, y1), geodesy.project(np, x2, y2)
        return np.hypot(bx - ax, by - ay)
    return _vincenty(x1, y1, x2, y2)


def _span_lengths(seg: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int, measure: str) -> np.ndarray:
    """Total length per row of the given parameter ranges of its segment."""
    s = seg[row]
    d = s[:, 2:] - s[:, :2]
    # the far end is taken as stored, so a whole segment has exactly its own length
    end = b == 1.0
    x2 = np.where(end, s[:, 2], s[:, 0] + b * d[:, 0])
    y2 = np.where(end, s[:, 3], s[:, 1] + b * d[:, 1])
    length = _lengths(s[:, 0] + a * d[:, 0], s[:, 1] + a * d[:, 1], x2, y2, measure)
    return np.bincount(row, length, rows)


def span_lengths(x1, y1, x2, y2, spans: pa.Array, measure: str) -> pa.Array:
    """Length of a list of parameter ranges of each segment."""
    offsets = _offsets(spans)
    values = spans.values
    row = np.repeat(np.arange(len(spans)), np.diff(offsets))
    here = slice(offsets[0], offsets[-1])
    a, b = _numbers(values.field("ta"))[here], _numbers(values.field("tb"))[here]
    return pa.array(_span_lengths(_segment_table(x1, y1, x2, y2), row, a, b, len(spans), measure))


def clip_spans(x1, y1, x2, y2, lo, hi, core, parity, blob, measure: str | None = None) -> pa.Array:
    """Parameter ranges of each segment, within [lo, hi], that lie in the closed zone.

    With a ``measure`` the result is ``struct<spans, length>``.

    The range is cut at every edge crossing; a piece counts when its midpoint is inside or
    when an edge runs along it, so a line on a shared border belongs to both zones.
    """
    seg = _segment_table(x1, y1, x2, y2)
    low, high = _numbers(lo), _numbers(hi)
    is_core = _flags(core)
    table, start, count = _edges(blob)
    count = np.where(is_core, 0, count)
    par = _numbers(parity).astype("int64")
    rows = len(seg)
    d = seg[:, 2:] - seg[:, :2]

    near, near_start, near_count = _near(
        table,
        start,
        count,
        np.minimum(seg[:, 0], seg[:, 2]),
        np.minimum(seg[:, 1], seg[:, 3]),
        np.maximum(seg[:, 0], seg[:, 2]),
        np.maximum(seg[:, 1], seg[:, 3]),
    )
    row = np.repeat(np.arange(rows), near_count)
    s = seg[row]
    dx, dy = d[row, 0], d[row, 1]
    ex, ey = near[:, 2] - near[:, 0], near[:, 3] - near[:, 1]
    along = (_side(s, near[:, 0], near[:, 1]) == 0) & (_side(s, near[:, 2], near[:, 3]) == 0)
    length2 = dx * dx + dy * dy
    ta = ((near[:, 0] - s[:, 0]) * dx + (near[:, 1] - s[:, 1]) * dy) / length2
    tb = ((near[:, 2] - s[:, 0]) * dx + (near[:, 3] - s[:, 1]) * dy) / length2
    turn = dx * ey - dy * ex
    cut = ((near[:, 0] - s[:, 0]) * ey - (near[:, 1] - s[:, 1]) * ex) / np.where(turn != 0, turn, 1.0)

    every = np.arange(rows)
    stop_row = np.concatenate([every, every, row[along], row[along], row[~along & (turn != 0)]])
    stop_t = np.concatenate([low, high, ta[along], tb[along], cut[~along & (turn != 0)]])
    ok = (stop_t >= low[stop_row]) & (stop_t <= high[stop_row])
    stop_row, stop_t = stop_row[ok], stop_t[ok]
    order = np.lexsort((stop_t, stop_row))
    stop_row, stop_t = stop_row[order], stop_t[order]
    joined = (stop_row[1:] == stop_row[:-1]) & (stop_t[1:] - stop_t[:-1] > 0)
    p_row, p_a, p_b = stop_row[:-1][joined], stop_t[:-1][joined], stop_t[1:][joined]

    mid = (p_a + p_b) / 2
    mx, my = seg[p_row, 0] + mid * d[p_row, 0], seg[p_row, 1] + mid * d[p_row, 1]
    where = np.where(is_core[p_row], INSIDE, _locate(mx, my, table, start[p_row], count[p_row], par[p_row]))
    keep = where != OUTSIDE
    if along.any():
        n = np.bincount(row[along], minlength=rows)
        first = np.cumsum(n) - n
        a_t, b_t = np.minimum(ta[along], tb[along]), np.maximum(ta[along], tb[along])
        r = np.repeat(np.arange(len(p_row)), n[p_row])
        j = _ranges(first[p_row], n[p_row])
        keep |= np.bincount(r, (a_t[j] <= mid[r]) & (mid[r] <= b_t[j]), len(p_row)) > 0
    keep &= (p_b - p_a > T_NOISE) | (is_core[p_row])
    p_row, p_a, p_b = p_row[keep], p_a[keep], p_b[keep]
    # Pieces that meet at a superfluous cut are one range.
    if len(p_row):
        fresh = np.ones(len(p_row), dtype=bool)
        fresh[1:] = (p_row[1:] != p_row[:-1]) | (p_a[1:] != p_b[:-1])
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(p_row) - 1)
        p_row, p_a, p_b = p_row[fresh], p_a[fresh], p_b[last]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(p_row, minlength=rows)))).astype("int32")
    spans = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(p_a), pa.array(p_b)], names=["ta", "tb"])
    )
    if measure is None:
        return spans
    length = _span_lengths(seg, p_row, p_a, p_b, rows, measure)
    return pa.StructArray.from_arrays([spans, pa.array(length)], names=["spans", "length"])


# --- tiling ---------------------------------------------------------------------------------


def tiles_of(geom: pa.Array, size: float, margin: float) -> pa.Array:
    """Tiles of every zone (see ``operators.tiling``)."""
    s = Shapes(geom)
    seg, _, row = s.segments()
    count = np.bincount(row, minlength=s.rows)
    start = np.cumsum(count) - count
    out: list[tuple] = []
    offsets = [0]
    for r in range(s.rows):
        if s.valid[r] and count[r]:
            _zone_tiles(seg[start[r] : start[r] + count[r]], size, margin, out)
        offsets.append(len(out))
    cx, cy, core, parity, edges = zip(*out) if out else ((), (), (), (), ())
    fields = [
        pa.array(cx, pa.int32()),
        pa.array(cy, pa.int32()),
        pa.array(core, pa.bool_()),
        pa.array(parity, pa.int32()),
        pa.array(edges, pa.binary()),
    ]
    items = pa.StructArray.from_arrays(fields, names=["cx", "cy", "core", "parity", "edges"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _zone_tiles(seg: np.ndarray, size: float, margin: float, out: list) -> None:
    low_x, high_x = np.minimum(seg[:, 0], seg[:, 2]), np.maximum(seg[:, 0], seg[:, 2])
    low_y, high_y = np.minimum(seg[:, 1], seg[:, 3]), np.maximum(seg[:, 1], seg[:, 3])
    cols = np.arange(np.floor((low_x.min() - margin) / size), np.floor((high_x.max() + margin) / size) + 1)
    bx1, bx2 = cols * size - margin, (cols + 1) * size + margin
    for cy in range(int(np.floor((low_y.min() - margin) / size)), int(np.floor((high_y.max() + margin) / size)) + 1):
        by1, by2 = cy * size - margin, (cy + 1) * size + margin
        in_row = (low_y <= by2) & (high_y >= by1)
        e, ex1, ex2 = seg[in_row], low_x[in_row], high_x[in_row]
        spans_row = (low_y[in_row] < by1) & (high_y[in_row] > by2)
        corners = [
            (e[:, 2:3] - e[:, 0:1]) * (by - e[:, 1:2]) - (bx[None, :] - e[:, 0:1]) * (e[:, 3:4] - e[:, 1:2])
            for bx in (bx1, bx2)
            for by in (by1, by2)
        ]
        one_side = (np.minimum.reduce(corners) > 0) | (np.maximum.reduce(corners) < 0)
        overlap = (ex1[:, None] <= bx2[None, :]) & (ex2[:, None] >= bx1[None, :])
        border = (overlap & ~one_side).any(axis=0)
        mid_y = (by1 + by2) / 2
        mid_x = (bx1 + bx2) / 2
        side = (e[:, 2:3] - e[:, 0:1]) * (mid_y - e[:, 1:2]) - (mid_x[None, :] - e[:, 0:1]) * (e[:, 3:4] - e[:, 1:2])
        up = ((e[:, 1] <= mid_y) & (e[:, 3] > mid_y))[:, None] & (side > 0)
        down = ((e[:, 1] > mid_y) & (e[:, 3] <= mid_y))[:, None] & (side < 0)
        inside = (up | down).sum(axis=0) % 2 == 1
        for k in np.flatnonzero(border | inside):
            if not border[k]:
                out.append((int(cols[k]), cy, True, 0, b""))
                continue
            by_all = spans_row & (ex1 > bx2[k])
            local = (ex2 >= bx1[k]) & ~by_all
            out.append((int(cols[k]), cy, False, int(by_all.sum()) % 2, np.ascontiguousarray(e[local]).tobytes()))


# --- ellipsoidal distance -------------------------------------------------------------------

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def ellipsoid_distance(lon1: pa.Array, lat1: pa.Array, lon2: pa.Array, lat2: pa.Array) -> pa.Array:
    metres = _vincenty(_numbers(lon1), _numbers(lat1), _numbers(lon2), _numbers(lat2))
    return pa.array(metres, mask=~np.isfinite(metres))


def _vincenty(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Geodesic length by Vincenty's inverse formula, iterated until every row settles."""
    if not len(lon1):
        return np.zeros(0)
    b = WGS84_A * (1 - WGS84_F)
    lam0 = np.radians(lon2 - lon1)
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lam0.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_sigma = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_sigma = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma > 0, c1 * c2 * sl / np.where(sin_sigma > 0, sin_sigma, 1), 0.0)
            cos2_alpha = 1 - sin_alpha**2
            cos_2m = np.where(cos2_alpha > 0, cos_sigma - 2 * s1 * s2 / np.where(cos2_alpha > 0, cos2_alpha, 1), 0.0)
            c = WGS84_F / 16 * cos2_alpha * (4 + WGS84_F * (4 - 3 * cos2_alpha))
            new = lam0 + (1 - c) * WGS84_F * sin_alpha * (
                sigma + c * sin_sigma * (cos_2m + c * cos_sigma * (2 * cos_2m**2 - 1))
            )
            settled = np.abs(new - lam) < 1e-13
            lam = new
            if np.all(settled | ~np.isfinite(new)):
                break
    u_sq = cos2_alpha * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    delta = big_b * sin_sigma * (
        cos_2m
        + big_b
        / 4
        * (
            cos_sigma * (2 * cos_2m**2 - 1)
            - big_b / 6 * cos_2m * (4 * sin_sigma**2 - 3) * (4 * cos_2m**2 - 3)
        )
    )
    return b * big_a * (sigma - delta)


# --- validity -------------------------------------------------------------------------------


def _sweep_pairs(e: np.ndarray):
    """Index pairs of edges whose boxes overlap, by sorting on x and widening one step at a time."""
    order = np.argsort(np.minimum(e[:, 0], e[:, 2]), kind="stable")
    low, high = np.minimum(e[:, 0], e[:, 2])[order], np.maximum(e[:, 0], e[:, 2])[order]
    y1, y2 = np.minimum(e[:, 1], e[:, 3])[order], np.maximum(e[:, 1], e[:, 3])[order]
    step = 1
    alive = np.arange(len(e) - 1)
    while len(alive):
        alive = alive[alive + step < len(e)]
        alive = alive[low[alive + step] <= high[alive]]
        meet = alive[(y1[alive] <= y2[alive + step]) & (y2[alive] >= y1[alive + step])]
        if len(meet):
            yield order[meet], order[meet + step]
        step += 1


def _overlap_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where two segments share more than a point (collinear overlap)."""
    line = (_side(a, b[:, 0], b[:, 1]) == 0) & (_side(a, b[:, 2], b[:, 3]) == 0)
    dx, dy = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]
    t1 = (b[:, 0] - a[:, 0]) * dx + (b[:, 1] - a[:, 1]) * dy
    t2 = (b[:, 2] - a[:, 0]) * dx + (b[:, 3] - a[:, 1]) * dy
    full = dx * dx + dy * dy
    return line & (np.minimum(np.maximum(t1, t2), full) - np.maximum(np.minimum(t1, t2), 0) > 0)


def _proper_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d1, d2 = _side(b, a[:, 0], a[:, 1]), _side(b, a[:, 2], a[:, 3])
    d3, d4 = _side(a, b[:, 0], b[:, 1]), _side(a, b[:, 2], b[:, 3])
    return (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)


def _polygon_reason(parts: list[list[np.ndarray]]) -> str | None:
    """First validity problem of a polygon given as parts of rings (n x 2), or None."""
    rings = [(p, k, ring) for p, part in enumerate(parts) for k, ring in enumerate(part)]
    for _, _, ring in rings:
        if not np.isfinite(ring).all():
            return "Invalid Coordinate"
        if len(ring) < 4:
            return "Too few points in geometry component"
        if (ring[0] != ring[-1]).any():
            return "Ring not closed"
    edges, owner, position, sizes = [], [], [], []
    for i, (_, _, ring) in enumerate(rings):
        e = np.column_stack([ring[:-1], ring[1:]])
        e = e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]
        if len(e) < 3:
            return "Too few points in geometry component"
        edges.append(e)
        owner.append(np.full(len(e), i))
        position.append(np.arange(len(e)))
        sizes.append(len(e))
    e, own, pos, size = np.vstack(edges), np.concatenate(owner), np.concatenate(position), np.array(sizes)
    for i, j in _sweep_pairs(e):
        same = own[i] == own[j]
        gap = np.abs(pos[i] - pos[j])
        adjacent = same & ((gap == 1) | (gap == size[own[i]] - 1))
        if (_proper_cross(e[i], e[j]) | _overlap_length(e[i], e[j])).any():
            return "Self-intersection"
        if (same & ~adjacent & _segments_touch(e[i], e[j])).any():
            return "Ring Self-intersection"

    def inside(ring: np.ndarray, of: np.ndarray) -> bool:
        table = np.column_stack([of[:-1], of[1:]])
        n = len(ring)
        zeros = np.zeros(n, dtype="int64")
        where = _locate(ring[:, 0], ring[:, 1], table, zeros, zeros + len(table), zeros)
        decided = where[where != BOUNDARY]
        return bool(len(decided) and decided[0] == INSIDE)

    for part in parts:
        for k, hole in enumerate(part[1:]):
            if not inside(hole, part[0]):
                return "Hole lies outside shell"
            if any(inside(hole, other) for m, other in enumerate(part[1:]) if m != k):
                return "Holes are nested"
    shells = [part[0] for part in parts]
    for a, shell in enumerate(shells):
        for c, part in enumerate(parts):
            if a != c and inside(shell, part[0]) and not any(inside(shell, h) for h in part[1:]):
                return "Nested shells"
    return None


# Rings up to this many edges are checked pair by pair for a whole batch at once.
SMALL_RING = 64


#: What is found on a simple ring; nothing yet where the general check decides.
RING_FINDINGS = (None, "Valid Geometry", "Self-intersection", "Ring Self-intersection")


def _simple_rows(s: Shapes, polygon: np.ndarray) -> np.ndarray:
    """Place in ``RING_FINDINGS`` for rows made of one small, closed, proper ring.

    Anything odd (holes, several parts, repeated vertices, an open ring) is 0, left to the
    general check.
    """
    first, n = s.row_points[:-1], np.diff(s.row_points)
    row_rings = np.bincount(s.ring_row, minlength=s.rows)
    candidate = polygon & (row_rings == 1) & (np.diff(s.row_parts) == 1) & (n >= 4) & (n <= SMALL_RING + 1)
    rows = np.flatnonzero(candidate)
    a, z = first[rows], first[rows] + n[rows] - 1
    rows = rows[(s.x[a] == s.x[z]) & (s.y[a] == s.y[z])]
    start, count = first[rows], n[rows] - 1
    idx = _ranges(start, count)
    owner = np.repeat(np.arange(len(rows)), count)
    e = np.column_stack([s.x[idx], s.y[idx], s.x[idx + 1], s.y[idx + 1]]) if len(idx) else np.zeros((0, 4))
    odd = ~np.isfinite(e).all(axis=1) | ((e[:, 0] == e[:, 2]) & (e[:, 1] == e[:, 3]))
    proper = np.bincount(owner, odd, len(rows)) == 0
    local = np.cumsum(count) - count
    finding = np.ones(len(rows), dtype=np.int64)
    for b0, b1 in _blocks(count * count):
        r, i, j = _products(local[b0:b1], count[b0:b1], local[b0:b1], count[b0:b1])
        keep = i < j
        r, i, j = r[keep], i[keep], j[keep]
        gap = j - i
        apart = (gap != 1) & (gap != count[b0:b1][r] - 1)
        crosses = _proper_cross(e[i], e[j]) | _overlap_length(e[i], e[j])
        touches = apart & ~crosses & _segments_touch(e[i], e[j])
        crossed, touched = (np.bincount(r, bad, b1 - b0) > 0 for bad in (crosses, touches))
        # Of several faults the general check names the one that it meets first.
        finding[b0:b1] = np.where(crossed & touched, 0, np.where(crossed, 2, np.where(touched, 3, 1)))
    found = np.zeros(s.rows, dtype=np.int64)
    found[rows[proper]] = finding[proper]
    return found


def validity(geom: pa.Array) -> pa.Array:
    """``struct<valid, reason>``; only polygons can be invalid, empty ones are valid."""
    s = Shapes(geom)
    polygon, line = (s.valid & _flags(pc.equal(s.kind, kind)) for kind in ("POLYGON", "LINE"))
    found = _simple_rows(s, polygon)
    reasons = np.array(RING_FINDINGS, dtype=object)[found]
    reason = np.where(s.valid & (found == 0), RING_FINDINGS[1], reasons)
    for r in np.flatnonzero((found == 0) & (polygon | line)).tolist():
        why = None
        if polygon[r]:
            parts = []
            for p in range(s.row_parts[r], s.row_parts[r + 1]):
                spans = [(s.ring_points[k], s.ring_points[k + 1]) for k in range(s.part_rings[p], s.part_rings[p + 1])]
                rings = [np.column_stack([s.x[a:b], s.y[a:b]]) for a, b in spans if b > a]
                if rings:
                    parts.append(rings)
            why = _polygon_reason(parts) if parts else None
        else:
            a, b = s.row_points[r], s.row_points[r + 1]
            if b - a == 1 or (b > a and len({*zip(s.x[a:b], s.y[a:b])}) == 1):
                why = "Too few points in geometry component"
        reason[r] = why or RING_FINDINGS[1]
    valid = pa.array(reason == RING_FINDINGS[1], pa.bool_(), mask=~s.valid)
    return pa.StructArray.from_arrays([valid, pa.array(reason, pa.string())], names=["valid", "reason"])
