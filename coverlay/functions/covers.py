"""Kernels for features of any size, and for distances to a border.

A large polygon is covered by cells of a quadtree: coarse cells where its interior fills
them, fine ones along its border.  The number of cells follows the border, not the area.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from coverlay.functions import geodesy
from coverlay.functions.kernels import (
    BLOCK,
    INSIDE,
    OUTSIDE,
    Shapes,
    _blocks,
    _edges,
    _flags,
    _locate,
    _near,
    _numbers,
    _products,
    _ranges,
    _segments_touch,
    _zone_tiles,
    measures,
    polygon_hits,
)

# What a cell of a feature says: its border passes, its interior fills the cell, its centroid
# lies there.
BORDER, CORE, CENTRE = 1, 2, 3


def _lists(counts: list[int], columns: dict[str, tuple[list, pa.DataType]]) -> pa.ListArray:
    items = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), items)


def _rows(s: Shapes):
    """Edge table, and start and count of its edges per row."""
    seg, _, row = s.segments()
    count = np.bincount(row, minlength=s.rows)
    return seg, np.cumsum(count) - count, count


# --- zones ----------------------------------------------------------------------------------


def nested_tiles(geom: pa.Array, size: float, margin: float, levels: int) -> pa.Array:
    """Every zone's tiles at level 0 and, once each, the cells of the coarser levels that hold one."""
    s = Shapes(geom)
    seg, start, count = _rows(s)
    tiles: list[tuple] = []
    own = np.zeros(s.rows, np.int64)
    for r in range(s.rows):
        before = len(tiles)
        if s.valid[r] and count[r]:
            _zone_tiles(seg[start[r] : start[r] + count[r]], size, margin, tiles)
        own[r] = len(tiles) - before
    cx, cy, core, parity, edges = (list(c) for c in zip(*tiles)) if tiles else ([],) * 5
    at = np.column_stack([np.repeat(np.arange(s.rows), own), np.array(cx, np.int64), np.array(cy, np.int64)])
    found = [(0, at)]
    for level in range(1, levels + 1):
        at = np.unique(np.column_stack([at[:, 0], at[:, 1:] >> 1]), axis=0)
        found.append((level, at))
    cells = np.vstack([a for _, a in found])
    more = len(cells) - len(tiles)
    order = pa.array(np.argsort(cells[:, 0], kind="stable"))
    fields = {
        "_level": pa.array(np.repeat([n for n, _ in found], [len(a) for _, a in found]), pa.int32()),
        "cx": pa.array(cells[:, 1], pa.int32()),
        "cy": pa.array(cells[:, 2], pa.int32()),
        "core": pa.concat_arrays([pa.array(core, pa.bool_()), pa.nulls(more, pa.bool_())]),
        "parity": pa.concat_arrays([pa.array(parity, pa.int32()), pa.nulls(more, pa.int32())]),
        "edges": pa.concat_arrays([pa.array(edges, pa.binary()), pa.nulls(more, pa.binary())]),
    }
    items = pa.StructArray.from_arrays([f.take(order) for f in fields.values()], names=list(fields))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(cells[:, 0], minlength=s.rows))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def near_tiles(geom: pa.Array, size: float, margin: float, projected: bool) -> pa.Array:
    """Every zone's tiles with ``near``: the edges one of which is nearest to any point there.

    From the tile's centre the nearest edge is ``d`` away, from a point of the tile, at most
    ``r`` from the centre, ``d + r`` at most; so edges beyond ``d + 2r`` are never nearest.
    ``projected`` measures in the equal-area plane, where ``r`` comes from projected points of
    the tile, with room for its curved sides.
    """
    s = Shapes(geom)
    seg, start, count = _rows(s)
    flat = seg
    if projected:
        flat = np.column_stack([*geodesy.project(np, seg[:, 0], seg[:, 1]), *geodesy.project(np, seg[:, 2], seg[:, 3])])
    out: list[tuple] = []
    counts = []
    for r in range(s.rows):
        tiles: list[tuple] = []
        if s.valid[r] and count[r]:
            here = slice(start[r], start[r] + count[r])
            _zone_tiles(seg[here], size, margin, tiles)
            blobs = _nearest_of(np.array([t[:2] for t in tiles], np.float64).reshape(-1, 2), flat[here], size, margin, projected)
            tiles = [(*tile, near) for tile, near in zip(tiles, blobs, strict=True)]
        out += tiles
        counts.append(len(tiles))
    cx, cy, core, parity, edges, near = (list(c) for c in zip(*out)) if out else ([],) * 6
    return _lists(counts, {
        "cx": (cx, pa.int32()), "cy": (cy, pa.int32()), "core": (core, pa.bool_()),
        "parity": (parity, pa.int32()), "edges": (edges, pa.binary()), "near": (near, pa.binary()),
    })


def _nearest_of(cells: np.ndarray, edges: np.ndarray, size: float, margin: float, projected: bool) -> list[bytes]:
    steps = np.array([(x, y) for x in (0.5, 0.0, 1.0) for y in (0.5, 0.0, 1.0)])
    x = (cells[:, :1] + steps[:, 0]) * size + np.sign(steps[:, 0] - 0.5) * margin
    y = (cells[:, 1:] + steps[:, 1]) * size + np.sign(steps[:, 1] - 0.5) * margin
    room = 1 + 1e-9
    if projected:
        with np.errstate(invalid="ignore"):
            x, y = geodesy.project(np, x, y)
        room = 1.25
    reach = np.hypot(x - x[:, :1], y - y[:, :1]).max(axis=1) * room
    out = []
    step = max(1, BLOCK // max(len(edges), 1))
    for begin in range(0, len(cells), step):
        end = min(begin + step, len(cells))
        n = (end - begin) * len(edges)
        away = _edge_distance(np.repeat(x[begin:end, 0], len(edges)), np.repeat(y[begin:end, 0], len(edges)), np.tile(edges, (end - begin, 1))).reshape(-1, len(edges)) if n else np.zeros((end - begin, 0))
        # What cannot be compared stays.
        beyond = away > (away.min(axis=1) + 2 * reach[begin:end])[:, None] * (1 + 1e-9)
        out += [np.ascontiguousarray(edges[~far]).tobytes() for far in beyond]
    return out


def _edge_distance(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    length2 = dx * dx + dy * dy
    along = ((px - e[:, 0]) * dx + (py - e[:, 1]) * dy) / np.where(length2 > 0, length2, 1.0)
    t = np.clip(np.where(length2 > 0, along, 0.0), 0.0, 1.0)
    return np.hypot(px - (e[:, 0] + t * dx), py - (e[:, 1] + t * dy))


def locate_near(core, x, y, parity, blob, px, py, near) -> pa.Array:
    """Distance from each point inside the zone to the nearest of its tile's near edges.

    NULL for points outside the zone or on its border.
    """
    table, start, count = _edges(blob)
    where = np.where(_flags(core), INSIDE, _locate(_numbers(x), _numbers(y), table, start, count, _numbers(parity).astype("int64")))
    inside = np.flatnonzero(where == INSIDE)
    px, py = _numbers(px), _numbers(py)
    table, start, count = _edges(near)
    best = np.full(len(px), np.inf)
    for a, b in _blocks(count[inside]):
        rows = inside[a:b]
        row = np.repeat(rows, count[rows])
        np.minimum.at(best, row, _edge_distance(px[row], py[row], table[_ranges(start[rows], count[rows])]))
    return pa.array(best, mask=~np.isfinite(best))


# --- features -------------------------------------------------------------------------------


def centroids(geom: pa.Array, centre: str) -> tuple[np.ndarray, np.ndarray]:
    flat = centre == "equal_area"
    m = measures(geom, projected=flat, back=flat)
    return _numbers(m.field("cx")), _numbers(m.field("cy"))


def cover_polygons(geom: pa.Array, size: float, margin: float, levels: int, centre: str | None) -> pa.Array:
    """``struct<mx, my, cover>``: a polygon's centroid (in the ``centre`` space) and its cells.

    The loop is over polygons of many cells each, not over rows of a layer.
    """
    s = Shapes(geom)
    nan = np.full(s.rows, np.nan)
    mx, my = (nan, nan) if centre is None else centroids(geom, centre)
    seg, start, count = _rows(s)
    numbers, blobs, counts = [np.zeros((0, 5), np.int64)], [], np.zeros(s.rows, np.int64)
    for r in np.flatnonzero(s.valid & (count > 0)):
        cells, edges = _cover(seg[start[r] : start[r] + count[r]], size, margin, levels)
        if np.isfinite(mx[r]) and np.isfinite(my[r]):
            cells = np.vstack([cells, [[CENTRE, 0, np.floor(mx[r] / size), np.floor(my[r] / size), 0]]]).astype(np.int64)
        numbers.append(cells)
        blobs.append(pa.concat_arrays([edges, pa.nulls(len(cells) - len(edges), pa.binary())]))
        counts[r] = len(cells)
    table = np.vstack(numbers)
    fields = [pa.array(table[:, k], pa.int32()) for k in range(5)] + [pa.concat_arrays(blobs) if blobs else pa.nulls(0, pa.binary())]
    items = pa.StructArray.from_arrays(fields, names=["kind", "level", "cx", "cy", "parity", "edges"])
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.StructArray.from_arrays([pa.array(mx), pa.array(my), pa.ListArray.from_arrays(offsets, items)], names=["mx", "my", "cover"])


def _cover(seg: np.ndarray, size: float, margin: float, levels: int) -> tuple[np.ndarray, pa.Array]:
    """Rows ``kind, level, cx, cy, parity`` of the cells that cover a polygon, those of its
    border first, and the edges that matter in each of those."""
    low_y, high_y = np.minimum(seg[:, 1], seg[:, 3]), np.maximum(seg[:, 1], seg[:, 3])
    low_x, high_x = np.minimum(seg[:, 0], seg[:, 2]), np.maximum(seg[:, 0], seg[:, 2])
    first = np.floor((low_y - margin) / size).astype(np.int64)
    rows = np.floor((high_y + margin) / size).astype(np.int64) - first + 1
    edge, cy = np.repeat(np.arange(len(seg)), rows), _ranges(first, rows)
    e = seg[edge]
    dy = e[:, 3] - e[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t1, t2 = (cy * size - margin - e[:, 1]) / dy, ((cy + 1) * size + margin - e[:, 1]) / dy
    flat = dy == 0
    t1, t2 = np.where(flat, 0.0, np.clip(np.minimum(t1, t2), 0, 1)), np.where(flat, 1.0, np.clip(np.maximum(t1, t2), 0, 1))
    xa, xb = e[:, 0] + t1 * (e[:, 2] - e[:, 0]), e[:, 0] + t2 * (e[:, 2] - e[:, 0])
    left = np.floor((np.minimum(xa, xb) - 2 * margin) / size).astype(np.int64)
    columns = np.floor((np.maximum(xa, xb) + 2 * margin) / size).astype(np.int64) - left + 1
    border = np.unique(np.column_stack([np.repeat(cy, columns), _ranges(left, columns)]), axis=0)

    # Each border cell with all edges of its row: those that matter there, and a parity bit
    # for those that every point of the cell crosses on its way to the right.
    order = np.argsort(cy, kind="stable")
    edge, cy = edge[order], cy[order]
    begin = np.searchsorted(cy, border[:, 0])
    many = np.searchsorted(cy, border[:, 0], side="right") - begin
    parity, kept = np.zeros(len(border), np.int64), np.zeros(len(border), np.int64)
    local_edges = []
    for a, b in _blocks(many):
        cell = np.repeat(np.arange(a, b), many[a:b])
        at = edge[_ranges(begin[a:b], many[a:b])]
        row, column = border[cell, 0], border[cell, 1]
        spanning = (low_y[at] < row * size - margin) & (high_y[at] > (row + 1) * size + margin)
        by_all = spanning & (low_x[at] > (column + 1) * size + margin)
        local = (high_x[at] >= column * size - margin) & ~by_all
        parity += np.bincount(cell, by_all, len(border)).astype(np.int64)
        kept += np.bincount(cell, local, len(border)).astype(np.int64)
        local_edges.append(seg[at[local]])
    offsets = np.concatenate(([0], np.cumsum(kept))).astype(np.int32) * 32
    data = np.ascontiguousarray(np.vstack(local_edges)).tobytes()
    edges = pa.BinaryArray.from_buffers(pa.binary(), len(border), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    found = [_cells(BORDER, 0, border, parity % 2)]

    # From the coarsest level down: cells without border are all inside or all outside.
    top = np.unique(border >> levels, axis=0)
    (y1, x1), (y2, x2) = top.min(axis=0), top.max(axis=0)
    around = np.stack(np.meshgrid(np.arange(y1, y2 + 1), np.arange(x1, x2 + 1), indexing="ij"), axis=-1).reshape(-1, 2)
    for level in range(levels, -1, -1):
        crossed = np.unique(border >> level, axis=0)
        free = _without(around, crossed)
        found.append(_cells(CORE, level, free[_centres_inside(free, seg, size * 2**level)]))
        around = (2 * crossed[:, None, :] + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])).reshape(-1, 2)
    return np.vstack(found), edges


def _cells(kind: int, level: int, yx: np.ndarray, parity: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros((len(yx), 5), np.int64)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = kind, level, yx[:, 1], yx[:, 0], parity
    return out


def _without(cells: np.ndarray, others: np.ndarray) -> np.ndarray:
    low = np.minimum(cells.min(axis=0), others.min(axis=0))
    width = max(cells[:, 1].max(), others[:, 1].max()) - low[1] + 1
    number = lambda c: (c[:, 0] - low[0]) * width + c[:, 1] - low[1]
    return cells[~np.isin(number(cells), number(others))]


def _centres_inside(cells: np.ndarray, seg: np.ndarray, side: float) -> np.ndarray:
    """Whether each cell's centre is in the polygon, none being on its border.

    Edges cross the rows' centre lines; going through a row from the left, each crossing
    turns outside to inside.  Every row has an even number of them, so one count serves all.
    """
    if not len(cells):
        return np.zeros(0, bool)
    low, high = np.minimum(seg[:, 1], seg[:, 3]) / side - 0.5, np.maximum(seg[:, 1], seg[:, 3]) / side - 0.5
    first = np.ceil(np.maximum(low, cells[:, 0].min())).astype(np.int64)
    n = np.maximum(np.ceil(np.minimum(high, cells[:, 0].max() + 1)).astype(np.int64) - first, 0)
    e, row = seg[np.repeat(np.arange(len(seg)), n)], _ranges(first, n)
    x = e[:, 0] + ((row + 0.5) * side - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
    rows, places = np.concatenate([row, cells[:, 0]]), np.concatenate([x, (cells[:, 1] + 0.5) * side])
    order = np.lexsort((places, rows))
    crossings = np.cumsum(order < len(row))
    inside = np.zeros(len(rows), bool)
    inside[order] = crossings % 2 == 1
    return inside[len(row) :]


def _clipped_middles(table, start, count, x1, y1, x2, y2):
    """Row and middle of what lies in the row's box of each edge that reaches it."""
    row = np.repeat(np.arange(len(start)), count)
    e = table[_ranges(start, count)]
    low, high = np.zeros(len(e)), np.ones(len(e))
    with np.errstate(divide="ignore", invalid="ignore"):
        for at, d, a, b in ((e[:, 0], e[:, 2] - e[:, 0], x1[row], x2[row]), (e[:, 1], e[:, 3] - e[:, 1], y1[row], y2[row])):
            t1, t2 = (a - at) / d, (b - at) / d
            still = d == 0
            out = still & ((at < a) | (at > b))
            low = np.where(out, 2.0, np.where(still, low, np.maximum(low, np.minimum(t1, t2))))
            high = np.where(still, high, np.minimum(high, np.maximum(t1, t2)))
    reach = low <= high
    middle = (low[reach] + high[reach]) / 2
    e = e[reach]
    return row[reach], e[:, 0] + middle * (e[:, 2] - e[:, 0]), e[:, 1] + middle * (e[:, 3] - e[:, 1])


def local_hits(core, cx, cy, parity, blob, own_parity, own_blob, size: float) -> np.ndarray:
    """Do the polygon and the zone share a point of this cell?  Both only know the cell.

    Either edges of both meet, or what lies in the cell of one edge is in the other shape, or
    no edge bounds what they share and the cell's centre is in both.
    """
    is_core = _flags(core)
    z_table, z_start, z_count = _edges(blob)
    p_table, p_start, p_count = _edges(own_blob)
    z_count = np.where(is_core, 0, z_count)
    z_parity, p_parity = np.where(is_core, 1, _numbers(parity)).astype("int64"), _numbers(own_parity).astype("int64")
    x1, y1 = _numbers(cx) * size, _numbers(cy) * size
    x2, y2 = x1 + size, y1 + size
    n = len(x1)
    mx, my = x1 + size / 2, y1 + size / 2
    hit = (_locate(mx, my, z_table, z_start, z_count, z_parity) != OUTSIDE) & (_locate(mx, my, p_table, p_start, p_count, p_parity) != OUTSIDE)
    sides = ((p_table, p_start, p_count, z_table, z_start, z_count, z_parity), (z_table, z_start, z_count, p_table, p_start, p_count, p_parity))
    for table, start, count, other, other_start, other_count, other_parity in sides:
        row, x, y = _clipped_middles(table, start, count, x1, y1, x2, y2)
        where = _locate(x, y, other, other_start[row], other_count[row], other_parity[row])
        hit |= np.bincount(row, where != OUTSIDE, n) > 0
    rest = np.flatnonzero(~hit)
    box = (x1[rest], y1[rest], x2[rest], y2[rest])
    p_near, p_at, p_n = _near(p_table, p_start[rest], p_count[rest], *box)
    z_near, z_at, z_n = _near(z_table, z_start[rest], z_count[rest], *box)
    for a, b in _blocks(p_n * z_n):
        r, i, j = _products(p_at[a:b], p_n[a:b], z_at[a:b], z_n[a:b])
        hit[rest[a:b]] |= np.bincount(r, _segments_touch(p_near[i], z_near[j]), b - a) > 0
    return hit


def small_hits(geom, core, cx, cy, parity, blob, size: float, margin: float, centre: str | None) -> pa.Array:
    """``struct<touches, centred>`` of (polygon, zone) pairs, from whole polygons."""
    nan = np.full(len(geom), np.nan)
    mx, my = (nan, nan) if centre is None else centroids(geom, centre)
    touches, centred = polygon_hits(geom, core, cx, cy, parity, blob, mx, my, size, margin)
    return pa.StructArray.from_arrays([pa.array(touches), pa.array(centred)], names=["touches", "centred"])


def window_hits(geom, sure, tiles, x1, y1, x2, y2, size: float, margin: float, centre: str | None) -> pa.Array:
    """``list<struct<z, touches, centred>>``: the zones that each polygon meets, each once.

    Only tiles of the cells that the polygon's box covers (``x1`` to ``y2``) are tried; a ``sure``
    polygon is known to lie in the interior of all zones of its cell.
    """
    row = _numbers(pc.list_parent_indices(tiles)).astype(np.int64)
    flat = pc.list_flatten(tiles)
    z, cx, cy, core, parity, edges = (flat.field(n) for n in ("z", "cx", "cy", "core", "parity", "edges"))
    across, up = _numbers(cx), _numbers(cy)
    own = (across >= _numbers(x1)[row]) & (across <= _numbers(x2)[row]) & (up >= _numbers(y1)[row]) & (up <= _numbers(y2)[row])
    touches = _flags(sure)[row] & own
    centred = touches.copy()
    tried = np.flatnonzero(own & ~touches)
    if len(tried):
        at = pa.array(tried)
        found = small_hits(geom.take(pa.array(row[tried])), *(c.take(at) for c in (core, cx, cy, parity, edges)), size, margin, centre)
        touches[tried], centred[tried] = (_flags(found.field(n)) for n in ("touches", "centred"))
    hit = np.flatnonzero(touches | centred)
    zone = _numbers(z)[hit].astype(np.int64)
    wide = int(zone.max(initial=0)) + 1
    pair, group = np.unique(row[hit] * wide + zone, return_inverse=True)
    marks = [np.bincount(group, m[hit], len(pair)) > 0 for m in (touches, centred)]
    items = pa.StructArray.from_arrays([pa.array(pair % wide, pa.int32()), *map(pa.array, marks)], names=["z", "touches", "centred"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(pair // wide, minlength=len(tiles)))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def pairs_of(hits: pa.ListArray, zones: pa.Array, whole: pa.Array, many_cells: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """``window_hits`` as one row per hit: the polygon's row, and its zone, ``home`` and marks.

    ``zones`` lists each row's zones in ascending order.  What a row that is not ``whole`` saw is
    not all: it has no ``home`` and no number of zones.
    """
    row = _numbers(pc.list_parent_indices(hits)).astype(np.int64)
    z, touches, centred = (pc.list_flatten(hits).field(n) for n in ("z", "touches", "centred"))
    lengths = _numbers(pc.list_value_length(zones)).astype(np.int64)
    names, first = pc.list_flatten(zones), np.cumsum(lengths) - lengths
    place = first[row] + _numbers(z).astype(np.int64)
    home, none = np.full(len(hits), len(names)), len(names)
    inside = _flags(centred)
    np.minimum.at(home, row[inside], place[inside])
    seen = _flags(whole)
    home = home[row]
    at = pa.array(row)
    marks = [
        names.take(pa.array(place)),
        names.take(pa.array(home, mask=(home == none) | ~seen[row])),
        many_cells.take(at),
        pa.array(np.bincount(row, _flags(touches), len(hits)).astype(np.int32)[row], mask=~seen[row]),
        touches,
        centred,
    ]
    return at, marks


def large_hits(kind, core, cx, cy, parity, blob, own_parity, own_blob, mx, my, size: float) -> pa.Array:
    """The same from the cells that cover a polygon."""
    kinds = _numbers(kind)
    touches, centred = kinds == CORE, np.zeros(len(kinds), bool)
    border, middle = np.flatnonzero(kinds == BORDER), np.flatnonzero(kinds == CENTRE)
    if len(border):
        at = pa.array(border)
        touches[border] = local_hits(*(c.take(at) for c in (core, cx, cy, parity, blob, own_parity, own_blob)), size)
    if len(middle):
        table, start, count = _edges(blob.take(pa.array(middle)))
        inside = _locate(_numbers(mx)[middle], _numbers(my)[middle], table, start, count, _numbers(parity)[middle].astype("int64")) == INSIDE
        centred[middle] = inside | _flags(core)[middle]
    return pa.StructArray.from_arrays([pa.array(touches), pa.array(centred)], names=["touches", "centred"])
