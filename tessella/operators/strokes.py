"""Tables from the strokes of a page: edges, crossings, cells, connected cells.

Strokes have doc_id, page_no, x0, x1, top and bottom.  Thin ones are an edge,
boxes four.  Edges of nearly one place are snapped to their mean and joined
where they touch; an upright edge is met by the level ones between its ends.  A
cell hangs on the crossing at its upper left and ends at the nearest crossings
to the right and below whose edges close it.  Cells that share a corner are a
table.  Pages are dealt and sorted once; a task takes many at a time, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.folds import placed, whole_places
from tessella.operators.geometry import PAGE

# fixed values: tolerances and sizes in points
SNAP = 3.0
THIN = 3.75
SHORTEST = 3.0
SMALLEST = (20.0, 10.0)

#: So many pairs of edges are looked at together.
PAIRS = 1 << 20

_CELL = ("x0", "top", "x1", "bottom")
_BOX = ("x0", "x1", "top", "bottom")

Edges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Draws = Callable[..., tuple[np.ndarray, list[np.ndarray]]]


def _edges(page: np.ndarray, box: list[np.ndarray]) -> tuple[Edges, Edges]:
    """(page, pos, lo, hi) of upright and of level edges: thin strokes by their middle, and the four sides of boxes."""
    x0, x1, y0, y1 = np.minimum(*box[:2]), np.maximum(*box[:2]), np.minimum(*box[2:]), np.maximum(*box[2:])
    wide, tall = x1 - x0, y1 - y0
    level = (tall <= THIN) & (wide >= tall)
    upright = ~level & (wide <= THIN)
    four = ~level & ~upright

    def sides(thin: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Edges:
        parts = [(page[thin], (a[thin] + b[thin]) / 2, lo[thin], hi[thin]), *((page[four], pos[four], lo[four], hi[four]) for pos in (a, b))]
        found = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return tuple(c[found[3] - found[2] >= SHORTEST] for c in found)

    return sides(upright, x0, x1, y0, y1), sides(level, y0, y1, x0, x1)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _whole(edges: Edges, tolerance: float) -> Edges:
    """Edges by page, place and start: a chain whose neighbours lie within the tolerance is moved to the mean of its places, and what touches or nearly so there becomes one."""
    page, pos, lo, hi = edges
    if not len(page):
        return edges
    order = np.lexsort((hi, lo, pos, page))
    page, pos, lo, hi = (c[order] for c in (page, pos, lo, hi))
    starts = _changes(page)
    starts[1:] |= pos[1:] - pos[:-1] > tolerance
    chain = np.cumsum(starts) - 1
    mean = np.bincount(chain, weights=pos) / np.bincount(chain)
    order = np.lexsort((hi, lo, chain))
    page, lo, hi, chain = page[order], lo[order], hi[order], chain[order]
    # how far the edges of a chain reach so far: the highest rank of an end, higher in later chains
    by_end = np.argsort(hi, kind="stable")
    rank = np.empty(len(hi), np.int64)
    rank[by_end] = np.arange(len(hi))
    reach = hi[by_end[np.maximum.accumulate(chain * len(hi) + rank) % len(hi)]]
    starts = _changes(chain)
    starts[1:] |= lo[1:] > reach[:-1] + tolerance
    first = np.flatnonzero(starts)
    return page[first], mean[chain[first]], lo[first], np.maximum.reduceat(hi, first)


def _before(page: np.ndarray, value: np.ndarray, of: np.ndarray, limit: np.ndarray, equal: bool) -> np.ndarray:
    """How many rows, sorted by page and value, come before a limit in page ``of``, those at it included or not."""
    n = len(page)
    asks = np.arange(n + len(of)) >= n
    order = np.lexsort((asks == equal, np.concatenate([value, limit]), np.concatenate([page, of])))
    out, at = np.empty(len(of), np.int64), asks[order]
    out[order[at] - n] = np.cumsum(~at)[at]
    return out


def _crossings(upright: Edges, level: Edges, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each upright edge and each level one that it meets, ends within the tolerance included, sorted."""
    (page, x, top, bottom), (on, y, left, right) = upright, level
    low, high = _before(on, y, page, top - tolerance, False), _before(on, y, page, bottom + tolerance, True)
    count = np.maximum(high - low, 0)
    found, start, total = [], 0, np.cumsum(count)
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(total, PAIRS + (total[start - 1] if start else 0), side="right")))
        n = count[start:stop]
        v = np.repeat(np.arange(start, stop), n)
        h = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + low[v]
        meet = (x[v] >= left[h] - tolerance) & (x[v] <= right[h] + tolerance)
        found.append((v[meet], h[meet]))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _cells(upright: Edges, level: Edges, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pages and boxes of the smallest closed cell below and right of each crossing, by page, top and left.

    Only a crossing from which an upright edge goes down can be the upper right
    corner, and only one from which a level edge goes right the lower left one.
    If the nearest two are closed by a fourth, no smaller cell is there; what a
    loose stroke leaves open is searched along both edges.
    """
    v, h = _crossings(upright, level, tolerance)
    n, x, y = len(v), upright[1][v], level[1][h]
    if not n:
        return np.empty(0, np.int64), np.empty((0, 4))
    # crossings lie along upright edges from top to bottom; along is their order along level ones, from left to right
    along = np.argsort(h, kind="stable")
    place = np.empty(n, np.int64)
    place[along] = np.arange(n)
    end_v, end_h = np.searchsorted(v, v, side="right") - 1, np.searchsorted(h[along], h, side="right") - 1
    down, right = y[end_v] > y, x[along[end_h]] > x

    def following(fits: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The next place that fits, up to the end; else -1."""
        at = np.append(np.minimum.accumulate(np.where(fits, np.arange(n), n)[::-1])[::-1][1:], n)
        return np.where(at <= end, at, -1)

    asks = np.flatnonzero(down & right)
    to_right, below = following(down[along], end_h[along])[place[asks]], following(right, end_v)[asks]
    corner = along[to_right]
    code = v * len(level[0]) + h
    fourth = v[corner] * len(level[0]) + h[below]
    closed = (to_right >= 0) & (below >= 0) & (code[np.minimum(np.searchsorted(code, fourth), n - 1)] == fourth) & (x[corner] > x[asks]) & (y[below] > y[asks])
    full = [(asks[closed], y[below[closed]], x[corner[closed]])]
    for k in asks[~closed]:
        rights = along[place[k] + 1 : end_h[k] + 1]
        rights, best = v[rights[x[rights] > x[k]]], None
        for j in range(k + 1, end_v[k] + 1):
            if y[j] <= y[k]:
                continue
            if best and y[j] > best[0]:
                break
            met = v[along[place[j] + 1 : end_h[j] + 1]]
            met = met[np.isin(met, rights)]
            if len(met) and (best is None or upright[1][met[0]] < best[1]):
                best = (y[j], upright[1][met[0]])
        if best:
            full.append(tuple(np.array([value]) for value in (k, *best)))
    at, bottom, x1 = (np.concatenate(c) for c in zip(*full, strict=True))
    page, cell = upright[0][v[at]], np.stack([x[at], y[at], x1, bottom], axis=1)
    order = np.lexsort((cell[:, 2], cell[:, 3], cell[:, 0], cell[:, 1], page))
    page, cell = page[order], cell[order]
    first = _changes(page, cell[:, 1], cell[:, 0])
    return page[first], cell[first]


def _components(corners: np.ndarray) -> np.ndarray:
    """The smallest number of a cell that each cell reaches over shared corners; ``corners``: cells x 4, equal numbers are one place."""
    owner, place, label = np.repeat(np.arange(len(corners)), 4), corners.reshape(-1), np.arange(len(corners))
    while len(corners):
        low = np.full(place.max() + 1, len(corners))
        np.minimum.at(low, place, label[owner])
        new = label.copy()
        np.minimum.at(new, owner, low[place])
        np.minimum.at(new, label, new)  # the old root follows, so long tables take few turns
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _numbered(page: np.ndarray, cell: np.ndarray, smallest: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Which cells are in a table, and its number within the page; cells come by page, top and left, many pages at a time."""
    owner = np.tile(np.arange(len(page)), 4)
    across, along = cell[:, [0, 0, 2, 2]].T.reshape(-1), cell[:, [1, 3, 1, 3]].T.reshape(-1)
    order = np.lexsort((across, along, page[owner]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([v[order][1:] != v[order][:-1] for v in (across, along, page[owner])])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    part = _components(place.reshape(4, -1).T)
    low = [np.full(len(page), np.inf) for _ in _CELL[:2]]
    high = [np.full(len(page), -np.inf) for _ in _CELL[:2]]
    for k in (0, 1):
        np.minimum.at(low[k], part, cell[:, k])
        np.maximum.at(high[k], part, cell[:, k + 2])
    fine = (np.bincount(part, minlength=len(page)) > 1) & (high[0] - low[0] >= smallest[0]) & (high[1] - low[1] >= smallest[1])
    keep = fine[part]
    roots, own = np.unique(part[keep], return_inverse=True)
    return keep, (np.arange(len(roots)) - np.searchsorted(page[roots], page[roots]))[own].astype(np.int32)


def table_cells(rows: DataFrame, tolerance: float = SNAP, *, reads: tuple[str, ...] = _BOX, draws: Draws | None = None) -> DataFrame:
    """(page, x0, top, x1, bottom, table_no): the cells of every table that strokes draw.

    ``table_no`` counts from 0 within the page, by top and left; lone cells and
    tiny tables are none.  Strokes without coordinates draw nothing, those drawn
    twice count once, and a page without crossings has no tables.  Rows that
    are dealt by a column of their page are not shuffled again.

    Where rows are no strokes but say how to draw some, ``draws`` takes their
    columns ``reads``, none of them null, and gives the row and the place of
    each stroke; so only the rows travel to the workers.
    """
    kept = PAGE if draws else (*PAGE, *reads)
    there = rows.select(*PAGE, *(F.col(c) if draws else F.col(c).cast("double").alias(c) for c in reads)).where(" AND ".join(f"{c} IS NOT NULL" for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, first in whole_places(batches):
            own, box = np.arange(len(first)), [whole.column(c).to_numpy() for c in reads]
            own, box = draws(*box) if draws else (own, box)
            fine = ~np.isnan(box).any(axis=0)
            page, box = (np.cumsum(first) - 1)[own[fine]], [c[fine] for c in box]
            upright, level = (_whole(e, tolerance) for e in _edges(page, box))
            page, cell = _cells(upright, level, tolerance)
            keep, no = _numbered(page, cell, SMALLEST)
            at = pa.array(np.flatnonzero(first)[page[keep]])
            yield pa.RecordBatch.from_arrays([*(whole.column(c).take(at).combine_chunks() for c in PAGE), *(pa.array(c) for c in cell[keep].T), pa.array(no)], names=[*PAGE, *_CELL, "table_no"])

    types = [*(f"{c} {there.schema[c].dataType.simpleString()}" for c in PAGE), *(f"{c} double" for c in _CELL)]
    return placed(there, PAGE, ()).mapInArrow(run, ", ".join([*types, "table_no int"]))


def table_boxes(found: DataFrame) -> DataFrame:
    """The box of each table and its number of cells."""
    return found.groupBy(*PAGE, "table_no").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("cells"))
