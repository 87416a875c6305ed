"""Sequential graph and geometry work on one parcel's arrays (numpy only).

A grid is an array with NaN where there is no height; cells are (row, column).
``per_parcel`` runs such a kernel over many parcels, one Arrow group each; a grid
has at most 90,000 cells, which bounds a group.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .grid import dealt

STEPS = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)
CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def to_grid(pdf: pd.DataFrame, column: str = "z") -> np.ndarray:
    out = np.full((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), np.nan)
    out[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf[column].astype(float).to_numpy()
    return out


def per_parcel(cells: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` of every parcel; its rows get the parcel_id."""

    def run(key, pdf):
        out = kernel(pdf)
        out.insert(0, "parcel_id", key[0])
        return out

    return dealt(cells, ["parcel_id"]).groupBy("parcel_id").applyInPandas(run, f"parcel_id string, {schema}")


def as_rows(**grids: np.ndarray) -> pd.DataFrame:
    """A row a cell of equal-shaped arrays."""
    shape = next(iter(grids.values())).shape
    r, c = np.indices(shape)
    return pd.DataFrame({"r": r.ravel(), "c": c.ravel(), **{k: v.ravel() for k, v in grids.items()}})


def inside(cell: tuple[int, int], shape: tuple[int, int]) -> bool:
    return 0 <= cell[0] < shape[0] and 0 <= cell[1] < shape[1]


# --- hydrology --------------------------------------------------------------------

def fill(z: np.ndarray) -> np.ndarray:
    """Depressions raised to the lowest way out over the grid's edge."""
    out, done = z.copy(), np.isnan(z)
    heap = []
    rows, cols = z.shape
    for r in range(rows):
        for c in range(cols):
            if not done[r, c] and (r in (0, rows - 1) or c in (0, cols - 1)):
                heapq.heappush(heap, (z[r, c], r, c))
                done[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for dr, dc in STEPS:
            n = r + dr, c + dc
            if inside(n, z.shape) and not done[n]:
                done[n] = True
                out[n] = max(z[n], level)
                heapq.heappush(heap, (out[n], *n))
    return out


def directions(z: np.ndarray, px: float, py: float) -> np.ndarray:
    """Index into STEPS of the steepest way down, the first of equals; -1 if none."""
    best = np.zeros(z.shape, np.float32)
    out = np.full(z.shape, -1)
    padded = np.pad(z.astype(np.float32), 1, constant_values=np.nan)
    for k, (dr, dc) in enumerate(STEPS):
        there = padded[1 + dr : 1 + dr + z.shape[0], 1 + dc : 1 + dc + z.shape[1]]
        drop = (z.astype(np.float32) - there) / np.float32(math.hypot(dc * px, dr * py))
        better = np.nan_to_num(drop, nan=-1) > best
        best[better], out[better] = drop[better], k
    return out


def accumulation(z: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included."""
    total = np.where(np.isnan(z), 0, 1)
    flat = np.argsort(-np.where(np.isnan(z), -np.inf, z), axis=None, kind="stable")
    for i in flat:
        r, c = divmod(int(i), z.shape[1])
        k = direction[r, c]
        if k >= 0:
            total[r + STEPS[k][0], c + STEPS[k][1]] += total[r, c]
    return total


def label(mask: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, int]:
    """Connected components in reading order of their first cells; -1 elsewhere."""
    out, n = np.full(mask.shape, -1), 0
    steps = STEPS if connectivity == 8 else CROSS
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start] >= 0:
            continue
        out[start] = n
        queue = deque([start])
        while queue:
            r, c = queue.popleft()
            for dr, dc in steps:
                cell = r + dr, c + dc
                if inside(cell, mask.shape) and mask[cell] and out[cell] < 0:
                    out[cell] = n
                    queue.append(cell)
        n += 1
    return out, n


def branches(component: np.ndarray, direction: np.ndarray) -> list[list[tuple[int, int]]]:
    """From each head of a component (no cell of it drains there) downstream as
    long as the way stays in it."""
    def follow(cell):
        k = direction[cell]
        nxt = None if k < 0 else (cell[0] + STEPS[k][0], cell[1] + STEPS[k][1])
        return nxt if nxt is not None and inside(nxt, component.shape) and component[nxt] else None

    cells = [tuple(map(int, x)) for x in zip(*np.nonzero(component), strict=True)]
    fed = {follow(c) for c in cells}
    out = []
    for head in cells:
        if head not in fed:
            path, at = [], head
            while at is not None:
                path.append(at)
                at = follow(at)
            out.append(path)
    return out


def valleys(z: np.ndarray, px: float, py: float, stream: float = 0.5, primary: float = 2.0) -> list[dict]:
    """Components of cells draining ``stream`` acres or more, of which some cell
    drains ``primary``, with their branches of two cells or more."""
    filled = fill(z)
    direction = directions(filled, px, py)
    acres = accumulation(filled, direction) * px * py / 4046.8564224
    parts, n = label(acres >= stream)
    out = []
    for k in range(n):
        here = parts == k
        if acres[here].max() >= primary:
            ways = [b for b in branches(here, direction) if len(b) > 1]
            if ways:
                out.append({"valley_id": len(out), "max_acres": float(acres[here].max()), "branches": ways})
    return out


def stem(branches_: list[list[tuple[int, int]]], direction: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """From the valley's outlet upstream, always by the feeder that drains most."""
    def key(cell):
        return total[cell], -cell[0], -cell[1]

    feeders: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(direction >= 0), strict=True):
        dr, dc = STEPS[direction[r, c]]
        feeders.setdefault((int(r) + dr, int(c) + dc), []).append((int(r), int(c)))
    at = max((b[-1] for b in branches_), key=key)
    out = [at]
    while feeders.get(at):
        at = max(feeders[at], key=key)
        out.append(at)
    return out


def _residual(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    dx, dy = x - x.mean(), y - y.mean()
    sxx = float(dx @ dx)
    rest = float(dy @ dy)
    return rest if sxx == 0 else rest - float(dx @ dy) ** 2 / sxx


def keypoint_split(distance: np.ndarray, height: np.ndarray, slope: np.ndarray, run: int = 6, drop: float = 3.0) -> tuple[int, float] | None:
    """The place where two straight lines fit a profile best, among those where
    the mean slope over ``run`` cells falls by ``drop`` percent. Running sums give
    the residuals of all splits at once."""
    n = len(distance)
    at = np.arange(run, n - run)
    if not len(at):
        return None
    level = np.concatenate([[0.0], np.cumsum(slope)])
    fall = (2 * level[at] - level[at - run] - level[at + run]) / run
    x, y = distance - np.mean(distance), height - np.mean(height)
    sums = np.concatenate([np.zeros((5, 1)), np.cumsum(np.stack([x, y, x * x, x * y, y * y]), axis=1)], axis=1)

    def residual(part: np.ndarray, count: np.ndarray) -> np.ndarray:
        sx, sy, xx, xy, yy = part
        xx, xy, yy = xx - sx * sx / count, xy - sx * sy / count, yy - sy * sy / count
        return np.maximum(yy - np.divide(xy * xy, xx, out=np.zeros_like(xx), where=xx > 1e-12), 0)

    whole = residual(sums[:, at + 1], at + 1) + residual(sums[:, [n]] - sums[:, at], n - at)
    whole = np.where(fall >= drop, whole, np.inf)
    k = int(np.argmin(whole))
    return (int(at[k]), float(fall[k])) if np.isfinite(whole[k]) else None


def keypoints(z: np.ndarray, px: float, py: float, smooth: int = 5, run: int = 6, drop: float = 3.0, artefact: float = 0.15, **valley) -> list[dict]:
    """At most one keypoint a valley, the largest fall of slope first."""
    filled = fill(z)
    direction = directions(filled, px, py)
    total = accumulation(filled, direction)
    out = []
    for v in valleys(z, px, py, **valley):
        down = stem(v["branches"], direction, total)[::-1]
        if len(down) < 2 * run + 2:
            continue
        r, c = np.array(down).T
        step = np.hypot(np.diff(c) * px, np.diff(r) * py)
        distance = np.concatenate([[0.0], np.cumsum(step)])
        height = moving_average(z[r, c], smooth)
        grade = moving_average(np.append((height[:-1] - height[1:]) / step * 100, 0.0), smooth)
        found = keypoint_split(distance, height, grade, run, drop)
        if found and filled[down[found[0]]] - z[down[found[0]]] <= artefact:
            out.append({"valley_id": v["valley_id"], "r": down[found[0]][0], "c": down[found[0]][1], "drop_pct": found[1]})
    out.sort(key=lambda k: -k["drop_pct"])
    return [dict(k, keypoint_id=i) for i, k in enumerate(out)]


def moving_average(values: np.ndarray, window: int) -> np.ndarray:
    """Centred, shrinking at the ends."""
    half, n = window // 2, len(values)
    run = np.concatenate([[0.0], np.cumsum(values)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (run[hi] - run[lo]) / (hi - lo)


# --- masks --------------------------------------------------------------------------

def shifted(mask: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """``mask`` at (r + dr, c + dc); False outside."""
    out = np.zeros_like(mask)
    rows, cols = mask.shape
    if abs(dr) < rows and abs(dc) < cols:
        out[max(0, -dr) : rows - max(0, dr), max(0, -dc) : cols - max(0, dc)] = mask[max(0, dr) : rows - max(0, -dr), max(0, dc) : cols - max(0, -dc)]
    return out


def erode(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, dr, dc) for dr, dc in offsets]) if offsets else mask.copy()


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, -dr, -dc) for dr, dc in offsets]) if offsets else mask.copy()


def waist_split(mask: np.ndarray, px: float, py: float, least_acres: float = 0.5, waist: float = 24.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """A cluster cut at its waists if every part stays large enough: cores are what
    erosion leaves; other cells join the core that reaches them first. Each part comes
    with its core, which is to be drawn: between cores the gap of the waist is seen. An
    uncut cluster is its own core."""
    radius = max(1, math.ceil(waist / ((px + py) / 2) / 2))
    core = mask
    for _ in range(radius):
        core = erode(core, [(0, 0), *STEPS])
    seeds, n = label(core)
    if n < 2:
        return [(mask, mask)]
    owner = seeds.copy()
    queue = deque(tuple(map(int, x)) for x in zip(*np.nonzero(seeds >= 0), strict=True))
    while queue:
        r, c = queue.popleft()
        for dr, dc in STEPS:
            cell = r + dr, c + dc
            if inside(cell, mask.shape) and mask[cell] and owner[cell] < 0:
                owner[cell] = owner[r, c]
                queue.append(cell)
    if (mask & (owner < 0)).any():
        raise RuntimeError("a cell of the cluster reached no core")
    parts = [(owner == k, seeds == k) for k in range(n)]
    acre = px * py / 4046.8564224
    return parts if all(p.sum() * acre >= least_acres for p, _ in parts) else [(mask, mask)]


def holes(mask: np.ndarray) -> list[np.ndarray]:
    """Background parts that the box of the cluster's cells encloses."""
    r, c = np.nonzero(mask)
    box = np.pad(mask[r.min() : r.max() + 1, c.min() : c.max() + 1], 1)
    parts, n = label(~box)
    outer = parts[0, 0]
    out = []
    for k in range(n):
        if k != outer:
            whole = np.zeros_like(mask)
            whole[r.min() : r.max() + 1, c.min() : c.max() + 1] = (parts == k)[1:-1, 1:-1]
            out.append(whole)
    return out


def production_clusters(eligible: np.ndarray, z: np.ndarray, px: float, py: float, least_acres: float = 0.5, opening: float = 12.0, lead: int = 1) -> list[dict]:
    """4-connected clusters, split at waists, gated by area, with the fill that a
    disc opening leaves, holes and median height."""
    from .grid import disc

    parts, n = label(eligible, 4)
    acre, out = px * py / 4046.8564224, []
    element, more = disc(opening, px, py), disc(opening + lead * (px + py) / 2, px, py)
    for k in range(n):
        for piece, core in waist_split(parts == k, px, py, least_acres):
            if piece.sum() * acre < least_acres:
                continue
            opened = dilate(erode(piece, more), element) & piece
            out.append(
                {
                    "patch_id": len(out), "cells": piece, "render_cells": core, "fill": opened if opened.any() else piece, "acres": float(piece.sum() * acre),
                    "n_holes": len(holes(piece)), "median_z": float(np.nanmedian(z[piece])), "source": k,
                }
            )
    return out


def grow(start: np.ndarray, total: np.ndarray, target: int) -> list[tuple[int, int]]:
    """From the cell that drains most, always the best cell at the rim (4-connected)
    until ``target`` cells."""
    def rank(cell):
        return -total[cell], cell[0], cell[1]

    cells = [tuple(map(int, x)) for x in zip(*np.nonzero(start), strict=True)]
    first = min(cells, key=rank)
    heap, met, out = [(*rank(first),)], {first}, []
    while heap and len(out) < target:
        _, r, c = heapq.heappop(heap)
        out.append((r, c))
        for dr, dc in CROSS:
            cell = r + dr, c + dc
            if inside(cell, start.shape) and start[cell] and cell not in met:
                met.add(cell)
                heapq.heappush(heap, rank(cell))
    return out


# --- routes -------------------------------------------------------------------------

def cost_field(cost: np.ndarray, sources: list[tuple[int, int]], px: float, py: float, goals: set | None = None):
    """Least cost to each cell (a step costs its length times the cost of the cell
    it enters), the cell before it, and the first goal reached."""
    rows, cols = cost.shape
    # Plain lists: a cell is looked at eight times, and numbers of arrays are slow alone.
    price, least = cost.tolist(), [[math.inf] * cols for _ in range(rows)]
    steps = [(dr, dc, math.hypot(dc * px, dr * py)) for dr, dc in STEPS]
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    heap, n, inf = [], 0, math.inf
    for s in sources:
        if np.isfinite(cost[s]):
            least[s[0]][s[1]], before[s] = 0.0, None
            heap.append((0.0, n, s))
            n += 1
    heapq.heapify(heap)
    closed = [[False] * cols for _ in range(rows)]
    while heap:
        spent, _, at = heapq.heappop(heap)
        r, c = at
        if closed[r][c]:
            continue
        closed[r][c] = True
        if goals and at in goals:
            return np.array(least), before, at
        for dr, dc, length in steps:
            y, x = r + dr, c + dc
            if 0 <= y < rows and 0 <= x < cols and not closed[y][x] and -inf < price[y][x] < inf:
                new = spent + length * price[y][x]
                if new < least[y][x]:
                    least[y][x], before[y, x] = new, at
                    n += 1
                    heapq.heappush(heap, (new, n, (y, x)))
    return np.array(least), before, None


def route(before: dict, cell: tuple[int, int]) -> list[tuple[int, int]]:
    out = [cell]
    while before[out[-1]] is not None:
        out.append(before[out[-1]])
    return out[::-1]


def least_cost_path(cost: np.ndarray, sources: list, goals: list, px: float, py: float) -> dict | None:
    total, before, reached = cost_field(cost, sources, px, py, set(goals))
    return None if reached is None else {"cells": route(before, reached), "cost": float(total[reached])}


def road_network(
    cost: np.ndarray, anchor: tuple[int, int], demand: np.ndarray, px: float, py: float, radius: float = 100.0,
    per_acre: float = 100.0, reuse: float = 0.01, water: list | None = None, spur: float = 150.0,
) -> dict:
    """Branches from the anchor, each the best of least cost per acre that it newly
    serves within ``radius``, until the next would need more than ``per_acre``
    metres an acre; then one way to water if short enough. The first branch is the
    trunk, others are spurs; each tells the branch that it joins."""
    from .grid import disc

    cost = cost.copy()
    element = disc(radius, px, py)
    acre = px * py / 4046.8564224
    served, taken, out = np.zeros(demand.shape, bool), {anchor}, []
    stop = "all_demand_served" if demand.any() else "no_demand"
    owner: dict[tuple[int, int], int] = {}

    def serves(cells) -> np.ndarray:
        hit = np.zeros(demand.shape, bool)
        for c in cells:
            hit[c] = True
        return dilate(hit, element) & demand

    def length(cells) -> float:
        return sum(math.hypot((b[1] - a[1]) * px, (b[0] - a[0]) * py) for a, b in zip(cells, cells[1:], strict=False) if b not in taken)

    rim = max((max(abs(dr), abs(dc)) for dr, dc in element), default=0)
    wide = demand.shape[1] + 2 * rim
    disc_ = np.array([dr * wide + dc for dr, dc in element])
    wanted, reached = np.pad(demand, rim).ravel(), dilate(demand, element)
    served |= serves([anchor])
    while (demand & ~served).any():
        total, before, _ = cost_field(cost, [anchor], px, py)
        children: dict[tuple[int, int], list] = {}
        for cell, parent in before.items():
            if parent is not None:
                children.setdefault(parent, []).append(cell)
        # Depth first with a count per cell of the discs that cover it, undone on the way
        # back: what each route serves costs one disc a cell. Arrays have a rim of the
        # disc's size, so that a disc is one list of places from its middle's.
        covered = np.pad(served.astype(np.int32), rim).ravel()
        best, stack, gain = None, [(anchor, 0)], 0
        while stack:
            cell, state = stack.pop()
            near = reached[cell]
            if near:
                place = (cell[0] + rim) * wide + cell[1] + rim + disc_
            if state == 0:
                if near:
                    count = covered[place]
                    gain += np.count_nonzero(wanted[place] & (count == 0))
                    covered[place] = count + 1
                stack.append((cell, 1))
                if gain:
                    key = total[cell] / (gain * acre), total[cell], cell
                    if best is None or key < best:
                        best = key
                stack += [(c, 0) for c in children.get(cell, [])]
            elif near:
                count = covered[place] - 1
                covered[place] = count
                gain -= np.count_nonzero(wanted[place] & (count == 0))
        if best is None:
            stop = "no_reachable_demand"
            break
        cells = route(before, best[2])
        fresh = serves(cells) & ~served
        meters = length(cells)
        if not fresh.any() or meters / (fresh.sum() * acre) > per_acre:
            stop = "cost_per_acre_exceeded"
            break
        _accept(cells, taken, owner, out, cost, reuse, meters, float(fresh.sum() * acre), "spur" if out else "trunk", float(total[best[2]]))
        served |= fresh
    if water:
        total, before, reached = cost_field(cost, [anchor], px, py, set(water))
        if reached is not None and length(route(before, reached)) <= spur:
            cells = route(before, reached)
            _accept(cells, taken, owner, out, cost, reuse, length(cells), 0.0, "water_spur", float(total[reached]))
    return {
        "branches": out, "cells": taken, "total_length_meters": float(sum(b["meters"] for b in out)), "total_served_acres": float((demand & served).sum() * acre),
        "unserved_acres": float((demand & ~served).sum() * acre), "stop_reason": stop,
    }


def _accept(cells, taken, owner, out, cost, reuse, meters, acres, role, total) -> None:
    start = 0
    while start + 1 < len(cells) and cells[start + 1] in taken:
        start += 1
    taken.update(cells)
    for c in cells:
        cost[c] = reuse
    joins = owner.get(cells[start])
    for c in cells[start:]:
        owner.setdefault(c, len(out))
    out.append({"branch_id": len(out), "cells": cells[start:], "meters": meters, "served_acres": acres, "branch_role": role, "joins_branch_index": joins, "total_cost": total})


# --- lines and polygons ---------------------------------------------------------------

def contains(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points strictly inside a ring by ray casting."""
    out = np.zeros(np.shape(x), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for (x1, y1), (x2, y2) in zip(a, b, strict=True):
        crosses = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def distance_to_ring(ring: np.ndarray, x: np.ndarray, y: np.ndarray, closed: bool = True) -> np.ndarray:
    best = np.full(np.shape(x), np.inf)
    ends = np.roll(ring, -1, axis=0) if closed else ring[1:]
    for (x1, y1), (x2, y2) in zip(ring if closed else ring[:-1], ends, strict=True):
        dx, dy = x2 - x1, y2 - y1
        size = dx * dx + dy * dy
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / size, 0, 1) if size else 0.0
        best = np.minimum(best, np.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


def ring_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = sorted(map(tuple, np.unique(points, axis=0)))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A ring cut to a convex counter-clockwise window."""
    out = [tuple(p) for p in ring]
    for (x1, y1), (x2, y2) in zip(window, np.roll(window, -1, axis=0), strict=True):
        def side(p):
            return (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)

        nxt = []
        for a, b in zip(out, out[1:] + out[:1], strict=True):
            sa, sb = side(a), side(b)
            if sa >= 0:
                nxt.append(a)
            if (sa >= 0) != (sb >= 0):
                t = sa / (sa - sb)
                nxt.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        out = nxt
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def footprint_edges(mask: np.ndarray) -> int:
    """Cell sides between the mask and what isn't of it."""
    return int(sum((mask & ~shifted(mask, dr, dc)).sum() for dr, dc in CROSS))


# --- projection -----------------------------------------------------------------------

def utm(lon: np.ndarray, lat: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing on the WGS84 ellipsoid by the transverse Mercator
    series in the third flattening; south of the equator 10,000 km are added."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = np.radians(lat), np.radians(np.asarray(lon) - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x = eta + sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(alpha, 1))
    y = xi + sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(alpha, 1))
    return 500_000 + 0.9996 * radius * x, 0.9996 * radius * y + np.where(np.asarray(lat) < 0, 1e7, 0.0)


def lonlat(x: np.ndarray, y: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``utm``, by the inverse series to the same order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (np.asarray(y) - (1e7 if south else 0.0)) / (0.9996 * radius), (np.asarray(x) - 500_000) / (0.9996 * radius)
    u = xi - sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(beta, 1))
    v = eta - sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(beta, 1))
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    phi = chi + sum(k * np.sin(2 * j * chi) for j, k in enumerate(delta, 1))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(phi)


def ring_overlap(ax, ay, bx, by) -> float:
    """Area that two simple rings share. Between neighbouring heights of corners and
    crossings no edges cross, so the common width is linear there: its value half way
    times the height is exact."""
    a, b = np.column_stack([ax, ay]).astype(float), np.column_stack([bx, by]).astype(float)
    if len(a) < 3 or len(b) < 3:
        return 0.0
    da, db = np.roll(a, -1, 0) - a, np.roll(b, -1, 0) - b
    det = da[:, None, 0] * db[None, :, 1] - da[:, None, 1] * db[None, :, 0]
    gap = b[None] - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * db[None, :, 1] - gap[..., 1] * db[None, :, 0]) / det
    inside = np.isfinite(t) & (t >= 0) & (t <= 1)
    crossings = (a[:, None, 1] + np.where(inside, t, 0) * da[:, None, 1])[inside]
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 1].max(), b[:, 1].max())
    levels = np.unique(np.concatenate([a[:, 1], b[:, 1], crossings]))
    levels = levels[(levels >= low) & (levels <= high)]

    def widths(ring, step, y):
        hit = (ring[:, 1] <= y) != (ring[:, 1] + step[:, 1] <= y)
        return ring[hit, 0] + (y - ring[hit, 1]) / step[hit, 1] * step[hit, 0]

    total = 0.0
    for y0, y1 in zip(levels[:-1], levels[1:], strict=True):
        of_a, of_b = (widths(ring, step, (y0 + y1) / 2) for ring, step in ((a, da), (b, db)))
        x = np.concatenate([of_a, of_b])
        order = np.argsort(x, kind="stable")
        is_a = order < len(of_a)
        both = (np.cumsum(is_a) % 2 == 1) & (np.cumsum(~is_a) % 2 == 1)
        total += float((np.diff(x[order]) * both[:-1]).sum()) * (y1 - y0)
    return total


#: Numbers of a batch of overlaps that are held at once.
_HELD = 2_000_000


def ring_overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``ring_overlap`` of pairs of rings (arrays of corners): those with as many corners
    are worked out side by side, level by level."""
    out = np.zeros(len(a))
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        kinds.setdefault((len(p), len(q)), []).append(k)
    for (n, m), mine in kinds.items():
        each = (n + m + n * m) * (n + m)
        if n < 3 or m < 3:
            continue
        if each > _HELD // 8:  # no use side by side
            for k in mine:
                out[k] = ring_overlap(a[k][:, 0], a[k][:, 1], b[k][:, 0], b[k][:, 1])
            continue
        for at in range(0, len(mine), many := _HELD // each):
            some = mine[at : at + many]
            out[some] = _overlaps(np.stack([a[k] for k in some]).astype(float), np.stack([b[k] for k in some]).astype(float))
    return out


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    da, db = np.roll(a, -1, 1) - a, np.roll(b, -1, 1) - b
    gap, d, e = b[:, None] - a[:, :, None], da[:, :, None], db[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / (d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0])
    inside = np.isfinite(t) & (t >= 0) & (t <= 1)
    crossings = np.where(inside, a[:, :, None, 1] + np.where(inside, t, 0) * d[..., 1], a[:, :1, None, 1]).reshape(len(a), -1)
    low, high = np.maximum(a[..., 1].min(1), b[..., 1].min(1)), np.minimum(a[..., 1].max(1), b[..., 1].max(1))
    levels = np.sort(np.concatenate([a[..., 1], b[..., 1], crossings], axis=1), axis=1)
    levels = np.clip(levels, low[:, None], np.maximum(low, high)[:, None])  # none is left between these: no height
    y = ((levels[:, :-1] + levels[:, 1:]) / 2)[..., None]

    def widths(ring: np.ndarray, step: np.ndarray) -> np.ndarray:
        x0, y0, dx, dy = (v[:, None] for v in (ring[..., 0], ring[..., 1], step[..., 0], step[..., 1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((y0 <= y) != (y0 + dy <= y), x0 + (y - y0) / dy * dx, np.inf)

    x = np.concatenate([widths(a, da), widths(b, db)], axis=2)
    order = np.argsort(x, axis=2, kind="stable")
    x, of_a = np.take_along_axis(x, order, 2), order < a.shape[1]
    both = (np.cumsum(of_a, 2) % 2 == 1) & (np.cumsum(~of_a, 2) % 2 == 1)
    both[..., :-1] &= np.isfinite(x[..., 1:])
    with np.errstate(invalid="ignore"):
        wide = np.where(both[..., :-1], np.diff(x, axis=2), 0.0).sum(2)
    return (wide * np.diff(levels, axis=1)).sum(1)
