"""Analysis of one label: cross sections, point-to-point paths, parcels."""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np

from voxloom.kernels import geodesic as geo
from voxloom.kernels.edt import edt
from voxloom.kernels.graph import paths
from voxloom.kernels.grid import OFFSETS, Voxels, label_components
from voxloom.kernels.trace import Skeleton

#: Normals with a smaller part along an axis count as perpendicular to it.
FLAT = 1e-6


def box_sections(low: np.ndarray, high: np.ndarray, point: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Area that a plane cuts out of each axis-aligned box.

    The area is the derivative of the volume below the plane: a signed sum, over the corners, of powers of how far each
    lies below it.  Axes that the plane doesn't tilt along give the box's length as a factor."""
    n = normal / np.linalg.norm(normal)
    tilted = np.flatnonzero(np.abs(n) > FLAT)
    size = high - low
    factor = np.prod(np.delete(size, tilted, axis=1), axis=1)
    d = (point[tilted] * n[tilted]).sum()
    if len(tilted) == 1:  # on a shared face the lower box has the plane
        a = tilted[0]
        return factor * ((low[:, a] < point[a]) & (point[a] <= high[:, a]))
    flip = n[tilted] < 0  # mirrored axes, so that all parts are positive
    lo, hi = low[:, tilted].copy(), high[:, tilted].copy()
    lo[:, flip], hi[:, flip] = -high[:, tilted][:, flip], -low[:, tilted][:, flip]
    m, k = np.abs(n[tilted]), len(tilted)
    total = np.zeros(len(low))
    for corner in product((0, 1), repeat=k):
        at = np.where(np.array(corner) == 1, hi, lo) @ m
        total += (-1) ** sum(corner) * np.maximum(0, d - at) ** (k - 1)
    return factor * np.maximum(total, 0) / (np.prod(m) * (1 if k == 2 else 2))


def moving_average(values: np.ndarray, window: int) -> np.ndarray:
    """Mean of the last ``window`` rows; the path goes on mirrored at its ends."""
    n = len(values)
    at = np.arange(-window + 1, n) % (2 * n)
    mirrored = values[np.where(at < n, at, 2 * n - 1 - at)]
    sums = np.cumsum(np.vstack([np.zeros((1, values.shape[1])), mirrored]), axis=0)
    return (sums[window:] - sums[:-window]) / window


def tangents(path: np.ndarray, window: int) -> np.ndarray:
    """Unit directions along a path, smoothed forward and backward."""
    step = np.diff(path, axis=0).astype(np.float64)
    raw = np.vstack([step, step[-1:]])
    if window > 1:
        raw = moving_average(moving_average(raw, window)[::-1], window)[::-1]
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def section(mask: np.ndarray, point: np.ndarray, normal: np.ndarray, anisotropy) -> tuple[float, int, np.ndarray]:
    """(area, contacts, voxels) of the plane through ``point`` within the part of ``mask`` that it meets there.

    Contacts is a bit for each face of the volume that the section touches: -x +x -y +y -z +z."""
    w = np.asarray(anisotropy, np.float64)
    where = np.argwhere(mask)
    centre = (where - point) * w
    n = np.asarray(normal, np.float64)
    reach = (np.abs(n) * w).sum() / 2
    close = np.abs(centre @ n) <= reach + 1e-9
    where, centre = where[close], centre[close]
    if not len(where):
        return 0.0, 0, where
    area = box_sections(centre - w / 2, centre + w / 2, np.zeros(3), n)
    cut = area > 0
    where, area = where[cut], area[cut]
    if not len(where):
        return 0.0, 0, where
    plane = np.zeros(mask.shape, np.int8)
    plane[tuple(where.T)] = 1
    ids, _ = label_components(plane, OFFSETS)
    start = np.rint(point).astype(int)
    own = ids[tuple(start)] if (start >= 0).all() and (start < mask.shape).all() else 0
    if not own:
        return 0.0, 0, where[:0]
    here = ids[tuple(where.T)] == own
    where = where[here]
    contacts = sum(1 << (2 * a + e) for a in range(3) for e, at in ((0, 0), (1, mask.shape[a] - 1)) if (where[:, a] == at).any())
    return float(area[here].sum()), contacts, where


def section_areas(mask: np.ndarray, skeleton: Skeleton, anisotropy, smoothing_window: int = 1, step: int = 1, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(areas, contacts) of every vertex (or of those ``wanted``; 0 for others), given in voxels of ``mask``; branch points
    get the mean over their paths."""
    count = len(skeleton.vertices)
    areas, contacts = np.zeros(count, np.float32), np.zeros(count, np.uint8)
    degree = np.bincount(skeleton.edges.ravel(), minlength=count)
    at_branch: dict[int, list[float]] = {}
    for path in paths(skeleton):
        normal = tangents(skeleton.vertices[path].astype(np.float64), smoothing_window)
        since = 0
        for i, v in enumerate(path):
            since += 1
            if since < step and 0 < i < len(path) - 1:
                continue
            since = 0 if since == step else since
            if (areas[v] and degree[v] < 3) or not (wanted is None or wanted[v]):
                continue
            areas[v], touched, _ = section(mask, skeleton.vertices[v].astype(np.float64), normal[i], anisotropy)
            contacts[v] |= touched
            if degree[v] >= 3:
                at_branch.setdefault(v, []).append(float(areas[v]))
    for v, values in at_branch.items():
        areas[v] = np.float32(sum(np.float32(x) for x in values) / len(values))
    return areas, contacts


def connect_points(mask: np.ndarray, start, end, anisotropy, pdrf_scale: float = 100000, pdrf_exponent: float = 4) -> Skeleton:
    """The most central path between two points of a component, from ``end`` to ``start``, in physical units."""
    mask = mask != 0
    start, end = tuple(int(x) for x in start), tuple(int(x) for x in end)
    for p in (start, end):
        if not all(0 <= x < s for x, s in zip(p, mask.shape)):
            raise ValueError("point outside volume")
    ids, _ = label_components(mask.astype(np.int8))
    if not ids[start] or ids[start] != ids[end]:
        raise ValueError("cannot extract a centre line from disconnected components")
    where = np.argwhere(ids == ids[start])
    voxels = Voxels.of(where)
    dbf = edt(mask.astype(np.int8), anisotropy, True)[tuple(voxels.coords.T)]
    begin, finish = voxels.find(start), voxels.find(end)
    cost = geo.penalties(dbf, geo.edge_distances(voxels, begin, anisotropy), pdrf_scale, pdrf_exponent)
    dist, came, heap, done = {finish: np.float32(0)}, {}, [(0.0, finish)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == begin:
            break
        for v in voxels.near[u][voxels.near[u] >= 0].tolist():
            if v not in done and (value := np.float32(np.float32(d) + cost[v])) < dist.get(v, np.inf):
                dist[v], came[v] = value, u
                heapq.heappush(heap, (float(value), v))
    path = [begin]
    while path[-1] != finish:
        path.append(came[path[-1]])
    path = path[::-1]
    place = (voxels.coords[path] * np.asarray(anisotropy, np.float32)).astype(np.float32)
    links = np.stack([np.arange(len(path) - 1), np.arange(1, len(path))], axis=1)
    return Skeleton(place, links, dbf[path].astype(np.float32))


def parcels(where: np.ndarray, sources: np.ndarray, anisotropy) -> tuple[np.ndarray, np.ndarray]:
    """(voxels in the order of their index, number of the nearest source of each)."""
    voxels = Voxels.of(where)
    points = sorted({tuple(p) for p in sources.tolist()})
    numbers = [n for n in (voxels.find(p) for p in points) if n >= 0]
    return voxels.coords, geo.feature_map(voxels, numbers, anisotropy) if numbers else np.zeros(len(voxels.coords), np.int64)
