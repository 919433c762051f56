"""Shortest paths within one component."""

from __future__ import annotations

import heapq

import numpy as np

from voxloom.kernels.grid import JOIN_RANK, Voxels, step_weights

INF = np.float32(np.inf)


def freespace(delta: np.ndarray, anisotropy) -> np.ndarray:
    """Length of the shortest walk of 26-neighbour steps over free space, in closed form."""
    away = np.abs(delta)
    w = np.asarray(anisotropy, np.float64)
    order = np.argsort(away, axis=1, kind="stable")
    low, mid, high = (np.take_along_axis(away, order[:, i : i + 1], 1)[:, 0] for i in range(3))
    weight = w[order] ** 2
    three, two, one = np.sqrt(weight.sum(axis=1)), np.sqrt(weight[:, 1] + weight[:, 2]), np.sqrt(weight[:, 2])
    return (low * three + (mid - low) * two + (high - mid) * one).astype(np.float32)


def edge_distances(voxels: Voxels, source: int, anisotropy, free_radius: float = 0.0) -> np.ndarray:
    """Distance over steps of the voxels from ``source``; inside ``free_radius`` as if nothing stood in the way."""
    weights = step_weights(anisotropy)
    dist = np.full(len(voxels.coords), INF)
    dist[source] = 0
    if free_radius > 0:
        direct = freespace(voxels.coords - voxels.coords[source], anisotropy)
        dist = np.where(direct < free_radius, direct, dist).astype(np.float32)
    frontier = np.flatnonzero(dist < INF)
    while len(frontier):
        # rounds of relaxation from voxels that improved; float32 sums have one least fixed point
        target = voxels.near[frontier]
        value = dist[frontier][:, None] + weights
        ok = target >= 0
        target, value = target[ok], value[ok]
        better = value < dist[target]
        target, value = target[better], value[better]
        np.minimum.at(dist, target, value)
        frontier = np.unique(target)
    return dist


def farthest(field: np.ndarray) -> int:
    """The largest finite value, the least index on ties."""
    return int(np.where(np.isfinite(field), field, -1).argmax())


def penalties(dbf: np.ndarray, daf: np.ndarray, scale: float, exponent: float) -> np.ndarray:
    """Cost of entering a voxel: high near the surface, and rising a little with the distance from the root."""
    top, far = float(dbf.max()), float(daf[np.isfinite(daf)].max(initial=0))
    m = np.float32(1 / top**1.01)
    depth = np.where(dbf == 0, INF, dbf).astype(np.float32)
    away = np.where(np.isinf(daf), np.float32(0), daf).astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.float32(1) - depth * m
        e = int(exponent) if float(exponent).is_integer() and 0 < exponent < 65536 else 0
        if e and not e & (e - 1):
            while e > 1:
                value, e = value * value, e >> 1
        else:
            value = np.power(value, np.float32(exponent))
        value = np.float32(scale) * value
        if far:
            value = value + away * np.float32(1 / far)
    return value.astype(np.float32)


def enter(d: np.float32, cost: np.float32) -> np.float32:
    """Distance after entering a voxel; it rises even where the cost is below the last digit."""
    out = np.float32(d + cost)
    return np.nextafter(d, INF) if out == d and cost > 0 and d < INF else out


def entry_distances(voxels: Voxels, cost: np.ndarray, source: int) -> np.ndarray:
    """Least sum of entry costs from ``source`` to every voxel."""
    dist = np.full(len(cost), INF)
    dist[source] = 0
    frontier = np.array([source])
    while len(frontier):
        target = voxels.near[frontier]
        base = np.broadcast_to(dist[frontier][:, None], target.shape)
        ok = target >= 0
        target, base = target[ok], base[ok]
        price = cost[target]
        value = base + price
        value = np.where((value == base) & (price > 0), np.nextafter(base, INF), value)
        better = value < dist[target]
        target, value = target[better], value[better]
        np.minimum.at(dist, target, value)
        frontier = np.unique(target)
    return dist


def parents(voxels: Voxels, dist: np.ndarray, source: int) -> np.ndarray:
    """The neighbour with the least distance, the first in the order of steps on ties; -1 at the source and out of reach."""
    around = np.where(voxels.near >= 0, dist[voxels.near], INF)
    best = around.argmin(axis=1)
    out = np.take_along_axis(voxels.near, best[:, None], 1)[:, 0].astype(np.int64)
    out[(dist == INF) | (around.min(axis=1) == INF)] = -1
    out[source] = -1
    return out


def walk_back(parent: np.ndarray, target: int, source: int) -> list[int]:
    """Source to target; from where the chain breaks if it doesn't reach the source."""
    path = [target]
    while path[-1] != source and parent[path[-1]] >= 0 and len(path) <= len(parent):
        path.append(int(parent[path[-1]]))
    return path[::-1]


def railroad(voxels: Voxels, cost: np.ndarray, target: int) -> list[int]:
    """Cheapest path from ``target`` to a rail (a voxel of cost 0), the target first.

    Empty if no rail can be reached, the target alone if it is one.  The last voxel before the rails joins the first rail
    in the order of ``JOIN_RANK``."""
    if cost[target] == 0:
        return [target]
    near, inf = voxels.near, float("inf")
    dist: dict[int, np.float32] = {target: np.float32(0)}
    heap: list[tuple[float, int]] = [(0.0, target)]
    settled: set[int] = set()
    rank = np.argsort(JOIN_RANK)
    last = rail = -1
    while heap:
        d, u = heapq.heappop(heap)
        if u in settled:
            continue
        settled.add(u)
        around = near[u]
        rails = [int(v) for v in around[rank] if v >= 0 and cost[v] == 0]
        if rails:
            last, rail = u, rails[0]
            break
        for v in around[around >= 0].tolist():
            if v not in settled and (c := enter(np.float32(d), cost[v])) < dist.get(v, inf):
                dist[v] = c
                heapq.heappush(heap, (float(c), v))
    if last < 0:
        return []
    back = [last]
    while back[-1] != target:
        u = back[-1]
        options = [(float(dist[v]), k, v) for k, v in enumerate(near[u].tolist()) if v in settled]
        back.append(min(options)[2])
    return [*back[::-1], rail]


def invalidate(voxels: Voxels, alive: np.ndarray, dbf: np.ndarray, path: list[int], scale: float, const: float, anisotropy) -> int:
    """Takes voxels near ``path`` out of ``alive`` and returns how many.

    A voxel goes if it is reached through living voxels, each nearer than scale * dbf + const to the path's voxel that the
    growth came from.  Growth with the least largest distance so far wins, then the source with the least index."""
    w = np.asarray(anisotropy, np.float32)
    place = voxels.coords.astype(np.float32)
    reach = np.float32(scale) * dbf + np.float32(const)
    best: dict[int, tuple[float, int]] = {s: (0.0, s) for s in path}
    heap = [(0.0, s, s) for s in set(path)]
    heapq.heapify(heap)
    gone: list[int] = []
    most, waiting = int(alive.sum()), alive.copy()  # what is settled takes no more offers
    while heap and len(gone) < most:
        m, s, u = heapq.heappop(heap)
        if best.get(u) != (m, s):
            continue
        if alive[u]:
            gone.append(u)
        waiting[u] = False
        around = voxels.near[u]
        around = around[around >= 0]
        around = around[waiting[around]]
        if not len(around):
            continue
        delta = w * (place[around] - place[s])
        away = np.sqrt((delta * delta).sum(axis=1, dtype=np.float32))
        for v, d in zip(around[away < reach[s]].tolist(), away[away < reach[s]].tolist()):
            key = (max(m, d), s)
            if key < best.get(v, (float("inf"), -1)):
                best[v] = key
                heapq.heappush(heap, (*key, v))
    alive[gone] = False
    return len(gone)


def feature_map(voxels: Voxels, sources: list[int], anisotropy) -> np.ndarray:
    """1-based number of the nearest source (geodesic) of every voxel, the larger on ties; 0 out of reach."""
    weights = step_weights(anisotropy)
    dist, owner = np.full(len(voxels.coords), INF), np.zeros(len(voxels.coords), np.int64)
    heap: list[tuple[float, int]] = []
    for i, s in enumerate(sources, 1):
        dist[s], owner[s] = 0, i
        heapq.heappush(heap, (0.0, s))
    done = np.zeros(len(dist), bool)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        for k, v in enumerate(voxels.near[u].tolist()):
            if v < 0:
                continue
            value = np.float32(np.float32(d) + weights[k])
            if value < dist[v]:
                dist[v], owner[v] = value, owner[u]
                heapq.heappush(heap, (float(value), v))
            elif value == dist[v] and owner[u] > owner[v] and not done[v]:
                owner[v] = owner[u]
    return owner
