"""Whole-volume steps that depend on the order of components, and the in-memory pipeline of one volume."""

from __future__ import annotations

from collections import Counter

import numpy as np

from voxloom.kernels.edt import edt, graph_edt, squared_edt
from voxloom.kernels.grid import GRAPH_BITS, OFFSETS, fill_voids, label_components, sequential_components, unravel
from voxloom.kernels.trace import Skeleton, skeleton_of
from voxloom.params import TeasarParams

FLAT8 = np.array([(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])


def boxes(ids: np.ndarray, count: int) -> list[tuple[slice, slice, slice] | None]:
    """The box of each id, by id; None for 0 and for ids without voxels."""
    out: list[tuple[slice, slice, slice] | None] = [None] * (count + 1)
    places = np.argwhere(ids > 0)
    if len(places):
        of = ids[tuple(places.T)]
        order = np.argsort(of, kind="stable")
        of, places = of[order], places[order]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        low, high = np.minimum.reduceat(places, heads), np.maximum.reduceat(places, heads) + 1
        for i, a, b in zip(of[heads].tolist(), low.tolist(), high.tolist()):
            out[i] = tuple(slice(x, y) for x, y in zip(a, b))
    return out


def graph_components(labels: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(ids, label of each id, least voxel of each id) where a step needs the bit of the voxel with the higher index.

    Background may connect; only voxels above 0 get an id.  A component's label is that of its last run's first voxel."""
    shape = labels.shape
    bits, values = graph.ravel(order="F").astype(np.int64), labels.ravel(order="F")
    at = np.arange(values.size).reshape(shape, order="F")
    a, b = [], []
    for k, o in enumerate(OFFSETS.tolist()):
        if o[::-1] < [0, 0, 0]:
            here = tuple(slice(max(0, -d), s - max(0, d)) for d, s in zip(o, shape))
            there = tuple(slice(max(0, d), s - max(0, -d)) for d, s in zip(o, shape))
            own, other = at[here].ravel(), at[there].ravel()
            ok = (bits[own] >> GRAPH_BITS[k]) & 1 == 1
            a.append(own[ok])
            b.append(other[ok])
    root = sequential_components(values.size, np.concatenate(a), np.concatenate(b))
    inside = values > 0
    roots = np.unique(root[inside])
    ids = np.zeros(values.size, np.int64)
    ids[inside] = np.searchsorted(roots, root[inside]) + 1
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]] & (ids > 0))
    label, first = {}, {}
    for s in starts.tolist():
        label[int(ids[s])] = int(values[s])
        first.setdefault(int(ids[s]), s)
    order = range(1, len(roots) + 1)
    return ids.reshape(shape, order="F"), [label[i] for i in order], [first[i] for i in order]


def fill_all_holes(ids: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """Fills each component's voids in its first box, by rising id; one that is painted over isn't filled later."""
    ids, total, skipped = ids.copy(), 0, set()
    for i, box in enumerate(boxes(ids, count)):
        if box is None or i in skipped:
            continue
        part = ids[box]
        solid, added = fill_voids(part == i)
        if added:
            new = solid & (part != i)
            skipped |= set(np.unique(part[new]).tolist())
            part[new] = i
            total += added
    return ids, total


RAYS = [(axis, side) for axis in range(3) for side in (1, -1)]


def enclosing(ids: np.ndarray, centre: tuple[int, int, int]) -> int:
    """Whose inside ``centre`` lies in: the component that rays along the axes meet first on leaving its own, if at least
    three meet one and they agree (but for one of more than three); else its own.  A ray to the low side stops short of
    the first plane."""
    own = int(ids[centre])
    met: Counter[int] = Counter()
    for axis, side in RAYS:
        line = np.moveaxis(ids, axis, 0)[(slice(None), *(c for k, c in enumerate(centre) if k != axis))]
        ray = line[centre[axis] :] if side > 0 else line[1 : centre[axis] + 1][::-1]
        left = ray[ray != own]
        if len(left) and left[0]:
            met[int(left[0])] += 1
    votes = met.total()
    if votes < 3 or votes - max(met.values()) > (votes > 3):
        return own
    return min(met, key=lambda other: (-met[other], other))


def _closed(ids: np.ndarray, box: tuple, own: int) -> np.ndarray:
    """The component's mask in its box, with holes in the box's six walls filled."""
    mask = ids[box] == own
    for axis, side in RAYS:
        wall = np.moveaxis(mask, axis, 0)[0 if side > 0 else -1]
        wall[...] = fill_voids(wall)[0]
    return mask


def fix_avocados(ids: np.ndarray, dbf: np.ndarray, threshold: float, anisotropy, black_border: bool = False, refresh=None) -> tuple[np.ndarray, np.ndarray, int]:
    """Gives a large inner component (a nucleus) to the one around it; at most 20 rounds.  In a round, the components with
    a voxel deeper than threshold / 2.5 take their turn by rising id, but for those that an earlier round left alone: each
    is joined to what its deepest voxel lies in, and its voids are filled."""
    ids, dbf = ids.copy(), dbf
    refresh = refresh or (lambda x: edt(x, anisotropy, black_border))
    alone: set[int] = set()
    for done in range(20):
        turn = np.setdiff1d(ids[dbf > np.float32(threshold / 2.5)], [0, *alone]).tolist()
        if not turn:
            return ids, dbf, done
        place, untouched, merged = boxes(ids, int(ids.max())), set(), set()
        for own in turn:
            box = place[own]
            mask = _closed(ids, box, own)
            deepest = int((mask * dbf[box]).ravel(order="F").argmax())
            centre = tuple(int(c) + b.start for c, b in zip(np.unravel_index(deepest, mask.shape, order="F"), box))
            pit, owner = int(ids[centre]), enclosing(ids, centre)
            if pit != owner or pit in merged:
                merged |= {pit, owner}
                untouched -= merged
                mask |= ids[box] == owner
            else:
                untouched.add(pit)
            ids[box][fill_voids(mask)[0]] = owner
        alone |= untouched
        if not merged:
            return ids, dbf, done + 1
        dbf = refresh(ids)
    return ids, dbf, 20


FACE_AXES = ((0, 1, 2), (0, 2, 1), (1, 2, 0))


def face_picks(plane: np.ndarray, wx: float, wy: float) -> list[tuple[int, int, int, int]]:
    """(first voxel, x, y, owner) for each patch of one face, by first voxel: the voxel farthest from the patch's rim.

    Ties go by distance to the patch's centroid, to the face's middle, to its corners, to its edges."""
    wx, wy = np.float32(wx), np.float32(wy)
    patch, roots = label_components(plane, FLAT8)
    if not len(roots):
        return []
    away = np.sqrt(squared_edt(patch.T[:, :, None], (wy, wx, 1), True, 2)[:, :, 0].astype(np.float32)).T
    nx, ny = plane.shape
    picks = []
    for p in range(1, len(roots) + 1):
        x, y = np.nonzero(patch == p)
        d = away[x, y]
        sx, sy, n = x.astype(np.float32).sum(dtype=np.float32), y.astype(np.float32).sum(dtype=np.float32), np.float32(len(x))
        px, py = wx * sx / n, wy * sy / n
        px, py = px + wx * (px < wx * np.float32(nx) / 2), py + wy * (py < wy * np.float32(ny) / 2)
        cx, cy = np.float32(int(px / wx)), np.float32(int(py / wy))
        top = d == d.max()
        tx, ty = x[top].astype(np.float32), y[top].astype(np.float32)
        span = lambda ux, uy: (wx * (tx - ux)) ** 2 + (wy * (ty - uy)) ** 2  # noqa: B023, E731
        fx, fy = np.float32(nx - 0.5), np.float32(ny - 0.5)
        corner = np.minimum.reduce([span(-0.5, -0.5), span(fx, -0.5), span(fx, fy), span(-0.5, fx)])
        edge = np.minimum.reduce([wx * (tx - 0.5), wx * (nx - 0.5 - tx), wy * (ty - 0.5), wy * (ny - 0.5 - ty)])
        key = np.lexsort((tx, ty, edge, corner, span(wx * nx / 2, wy * ny / 2), span(cx, cy)))[0]
        live = d > 0
        picks.append((int((x[live] + nx * y[live]).min()), int(tx[key]), int(ty[key]), int(plane[x[0], y[0]])))
    return sorted(picks)


def on_face(face: int, x: int, y: int, fixed: int) -> tuple[int, int, int]:
    point = [0, 0, 0]
    a, b, c = FACE_AXES[face // 2]
    point[a], point[b], point[c] = x, y, fixed
    return tuple(point)


def border_targets(ids: np.ndarray, anisotropy) -> dict[int, list[tuple[int, int, int]]]:
    """Where each component meets the faces of the volume, by face and by the patch's first voxel; a point stands once."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for face in range(6):
        a, b, c = FACE_AXES[face // 2]
        fixed = ids.shape[c] - 1 if face % 2 else 0
        for _, x, y, owner in face_picks(np.take(ids, fixed, axis=c), anisotropy[a], anisotropy[b]):
            if (point := on_face(face, x, y, fixed)) not in out.setdefault(owner, []):
                out[owner].append(point)
    return out


def wrapped(points, shape) -> list[tuple[int, int, int]]:
    """Points with negative coordinates counted from the end, once; an error outside."""
    out = []
    for p in points:
        q = tuple(int(x) + s if x < 0 else int(x) for x, s in zip(p, shape))
        if not all(0 <= x < s for x, s in zip(q, shape)):
            raise ValueError(f"target {tuple(p)} lies outside the volume")
        out.append(q)
    return out


def skeletonize_volume(
    labels: np.ndarray, params: TeasarParams, anisotropy=(1.0, 1.0, 1.0), dust_threshold: float = 1000, fix_branching: bool = True, fix_borders: bool = True,
    fill_holes: bool = False, avocados: bool = False, before=(), after=(), graph: np.ndarray | None = None, object_ids=None,
) -> list[tuple[int, Skeleton]]:
    """(label, skeleton in physical units) of every component above the dust threshold, in the order of components."""
    labels = np.asarray(labels)
    labels = np.where(np.isin(labels, list(object_ids)), labels, 0) if object_ids is not None else labels
    if labels.size <= dust_threshold:
        return []
    if graph is None:
        ids, roots = label_components(labels)
        names = labels.ravel(order="F")[roots].tolist()
    else:
        ids, names, _ = graph_components(labels, graph)
    if not len(names):
        return []
    black = bool((labels == labels.flat[0]).all()) if graph is not None else len(names) == 1 and bool((ids > 0).all())
    counts = np.bincount(ids.ravel(), minlength=len(names) + 1)
    if fill_holes:
        ids, _ = fill_all_holes(ids, len(names))
        counts = np.bincount(ids.ravel(), minlength=len(names) + 1)
    dbf = edt(ids, anisotropy, black) if graph is None else graph_edt(ids, graph, anisotropy, black)
    if avocados:
        ids, dbf, _ = fix_avocados(ids, dbf, params.soma_detection_threshold, anisotropy, black)
        counts = np.bincount(ids.ravel(), minlength=len(names) + 1)
    borders = border_targets(ids, anisotropy) if fix_borders else {}
    first, last = wrapped(before, labels.shape), wrapped(after, labels.shape)
    out = []
    for i, box in enumerate(boxes(ids, len(names))):
        if box is None or counts[i] <= dust_threshold or np.prod([s.stop - s.start for s in box]) <= 1:
            continue
        low = np.array([s.start for s in box])
        inside = ids[box] == i
        where = np.argwhere(inside)
        local = lambda points: [tuple((np.array(p) - low).tolist()) for p in points]  # noqa: B023, E731
        mine = lambda points: [p for p in points if ids[p] == i]  # noqa: B023, E731
        own = [*borders.get(i, []), *mine(first)]
        root = own.pop(len(borders.get(i, [])) - 1) if borders.get(i) else None
        bits = None if graph is None else graph[box][inside]
        skeleton = skeleton_of(where, dbf[box][inside], params, anisotropy, local(own), local(mine(last)), None if root is None else local([root])[0], bits, fix_branching)
        if len(skeleton.edges):
            place = (skeleton.vertices + low).astype(np.float32) * np.asarray(anisotropy, np.float32)
            out.append((int(names[i - 1]), Skeleton(place, skeleton.edges, skeleton.radii)))
    return out


def unravelled(index, shape) -> list[tuple[int, int, int]]:
    return [tuple(x) for x in unravel(np.asarray(index), shape).tolist()]
