"""Centre-line tracing of one component (TEASAR), and assembly of its paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

from voxloom.kernels import geodesic as geo
from voxloom.kernels.edt import edt, graph_edt
from voxloom.kernels.grid import Voxels, fill_voids
from voxloom.params import TeasarParams

Point = tuple[int, int, int]


@dataclass
class Preparation:
    """What tracing starts from: all arrays follow ``voxels``."""

    voxels: Voxels
    dbf: np.ndarray
    daf: np.ndarray
    cost: np.ndarray
    root: int
    target: int
    before: list[int]
    after: list[int]
    soma: bool
    soma_radius: float
    maximum: float
    filled: int
    parent: np.ndarray | None = None


def soma_centre(coords: np.ndarray, dbf: np.ndarray) -> int:
    """Of the voxels with the largest distance, the one nearest their mean; the first in order of (x, y, z) on ties."""
    top = np.flatnonzero(dbf == dbf.max())
    points = coords[top]
    mean = points.mean(axis=0).astype(np.float32).astype(np.float64)
    away = ((points - mean) ** 2).sum(axis=1)
    return int(top[np.lexsort((points[:, 2], points[:, 1], points[:, 0], away))[0]])


def _with_voids(coords: np.ndarray, graph: np.ndarray | None, anisotropy) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """The component with its voids filled, and its distances anew."""
    low = coords.min(axis=0)
    mask = np.zeros(tuple(coords.max(axis=0) - low + 1), bool)
    mask[tuple((coords - low).T)] = True
    solid, added = fill_voids(mask)
    bits = None
    if graph is not None:
        bits = np.zeros(mask.shape, np.int64)
        bits[tuple((coords - low).T)] = graph
    field_ = graph_edt(solid.astype(np.int8), bits, anisotropy, bool(solid.all())) if bits is not None else edt(solid.astype(np.int8), anisotropy, bool(solid.all()))
    where = np.argwhere(solid)
    return where + low, field_[tuple(where.T)], None if bits is None else bits[tuple(where.T)], added


def prepare(coords: np.ndarray, dbf: np.ndarray, params: TeasarParams, anisotropy, before: list[Point] = (), after: list[Point] = (), root: Point | None = None, graph: np.ndarray | None = None, fix_branching: bool = True) -> Preparation | None:
    """Root, fields and targets of a component given by its voxels and their distances to its surface."""
    coords, dbf = np.asarray(coords, np.int64), np.asarray(dbf, np.float32)
    if not len(coords):
        return None
    filled, soma = 0, False
    maximum = float(dbf.max())
    if maximum > params.soma_detection_threshold:
        more, distances, bits, filled = _with_voids(coords, graph, anisotropy)
        if filled:
            coords, dbf, graph = more, distances, bits
            maximum = float(dbf.max())
        soma = maximum > params.soma_acceptance_threshold
    voxels = Voxels.of(coords, graph)
    order = np.lexsort((coords[:, 0], coords[:, 1], coords[:, 2]))
    dbf = dbf[order]
    number = lambda p: voxels.find(p)
    before, after = [number(p) for p in before], [number(p) for p in after]
    start = None if root is None else number(root)
    soma_radius = 0.0
    if soma:
        if start is not None:
            before.insert(0, start)
        start = soma_centre(voxels.coords, dbf)
        soma_radius = maximum * params.soma_invalidation_scale + params.soma_invalidation_const
    elif start is None:
        start = geo.farthest(geo.edge_distances(voxels, 0, anisotropy))
    daf = geo.edge_distances(voxels, start, anisotropy, maximum if soma else 0.0)
    target = geo.farthest(daf)
    cost = geo.penalties(dbf, daf, params.pdrf_scale, params.pdrf_exponent)
    ready = Preparation(voxels, np.where(dbf == 0, geo.INF, dbf), daf, cost, start, target, before, after, soma, soma_radius, maximum, filled)
    if not fix_branching:
        ready.parent = geo.parents(voxels, geo.entry_distances(voxels, cost, start), start)
    if not soma and not before:
        ready.before = [target]
    return ready


def target_order(daf: np.ndarray) -> np.ndarray:
    """Farthest first, the largest index first on ties; what is out of reach counts as distance 0."""
    away = np.where(np.isinf(daf), 0, daf)
    return np.lexsort((-np.arange(len(daf)), -away))


class Tracer:
    """Finds paths one by one; each takes the voxels around it out of ``alive``, and is a rail for those to come."""

    def __init__(self, ready: Preparation, params: TeasarParams, anisotropy) -> None:
        self.ready, self.params, self.anisotropy = ready, params, anisotropy
        self.alive = np.ones(len(ready.voxels.coords), bool)
        self.rails = None
        if ready.soma:
            self._absorb([ready.root], params.soma_invalidation_scale, params.soma_invalidation_const)
            away = np.asarray(anisotropy, np.float64) * (ready.voxels.coords - ready.voxels.coords[ready.root])
            self.outside = np.sqrt((away**2).sum(axis=1)) > ready.soma_radius
        if ready.parent is None:
            self.rails = ready.cost.copy()

    def _absorb(self, path: list[int], scale: float, const: float) -> None:
        geo.invalidate(self.ready.voxels, self.alive, self.ready.dbf, path, scale, const, self.anisotropy)

    def targets(self) -> Iterator[tuple[int, bool]]:
        """(voxel, whether it was asked for): those before, the last first; what is alive, farthest first; those after,
        the last first."""
        for asked in reversed(self.ready.before):
            yield asked, True
        for far in target_order(self.ready.daf).tolist():
            if self.alive[far]:
                yield far, False
        for asked in reversed(self.ready.after):
            yield asked, True

    def path_to(self, target: int) -> list[int]:
        if self.rails is None:
            return geo.walk_back(self.ready.parent, target, self.ready.root)
        return geo.railroad(self.ready.voxels, self.rails, target)

    def without_body(self, path: list[int]) -> list[int]:
        """The path's first voxel and those outside the cell body; an end within it becomes the root."""
        kept = [v for i, v in enumerate(path) if not i or self.outside[v]]
        return kept if self.rails is None or self.outside[path[-1]] else [*kept, self.ready.root]

    def paths(self) -> Iterator[list[int]]:
        if self.rails is not None:
            self.rails[self.ready.root] = 0
        for target, asked in self.targets():
            path = self.path_to(target)
            if not path and not asked:
                return
            if self.ready.soma and path:
                path = self.without_body(path)
            if path and self.alive.any():
                self._absorb(path, self.params.scale, self.params.const)
            if self.rails is not None:
                self.rails[path] = 0
            yield path


def trace(ready: Preparation, params: TeasarParams, anisotropy) -> list[list[int]]:
    """The paths, as numbers of the voxels, in the order they are found; ``max_paths`` at most, and none if the points
    asked for are as many."""
    tracer = Tracer(ready, params, anisotropy)
    most = int(tracer.alive.sum()) if params.max_paths is None else params.max_paths
    return list(islice(tracer.paths(), most)) if len(ready.before) + len(ready.after) < most else []


@dataclass
class Skeleton:
    """Vertices in rows, edges as pairs of row numbers, and the radius of each vertex."""

    vertices: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.float32))
    edges: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))
    radii: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))


def consolidate(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray) -> tuple[Skeleton, np.ndarray]:
    """Equal vertices become one (the first's radius stays), in order of (x, y, z); edges are made unique, loops and
    vertices without edges go.  Also the row each kept vertex came from."""
    edges = np.asarray(edges, np.int64).reshape(-1, 2)
    if not len(edges) or not len(vertices):
        return Skeleton(), np.empty(0, np.int64)
    distinct, first, of = np.unique(vertices, axis=0, return_index=True, return_inverse=True)
    pairs = np.sort(of.reshape(-1)[edges], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    used, renamed = np.unique(pairs, return_inverse=True)
    return Skeleton(distinct[used], renamed.reshape(-1, 2), radii[first[used]]), first[used]


def assemble(ready: Preparation, paths: list[list[int]]) -> Skeleton:
    """Paths of two voxels or more as one skeleton in voxel coordinates; the radius is the distance to the surface."""
    chains = [p for p in paths if len(p) >= 2]
    if not chains:
        return Skeleton()
    rows = np.concatenate(chains)
    ends = np.cumsum([len(p) for p in chains])
    links = np.setdiff1d(np.arange(len(rows) - 1), ends - 1)
    out, _ = consolidate(ready.voxels.coords[rows], np.stack([links, links + 1], axis=1), ready.dbf[rows])
    return out


def skeleton_of(coords, dbf, params: TeasarParams, anisotropy, before=(), after=(), root=None, graph=None, fix_branching: bool = True) -> Skeleton:
    ready = prepare(coords, dbf, params, anisotropy, list(before), list(after), root, graph, fix_branching)
    return Skeleton() if ready is None else assemble(ready, trace(ready, params, anisotropy))
