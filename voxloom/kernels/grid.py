"""Neighbourhoods on voxel grids, and components as compact lists of voxels."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np

#: Bit of each step in a voxel connectivity graph, in the order of ``OFFSETS``; fixed values of the exchange format.
GRAPH_BITS = (1, 0, 3, 2, 5, 4, 9, 7, 8, 6, 17, 13, 16, 12, 15, 11, 14, 10, 25, 21, 23, 19, 24, 20, 22, 18)


def _offsets() -> np.ndarray:
    """Faces by axis, then edges in the planes xy, yz, xz, then corners; minus before plus."""
    out = [tuple(s if a == axis else 0 for a in range(3)) for axis in range(3) for s in (-1, 1)]
    for a, b in ((0, 1), (1, 2), (0, 2)):
        out += [tuple(s if i == a else t if i == b else 0 for i in range(3)) for s, t in product((-1, 1), repeat=2)]
    return np.array([*out, *product((-1, 1), repeat=3)], dtype=np.int64)


OFFSETS = _offsets()
OPPOSITE = np.array([int(np.flatnonzero((OFFSETS == -o).all(axis=1))[0]) for o in OFFSETS])


def _join_rank() -> np.ndarray:
    """Order in which a path looks for a rail next to it: as above, but corners by how many axes go up."""
    corners = [tuple(1 if a in up else -1 for a in range(3)) for n in range(4) for up in combinations(range(3), n)]
    order = [*map(tuple, OFFSETS[:18].tolist()), *corners]
    return np.array([order.index(tuple(o)) for o in OFFSETS.tolist()])


JOIN_RANK = _join_rank()


def step_weights(anisotropy) -> np.ndarray:
    """Length of each step: double precision, then rounded to float32."""
    return np.sqrt(((OFFSETS * np.asarray(anisotropy, np.float64)) ** 2).sum(axis=1)).astype(np.float32)


def flat(coords: np.ndarray, shape) -> np.ndarray:
    """Index with x fastest."""
    return coords[..., 0] + shape[0] * (coords[..., 1] + shape[1] * coords[..., 2])


def unravel(index: np.ndarray, shape) -> np.ndarray:
    index = np.asarray(index, np.int64)
    return np.stack([index % shape[0], index // shape[0] % shape[1], index // (shape[0] * shape[1])], axis=-1)


@dataclass
class Voxels:
    """The voxels of one component in the order of their index (x fastest), and the table of their neighbours.

    ``near[i, k]`` is the voxel one step ``OFFSETS[k]`` from i, or -1; a connectivity graph removes steps."""

    coords: np.ndarray
    near: np.ndarray
    shape: tuple[int, int, int]

    @classmethod
    def of(cls, coords: np.ndarray, graph: np.ndarray | None = None) -> Voxels:
        coords = np.asarray(coords, np.int64)
        low = coords.min(axis=0)
        shape = tuple((coords.max(axis=0) - low + 1).tolist())
        key = flat(coords - low, shape)
        order = np.argsort(key, kind="stable")
        coords, bits = coords[order], None if graph is None else np.asarray(graph, np.int64)[order]
        wide = tuple(s + 2 for s in shape)
        place = np.full(int(np.prod(wide)), -1, np.int32)
        at = flat(coords - low + 1, wide)
        place[at] = np.arange(len(coords), dtype=np.int32)
        near = np.stack([place[at + int(flat(o, wide))] for o in OFFSETS], axis=1)
        if bits is not None:
            allowed = (bits[:, None] >> np.array(GRAPH_BITS)) & 1
            near = np.where(allowed == 1, near, -1)
        return cls(coords, near, shape)

    def find(self, point) -> int:
        """Number of the voxel at ``point``, or -1."""
        hit = np.flatnonzero((self.coords == np.asarray(point)).all(axis=1))
        return int(hit[0]) if len(hit) else -1


def sequential_components(count: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Least member of each one's component, by hooking roots and jumping pointers until nothing changes."""
    root = np.arange(count)
    while True:
        a, b = root[first], root[second]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def label_components(labels: np.ndarray, neighbours: np.ndarray = OFFSETS, background: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots): components of equal labels, numbered from 1 by their least index with x fastest; 0 is background."""
    shape = labels.shape
    values = labels.ravel(order="F")
    at = np.arange(values.size).reshape(shape, order="F")
    firsts, seconds = [], []
    for o in neighbours[[tuple(x) > (0,) * len(x) for x in neighbours[:, ::-1].tolist()]].tolist():
        here = tuple(slice(max(0, -d), s - max(0, d)) for d, s in zip(o, shape))
        there = tuple(slice(max(0, d), s - max(0, -d)) for d, s in zip(o, shape))
        same = labels[here] == labels[there]
        if not background:
            same &= labels[here] != 0
        firsts.append(at[here][same])
        seconds.append(at[there][same])
    root = sequential_components(values.size, np.concatenate(firsts), np.concatenate(seconds))
    kept = np.ones(values.size, bool) if background else values != 0
    roots = np.unique(root[kept])
    ids = np.zeros(values.size, np.int64)
    ids[kept] = np.searchsorted(roots, root[kept]) + 1
    return ids.reshape(shape, order="F"), roots


def fill_voids(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """The mask with its enclosed background filled (steps over faces), and how many voxels that added."""
    ids, _ = label_components((~mask).astype(np.int8), OFFSETS[:6, : mask.ndim] if mask.ndim == 3 else np.array([[-1, 0], [1, 0], [0, -1], [0, 1]]))
    open_ = set()
    for axis in range(mask.ndim):
        for end in (0, -1):
            open_ |= set(np.unique(np.take(ids, end, axis=axis)).tolist())
    holes = ~mask & ~np.isin(ids, list(open_))
    return mask | holes, int(holes.sum())
