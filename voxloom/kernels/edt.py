"""Exact anisotropic distance to the nearest voxel of another label.

One pass per axis.  Within a run of equal labels along a line, a voxel's squared distance is the least over shifts of
its neighbours' plus the squared shift; where a shift leaves the run, the voxel beyond is a wall.  Shifts are tried in
rising order, for all lines at once, until no squared shift is below the largest distance left."""

from __future__ import annotations

import numpy as np


def _shifted(values: np.ndarray, axis: int, k: int) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    here, there = [slice(None)] * values.ndim, [slice(None)] * values.ndim
    here[axis], there[axis] = slice(None, -k), slice(k, None)
    return tuple(here), tuple(there)


def _runs(labels: np.ndarray, axis: int) -> np.ndarray:
    """Number of a voxel's run of equal labels on its line."""
    change = np.zeros(labels.shape, np.int32)
    here, there = _shifted(labels, axis, 1)
    change[there] = labels[here] != labels[there]
    return np.cumsum(change, axis=axis, dtype=np.int32)


def _pass(labels: np.ndarray, squared: np.ndarray, axis: int, steps: np.ndarray, black_border: bool) -> np.ndarray:
    """``steps[k]`` is the squared length of k steps; ``squared`` holds the passes before (infinite at first)."""
    run, out, size = _runs(labels, axis), squared.copy(), labels.shape[axis]
    for k in range(1, size + 1):
        cost = steps[k]
        if not (cost < out.max(initial=0)):
            break
        if k < size:
            here, there = _shifted(labels, axis, k)
            same = run[here] == run[there]
            for own, other in ((here, there), (there, here)):
                np.minimum(out[own], np.where(same, squared[other] + cost, cost), out=out[own])
        if black_border:
            edge = [slice(None)] * labels.ndim
            for at in (slice(k - 1, k), slice(size - k, size - k + 1)):
                edge[axis] = at
                np.minimum(out[tuple(edge)], cost, out=out[tuple(edge)])
    return out


def squared_edt(labels: np.ndarray, anisotropy=(1.0, 1.0, 1.0), black_border: bool = False, dimensions: int = 3) -> np.ndarray:
    """Squared distances; 0 in the background, infinite where nothing ends the label."""
    out = np.full(labels.shape, np.inf)
    for axis in range(dimensions):
        w = np.float32(anisotropy[axis])
        k = np.arange(labels.shape[axis] + 1)
        if axis == 0:  # the first axis adds spacings up one by one, in float32
            lengths = np.concatenate([[np.float32(0)], np.cumsum(np.full(len(k) - 1, w), dtype=np.float32)])
            steps = (lengths * lengths).astype(np.float64)
        else:
            steps = (float(w) * k) ** 2
        out = _pass(labels, out, axis, steps, black_border)
    out[labels == 0] = 0
    return out


def edt(labels: np.ndarray, anisotropy=(1.0, 1.0, 1.0), black_border: bool = False, dimensions: int = 3) -> np.ndarray:
    return np.sqrt(squared_edt(labels, anisotropy, black_border, dimensions).astype(np.float32))


def graph_edt(labels: np.ndarray, graph: np.ndarray, anisotropy=(1.0, 1.0, 1.0), black_border: bool = False) -> np.ndarray:
    """Distances where forbidden steps over faces are walls half a voxel away: on a grid of doubled resolution."""
    inside = labels > 0
    doubled = np.zeros(tuple(2 * s for s in labels.shape), np.int8)
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                part = inside
                if dx + dy + dz == 1:  # only the middle of a face can be a wall; bits of +x, +y, +z
                    part = inside & ((graph >> (0 if dx else 2 if dy else 4)) & 1 == 1)
                doubled[dx::2, dy::2, dz::2] = part
    if black_border:
        for axis in range(3):
            end = [slice(None)] * 3
            end[axis] = -1
            doubled[tuple(end)] = 0
    half = [x / 2 for x in anisotropy]
    return np.where(inside, edt(doubled, half, black_border)[::2, ::2, ::2], np.float32(0)).astype(np.float32)
