"""Paths and traces of single components, as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from voxloom.kernels import geodesic as geo
from voxloom.kernels.grid import Voxels
from voxloom.kernels.trace import skeleton_of
from voxloom.operators.grouped import box_of, grouped
from voxloom.operators.postprocess import skeleton_rows, split
from voxloom.params import TeasarParams
from voxloom.schemas import SKELETONS


def _ordered(c) -> tuple[Voxels, np.ndarray, np.ndarray]:
    at, _ = box_of(c)
    order = np.lexsort((at[:, 0], at[:, 1], at[:, 2]))
    bits = c["graph_bits"].astype(np.int64) if "graph_bits" in c else None
    return Voxels.of(at, bits), order, c["vid"].astype(np.int64)[order]


def railroads(voxels: DataFrame, targets: DataFrame) -> DataFrame:
    """(volume_id, cc, i, vid): the cheapest path from each component's target (volume_id, cc, target) to a rail, a voxel
    whose ``cost`` is 0; no rows where none can be reached."""

    def kernel(c):
        near, order, vid = _ordered(c)
        start = int(np.flatnonzero(vid == int(c["target"][0]))[0])
        path = geo.railroad(near, c["cost"].astype(np.float32)[order], start)
        return {"i": list(range(len(path))), "vid": vid[path]}

    return grouped(voxels.join(targets, ["volume_id", "cc"]), ["volume_id", "cc"], kernel, "volume_id long, cc long, i long, vid long")


def backtraces(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """(volume_id, cc, i, vid): from each component's source to its target through ``parent``, as far as it leads."""

    def kernel(c):
        vid = c["vid"].astype(np.int64)
        place = {v: k for k, v in enumerate(vid.tolist())}
        parent = np.array([place.get(int(p), -1) for p in c["parent"]])
        path = geo.walk_back(parent, place[int(c["target"][0])], -1)
        return {"i": list(range(len(path))), "vid": vid[path]}

    return grouped(parents.join(targets, ["volume_id", "cc"]), ["volume_id", "cc"], kernel, "volume_id long, cc long, i long, vid long")


def traces(components: DataFrame, teasar_params, anisotropy, fix_branching: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) in voxel coordinates of every component with its distances (columns cc, dbf)."""
    params = TeasarParams.of(teasar_params)

    def kernel(c):
        at, _ = box_of(c)
        s = skeleton_of(at, c["dbf"].astype(np.float32), params, anisotropy, fix_branching=fix_branching)
        return skeleton_rows([(int(c["cc"][0]), 0, s)] if len(s.edges) else [])

    v, e = split(grouped(components, ["volume_id", "cc"], kernel, SKELETONS))
    return v.drop("part"), e.drop("part")
