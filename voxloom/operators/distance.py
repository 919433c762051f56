"""Distance fields of volumes.

The exact distance to the surface takes one pass per axis.  A pass groups voxels by pencils (blocks of lines along the
axis), so a group holds at most ``PENCIL``^2 whole lines; three shuffles, whatever the sizes of the objects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.voxel import steps
from voxloom.kernels.edt import _pass, edt, graph_edt
from voxloom.kernels.geodesic import edge_distances, entry_distances, farthest, feature_map, parents
from voxloom.kernels.grid import Voxels
from voxloom.operators.grouped import box_of, grouped
from voxloom.operators.joins import neighbour_pairs
from voxloom.plans.fixpoint import distances

PENCIL = 64


def _axis_pass(axis: int, black_border: bool, first: bool, carry: tuple[str, ...]):
    def kernel(c):
        at, low = box_of(c)
        size = at.max(axis=0) - low + 1
        length = int(c["size"][0])
        low[axis], size[axis] = 0, length
        labels, squared = np.zeros(tuple(size), np.int64), np.full(tuple(size), np.inf)
        place = tuple((at - low).T)
        labels[place] = c["cc"].astype(np.int64)
        if not first:
            squared[place] = c["d2"]
        w = np.float32(c["spacing"][0])
        k = np.arange(length + 1)
        if axis == 0:
            lengths = np.concatenate([[np.float32(0)], np.cumsum(np.full(length, w), dtype=np.float32)])
            steps = (lengths * lengths).astype(np.float64)
        else:
            steps = (float(w) * k) ** 2
        out = _pass(labels, squared, axis, steps, black_border)
        return {n: c[n].astype(np.int64) for n in ("vid", "x", "y", "z", "cc", *carry)} | {"d2": out[place]}

    return kernel


def axis_pass(rows: DataFrame, volumes: DataFrame, axis: int, black_border: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One axis of ``squared_edt``, over rows with ``cc`` and, but for the first axis, ``d2``; ``carry`` names further
    columns of integers that stay with their voxels."""
    a, others = "xyz"[axis], [b for b in "xyz" if b != "xyz"[axis]]
    cut = rows.join(volumes.select("volume_id", F.col(f"s{a}").alias("size"), F.col(f"a{a}").alias("spacing")), "volume_id")
    cut = cut.withColumns({f"p{b}": F.floor(F.col(b) / PENCIL) for b in others})
    schema = ", ".join(["volume_id long", *[f"{c} long" for c in (f"p{others[0]}", f"p{others[1]}", "vid", "x", "y", "z", "cc", *carry)], "d2 double"])
    return grouped(cut, ["volume_id", *[f"p{b}" for b in others]], _axis_pass(axis, black_border, axis == 0, carry), schema).drop(*[f"p{b}" for b in others])


def squared_edt(voxels: DataFrame, volumes: DataFrame, black_border: bool = False, key: str = "cc", carry: tuple[str, ...] = ()) -> DataFrame:
    """Voxels with ``d2``: the squared distance to the nearest voxel with another ``key``, background among them;
    infinite where a volume has none.  With ``black_border`` the outside counts too."""
    rows = voxels.withColumn("cc", F.col(key)).select("volume_id", "vid", "x", "y", "z", "cc", *carry)
    for axis in range(3):
        rows = axis_pass(rows, volumes, axis, black_border, carry)
    return rows.withColumnRenamed("cc", key)


def depth() -> Column:
    """The distance, as float, of the column ``d2``."""
    return F.sqrt(F.col("d2").cast("float")).cast("float")


def with_dbf(voxels: DataFrame, volumes: DataFrame, black_border: bool = False) -> DataFrame:
    """Voxels (with ``cc``) and their distance to the surface, as float.  Columns of integers travel with the voxels."""
    carry = tuple(c for c, kind in voxels.dtypes if c not in ("volume_id", "vid", "x", "y", "z", "cc") and kind in ("bigint", "int", "smallint", "tinyint"))
    return squared_edt(voxels, volumes, black_border, carry=carry).select("volume_id", "vid", "x", "y", "z", *carry, "cc", depth().alias("dbf"))


def graph_dbf(cells: DataFrame) -> DataFrame:
    """Distances where a connectivity graph's forbidden faces are walls half a voxel away; a group is a volume or chunk."""

    def kernel(c):
        at, low = box_of(c)
        shape = tuple(at.max(axis=0) + 1)
        labels, bits = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        labels[tuple(at.T)], bits[tuple(at.T)] = c["label"], c["graph_bits"]
        d = graph_edt(labels, bits, (float(c["ax"][0]), float(c["ay"][0]), float(c["az"][0])))
        return {n: c[n].astype(np.int64) for n in ("vid", "x", "y", "z", "label")} | {"dbf": d[tuple(at.T)]}

    return grouped(cells, ["volume_id"], kernel, "volume_id long, vid long, x long, y long, z long, label long, dbf float")


def line_edt(voxels: DataFrame, anisotropy, dimensions: int = 1) -> DataFrame:
    """Distances along x, or in planes of x and y: groups are the lines' planes."""

    def kernel(c):
        at, low = box_of(c)
        shape = tuple(at.max(axis=0) - low + 3)
        labels = np.zeros(shape, np.int64)
        place = tuple((at - low + 1).T)
        labels[place] = c["label"]
        return {n: c[n].astype(np.int64) for n in ("vid", "x", "y", "label")} | {"d": edt(labels, anisotropy, False, dimensions)[place]}

    return grouped(voxels, ["volume_id", "z"], kernel, "volume_id long, z long, vid long, x long, y long, label long, d float")


def geodesic(voxels: DataFrame, volumes: DataFrame, sources: DataFrame) -> DataFrame:
    """(volume_id, vid, dist): shortest walks over steps of one label from the sources (volume_id, vid), as rounds of
    joins; for components of any size."""
    pairs = neighbour_pairs(voxels, volumes)
    offsets = steps(voxels.sparkSession).select("k", "dx", "dy", "dz")
    weights = pairs.join(F.broadcast(offsets), "k").join(volumes.select("volume_id", "ax", "ay", "az"), "volume_id")  # 26 rows
    w = F.sqrt(F.expr("ax*ax*dx*dx + ay*ay*dy*dy + az*az*dz*dz"))
    number = lambda v: F.struct("volume_id", F.col(v).alias("vid"))
    out = distances(weights.select(number("vid").alias("a"), number("nvid").alias("b"), w.alias("w")), sources.select(number("vid").alias("node")))
    return out.select("node.volume_id", "node.vid", "dist")


def component_field(voxels: DataFrame, kind: str, anisotropy, source: str = "first") -> DataFrame:
    """Fields of each component, by kernel: ``kind`` is ``daf`` (steps weighted by length) or ``entry`` (by the cost of
    the voxel entered, column ``cost``; with the preceding voxel).  The source is the first voxel, or the column
    ``source`` where that is named."""

    def kernel(c):
        at, _ = box_of(c)
        order = np.lexsort((at[:, 0], at[:, 1], at[:, 2]))
        vid = c["vid"].astype(np.int64)[order]
        near = Voxels.of(at, c["graph_bits"].astype(np.int64) if "graph_bits" in c else None)
        start = 0 if source == "first" else int(np.flatnonzero(vid == int(c["source"][0]))[0])
        if kind == "daf":
            dist, before = edge_distances(near, start, anisotropy), np.full(len(vid), -1)
        else:
            dist = entry_distances(near, c["cost"].astype(np.float32)[order], start)
            before = parents(near, dist, start)
        top = np.zeros(len(vid), bool)
        top[farthest(dist)] = True
        return {"vid": vid, "dist": dist, "parent": np.where(before >= 0, vid[before], -1), "farthest": top}

    return grouped(voxels, ["volume_id", "cc"], kernel, "volume_id long, cc long, vid long, dist float, parent long, farthest boolean")


def nearest_source(voxels: DataFrame, sources: DataFrame, anisotropy) -> DataFrame:
    """(volume_id, label, vid, source): the geodesically nearest source of each voxel, by its number from 1 in the order of
    (x, y, z); the larger on ties.  Sources are rows (volume_id, label, x, y, z)."""
    marked = voxels.join(sources.select("volume_id", "label", "x", "y", "z").distinct().withColumn("__s", F.lit(1)), ["volume_id", "label", "x", "y", "z"], "left")

    def kernel(c):
        at, _ = box_of(c)
        order = np.lexsort((at[:, 0], at[:, 1], at[:, 2]))
        near = Voxels.of(at)
        is_source = ~np.isnan(c["__s"].astype(float))[order]
        points = np.flatnonzero(is_source)
        points = points[np.lexsort((near.coords[points, 2], near.coords[points, 1], near.coords[points, 0]))]
        return {"vid": c["vid"].astype(np.int64)[order], "source": feature_map(near, points.tolist(), anisotropy)}

    return grouped(marked, ["volume_id", "label"], kernel, "volume_id long, label long, vid long, source long")
