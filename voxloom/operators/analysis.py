"""Cross sections, parcels and point-to-point paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.kernels.graph import paths
from voxloom.kernels.grid import fill_voids
from voxloom.kernels.section import connect_points as connect_kernel
from voxloom.kernels.section import parcels, section, section_areas, tangents
from voxloom.operators.grouped import box_of, grouped
from voxloom.operators.postprocess import KEYS, downsampled, nested, skeleton_from, skeleton_rows, split
from voxloom.schemas import SKELETONS


def _crop(table: pa.Table, shape, fill_holes: bool) -> tuple[np.ndarray, np.ndarray]:
    """A label's mask with a margin of one voxel where the volume goes on, and its origin."""
    at = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1).astype(np.int64)
    low = np.maximum(at.min(axis=0) - 1, 0)
    high = np.minimum(at.max(axis=0) + 2, shape)
    mask = np.zeros(tuple(high - low), bool)
    mask[tuple((at - low).T)] = True
    return (fill_voids(mask)[0] if fill_holes else mask), low


def cross_sectional_area(
    voxels: DataFrame, volumes: DataFrame, vertices: DataFrame, edges: DataFrame, smoothing_window: int = 1, step: int = 1, fill_holes: bool = False, physical: bool = True,
    previous: DataFrame | None = None, multipass: bool = False, repair_contacts: bool = False,
) -> DataFrame:
    """(volume_id, label, vidx, area, contacts) of every vertex: the plane across the smoothed direction of its path, cut
    with the connected part of its label.  A label without voxels has area -1.  A group is one label with its skeleton.

    ``previous`` are rows of an earlier pass, over a smaller or a cut volume.  With ``multipass`` areas above 0 stay and the
    others are measured; with ``repair_contacts`` only sections that touched a face are measured again."""
    if (multipass or repair_contacts) and previous is None:
        raise ValueError("a further pass needs the rows of the previous one")
    graphs = nested(vertices, edges)
    if previous is not None:
        lists = previous.groupBy(*KEYS).agg(F.collect_list(F.struct("vidx", "area", "contacts")).alias("p"))
        graphs = graphs.join(lists, KEYS, "left")
    schema = "volume_id long, label long, vidx long, area float, contacts long"
    sized = voxels.join(volumes, "volume_id").select(*KEYS, "x", "y", "z", "sx", "sy", "sz", "ax", "ay", "az")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("volume_id", "label", "vidx", "area", "contacts")}
        for row in right.to_pylist():
            names = [p["vidx"] for p in row["v"]]
            areas, contacts = np.full(len(names), -1, np.float32), np.zeros(len(names), np.int64)
            before = {q["vidx"]: (q["area"], q["contacts"]) for q in row.get("p") or []}
            old = [before.get(v, (-1.0, 0)) for v in names]
            wanted = np.array([(v not in before) or (repair_contacts and c > 0) or (multipass and a <= 0) for v, (a, c) in zip(names, old)], bool)
            if left.num_rows > 1 and wanted.any():
                w = np.array([left.column(f"a{a}")[0].as_py() for a in "xyz"])
                mask, low = _crop(left, np.array([left.column(f"s{a}")[0].as_py() for a in "xyz"]), fill_holes)
                s = skeleton_from(row["v"], row["e"])
                s.vertices = (np.rint(s.vertices / w.astype(np.float32)) if physical else s.vertices) - low
                areas, contacts = section_areas(mask, s, w, smoothing_window, step, wanted)
            if before:
                areas = np.where(wanted, areas, np.array([a for a, _ in old], np.float32))
                contacts = np.where(wanted, contacts, np.array([c for _, c in old], np.int64))
            out["vidx"] += names
            out["area"] += areas.tolist()
            out["contacts"] += contacts.tolist()
            out["volume_id"] += [row["volume_id"]] * len(names)
            out["label"] += [row["label"]] * len(names)
        return pa.table({n: pa.array(v, pa.float32() if n == "area" else pa.int64()) for n, v in out.items()})

    return sized.groupBy(*KEYS).cogroup(graphs.groupBy(*KEYS)).applyInArrow(run, schema)


def section_planes(voxels: DataFrame, volumes: DataFrame, vertices: DataFrame, edges: DataFrame, smoothing_window: int = 1) -> DataFrame:
    """(volume_id, label, x, y, z, vidx): the voxels of every vertex's section, for display; the last vertex wins."""
    from voxloom.kernels.graph import paths

    schema = "volume_id long, label long, x long, y long, z long, vidx long"
    sized = voxels.join(volumes, "volume_id").select(*KEYS, "x", "y", "z", "sx", "sy", "sz", "ax", "ay", "az")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in right.to_pylist() if left.num_rows > 1 else []:
            w = np.array([left.column(f"a{a}")[0].as_py() for a in "xyz"])
            mask, low = _crop(left, np.array([left.column(f"s{a}")[0].as_py() for a in "xyz"]), False)
            s = skeleton_from(row["v"], row["e"])
            s.vertices = np.rint(s.vertices / w.astype(np.float32)) - low
            seen: dict[tuple, int] = {}
            for path in paths(s):
                for v, n in zip(path, tangents(s.vertices[path].astype(np.float64), smoothing_window)):
                    seen |= {tuple(p): row["v"][v]["vidx"] for p in section(mask, s.vertices[v].astype(np.float64), n, w)[2].tolist()}
            rows += [(row["volume_id"], row["label"], *(np.array(p) + low).tolist(), v) for p, v in seen.items()]
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(schema.split(", "))})

    return sized.groupBy(*KEYS).cogroup(nested(vertices, edges).groupBy(*KEYS)).applyInArrow(run, schema)


def oversegment(voxels: DataFrame, vertices: DataFrame, edges: DataFrame, anisotropy, downsample: int = 0, physical: bool = True) -> tuple[DataFrame, DataFrame]:
    """(voxels with ``feature``, vertices with ``segment``): each voxel belongs to the nearest vertex of its label's
    skeleton; parcels are numbered in the order of their first voxels."""
    w = [float(x) for x in anisotropy]
    place = [F.rint(F.col(a) / F.lit(k)).cast("long").alias(a) if physical else F.col(a).cast("long").alias(a) for a, k in zip("xyz", w)]
    points = vertices.select(*KEYS, "vidx", *place)
    sources = points if downsample <= 1 else points.join(downsampled(vertices, edges, downsample), [*KEYS, "vidx"], "left_semi")
    marked = voxels.join(sources.select(*KEYS, "x", "y", "z").distinct().withColumn("__s", F.lit(1)), [*KEYS, "x", "y", "z"], "left")

    def kernel(c):
        at, _ = box_of(c)
        coords, owner = parcels(at, at[~np.isnan(c["__s"].astype(float))], w)
        order = np.lexsort((at[:, 0], at[:, 1], at[:, 2]))
        return {"vid": c["vid"].astype(np.int64)[order], "x": coords[:, 0], "y": coords[:, 1], "z": coords[:, 2], "owner": owner}

    owned = grouped(marked, KEYS, kernel, "volume_id long, label long, vid long, x long, y long, z long, owner long")
    first = owned.where("owner > 0").groupBy(*KEYS, "owner").agg(F.min("vid").alias("first"))
    number = first.withColumn("feature", F.row_number().over(Window.partitionBy("volume_id").orderBy("first")).cast("long"))
    features = owned.join(number.drop("first"), [*KEYS, "owner"], "left").select(*KEYS, "vid", "x", "y", "z", F.coalesce("feature", F.lit(0)).cast("long").alias("feature"))
    segments = points.join(features.select(*KEYS, "x", "y", "z", F.col("feature").alias("segment")), [*KEYS, "x", "y", "z"], "left")
    return features, segments


def connect_points(voxels: DataFrame, volumes: DataFrame, start, end, pdrf_scale: float = 100000, pdrf_exponent: float = 4) -> tuple[DataFrame, DataFrame]:
    """The most central path from ``end`` to ``start`` in each volume, as vertices and edges in physical units."""

    def kernel(c):
        at, _ = box_of(c)
        mask = np.zeros(tuple(int(c[f"s{a}"][0]) for a in "xyz"), bool)
        mask[tuple(at.T)] = True
        return skeleton_rows([(0, 0, connect_kernel(mask, start, end, [float(c[f"a{a}"][0]) for a in "xyz"], pdrf_scale, pdrf_exponent))])

    v, e = split(grouped(voxels.join(volumes, "volume_id"), ["volume_id"], kernel, SKELETONS))
    return v.drop("part"), e.drop("part")
