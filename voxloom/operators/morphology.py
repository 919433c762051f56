"""Hole filling, repair of nested components, border targets, invalidation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from voxloom.kernels import geodesic as geo
from voxloom.kernels import volume as vol
from voxloom.kernels.edt import edt
from voxloom.kernels.grid import Voxels, fill_voids
from voxloom.operators.components import face_components
from voxloom.operators.filters import faces
from voxloom.operators.grouped import box_of, grouped

VOLUME_KEYS = ["volume_id"]


def _volume(c, columns: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    at, _ = box_of(c)
    shape = tuple(int(c[f"s{a}"][0]) for a in "xyz")
    out = []
    for name in columns:
        a = np.zeros(shape, np.float32 if name == "dbf" else np.int64)
        a[tuple(at.T)] = c[name]
        out.append(a)
    return at, out


def _rows(ids: np.ndarray, **fields: np.ndarray) -> dict[str, np.ndarray]:
    at = np.argwhere(ids)
    place = tuple(at.T)
    sx, sy, _ = ids.shape
    return {"vid": at[:, 0] + sx * (at[:, 1] + sy * at[:, 2]), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "cc": ids[place]} | {k: v[place] for k, v in fields.items()}


def filled_components(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every component with its voids filled, by rising number within its first box; a component that is painted over
    isn't filled later.  The order makes a volume (or chunk) one group."""

    def kernel(c):
        _, (ids,) = _volume(c, ("cc",))
        return _rows(vol.fill_all_holes(ids, int(ids.max()))[0])

    return grouped(voxels.join(volumes.select("volume_id", "sx", "sy", "sz"), "volume_id"), VOLUME_KEYS, kernel, "volume_id long, vid long, x long, y long, z long, cc long")


def filled_masks(voxels: DataFrame, key: str = "cc") -> DataFrame:
    """Each component with its own voids, apart from all others: (volume_id, cc, x, y, z, added)."""

    def kernel(c):
        at, low = box_of(c)
        mask = np.zeros(tuple(at.max(axis=0) - low + 1), bool)
        mask[tuple((at - low).T)] = True
        solid, _ = fill_voids(mask)
        where = np.argwhere(solid)
        x, y, z = (where + low).T
        return {"x": x, "y": y, "z": z, "added": ~mask[tuple(where.T)]}

    return grouped(voxels, ["volume_id", key], kernel, f"volume_id long, {key} long, x long, y long, z long, added boolean")


def repaired(voxels: DataFrame, volumes: DataFrame, threshold: float) -> DataFrame:
    """Large inner components go to the component around them; a volume (or chunk) is one group, since each decision
    depends on those before.  ``voxels`` has cc and dbf; the result has both anew, numbered by first voxels."""

    def kernel(c):
        _, (ids, dbf) = _volume(c, ("cc", "dbf"))
        w = tuple(float(c[f"a{a}"][0]) for a in "xyz")
        ids, dbf, _ = vol.fix_avocados(ids, dbf, threshold, w)
        flat = ids.ravel(order="F")
        found, first = np.unique(flat, return_index=True)
        order = [i for _, i in sorted(zip(first.tolist(), found.tolist())) if i]
        number = np.zeros(int(flat.max()) + 1, np.int64)
        number[order] = np.arange(1, len(order) + 1)
        return _rows(number[ids], dbf=dbf)

    return grouped(voxels.join(volumes, "volume_id"), VOLUME_KEYS, kernel, "volume_id long, vid long, x long, y long, z long, cc long, dbf float")


def soma_flags(voxels: DataFrame, volumes: DataFrame, detection: float, acceptance: float, scale: float, const: float) -> DataFrame:
    """(volume_id, cc, soma, radius, filled): which components are taken for cell bodies, after filling their voids."""

    def kernel(c):
        at, low = box_of(c)
        d = c["dbf"].astype(np.float32)
        top, added = float(d.max()), 0
        if top > detection:
            mask = np.zeros(tuple(at.max(axis=0) - low + 1), bool)
            mask[tuple((at - low).T)] = True
            solid, added = fill_voids(mask)
            if added:
                top = float(edt(solid.astype(np.int8), tuple(float(c[f"a{a}"][0]) for a in "xyz"), bool(solid.all())).max())
        soma = top > detection and top > acceptance
        return {"soma": [soma], "radius": [top * scale + const if soma else 0.0], "filled": [added]}

    return grouped(voxels.join(volumes.select("volume_id", "ax", "ay", "az"), "volume_id"), ["volume_id", "cc"], kernel, "volume_id long, cc long, soma boolean, radius double, filled long")


def border_targets(components: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, cc, ord, face, x, y, z): where each component meets the volume's faces; a group is one face."""
    pixels = faces(components.select("volume_id", "vid", "x", "y", "z", F.col("cc").alias("label")), volumes).join(volumes, "volume_id")

    def kernel(c):
        face = int(c["face"][0])
        a, b, k = vol.FACE_AXES[face // 2]
        size = [int(c[f"s{n}"][0]) for n in "xyz"]
        w = [float(c[f"a{n}"][0]) for n in "xyz"]
        plane = np.zeros((size[a], size[b]), np.int64)
        plane[c["u"].astype(int), c["v"].astype(int)] = c["label"]
        got = vol.face_picks(plane, w[a], w[b])
        points = [vol.on_face(face, x, y, size[k] - 1 if face % 2 else 0) for _, x, y, _ in got]
        return {"cc": [p[3] for p in got], "first": [p[0] for p in got]} | {n: [p[i] for p in points] for i, n in enumerate("xyz")}

    found = grouped(pixels, ["volume_id", "face"], kernel, "volume_id long, face long, cc long, first long, x long, y long, z long")
    once = found.groupBy("volume_id", "cc", "x", "y", "z").agg(F.min(F.struct("face", "first")).alias("at"))
    return once.select("volume_id", "cc", F.struct("at.face", "at.first").alias("ord"), F.col("at.face").alias("face"), "x", "y", "z")


def patches(components: DataFrame, volumes: DataFrame) -> DataFrame:
    """Patches of components on the faces: see ``face_components``."""
    return face_components(faces(components.select("volume_id", "vid", "x", "y", "z", F.col("cc").alias("label")), volumes))


def invalidated(voxels: DataFrame, path: DataFrame, scale: float, const: float, anisotropy) -> DataFrame:
    """(volume_id, cc, vid): the voxels that growth from a path (volume_id, cc, vid) takes out of a component with dbf."""
    marked = voxels.join(path.select("volume_id", "cc", "vid").withColumn("__p", F.lit(1)), ["volume_id", "cc", "vid"], "left")

    def kernel(c):
        at, _ = box_of(c)
        order = np.lexsort((at[:, 0], at[:, 1], at[:, 2]))
        near, alive = Voxels.of(at), np.ones(len(at), bool)
        on = np.flatnonzero(~np.isnan(c["__p"].astype(float))[order])
        geo.invalidate(near, alive, c["dbf"].astype(np.float32)[order], on.tolist(), scale, const, anisotropy)
        return {"vid": c["vid"].astype(np.int64)[order][~alive]}

    return grouped(marked, ["volume_id", "cc"], kernel, "volume_id long, cc long, vid long")


def normalised_distances(voxels: DataFrame) -> DataFrame:
    """Foreground with distance 0 (painted since the field was made) counts as infinitely deep."""
    return voxels.withColumn("dbf", F.when((F.col("dbf") == 0) & (F.col("label") != 0), F.lit(float("inf")).cast("float")).otherwise(F.col("dbf")))
