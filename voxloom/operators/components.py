"""Connected components of volumes and skeletons.

Volumes are cut into blocks.  Each block is labelled by a kernel; pairs of voxels across block walls give edges between
block components; the small graph of those is contracted.  Only wall voxels take part in a join, so the work beyond the
kernels grows with the surface of blocks and not with the volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.kernels.grid import GRAPH_BITS, OFFSETS, Voxels, flat, sequential_components
from voxloom.operators.filters import with_steps
from voxloom.operators.grouped import TASK_ROWS, box_of, grouped
from voxloom.plans.fixpoint import components as graph_roots, reliable

BLOCK = 64


def _blocked(voxels: DataFrame, block: int) -> DataFrame:
    return voxels.withColumns({f"b{a}": F.floor(F.col(a) / block) for a in "xyz"})


def _local_roots(graph: bool, faces_only: bool):
    """Kernel of a block: the least index of each voxel's component within the block."""

    def kernel(c):
        at, low = box_of(c)
        vid, labels = c["vid"].astype(np.int64), c["label"].astype(np.int64)
        order = np.argsort(flat(at - low, tuple(at.max(axis=0) - low + 1)), kind="stable")
        voxels = Voxels.of(at)
        vid, labels = vid[order], labels[order]
        near = voxels.near
        ks = range(6) if faces_only else range(26)
        first, second = [], []
        bits = c["graph_bits"].astype(np.int64)[order] if graph else None
        for k in ks:
            if OFFSETS[k][::-1].tolist() > [0, 0, 0]:
                continue
            other = near[:, k]
            ok = other >= 0
            if graph:
                ok &= (bits >> GRAPH_BITS[k]) & 1 == 1
            else:
                ok &= labels == labels[other]
            first.append(np.flatnonzero(ok))
            second.append(other[ok])
        root = sequential_components(len(vid), np.concatenate(first), np.concatenate(second))
        return {"vid": vid, "x": voxels.coords[:, 0], "y": voxels.coords[:, 1], "z": voxels.coords[:, 2], "label": labels, "local": vid[root], **({"graph_bits": bits} if graph else {})}

    return kernel


def labelled(voxels: DataFrame, volumes: DataFrame, block: int = BLOCK, graph: bool = False, faces_only: bool = False) -> DataFrame:
    """Voxels with ``root``, the least index of their component.  With ``graph`` a step needs the bit of the voxel with the
    higher index, whatever the labels; then background voxels should be among the rows, since they may connect."""
    extra = ", graph_bits long" if graph else ""
    cut = _blocked(voxels, block)
    local = grouped(cut, ["volume_id", "bx", "by", "bz"], _local_roots(graph, faces_only), f"volume_id long, bx long, by long, bz long, vid long, x long, y long, z long, label long, local long{extra}")
    at_wall = F.lit(False)
    for a in "xyz":
        at_wall |= (F.col(a) % block == 0) | (F.col(a) % block == block - 1)
    walls = local.where(at_wall)
    asked = with_steps(walls, volumes).where(f"nvid < vid AND (floor(nx / {block}) <> bx OR floor(ny / {block}) <> by OR floor(nz / {block}) <> bz)")
    if faces_only:
        asked = asked.where("k < 6")
    if graph:
        asked = asked.where("(shiftright(graph_bits, cast(bit AS int)) & 1) = 1")
    other = walls.select("volume_id", F.col("vid").alias("nvid"), F.col("label").alias("nlabel"), F.col("local").alias("nlocal"))
    met = asked.join(other, ["volume_id", "nvid"])
    seams = (met if graph else met.where("label = nlabel")).select("volume_id", "local", "nlocal").distinct()
    number = lambda c: F.struct("volume_id", F.col(c).alias("vid"))
    roots = graph_roots(seams.select(number("local").alias("a"), number("nlocal").alias("b")))
    found = roots.select(F.col("node.volume_id").alias("volume_id"), F.col("node.vid").alias("local"), F.col("root.vid").alias("root"))
    return local.join(found, ["volume_id", "local"], "left").select("volume_id", "vid", "x", "y", "z", "label", F.coalesce("root", "local").alias("root"), *(["graph_bits"] if graph else []))


def ranked(roots: DataFrame) -> DataFrame:
    """Distinct (volume_id, root), and whatever other columns, with ``cc``: 1, 2, ... in a volume, in the order of the roots.

    Roots are dealt by ranges and ranked within them; only ranges' sizes are summed up in one task."""
    roots = reliable(roots)
    tasks = max(1, -(-roots.count() // TASK_ROWS))
    dealt_out = reliable(roots.repartitionByRange(tasks, "volume_id", "root").withColumn("__range", F.spark_partition_id()))
    sizes = dealt_out.groupBy("volume_id", "__range").agg(F.count("*").alias("__n"))
    above = Window.partitionBy("volume_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("volume_id", "__range", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    within = F.row_number().over(Window.partitionBy("volume_id", "__range").orderBy("root"))
    placed = dealt_out.repartition(tasks, "volume_id", "__range").withColumn("__at", within).join(sizes, ["volume_id", "__range"])
    return placed.withColumn("cc", (F.col("__above") + F.col("__at")).cast("long")).drop("__range", "__at", "__above")


def numbered(rooted: DataFrame) -> DataFrame:
    """Voxels with ``cc``: components as 1, 2, ... in the order of their least index; only the roots are ranked."""
    return rooted.join(ranked(rooted.where("vid = root").select("volume_id", "root")), ["volume_id", "root"])


def connected_components(voxels: DataFrame, volumes: DataFrame, block: int = BLOCK) -> DataFrame:
    """26-connected components of equal labels: voxels with ``root`` and ``cc``."""
    return numbered(labelled(voxels, volumes, block))


def component_table(components: DataFrame) -> DataFrame:
    """(volume_id, cc, label, root, voxels)."""
    return components.groupBy("volume_id", "cc").agg(F.min_by("label", "vid").alias("label"), F.min("vid").alias("root"), F.count("*").alias("voxels"))


def graph_connected_components(cells: DataFrame, volumes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Components over permitted steps.  ``cells`` has background too (label 0 or less), which may connect; only voxels
    above 0 get a number, by the least index of the foreground's graph component.  ``mapped`` is the label at the start of
    the component's last run."""
    rooted = labelled(cells, volumes, block, graph=True)
    inside = rooted.where("label > 0")
    key = inside.groupBy("volume_id", "root").agg(F.min("vid").alias("first"))
    ranked = key.withColumn("cc", F.row_number().over(Window.partitionBy("volume_id").orderBy("root")).cast("long"))
    rows = inside.join(ranked, ["volume_id", "root"])
    order = Window.partitionBy("volume_id", "cc").orderBy("vid")
    starts = rows.withColumn("__before", F.lag("vid").over(order)).where("__before IS NULL OR __before <> vid - 1")
    last = starts.groupBy("volume_id", "cc").agg(F.max_by("label", "vid").alias("mapped"))
    return rows.join(last, ["volume_id", "cc"])


def face_components(pixels: DataFrame) -> DataFrame:
    """8-connected patches of equal components on each face: a group is one plane, bounded by the volume's side."""

    def kernel(c):
        u, v, owner = (c[k].astype(np.int64) for k in ("u", "v", "label"))
        flat_steps = [k for k in range(26) if OFFSETS[k][2] == 0]
        plane = Voxels.of(np.stack([u, v, np.zeros_like(u)], axis=1))
        order = np.lexsort((u, v))
        u, v, owner = u[order], v[order], owner[order]
        first = [np.flatnonzero((plane.near[:, k] >= 0) & (owner == owner[plane.near[:, k]])) for k in flat_steps]
        second = [plane.near[f, k] for f, k in zip(first, flat_steps)]
        root = sequential_components(len(u), np.concatenate(first), np.concatenate(second))
        return {"u": u, "v": v, "label": owner, "pu": u[root], "pv": v[root]}

    return grouped(pixels, ["volume_id", "face"], kernel, "volume_id long, face long, u long, v long, label long, pu long, pv long").withColumn("patch", F.struct(F.col("pv").alias("v"), F.col("pu").alias("u"))).drop("pu", "pv")


def skeleton_components(edges: DataFrame) -> DataFrame:
    """(volume_id, label, vidx, part): the least vertex of each vertex's component."""
    number = lambda c: F.struct("volume_id", "label", F.col(c).alias("vidx"))
    roots = graph_roots(edges.select(number("e0").alias("a"), number("e1").alias("b")))
    return roots.select("node.volume_id", "node.label", "node.vidx", F.col("root.vidx").alias("part"))


def background_cells(voxels: DataFrame, volumes: DataFrame, margin: int = 0) -> DataFrame:
    """The background within the bounding box of a volume's foreground, with a margin; label 0."""
    box = voxels.groupBy("volume_id").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    cells = box
    for a in "xyz":
        cells = cells.withColumn(a, F.explode(F.sequence(F.col(f"l{a}") - margin, F.col(f"h{a}") + margin)))
    sized = cells.join(volumes.select("volume_id", "sx", "sy", "sz"), "volume_id").where("x >= 0 AND y >= 0 AND z >= 0 AND x < sx AND y < sy AND z < sz")
    return sized.withColumn("vid", F.expr("x + sx * (y + sy * z)")).join(voxels.select("volume_id", "vid"), ["volume_id", "vid"], "left_anti").select("volume_id", "vid", "x", "y", "z", F.lit(0).cast("long").alias("label"))


def void_voxels(voxels: DataFrame, volumes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Background that the foreground encloses: 6-connected components of it that don't reach the box's faces."""
    cells = background_cells(voxels, volumes)
    rooted = labelled(cells, volumes, block, faces_only=True)
    box = voxels.groupBy("volume_id").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    outside = rooted.join(box, "volume_id").where(" OR ".join(f"{a} = l{a} OR {a} = h{a}" for a in "xyz")).select("volume_id", "root").distinct()
    return rooted.join(outside, ["volume_id", "root"], "left_anti")

