"""From labelled voxels to skeletons: one volume, batches of volumes, chunks of large volumes.

A batch is many volumes in one table, told apart by ``volume_id``; every step has it in its keys.  Components are traced in
groups of one component each, in parallel.  A component that is too large for one task is cut by chunking, as is any volume
whose options need whole volumes (holes, nested components, connectivity graphs)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from voxloom.functions.voxel import flat_index
from voxloom.kernels.trace import Skeleton, prepare, skeleton_of
from voxloom.kernels.volume import skeletonize_volume
from voxloom.operators.aggregates import box_stats
from voxloom.operators.components import component_table, connected_components, labelled, ranked
from voxloom.operators.distance import with_dbf
from voxloom.operators.filters import keep_ids
from voxloom.operators.grouped import box_of, grouped
from voxloom.operators.joins import assign_targets
from voxloom.operators.morphology import border_targets
from voxloom.operators.postprocess import postprocess, skeleton_rows, split
from voxloom.operators.setops import consolidated, merge_fragments
from voxloom.params import TeasarParams, check_anisotropy
from voxloom.plans.fixpoint import reliable, tasks_of
from voxloom.schemas import SKELETONS, TARGETS
from voxloom.sources.volumes import to_chunks

#: Voxels of a component that one task traces; larger ones should come in chunks.
MAX_GROUP_VOXELS = 1 << 26


def component_stats(voxels: DataFrame, volumes: DataFrame, dust_threshold: float = 0, object_ids=None) -> DataFrame:
    """(volume_id, cc, label, voxels, root, box) of the components above the dust threshold."""
    rows = reliable(voxels if object_ids is None else keep_ids(voxels, object_ids))
    with tasks_of(rows.sparkSession, rows.count()):
        # a component has one label; it is summed up under its root, and only then numbered
        found = labelled(rows, volumes).withColumnRenamed("root", "__root")
        stats = reliable(box_stats(found, "__root", F.min("label").alias("label")))
    kept = ranked(stats.drop("__root")).where(F.col("voxels") > dust_threshold)
    return kept.select("volume_id", "cc", *[f"{n}_{a}" for a in "xyz" for n in ("lo", "hi")], "voxels", "root", "label")


def _check_targets(targets: DataFrame | None) -> None:
    if targets is not None and set(targets.columns) != {c.split()[0] for c in TARGETS.split(", ")}:
        raise ValueError(f"targets need the columns {TARGETS}")


def _bounded(sizes: DataFrame, what: str) -> None:
    """Groups larger than a task may hold are an error before any is made; ``sizes`` has a column ``voxels``."""
    if not sizes.where(F.col("voxels") > MAX_GROUP_VOXELS).isEmpty():
        raise ValueError(f"a {what} is too large for one task; cut the volume into chunks")


def _by_volume(voxels: DataFrame, volumes: DataFrame, params: TeasarParams, dust: float, options: dict, targets: DataFrame | None) -> DataFrame:
    """Whole volumes as groups, for options whose steps depend on each other across components."""
    _bounded(volumes.select((F.col("sx") * F.col("sy") * F.col("sz")).alias("voxels")), "volume")
    rows = voxels.join(volumes, "volume_id")
    if targets is not None:
        lists = targets.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("kind", "ord", "x", "y", "z"))).alias("targets"))
        rows = rows.join(lists, "volume_id", "left")

    def kernel(c):
        at, _ = box_of(c)
        shape = tuple(int(c[f"s{a}"][0]) for a in "xyz")
        labels = np.zeros(shape, np.int64)
        labels[tuple(at.T)] = c["label"]
        bits = None
        if "graph_bits" in c:
            bits = np.zeros(shape, np.int64)
            bits[tuple(at.T)] = c["graph_bits"]
        wanted = c["targets"][0] if "targets" in c and c["targets"][0] is not None else []
        of = lambda kind: [(t["x"], t["y"], t["z"]) for t in wanted if t["kind"] == kind]
        found = skeletonize_volume(labels, params, tuple(float(c[f"a{a}"][0]) for a in "xyz"), dust, before=of("before"), after=of("after"), graph=bits, **options)
        return skeleton_rows([(label, i, s) for i, (label, s) in enumerate(found)])

    return grouped(rows, ["volume_id"], kernel, SKELETONS)


def _by_component(voxels: DataFrame, volumes: DataFrame, params: TeasarParams, dust: float, fix_branching: bool, fix_borders: bool, targets: DataFrame | None) -> DataFrame:
    found = reliable(connected_components(voxels, volumes))
    return traced_fields(found, None, volumes, params, dust, fix_branching, fix_borders, targets)


def traced_fields(found: DataFrame, measured: DataFrame | None, volumes: DataFrame, params: TeasarParams, dust: float, fix_branching: bool = True, fix_borders: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """Rows of ``SKELETONS``, one a component: ``found`` are voxels with their components, ``measured`` the same with their
    distances (computed here where there are none)."""
    table = reliable(component_table(found))
    _bounded(table, "component")
    kept = table.where((F.col("voxels") > dust) & (F.col("voxels") > 1)).select("volume_id", "cc", F.col("label").alias("name"))
    # a volume of one component without background has walls outside
    whole = table.groupBy("volume_id").agg(F.count("*").alias("n"), F.sum("voxels").alias("v")).join(volumes, "volume_id").where("n = 1 AND v = sx * sy * sz").select("volume_id")
    if measured is not None:
        pass
    elif whole.isEmpty():
        measured = with_dbf(found, volumes)
    else:
        measured = with_dbf(found.join(whole, "volume_id", "left_anti"), volumes).unionByName(with_dbf(found.join(whole, "volume_id", "left_semi"), volumes, True))
    fields = measured.join(kept, ["volume_id", "cc"])
    points = None
    if fix_borders:
        points = border_targets(found, volumes).select("volume_id", "cc", F.lit("border").alias("kind"), F.expr("ord.face * 1000000000000L + ord.first").alias("ord"), "x", "y", "z")
    if targets is not None:
        own = assign_targets(targets, found.drop("label").withColumnRenamed("cc", "label"), volumes).where("label IS NOT NULL").select("volume_id", F.col("label").alias("cc"), "kind", "ord", *[F.expr(f"{a}").alias(a) for a in "xyz"])
        points = own if points is None else points.unionByName(own)
    rows = fields.join(volumes.select("volume_id", "sx", "sy", "sz", "ax", "ay", "az"), "volume_id")
    if points is not None:
        lists = points.groupBy("volume_id", "cc").agg(F.sort_array(F.collect_list(F.struct("kind", "ord", "x", "y", "z"))).alias("targets"))
        rows = rows.join(lists, ["volume_id", "cc"], "left")

    def kernel(c):
        at, _ = box_of(c)
        w = tuple(float(c[f"a{a}"][0]) for a in "xyz")
        size = [int(c[f"s{a}"][0]) for a in "xyz"]
        wanted = c["targets"][0] if "targets" in c and c["targets"][0] is not None else []
        of = lambda kind: [tuple(int(t[a]) + (n if t[a] < 0 else 0) for a, n in zip("xyz", size)) for t in wanted if t["kind"] == kind]
        borders = of("border")
        root = borders.pop() if borders else None
        s = skeleton_of(at, c["dbf"].astype(np.float32), params, w, [*borders, *of("before")], of("after"), root, None, fix_branching)
        if not len(s.edges):
            return skeleton_rows([])
        return skeleton_rows([(int(c["name"][0]), int(c["cc"][0]), Skeleton((s.vertices.astype(np.float32) * np.asarray(w, np.float32)), s.edges, s.radii))])

    return grouped(rows, ["volume_id", "cc"], kernel, SKELETONS)


def skeletonize(
    voxels: DataFrame, volumes: DataFrame, teasar_params: dict | TeasarParams | None = None, dust_threshold: float = 1000, object_ids=None, fix_branching: bool = True,
    fix_borders: bool = True, fill_holes: bool = False, fix_avocados: bool = False, targets: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of one skeleton a label and volume, in physical units.

    ``voxels`` may have ``graph_bits``, a connectivity graph.  ``targets`` are rows (volume_id, kind, ord, x, y, z) with the
    kinds ``before`` and ``after``.  Components of one label share its skeleton."""
    params = TeasarParams.of(teasar_params)
    _check_targets(targets)
    rows = voxels if object_ids is None else keep_ids(voxels, object_ids)
    # a volume no larger than the dust threshold has nothing to trace
    rows = rows.join(volumes.where(F.col("sx") * F.col("sy") * F.col("sz") > dust_threshold).select("volume_id"), "volume_id", "left_semi")
    if fill_holes or fix_avocados or "graph_bits" in voxels.columns:
        options = {"fix_branching": fix_branching, "fix_borders": fix_borders, "fill_holes": fill_holes, "avocados": fix_avocados}
        found = _by_volume(rows, volumes, params, dust_threshold, options, targets)
    else:
        found = _by_component(rows, volumes, params, dust_threshold, fix_branching, fix_borders, targets)
    return united(found)


def united(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows of ``SKELETONS``: components of one label share its skeleton."""
    vertices, edges = split(reliable(found))
    number = lambda c: F.struct("part", F.col(c).alias("i")).alias(c)
    return consolidated(vertices.withColumn("vidx", number("vidx")).drop("part"), edges.withColumns({e: number(e) for e in ("e0", "e1")}).drop("part"))


def skeletonize_batch(samples: list[tuple[DataFrame, DataFrame]], teasar_params=None, **options) -> tuple[DataFrame, DataFrame]:
    """Several volumes at once; ``volume_id`` of the result is the sample's number."""
    tag = lambda df, i: df.withColumn("volume_id", F.lit(i).cast("long"))
    volumes, voxels = (reduce(DataFrame.unionByName, [tag(s[k], i) for i, s in enumerate(samples)]) for k in (0, 1))
    return skeletonize(voxels, volumes, teasar_params, **options)


def prepared(components: DataFrame, volumes: DataFrame, teasar_params=None) -> DataFrame:
    """(volume_id, cc, root, target, maximum, soma, valid): what tracing of each component (with dbf) starts from; root and
    target are indices."""
    params = TeasarParams.of(teasar_params)

    def kernel(c):
        at, _ = box_of(c)
        ready = prepare(at, c["dbf"].astype(np.float32), params, tuple(float(c[f"a{a}"][0]) for a in "xyz"))
        size = [int(c[f"s{a}"][0]) for a in "xyz"]
        index = lambda i: int(ready.voxels.coords[i][0] + size[0] * (ready.voxels.coords[i][1] + size[1] * ready.voxels.coords[i][2]))
        return {"root": [index(ready.root)], "target": [index(ready.target)], "maximum": [ready.maximum], "soma": [ready.soma], "valid": [len(ready.dbf)]}

    return grouped(components.join(volumes, "volume_id"), ["volume_id", "cc"], kernel, "volume_id long, cc long, root long, target long, maximum float, soma boolean, valid long")


def skeletonize_chunked(voxels: DataFrame, volumes: DataFrame, chunk_shape, teasar_params=None, dust: float = 0, tick: float = 0, dust_threshold: float = 0, anisotropy=None, **options) -> tuple[DataFrame, DataFrame]:
    """A large volume in overlapping chunks: each chunk is a volume of its own, its skeletons are moved to its origin, and
    fragments unite where chunks share a face (border targets put ends on the same voxel in both)."""
    if anisotropy is not None:
        volumes = volumes.withColumns({f"a{a}": F.lit(w) for a, w in zip("xyz", check_anisotropy(anisotropy))})
    cut = to_chunks(voxels, volumes, chunk_shape)
    size = volumes.select("volume_id", *[F.col(f"s{a}").alias(f"n{a}") for a in "xyz"], "ax", "ay", "az")
    origins = cut.select("volume_id", "ox", "oy", "oz").distinct()
    code = F.xxhash64("volume_id", "ox", "oy", "oz")
    plan = reliable(origins.join(size, "volume_id").select(code.alias("chunk"), "volume_id", "ox", "oy", "oz", *[F.least(F.lit(c), F.col(f"n{a}") - F.col(f"o{a}")).cast("long").alias(f"s{a}") for a, c in zip("xyz", chunk_shape)], "ax", "ay", "az"))
    chunks = plan.select(F.col("chunk").alias("volume_id"), "sx", "sy", "sz", "ax", "ay", "az")
    local = cut.withColumn("chunk", code).join(plan.select("chunk", "sx", "sy"), "chunk")
    for a in "xyz":
        local = local.withColumn(a, F.col(a) - F.col(f"o{a}"))
    local = local.select(F.col("chunk").alias("volume_id"), flat_index("x", "y", "z", "sx", "sy").alias("vid"), "x", "y", "z", "label")
    options = {"fix_borders": True} | options
    v, e = skeletonize(local, chunks, teasar_params, dust_threshold, **options)
    back = plan.select(F.col("chunk").alias("fragment"), F.col("volume_id").alias("whole"))
    home = lambda df: df.withColumnRenamed("volume_id", "fragment").join(back, "fragment").withColumnRenamed("whole", "volume_id")
    shift = plan.select(F.col("chunk").alias("fragment"), *[(F.col(f"o{a}") * F.col(f"a{a}")).cast("float").alias(f"o{a}") for a in "xyz"])
    merged = merge_fragments(home(v), home(e), shift)
    return postprocess(*merged, dust, tick) if dust or tick else merged
