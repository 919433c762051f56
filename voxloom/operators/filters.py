"""Filters and projections of voxels and skeleton graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.voxel import affine, step_array

#: Lists of ids up to this length become literals; longer ones are joined.
LITERAL_IDS = 1000


def checked_ids(ids: Iterable[int], low: int = -(1 << 63), high: int = (1 << 63) - 1) -> list[int]:
    """Sorted distinct ids; an id outside the type's range is an error."""
    out = sorted({int(i) for i in ids})
    if out and (out[0] < low or out[-1] > high):
        raise OverflowError("an id lies outside the range of the labels")
    return out


def keep_ids(voxels: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Voxels with one of the labels; other voxels become background, which isn't stored."""
    if isinstance(ids, DataFrame):
        return voxels.join(ids.select(F.col(ids.columns[0]).alias("label")), "label", "left_semi").select(*voxels.columns)
    ids = checked_ids(ids)
    if len(ids) <= LITERAL_IDS:
        return voxels.where(F.col("label").isin(ids))
    return keep_ids(voxels, voxels.sparkSession.createDataFrame([(i,) for i in ids], "label long"))


def any_foreground(voxels: DataFrame, ids: Iterable[int] | None = None) -> bool:
    """Whether a voxel is left after choosing ids; stops at the first."""
    return not (voxels if ids is None else keep_ids(voxels, ids)).where("label <> 0").isEmpty()


def binarised(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("label", (F.col("label") != 0).cast("long"))


def above_dust(stats: DataFrame, dust: float) -> DataFrame:
    """Components with more voxels than the threshold."""
    return stats.where(F.col("voxels") > dust)


def select_vertices(vertices: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The vertices that ``keep`` holds for, numbered anew, and the edges with both ends among them."""
    keys = ["volume_id", "label"]
    order = Window.partitionBy(*keys).orderBy("vidx")
    kept = vertices.where(keep).withColumn("new", (F.row_number().over(order) - 1).cast("long"))
    number = kept.select(*keys, "vidx", "new")
    ends = edges.select(*keys, "e0", "e1")
    for e in ("e0", "e1"):
        ends = ends.join(number.withColumnsRenamed({"vidx": e, "new": f"{e}_new"}), [*keys, e])
    return kept.drop("vidx").withColumnRenamed("new", "vidx").select(*vertices.columns), ends.select(*keys, F.col("e0_new").alias("e0"), F.col("e1_new").alias("e1"))


def prune_unused(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without vertices that no edge touches."""
    keys = ["volume_id", "label"]
    used = edges.select(*keys, F.explode(F.array("e0", "e1")).alias("vidx")).distinct().withColumn("__used", F.lit(True))
    marked = vertices.join(used, [*keys, "vidx"], "left").withColumn("__used", F.coalesce("__used", F.lit(False)))
    kept, links = select_vertices(marked, edges, F.col("__used"))
    return kept.select(*vertices.columns), links


def crop(vertices: DataFrame, edges: DataFrame, low, high) -> tuple[DataFrame, DataFrame]:
    """The part of skeletons inside a closed box; a box without volume crops nothing."""
    if not all(a < b for a, b in zip(low, high)):
        return vertices, edges
    inside = F.lit(True)
    for axis, a, b in zip("xyz", low, high):
        inside &= F.col(axis).between(a, b)
    return select_vertices(vertices, edges, inside)


def dense_renumber(voxels: DataFrame) -> DataFrame:
    """Labels as 1, 2, ... in the order of their first voxels."""
    first = voxels.groupBy("volume_id", "label").agg(F.min("vid").alias("first"))
    number = first.withColumn("new_label", F.dense_rank().over(Window.partitionBy("volume_id").orderBy("first")).cast("long"))
    return voxels.join(number.select("volume_id", "label", "new_label"), ["volume_id", "label"])


def faces(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, face, u, v, label): the six boundary planes; faces -x +x -y +y -z +z, with the other axes in the order
    (x, y), (x, z), (y, z)."""
    rows = voxels.join(volumes.select("volume_id", "sx", "sy", "sz"), "volume_id")
    plane = lambda n, at, u, v: F.when(at, F.struct(F.lit(n).cast("long").alias("face"), F.col(u).alias("u"), F.col(v).alias("v")))
    options = F.array(
        plane(0, F.col("z") == 0, "x", "y"), plane(1, F.col("z") == F.col("sz") - 1, "x", "y"), plane(2, F.col("y") == 0, "x", "z"),
        plane(3, F.col("y") == F.col("sy") - 1, "x", "z"), plane(4, F.col("x") == 0, "y", "z"), plane(5, F.col("x") == F.col("sx") - 1, "y", "z"),
    )
    others = [c for c in voxels.columns if c not in ("x", "y", "z")]
    return rows.select(*others, F.explode(F.filter(options, lambda p: p.isNotNull())).alias("p")).select(*others, "p.*")


def with_steps(voxels: DataFrame, volumes: DataFrame, bits: str | None = None) -> DataFrame:
    """Each voxel with the steps that stay inside the volume: k, bit, and nx, ny, nz, nvid of where they lead; a column of
    connectivity bits removes steps."""
    rows = voxels.join(volumes.select("volume_id", "sx", "sy", "sz"), "volume_id")
    rows = rows.select("*", F.inline(step_array()))
    for a in "xyz":
        rows = rows.withColumn(f"n{a}", F.col(a) + F.col(f"d{a}")).where(f"n{a} >= 0 AND n{a} < s{a}")
    if bits:
        rows = rows.where(F.expr(f"(shiftright({bits}, cast(bit AS int)) & 1) = 1"))
    return rows.withColumn("nvid", F.expr("nx + sx * (ny + sy * nz)"))


def transformed(vertices: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Vertices under a 3 x 4 matrix."""
    return vertices.withColumns(dict(zip("xyz", affine("x", "y", "z", matrix))))


def physical_origins(chunks: DataFrame, anisotropy) -> DataFrame:
    return chunks.withColumns({f"p{a}": F.col(f"{a}0") * F.lit(float(w)) for a, w in zip("xyz", anisotropy)})
