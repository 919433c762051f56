"""Unions of skeletons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def consolidated(vertices: DataFrame, edges: DataFrame, order: str = "vidx") -> tuple[DataFrame, DataFrame]:
    """Equal vertices of a label become one, with the radius of the first by ``order``; edges are made unique and point
    upward, loops and vertices without edges go; vertices are numbered by (x, y, z)."""
    keys = ["volume_id", "label"]
    place = [*keys, "x", "y", "z"]
    point = vertices.groupBy(*place).agg(F.min_by("radius", order).alias("radius"))
    ends = edges
    where = vertices.select(*keys, "vidx", F.struct("x", "y", "z").alias("p"))
    for e in ("e0", "e1"):
        ends = ends.join(where.withColumnsRenamed({"vidx": e, "p": f"p{e[1]}"}), [*keys, e])
    links = ends.where("p0 <> p1").select(*keys, F.least("p0", "p1").alias("p0"), F.greatest("p0", "p1").alias("p1")).distinct()
    used = links.select(*keys, F.explode(F.array("p0", "p1")).alias("p")).distinct().select(*keys, "p.*")
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y", "z")) - 1).cast("long")
    kept = point.join(used, place, "left_semi").withColumn("vidx", number)
    names = kept.select(*keys, F.struct("x", "y", "z").alias("p"), "vidx")
    for i in (0, 1):
        links = links.join(names.withColumnsRenamed({"p": f"p{i}", "vidx": f"e{i}"}), [*keys, f"p{i}"])
    return kept.select(*keys, "vidx", "x", "y", "z", "radius"), links.select(*keys, "e0", "e1")


def moved(vertices: DataFrame, origins: DataFrame) -> DataFrame:
    """Vertices of fragments shifted to their origins (fragment, ox, oy, oz)."""
    rows = vertices.join(origins, "fragment")
    return rows.withColumns({a: F.col(a) + F.col(f"o{a}").cast(dict(vertices.dtypes)[a]) for a in "xyz"}).drop("ox", "oy", "oz")


def merge_fragments(vertices: DataFrame, edges: DataFrame, origins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fragments (column ``fragment``) of each label as one skeleton: shifted, united where vertices coincide (the first
    fragment gives the radius), edges unique.  One shuffle by label and place for vertices, two for edges."""
    rows = vertices if origins is None else moved(vertices, origins)
    number = F.struct("fragment", "vidx")
    return consolidated(rows.withColumn("vidx", number), edges.withColumns({e: F.struct("fragment", F.col(e).alias("vidx")) for e in ("e0", "e1")}))


def fused(vertices: DataFrame, edges: DataFrame, low, high, origins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fragments cut to a closed box and merged; where the fragments have origins, the box is in the whole's place."""
    rows = vertices if origins is None else moved(vertices, origins)
    inside = reduce(lambda x, y: x & y, [F.col(a).between(p, q) for a, p, q in zip("xyz", low, high)])
    names = rows.where(inside).select("fragment", "volume_id", "label", "vidx")
    for e in ("e0", "e1"):
        edges = edges.join(names.withColumnRenamed("vidx", e), ["fragment", "volume_id", "label", e], "left_semi")
    return merge_fragments(rows.where(inside), edges)


def in_space(vertices: DataFrame, volumes: DataFrame, space: str) -> DataFrame:
    """Vertices in units of voxels (``voxel``) taken to physical units (``physical``), or back."""
    if space not in ("voxel", "physical"):
        raise ValueError("a space is voxel or physical")
    # a row a volume; where volume_id is a constant, the join would otherwise pair all partitions
    rows = vertices.join(F.broadcast(volumes.select("volume_id", "ax", "ay", "az")), "volume_id")
    scale = lambda a: F.col(a) * F.col(f"a{a}") if space == "physical" else F.col(a) / F.col(f"a{a}")
    return rows.withColumns({a: scale(a).cast("float") for a in "xyz"}).select(*vertices.columns)


def combined(batches: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Skeletons of several batches side by side, with the batch's number as volume; equal labels stay apart."""
    tag = lambda df, i: df.withColumn("volume_id", F.lit(i).cast("long"))
    return tuple(reduce(DataFrame.unionByName, [tag(b[k], i) for i, b in enumerate(batches)]) for k in (0, 1))


def same_label(parts: DataFrame) -> DataFrame:
    """Components of one original label in one skeleton: ``part`` becomes part of the vertex's number, by order."""
    keys = ["volume_id", "label"]
    order = Window.partitionBy(*keys).orderBy("part", "vidx")
    return parts.withColumn("vidx", (F.row_number().over(order) - 1).cast("long")).drop("part")


def candidates(found: DataFrame, settled: DataFrame) -> DataFrame:
    """Labels found but not settled."""
    return found.exceptAll(settled) if found.columns == settled.columns else found.join(settled, found.columns, "left_anti")
